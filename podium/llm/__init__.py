"""Operators for training data; nothing outside imports them."""
