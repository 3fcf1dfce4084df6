"""Losses and quality measures of predictions and ratings.

Predictions are frames with `p`, the chance given to what happened (the actual winner's). Null chances are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.operators.summary import competition_rank
from podium.runtime import broadcast_if_small, dropped, written

PRIOR = 0.05
SCHEMES = ("none", "entropy", "entropy_sqrt", "entropy_squared", "var_inv", "entropy_exp", "threshold")


def predicted(matches: DataFrame, ratings: DataFrame, alpha: float = 1.0, how: str = "bradley_terry", prior: float = PRIOR) -> DataFrame:
    """Matches with `p`, the chance of the actual winner; unrated sides have the prior rating."""
    m = matches
    for s in ("winner", "loser"):
        m = m.join(ratings.select(F.col("id").alias(f"{s}_team_id"), F.col("rating").alias(f"{s}_rating")), f"{s}_team_id", "left")
    a, b = F.coalesce("winner_rating", F.lit(prior)), F.coalesce("loser_rating", F.lit(prior))
    ways = {"bradley_terry": scalar.bradley_terry(a, b, alpha), "logistic": scalar.logistic(a, b, alpha), "identity": a / (a + b)}
    return m.withColumn("p", ways[how])


def loss(p: Column) -> Column:
    """-ln p of what happened, with p kept off 0 and 1."""
    return -F.log(scalar.clipped(p, 1e-15, 1 - 1e-15))


def confidence_weight(p: Column, scheme: str, threshold: float = 0.1, base: float = 2.0) -> Column:
    """Weight of a prediction in a loss: by its distance from one half (named entropy schemes run upwards with it)."""
    p = scalar.clipped(p, 1e-15, 1 - 1e-15)
    far = F.abs(p - 0.5) * 2
    return {
        "none": F.lit(1.0), "entropy": far, "entropy_sqrt": F.sqrt(far), "entropy_squared": far * far, "var_inv": 1 / (p * (1 - p)),
        "entropy_exp": F.pow(F.lit(base), far), "threshold": F.when(F.abs(p - 0.5) > threshold, 1.0).otherwise(0.1),
    }[scheme]


def uncertainty_weight(p: Column, scheme: str, threshold: float = 0.1, base: float = 2.0) -> Column:
    """The other family: by Shannon entropy in bits, which falls with the distance from one half."""
    h = (-p * F.log(p + 1e-10) - (1 - p) * F.log(1 - p + 1e-10)) / math.log(2)
    return {
        "none": F.lit(1.0), "entropy": h, "entropy_sqrt": F.sqrt(h), "entropy_squared": h * h, "var_inv": 1 / (p * (1 - p) + 1e-10),
        "entropy_exp": F.pow(F.lit(base), h), "threshold": (F.abs(p - 0.5) >= threshold).cast("double"),
    }[scheme]


def weighted_losses(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per group: matches, accuracy, Brier score, mean loss and the loss under every scheme."""
    p, x = F.col("p"), loss(F.col("p"))
    sums = [F.try_divide(F.sum(confidence_weight(p, s) * x), F.sum(confidence_weight(p, s))).alias(f"loss_{s}") for s in SCHEMES]
    g = pred.where("p is not null").groupBy(*by)
    return g.agg(F.count(F.lit(1)).alias("matches"), F.avg((p > 0.5).cast("double")).alias("accuracy"), F.avg((1 - p) * (1 - p)).alias("brier"), F.avg(p).alias("mean_p"), *sums)


def buckets(pred: DataFrame, n: int = 5) -> DataFrame:
    """Loss by confidence: n left-closed buckets of max(p, 1 - p) over [0.5, 1], the last closed."""
    b = F.least(F.floor((F.greatest(F.col("p"), 1 - F.col("p")) - 0.5) * 2 * n), F.lit(n - 1)).cast("long")
    return pred.where("p is not null").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("matches"), F.avg(loss(F.col("p"))).alias("mean_loss"))


def reliability(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """(bucket, matches, expected, observed, gap) of chances `p` and outcomes `won`, empty buckets too."""
    b = F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("long")
    g = outcomes.where("p is not null and won is not null").groupBy(b.alias("bucket"))
    g = g.agg(F.count(F.lit(1)).alias("matches"), F.avg("p").alias("expected"), F.avg(F.col("won").cast("double")).alias("observed"))
    all_ = outcomes.sparkSession.range(n).withColumnRenamed("id", "bucket").join(g, "bucket", "left").na.fill(0, ["matches"])
    return all_.withColumn("gap", F.abs(F.col("expected") - F.col("observed")))


def ece(rel: DataFrame) -> DataFrame:
    """Expected calibration error: gaps weighted by matches."""
    return rel.agg(F.try_divide(F.sum(F.col("gap") * F.col("matches")), F.sum("matches")).alias("ece"))


def both_ways(pred: DataFrame) -> DataFrame:
    """Every match from its lower-numbered team's side, as chance and outcome."""
    low = F.col("winner_team_id") < F.col("loser_team_id")
    return pred.withColumn("won", low.cast("int")).withColumn("p", F.when(low, F.col("p")).otherwise(1 - F.col("p")))


def concordance(pred: DataFrame, by: list[str]) -> DataFrame:
    """Share of matches that the better-rated side won; equal ratings count half."""
    d = F.col("winner_rating") - F.col("loser_rating")
    c = F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)
    return pred.where("winner_rating is not null and loser_rating is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("matches"), F.avg(c).alias("concordance"))


def upsets(pred: DataFrame) -> DataFrame:
    """Upsets observed and expected in five fixed ranges of the favourite's chance."""
    f = F.greatest(F.col("p"), 1 - F.col("p"))
    b = scalar.cut(f, [0.6, 0.7, 0.8, 0.9], ["50-60", "60-70", "70-80", "80-90", "90-100"])
    g = pred.where("p is not null").groupBy(b.alias("favourite")).agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("p") < 0.5).alias("upsets"), F.sum(1 - f).alias("expected"))
    return g.withColumn("ratio", F.try_divide("upsets", "expected"))


def alpha_losses(matches: DataFrame, ratings: DataFrame, grid: list[float]) -> DataFrame:
    """Mean loss of every exponent of a grid in one pass, for fitting by maximum likelihood."""
    return _alpha_losses(predicted(matches, ratings), grid)


def _alpha_losses(pred: DataFrame, grid: list[float]) -> DataFrame:
    gap = F.log(F.greatest(F.coalesce("winner_rating", F.lit(PRIOR)), F.lit(1e-12))) - F.log(F.greatest(F.coalesce("loser_rating", F.lit(PRIOR)), F.lit(1e-12)))
    sums = pred.agg(*[F.avg(loss(1 / (1 + F.exp(-a * gap)))).alias(f"a{i}") for i, a in enumerate(grid)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("loss")) for i, a in enumerate(grid)])))


def fitted_alpha(matches: DataFrame, ratings: DataFrame, low: float = 0.05, high: float = 5.0, rounds: int = 4, points: int = 9) -> float:
    """The exponent of least loss, by grids that close in around the best point; a pass over the matches, rated once, per grid."""
    pred = written(predicted(matches, ratings).select("winner_rating", "loser_rating"), "rated")
    for _ in range(rounds):
        grid = np.linspace(low, high, points).tolist()
        got = {r["alpha"]: r["loss"] for r in _alpha_losses(pred, grid).collect()}
        best = min(range(points), key=lambda i: (got[grid[i]], i)) if None not in got.values() else 0
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    dropped(pred)
    return (low + high) / 2


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of competition ranks averaged over ties."""
    for c in (a, b):
        df = competition_rank(df, c, f"__{c}", mean=True)
    return df.agg(F.corr(f"__{a}", f"__{b}").alias("spearman"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Rank-sum area under the curve; equal scores count half."""
    d = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(F.col(score).alias("s"), F.col(positive).cast("int").alias("y"))
    # One row per distinct score, cumulated by ranges.
    g = written(d.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "auc")
    mid = competition_rank(d, "s", "mid", mean=True)
    total, pos = g.agg(F.sum(F.col("pos") + F.col("neg")), F.sum("pos")).first()
    if not pos or total == pos:
        return d.sparkSession.createDataFrame([(None, int(total or 0))], "auc double, n long")
    # Ranks run from the best score, so the positives' sum is turned round.
    up = F.sum(F.when(F.col("y") == 1, F.lit(total + 1) - F.col("mid")))
    return mid.agg(((up - pos * (pos + 1) / 2) / (pos * (total - pos))).alias("auc"), F.count(F.lit(1)).alias("n"))


def folds(matches: DataFrame, n: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Temporal folds: tournaments in the order of their last match in n + 1 parts; each part is tested on all before it."""
    t = written(matches.groupBy("tournament_id").agg(F.max("ts").alias("last")), "folds")
    cuts = t.agg(F.percentile("last", [i / (n + 1) for i in range(1, n + 1)])).first()[0]
    m = matches.join(t, "tournament_id")
    out = []
    for i, c in enumerate(cuts or []):
        end = cuts[i + 1] if i + 1 < len(cuts) else math.inf
        out.append((m.where(F.col("last") <= c).drop("last"), m.where((F.col("last") > c) & (F.col("last") <= F.lit(float(end)))).drop("last")))
    return out


def sequential_holdout(matches: DataFrame, rate: Callable[[DataFrame], DataFrame], least: int = 10, splits: int | None = None, fit: bool = True, prior: float = PRIOR) -> DataFrame:
    """One row per tournament held out: matches, loss, mean chance, exponent and size of the training set.

    Tournaments in the order of their first match; each is predicted from ratings (`rate`: matches -> (id, rating)) of all
    that began before it, from the `least`-th on. `splits` spaces that many tournaments evenly over them, the last one
    among them; None holds out every one.
    """
    t = matches.where("ts is not null").groupBy("tournament_id").agg(F.min("ts").alias("start"))
    order = [r[0] for r in t.orderBy("start", "tournament_id").collect()]  # one row per tournament
    if len(order) <= least:
        raise ValueError(f"more than {least} tournaments are needed, there are {len(order)}")
    at = list(range(least, len(order)))
    if splits is not None and splits < len(at):
        at = [at[-1]] if splits == 1 else sorted({at[round(i)] for i in np.linspace(0, len(at) - 1, splits)})
    place = matches.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], "tournament_id long, __at int")
    m = written(matches.join(broadcast_if_small(place), "tournament_id"), "holdout")
    out = None
    for i in at:
        train = m.where(F.col("__at") < i).drop("__at")
        ratings = written(rate(train), "ratings")
        alpha = fitted_alpha(train, ratings) if fit else 1.0
        p = predicted(m.where(F.col("__at") == i), ratings, alpha, prior=prior)
        row = p.agg(F.lit(order[i]).cast("long").alias("tournament_id"), F.count(F.lit(1)).alias("matches"), F.avg(loss(F.col("p"))).alias("loss"), F.avg("p").alias("mean_p"), F.lit(alpha).alias("alpha"), F.lit(train.count()).alias("train_size"))
        out = row if out is None else out.unionByName(row)
    return out


def uncertainty_losses(pred: DataFrame, by: list[str]) -> DataFrame:
    """Per group the loss under every scheme of the entropy-based weights."""
    p, x = F.col("p"), loss(F.col("p"))
    sums = [F.try_divide(F.sum(uncertainty_weight(p, s) * x), F.sum(uncertainty_weight(p, s))).alias(f"loss_{s}") for s in SCHEMES]
    return pred.where("p is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("matches"), *sums)


def sampled(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows that follow from their keys' hash alone, or all if there are fewer."""
    return df.withColumn("__h", F.xxhash64(*keys, F.lit(seed))).orderBy("__h", *keys).limit(n).drop("__h")


def grid_search(objective: Callable[[dict], float], grid: dict[str, list]) -> tuple[dict, list[tuple[dict, float]]]:
    """The settings of least objective over the product of a grid, and all that were tried; the first of equal ones counts."""
    tried = [(x, objective(x)) for x in (dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values()))]
    return min(tried, key=lambda t: t[1])[0], tried


def random_search(objective: Callable[[dict], float], ranges: dict[str, tuple[float, float]], n: int = 20, seed: int = 42) -> tuple[dict, list[tuple[dict, float]]]:
    """The same over n settings drawn evenly from ranges, by the logarithm where both ends are positive and far apart."""
    g = np.random.default_rng(seed)
    draw = lambda lo, hi: float(np.exp(g.uniform(np.log(lo), np.log(hi)))) if lo > 0 and hi / lo > 10 else float(g.uniform(lo, hi))
    tried = [(x, objective(x)) for x in ({k: draw(*r) for k, r in ranges.items()} for _ in range(n))]
    return min(tried, key=lambda t: t[1])[0], tried


def gini(df: DataFrame, value: str) -> DataFrame:
    """Inequality of non-negative values."""
    # Equal values may share any order within the tie: the mean of their places.
    n = written(competition_rank(df.where(F.col(value).isNotNull()), value, "r", mean=True), "gini")
    count, total = n.agg(F.count(F.lit(1)), F.sum(value)).first()
    if not total:
        return df.sparkSession.createDataFrame([(0.0, count)], "gini double, n long")
    up = F.lit(count + 1.0) - F.col("r")
    return n.agg((F.sum((2 * up - count - 1) * F.col(value)) / (count * total)).alias("gini"), F.count(F.lit(1)).alias("n"))


def edge_dropout(edges: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Edges without a reproducible share of them, chosen by a number from their ends so that partitions don't matter."""
    return edges.where(edge_number(F.col("loser"), F.col("winner"), seed) >= fraction * 1_000_003)


def edge_number(a: Column, b: Column, seed: int) -> Column:
    """A number below 1,000,003 that follows from the ends alone, by the same arithmetic in any engine."""
    low = lambda c: F.pmod(c, F.lit(1 << 20))
    return F.pmod(low(a) * F.lit(1103515245) + low(b) * F.lit(12820163) + F.lit(7654321 * seed), F.lit(1_000_003))


def bootstrap(df: DataFrame, value: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Mean with a 95 % interval by Poisson bootstrap: every row draws its copies per replicate from its own hash.

    A batch draws its rows' copies as a matrix and a task gives one pair of sums per replicate, so rows aren't multiplied.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(*df.columns).alias("row"), F.col(value).cast("double").alias("v"))
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])
    rep = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = part.column(0).to_numpy().astype(np.uint64)[:, None] ^ rep[None, :]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
                k = np.searchsorted(cdf, u, side="right")
                n += k.sum(0)
                total += part.column(1).to_numpy() @ k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(n), pa.array(total)], names=["rep", "n", "total"])

    sums = rows.mapInArrow(draw, "rep long, n double, total double").groupBy("rep").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
    mean = rows.agg(F.avg("v")).first()[0]
    return sums.agg(F.lit(mean).cast("double").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
