"""How far a rating can be trusted, from whom a player met, and beat, and lost to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, written

# Uncertainty of a place by number of matches (below 10, 50, 200, and from there on).
UNCERTAINTY = ((10, 0.30), (50, 0.14), (200, 0.07), (None, 0.05))
# Weights and bounds of the one-sided measures.
UPWARD = {"quality": 0.5, "quantity": 0.2, "top": 0.3, "many": 20, "top_wins": 3}
DOWNWARD = {"quality": 0.7, "quantity": 0.3, "many": 10, "only_top": 0.2, "none": 0.5}
TIERS = (("high", 0.8), ("medium", 0.6), ("low", 0.4))


def with_uncertainty(confidence: DataFrame, ranks: DataFrame | None = None, alpha: float = 0.85) -> DataFrame:
    """Confidence rows with `information_bits` (one per effective comparison, up to the logarithm of the number of players),
    `rank_uncertainty` and `percentile_uncertainty`.

    A player's place is unsure by its number of matches, more so if few of all players were met, and by how much of a
    rating gets lost on the way to the others. `ranks` holds (player_id, rank); without a rank half of all places count.
    """
    c = written(confidence, "confidence")
    players = max(1, c.count())
    if ranks is not None:
        c = c.join(ranks.select("player_id", F.col("rank").alias("__rank")), "player_id", "left")
    else:
        c = c.withColumn("__rank", F.lit(None).cast("long"))
    m, o = F.col("matches"), F.col("opponents")
    effective = m * F.least(o / F.greatest(m, F.lit(1)), F.lit(1.0))
    bits = F.least(effective, F.lit(math.log2(players)))
    base = F.lit(UNCERTAINTY[-1][1])
    for most, x in reversed(UNCERTAINTY[:-1]):
        base = F.when(m < most, x).otherwise(base)
    factor = 2 - F.least(F.col("connectivity") / 5.0, F.lit(1.0))
    path = 1 - F.pow(F.lit(alpha), math.log(players) / F.log(F.greatest(o, F.lit(2)).cast("double")))
    total = F.least(base * factor + path, F.lit(1.0))
    place = F.coalesce(F.floor(F.col("__rank") * total), F.floor(players * total / 2)).cast("long")
    return c.withColumns({"information_bits": bits, "rank_uncertainty": place, "percentile_uncertainty": total * 50}).drop("__rank")


def asymmetric(compacted: DataFrame, ranks: DataFrame, top: float = 0.1, quality_weight: float = 2.0, boost: float = 3.0) -> DataFrame:
    """One row per player of the matches: the quality of those beaten and beaten by, upward mobility, downward pressure,
    overall confidence, tier and rankability.

    `ranks` holds (player_id, rank), 1 the best; a player's percentile is 1 - (rank - 1) / players, the first `top` of
    them are top players, and opponents without a rank count by number only. Pairs are summed as they arise.
    """
    n = max(1, ranks.count())
    r = broadcast_if_small(written(ranks.select(F.col("player_id").alias("opp"), (1 - (F.col("rank") - 1) / n).alias("pct"), (F.col("rank") <= int(n * top)).alias("top")), "ranks"))
    pair = compacted.select("match_id", "tournament_id", F.explode("winners").alias("w"), "losers").select("match_id", "tournament_id", "w", F.explode("losers").alias("l"))
    sides = F.array(F.struct(F.col("w").alias("id"), F.col("l").alias("opp"), F.lit(True).alias("won")), F.struct(F.col("l").alias("id"), F.col("w").alias("opp"), F.lit(False).alias("won")))
    pair = pair.select("match_id", "tournament_id", F.inline(sides))
    # Each opponent once with how often it was met, which halves the figures below; then its rank.
    met = pair.groupBy("id", "opp").agg(F.count_if("won").alias("beaten"), F.count_if(~F.col("won")).alias("lost")).join(r, "opp", "left")
    b, l, t = F.col("beaten"), F.col("lost"), F.coalesce("top", F.lit(False)).cast("int")
    ranked_b, ranked_l = (F.sum(F.when(F.col("pct").isNotNull(), x)) for x in (b, l))
    g = met.groupBy("id").agg(
        F.count(F.lit(1)).alias("unique_opponents"), F.sum(t).alias("top_opponents_faced"), F.sum(b * t).alias("top_players_beaten"), F.sum(l * t).alias("beaten_by_top"), F.sum(b).alias("__b"), F.sum(l).alias("__l"),
        F.coalesce(F.try_divide(F.sum(b * F.col("pct")), ranked_b), F.lit(0.0)).alias("outgoing_quality"), F.coalesce(F.try_divide(F.sum(l * F.col("pct")), ranked_l), F.lit(0.0)).alias("incoming_quality"),
        F.count_if(b > 0).alias("outgoing_edges"), F.count_if(l > 0).alias("incoming_edges"),
    )
    per = compacted.select("match_id", "tournament_id", F.explode(F.array_union("winners", "losers")).alias("id")).groupBy("id", "tournament_id").agg(F.count(F.lit(1)).alias("k"))
    g = g.join(per.groupBy("id").agg(F.count(F.lit(1)).alias("tournaments"), F.sum("k").alias("matches")), "id")
    nb, nl, top_b = F.col("__b"), F.col("__l"), F.col("top_players_beaten")
    up = UPWARD["quality"] * F.pow("outgoing_quality", F.lit(1 / quality_weight)) + UPWARD["quantity"] * F.least(nb / UPWARD["many"], F.lit(1.0)) + UPWARD["top"] * F.least(top_b / UPWARD["top_wins"], F.lit(1.0))
    g = g.withColumn("upward_mobility", F.when(nb > 0, up).otherwise(0.0))
    down = DOWNWARD["quality"] * (1 - F.col("incoming_quality")) + DOWNWARD["quantity"] * F.least(nl / DOWNWARD["many"], F.lit(1.0))
    g = g.withColumn("downward_pressure", F.when(nl == 0, DOWNWARD["none"]).when(F.col("beaten_by_top") == nl, DOWNWARD["only_top"]).otherwise(down))
    winner = (F.col("tournaments") <= 3) & (top_b >= 3) & (F.col("outgoing_quality") > 0.5)
    overall = F.least(F.abs(F.col("upward_mobility") - 0.5) + F.abs(0.5 - F.col("downward_pressure")), F.lit(1.0))
    g = g.withColumn("tournament_winner", winner).withColumn("overall_confidence", F.when(winner, F.least(overall * boost, F.lit(1.0))).otherwise(overall))
    tier = F.when(F.col("tournament_winner"), "high")
    for name, least in TIERS:
        tier = tier.when(F.col("overall_confidence") >= least, name)
    g = g.withColumn("tier", tier.otherwise("provisional"))
    rankable = F.when(F.col("tier") != "provisional", F.col("tier")).when(F.col("unique_opponents") < 10, "unrankable").otherwise("low")
    return g.withColumn("rankability", rankable).drop("__b", "__l").withColumnRenamed("id", "player_id")


def special_cases(measures: DataFrame) -> DataFrame:
    """(player_id, category): the first of five categories that a player's one-sided measures fit; others have no row."""
    up, m, faced = F.col("upward_mobility"), F.col("matches"), F.col("top_opponents_faced")
    isolated = (faced == 0) | ((faced < 3) & (m > 20))
    c = (
        F.when(F.col("tournament_winner"), "tournament_winners")
        .when((up > 0.8) & (m < 20), "giant_killers")
        .when((up > 0.4) & (up < 0.7) & (m > 50) & (faced > 10), "gatekeepers")
        .when(isolated & (m > 30), "isolated_active")
        .when((m < 10) & (F.col("outgoing_quality") > 0.7), "provisional_strong")
    )
    return measures.select("player_id", c.alias("category")).where("category is not null")


def joined(rankings: DataFrame, confidence: DataFrame) -> DataFrame:
    """Rankings with the columns of a confidence frame; players without one have 0, and are provisional."""
    j = rankings.join(confidence, "player_id", "left")
    numeric = [f.name for f in confidence.schema if f.name != "player_id" and f.dataType.typeName() in ("integer", "long", "double")]
    return j.na.fill(0, numeric).na.fill("provisional", [c for c in ("tier",) if c in confidence.columns])
