"""The N highest-scoring items of every group, by simultaneous bisection of all groups' cutoffs.

Every (score, identifier) pair has a code that keeps the order (its place among all distinct pairs, equal scores by
the smaller identifier first), so a cutoff is one number and no two items tie. Each round splits every open group's
interval into `fan` parts, counts its rows per part (counts add up on the map side, so a group of any size is spread),
accepts the parts above the cutoff, and keeps only the part that holds it; a group closes when exactly N are accepted.

Defined results: null or NaN scores and null groups or items are left out; repeated (group, item) rows count once with
the highest score; groups with fewer than N items give all; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, ranked, written


def coded(items: DataFrame, item: str, score: str) -> DataFrame:
    """(item, score, code): code 0 is the best; NaN and null scores are left out, an item's highest score counts."""
    s = items.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(item).isNotNull())
    best = s.groupBy(F.col(item).alias("item")).agg(F.max(score).alias("score"))
    return ranked(best, [F.desc("score"), F.asc("item")], "code")


def bisect(pairs: DataFrame, n: int, codes: int, fan: int = 32) -> DataFrame:
    """Of distinct (grp, code, ...) rows with codes in [0, codes), each group's n lowest codes."""
    keep = pairs.columns
    active = pairs.withColumns({"lo": F.lit(0).cast("long"), "width": F.lit(max(1, codes)).cast("long"), "need": F.lit(n).cast("long")})
    taken = []
    while True:
        # Part of the open interval [lo, lo + width) that the row is in, and the parts' size.
        step = F.ceil(F.col("width") / fan).cast("long")
        rows = active.withColumn("step", step).withColumn("part", F.floor((F.col("code") - F.col("lo")) / F.col("step")).cast("long"))
        counts = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        w = Window.partitionBy("grp").orderBy("part")
        run = counts.withColumn("upto", F.sum("c").over(w))
        # The first part that reaches what is needed, and how many come before it.
        cut = run.where("upto >= need").groupBy("grp").agg(F.min_by(F.struct("part", "c", (F.col("upto") - F.col("c")).alias("before")), "part").alias("s"))
        cut = broadcast_if_small(written(cut.select("grp", F.col("s.part").alias("cut"), F.col("s.c").alias("c"), F.col("s.before").alias("before")), "cuts"))
        j = rows.join(cut, "grp", "left")
        rest = F.col("need") - F.col("before")
        accept = F.col("cut").isNull() | (F.col("part") < F.col("cut")) | ((F.col("part") == F.col("cut")) & (F.col("c") == rest))
        j = j.withColumn("accept", accept).where(F.col("accept") | (F.col("part") == F.col("cut")))
        j = written(
            j.select(*keep, (F.col("lo") + F.col("part") * F.col("step")).alias("lo"), F.col("step").alias("width"), rest.alias("need"), "accept"), "bisected"
        )
        taken.append(j.where("accept").select(*keep))
        active = j.where("not accept").drop("accept")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def top_n(members: DataFrame, scores: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, position): the n best-scored items among each group's members, position from 1.

    `members` holds (group, item) rows, `scores` (item, score) rows. Members without a score are dropped before the
    shuffle that makes the pairs distinct.
    """
    codes = coded(scores, item, score)
    pairs = members.select(F.col(group).alias("grp"), F.col(item).alias("item")).dropna()
    pairs = pairs.join(broadcast_if_small(codes.select("item", "code")), "item").groupBy("grp", "code").agg(F.first("item").alias("item"))
    best = bisect(pairs, n, codes.count())
    w = Window.partitionBy("grp").orderBy("code")  # at most n rows a group
    out = best.join(broadcast_if_small(codes.select("code", "score")), "code").withColumn("position", F.row_number().over(w))
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "position")
