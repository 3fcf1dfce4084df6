"""Items in containers of fixed capacity with little room left, by bulk-synchronous best fit.

Rounds over frames: the items that are left and the gaps of the containers are range-sorted together by falling size, gaps
before items of the same size. One sweep through that order gives every item its successor gap, the smallest open one that
holds it, larger items first: gaps open like brackets, and each item closes the latest one that is still open. Every range
sweeps by itself; what it leaves (items that found no gap in it, then gaps no item took) is matched between ranges by rank:
the ranges' counts alone tell which of a range's open gaps go to which later items. Then the taken gaps shrink, and the next
round begins, at most one item per container and round. When no gap holds any item, new containers are opened: as many as
the rest needs at least, and one for each item over half the capacity.

A range holds at most about `RANGE` rows whatever the sizes are, equal sizes being told apart by a hash; the driver holds
two counts per range and a few figures per round; nothing grows with the capacity.

Defined results: items of size 0 or null need no room and get no container; an item over the capacity is split into
full pieces and a rest, no other item is; equal sizes go by a hash of the item; an empty input packs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.runtime import dropped, parallelism, written

#: Rows of a range, at most and about, and rows that are worth a range of their own.
RANGE, LEAST = 1_000_000, 20_000
PLACED, ITEM, GAP = 0, 1, 2


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of matched gaps and of their items, of items without a gap, and of gaps without an item, in the order given.

    In the order of falling size each gap opens a level and each item closes the latest; of a level's rows every item
    whose forerunner is a gap has it.
    """
    after = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, after, after + 1)
    order = np.lexsort((np.arange(len(level)), level))
    g, l = is_gap[order], level[order]
    hit = np.flatnonzero(g[:-1] & ~g[1:] & (l[:-1] == l[1:]))
    gaps, items = order[hit], order[hit + 1]
    free = np.ones(len(level), bool)
    free[gaps] = free[items] = False
    return gaps, items, np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)


def between(items: dict[int, int], gaps: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Which items left by a range take which gaps left by larger ranges, by rank.

    Runs (range, first rank, number, first match) of items in rising and (range, end of ranks, number, first match) of gaps
    in falling rank; the same match is a pair.
    """
    open_, of_items, of_gaps, match = [], [], [], 0
    for p in range(max([-1, *items, *gaps]) + 1):
        need, first = items.get(p, 0), 0
        while need and open_:
            q, end = open_.pop()
            n = min(need, end)
            of_items.append((p, first, n, match))
            of_gaps.append((q, end, n, match))
            need, first, match = need - n, first + n, match + n
            if end > n:
                open_.append((q, end - n))
        if gaps.get(p):
            open_.append((p, gaps[p]))
    return of_items, of_gaps


def _round(items: DataFrame, gaps: DataFrame, rows: int) -> DataFrame:
    """(state, item, piece, size, container, room): after one round, what is placed (with the room that is left), still to
    be placed, and open."""
    spark, kind = items.sparkSession, items.schema["item"].dataType.simpleString()
    n = max(min(-(-rows // LEAST), parallelism(items)), -(-rows // RANGE), 1)
    both = items.select(F.col("size").alias("at"), F.lit(False).alias("gap"), "item", "piece", F.lit(None).cast("long").alias("container"))
    both = both.unionByName(gaps.select(F.col("room").alias("at"), F.lit(True).alias("gap"), F.lit(None).cast(kind).alias("item"), F.lit(None).cast("int").alias("piece"), "container"))
    order = [F.desc("at"), F.desc("gap"), F.xxhash64("item", "piece", "container"), F.col("container"), F.col("item"), F.col("piece")]
    both = both.repartitionByRange(n, *order) if n > 1 else both.coalesce(1)
    both = both.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = list(batches)
        if not t:
            return
        t = pa.Table.from_batches(t).combine_chunks()
        if not t.num_rows:
            return
        at, part = t["at"].to_numpy(), t["part"][0].as_py()
        g, i, alone, open_ = sweep(t["gap"].to_numpy(zero_copy_only=False))
        state = np.repeat(np.array([PLACED, ITEM, GAP], np.int32), [len(g), len(alone), len(open_)])
        rank = np.concatenate([np.zeros(len(g), np.int64), np.arange(len(alone)), np.arange(len(open_))])
        mine, theirs = pa.array(np.concatenate([i, alone, open_])), pa.array(np.concatenate([g, alone, open_]))
        size = np.where(state == GAP, 0, at[mine.to_numpy()]).astype(np.int32)
        room = np.where(state == ITEM, 0, at[theirs.to_numpy()]).astype(np.int32)
        cols = [state, np.full(len(state), part, np.int32), rank, t["item"].take(mine), t["piece"].take(mine), size, t["container"].take(theirs), room]
        yield from pa.table(dict(zip(("state", "part", "rank", "item", "piece", "size", "container", "room"), cols, strict=True))).to_batches(65_536)

    swept = both.mapInArrow(run, f"state int, part int, rank long, item {kind}, piece int, size int, container long, room int")
    cols = ["state", "item", "piece", "size", "container", "room"]
    shrunk = F.when(F.col("state") == PLACED, F.col("room") - F.col("size")).otherwise(F.col("room")).alias("room")
    if n == 1:  # one range leaves nothing to others
        return written(swept.select(*cols[:-1], shrunk), "round")
    swept = written(swept, "swept")
    left = {(r[0], r[1]): r[2] for r in swept.where(F.col("state") != PLACED).groupBy("state", "part").count().collect()}  # two rows per range
    of_items, of_gaps = between({p: k for (s, p), k in left.items() if s == ITEM}, {p: k for (s, p), k in left.items() if s == GAP})
    placed = swept.where(F.col("state") == PLACED).select(*cols)
    alone, open_ = (swept.where(F.col("state") == s) for s in (ITEM, GAP))
    if of_items:
        runs = lambda r: F.broadcast(spark.createDataFrame(r, "p int, first long, n long, match long"))
        a, b = runs(of_items), runs(of_gaps)
        alone = alone.join(a, (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left")
        open_ = open_.join(b, (F.col("part") == F.col("p")) & (F.col("rank") < F.col("first")) & (F.col("rank") >= F.col("first") - F.col("n")), "left")
        alone = alone.withColumn("id", F.col("match") + F.col("rank") - F.col("first"))
        open_ = open_.withColumn("id", F.col("match") + F.col("first") - 1 - F.col("rank"))
        pairs = alone.where("id is not null").select("id", "item", "piece", "size").join(open_.where("id is not null").select("id", "container", "room"), "id")
        placed = placed.unionByName(pairs.select(F.lit(PLACED).alias("state"), *cols[1:]))
        alone, open_ = alone.where("id is null"), open_.where("id is null")
    done = placed.unionByName(alone.select(*cols)).unionByName(open_.select(*cols))
    done = written(done.select(*cols[:-1], shrunk), "round")
    dropped(swept)
    return done


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, size, container): container from 0, pieces of an item from 0; null containers for what has no size.

    `items` holds one row per item; `item` may be any column that tells items apart.
    """
    spark = items.sparkSession
    src = written(items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")), "sizes")
    full = F.when(F.col("size") > capacity, F.floor((F.col("size") - 1) / capacity)).otherwise(0)
    pieces = src.where("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), full.cast("int"))))
    left = pieces.select("item", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("size"))
    opened, rounds = 0, []
    figures = [F.count("size"), F.sum("size"), F.count_if(F.col("size") > capacity // 2), F.min("size")]
    n, tokens, over, least, most, free = *left.agg(*figures).first(), None, 0
    while n:
        if most is None or most < least:
            free = min(n, max(-(-tokens // capacity), over))
            gaps = spark.range(opened, opened + free).select(F.col("id").alias("container"), F.lit(capacity).alias("room"))
            opened += free
        else:
            gaps = rounds[-1].where((F.col("state") != ITEM) & (F.col("room") >= least)).select("container", "room")  # the others hold nothing any more
        rounds.append(_round(left, gaps, n + free))
        left = rounds[-1].where(F.col("state") == ITEM).select("item", "piece", "size")
        # One pass over the round: what is left, the widest gap, and how many gaps are open.
        size = F.when(F.col("state") == ITEM, F.col("size"))
        open_ = (F.col("state") != ITEM) & (F.col("room") > 0)
        n, tokens, over, least, most, free = rounds[-1].agg(F.count(size), F.sum(size), F.count_if(size > capacity // 2), F.min(size), F.max(F.when(open_, F.col("room"))), F.count_if(open_)).first()
    none = src.where("size <= 0").select("item", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("container"))
    placed = [r.where(F.col("state") == PLACED).select("item", "piece", "size", "container") for r in rounds]
    return reduce(DataFrame.unionByName, placed, none).withColumnRenamed("item", item)
