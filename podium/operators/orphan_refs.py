"""References to records that are missing, removed, or arrive after the record that names them.

Keys are range-partitioned at quantiles of the parents' keys, each range's parents are stored once as one row of sorted
arrays, and batches of references are probed against it by vectorised binary search. A range that holds many references
(a hot key) is split into several batches, each with the range's row beside it. Every batch is a partition of its own,
by its number and not by a hash, so no task meets more than one bounded batch. Only misses leave the probe.

Defined results: a null reference is none; a null time of arrival is unknown and never makes a reference late; a
target with rows in its table is neither deleted nor missing, whatever removals say; a record that names two targets is
checked for both; repeated rows are reported once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, written

#: Parents per range and references per batch: what one task holds.
RANGE_PARENTS, BATCH_REFS = 100_000, 400_000
KINDS = ("deleted", "missing", "late")
_NEVER = np.iinfo(np.int64).min
_MISS = "code int, record_id long, seen long, kind int"


@dataclass(frozen=True)
class Reference:
    """Column `column` of `child`, whose rows are named by `record`, holds keys `key` of `parent`; removals are noted as `entity`."""

    name: str
    child: DataFrame
    record: str
    column: str
    parent: DataFrame
    key: str
    entity: str
    arrived: str = "ingested_at"


def _micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: references (code, record_id, target, seen); right: one row of sorted arrays (targets, first_seen, present), or none."""
    target, seen = left["target"].to_numpy(), left["seen"].to_numpy()
    keys, first, here = (right[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("targets", "first_seen", "present"))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
        known = keys[at] == target
        present = known & here[at].astype(bool)
        late = present & (seen != _NEVER) & (first[at] != _NEVER) & (seen < first[at])
    else:
        known = present = late = np.zeros(len(target), bool)
    kind = np.where(late, 2, np.where(present, -1, np.where(known, 0, 1))).astype(np.int32)
    miss = np.flatnonzero(kind >= 0)
    out = left.select(["code", "record_id", "seen"]).take(pa.array(miss))
    return out.append_column("kind", pa.array(kind[miss]))


def find(references: list[Reference], removed: DataFrame, range_parents: int = RANGE_PARENTS, batch_refs: int = BATCH_REFS) -> DataFrame:
    """(reference, record_id, kind, seen_us): every row's reference without a target in time; `seen_us` is the row's arrival."""
    parents, refs = None, None
    for code, r in enumerate(references):
        there = r.parent.where(F.col(r.key).isNotNull()).groupBy(F.col(r.key).cast("long").alias("target"))
        there = there.agg(F.min(_micros(r.arrived)).alias("first_seen")).withColumn("present", F.lit(True))
        gone = removed.where(F.col("entity_type") == r.entity).select(F.col("internal_id").cast("long").alias("target")).dropna()
        gone = gone.select("target", F.lit(None).cast("long").alias("first_seen"), F.lit(False).alias("present"))
        both = there.unionByName(gone).groupBy("target").agg(F.max("first_seen").alias("first_seen"), F.max("present").alias("present"))
        both = both.withColumn("first_seen", F.coalesce("first_seen", F.lit(_NEVER)))
        own = r.child.where(F.col(r.column).isNotNull()).select(
            F.lit(code).alias("code"), F.col(r.record).cast("long").alias("record_id"), F.col(r.column).cast("long").alias("target"),
            F.coalesce(_micros(r.arrived), F.lit(_NEVER)).alias("seen"),
        )
        bounds = _bounds(r.parent, r.key, range_parents)
        both, own = _ranged(both, bounds, code), _ranged(own, bounds, code)
        parents = both if parents is None else parents.unionByName(both)
        refs = own if refs is None else refs.unionByName(own)
    # One row per range comes to the driver, as many as the parents fill: how many batches it takes, and their numbers.
    rows, batches = [], 0
    for r in refs.groupBy("code", "range").count().collect():
        n = -(-r[2] // batch_refs)
        rows.append((r[0], r[1], batches, n))
        batches += n
    spark = removed.sparkSession
    plan = broadcast_if_small(spark.createDataFrame(rows, "code int, range int, first_batch int, n int"))
    # A row's batch follows from the whole row, which spreads the copies of a record too.
    batch = F.col("first_batch") + F.pmod(F.xxhash64("record_id", "seen"), F.col("n")).cast("int")
    refs = refs.join(plan, ["code", "range"]).select("code", "record_id", "target", "seen", batch.alias("batch"))
    arrays = F.array_sort(F.collect_list(F.struct("target", "first_seen", "present")))
    stored = parents.groupBy("code", "range").agg(arrays.alias("p"))
    stored = written(stored.select("code", "range", *[F.col(f"p.{a}").alias(b) for a, b in (("target", "targets"), ("first_seen", "first_seen"), ("present", "present"))]), "parents")
    each = stored.join(plan, ["code", "range"]).withColumn("batch", F.explode(F.sequence(F.col("first_batch"), F.col("first_batch") + F.col("n") - 1)))
    each = each.select("batch", "targets", "first_seen", "present")
    if not batches:
        misses = spark.createDataFrame([], _MISS)
    else:
        refs, each = (x.repartitionById(batches, F.col("batch")) for x in (refs, each))
        misses = refs.groupBy("batch").cogroup(each.groupBy("batch")).applyInArrow(_probe, _MISS)
    return misses.select(
        F.element_at(F.array(*[F.lit(r.name) for r in references]), F.col("code") + 1).alias("reference"), "record_id",
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"),
        F.when(F.col("seen") != _NEVER, F.col("seen")).alias("seen_us"),
    )


def _bounds(parent: DataFrame, key: str, size: int) -> list[float]:
    """Inner bounds of the ranges: quantiles of the parents' keys."""
    n, keys = parent.select(F.count(F.lit(1)), F.percentile_approx(F.col(key).cast("double"), [i / 256 for i in range(1, 256)], 10000)).first()
    k = max(1, -(-n // size))
    if k == 1 or not keys:
        return []
    if k > 256:
        keys = parent.select(F.percentile_approx(F.col(key).cast("double"), [i / k for i in range(1, k)], 10 * k)).first()[0]
        return sorted(set(keys))
    return sorted({keys[round(i * 256 / k) - 1] for i in range(1, k)})


def _ranged(df: DataFrame, bounds: list[float], code: int) -> DataFrame:
    df = df.withColumn("code", F.lit(code))
    if not bounds:
        return df.withColumn("range", F.lit(0))
    b = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="__k", outputCol="__r")
    df = b.transform(df.withColumn("__k", F.col("target").cast("double")))
    return df.withColumn("range", F.col("__r").cast("int")).drop("__k", "__r")


def per_period(misses: DataFrame) -> DataFrame:
    """(reference, period, kind, records): orphan records per month of their earliest arrival that holds the reference."""
    first = misses.groupBy("reference", "record_id", "kind").agg(F.min("seen_us").alias("seen_us"))
    month = F.coalesce(F.date_format(F.timestamp_micros("seen_us"), "yyyy-MM"), F.lit("unknown"))
    return first.groupBy("reference", month.alias("period"), "kind").agg(F.count(F.lit(1)).alias("records"))
