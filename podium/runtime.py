"""Session factory, shared tables that cut lineage, broadcasts behind a size check, distributed places and quantiles."""

from __future__ import annotations

import bisect
import math
import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side may be broadcast up to this many bytes; beyond it the same join is shuffled.
BROADCAST_BYTES = int(os.environ.get("PODIUM_BROADCAST_BYTES", 16 << 20))


def session(cores: int | str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every plan here expects.

    With `cores` (or where no master is configured) it is a local one; else master, memory and the number of shuffle
    partitions are the cluster's own.
    """
    b = SparkSession.builder.appName("podium")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if cores is not None or not SparkConf().get("spark.master", None):
        b = b.master(f"local[{cores or '*'}]")
        base |= {"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": str(shuffle_partitions or 8)}
    elif shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Where that is unset a local session gets a folder of its own; on a cluster, whose executors would each write to their
    own disk, it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_podium_dir", None)
    if not d:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = "file://" + tempfile.mkdtemp(prefix="podium-")
        spark._podium_dir = d
    return d.rstrip("/")


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """`df` as a parquet table in the shared folder: cuts the lineage, and outlives the loss of executors.

    The table is removed by `dropped`, or when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/podium/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._podium_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing will read again, such as the vectors of earlier steps."""
    for t in tables:
        path = getattr(t, "_podium_path", None)
        if path:
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)


def row_bytes(df: DataFrame, string_bytes: int = 64) -> int:
    """Bytes of a row in a broadcast hash table, about: 40 besides its fields, texts as given, arrays and maps as four
    elements of theirs, structs as their fields."""

    def width(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return 8 + sum(width(f.dataType) for f in t)
        if isinstance(t, T.ArrayType):
            return 16 + 4 * width(t.elementType)
        if isinstance(t, T.MapType):
            return 32 + 4 * (width(t.keyType) + width(t.valueType))
        return 8 + string_bytes if isinstance(t, (T.StringType, T.BinaryType)) else 8

    return 40 + sum(width(f.dataType) for f in df.schema)


def broadcast_if_small(df: DataFrame, limit: int | None = None, string_bytes: int = 64) -> DataFrame:
    """`df` with a broadcast hint if its rows, counted now, fit in `limit` bytes; else `df` as it is, to be shuffled.

    A written table is counted from its files' footers; anything else is computed for it, so write what is costly.
    """
    most = max(0, (BROADCAST_BYTES if limit is None else limit) // row_bytes(df, string_bytes))
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))


def parallelism(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _ranges(df: DataFrame, order: list) -> DataFrame:
    """`df` in range partitions, as a written table with `__part` and the place `__row` within it, from 0."""
    d = df.repartitionByRange(parallelism(df), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    low = (1 << 33) - 1  # the id's lower bits count a partition's rows
    return written(d.select(*df.columns, F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(F.lit(low)).alias("__row")), "ranges")


def _offsets(parts: DataFrame, size: F.Column) -> DataFrame:
    """(__part, __offset): what all earlier partitions hold; one row per partition."""
    at, rows = 0, []
    for p, k in sorted((r[0], r[1]) for r in parts.groupBy("__part").agg(size).collect()):
        rows.append((p, at))
        at += k
    return F.broadcast(parts.sparkSession.createDataFrame(rows, "__part int, __offset long"))


def ranked(df: DataFrame, order: list, col: str = "rank") -> DataFrame:
    """`df` with its position from 0 in the total order `order`.

    Rows are range-partitioned and sorted, each partition numbers its own, and the partitions' sizes give the offsets;
    no task sees more than a range, and rows move once.
    """
    parts = _ranges(df, order)
    out = parts.join(_offsets(parts, F.count(F.lit(1))), "__part")
    return out.select(*df.columns, (F.col("__row") + F.col("__offset")).alias(col))


def cumulated(df: DataFrame, order: list, value: str, col: str) -> DataFrame:
    """`df` with the sum of `value` over all rows before its own in the total order `order`."""
    parts = _ranges(df, order)
    w = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(value).over(w), F.lit(0))
    out = parts.withColumn("__inner", inner).join(_offsets(parts, F.coalesce(F.sum(value), F.lit(0))), "__part")
    return out.select(*df.columns, (F.col("__inner") + F.col("__offset")).alias(col))


def quantile(df: DataFrame, col: str, q: float, most: int = 100_000, parts: int = 64) -> float | None:
    """The q-quantile of a numeric column, between neighbours by linear interpolation; nulls and NaN don't count.

    Exact without one task or buffer holding all values: distinct values with their counts are narrowed down by `parts`
    cuts a round until at most `most` are left, which come to the driver.
    """
    v = F.col(col).cast("double")
    g = written(df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    n, size = g.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not n:
        return None
    at = q * (n - 1)
    r0, r1 = math.floor(at), math.ceil(at)
    below, part = 0, g
    while size > most:
        cuts = sorted(set(part.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000)).first()[0]))
        upto = [below + (x or 0) for x in part.agg(*[F.sum(F.when(F.col("v") <= c, F.col("n"))) for c in cuts]).first()]
        a, b = bisect.bisect_right(upto, r0) - 1, bisect.bisect_right(upto, r1)
        if a >= 0:
            below, part = upto[a], part.where(F.col("v") > cuts[a])
        if b < len(cuts):
            part = part.where(F.col("v") <= cuts[b])
        size = part.count()
    rows = sorted((r["v"], r["n"]) for r in part.collect())
    dropped(g)
    got, upto = [], below
    for value, k in rows:
        upto += k
        while len(got) < 2 and (r0, r1)[len(got)] < upto:
            got.append(value)
    return got[0] + (got[1] - got[0]) * (at - r0)


def ranked_within(df: DataFrame, group: list[str], order: list, col: str = "place") -> DataFrame:
    """`df` with its position from 0 in the total order `order` among the rows of its group.

    Places are counted in one order over all groups and begin anew at each group's first, so no task holds a large group.
    """
    r = ranked(df, [*[F.asc(g) for g in group], *order], "__at")
    first = written(r.groupBy(*group).agg(F.min("__at").alias("__first")), "firsts")
    j = r.join(broadcast_if_small(first.withColumnsRenamed({g: f"__g_{g}" for g in group})), [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group])
    return j.select(*df.columns, (F.col("__at") - F.col("__first")).alias(col))


def beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each (aggregates without groups) as one row, through the driver; later columns of the same name win."""
    fields = {f.name: f for df in rows for f in df.schema.fields}
    values = {k: v for df in rows for k, v in df.first().asDict().items()}
    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in fields.items()])
    return rows[0].sparkSession.createDataFrame([tuple(values[n] for n in fields)], kinds)
