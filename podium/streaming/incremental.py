"""Structured Streaming: figures kept up to date as rows arrive, windows with late data, and the life of tournaments."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from podium.runtime import shared_dir
from podium.sources.store import Versioned

STALE_S = 7 * 86400


def read(spark: SparkSession, folder: str, pattern: str, files: int = 4) -> DataFrame:
    """A stream of the parquet files of a folder whose names fit, a few per batch."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def merged(partial: DataFrame, state: DataFrame | None) -> DataFrame:
    """Per-user counts, wins and last match of a batch added to those there are."""
    both = partial if state is None else state.unionByName(partial)
    g = both.groupBy("user_id")
    return g.agg(F.sum("matches").alias("matches"), F.sum("wins").alias("wins"), F.max("last_us").alias("last_us"), F.max_by("last_match", F.struct("last_us", "last_match")).alias("last_match"))


def partial(rows: DataFrame) -> DataFrame:
    """A batch reduced to one row per user, on the map side first."""
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("matches"), F.sum(F.col("is_winner").cast("long")).alias("wins"), F.max("created_us").alias("last_us"),
        F.max_by("match_id", F.struct("created_us", "match_id")).alias("last_match"),
    )


def keep_latest(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> None:
    """Runs a stream to its present end, merging each batch into a versioned table.

    The table keeps the number of the last merged batch, so a batch that comes again after a failure is not counted twice.
    """
    def each(batch: DataFrame, n: int) -> None:
        t = Versioned(batch.sparkSession, table)
        old = t.read()
        if old is not None and (done := old.agg(F.max("batch")).first()[0]) is not None and done >= n:
            return
        new = merged(partial(prepare(batch)), None if old is None else old.drop("batch"))
        t.replace(new.withColumn("batch", F.lit(n).cast("long")))
        t.drop_old()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_above(spark: SparkSession, table: str, rows: DataFrame, mark: str = "match_id") -> int:
    """Adds the rows beyond the table's largest `mark` as a new version; how many there were. Rows that come again, and such
    without a mark, add nothing."""
    t = Versioned(spark, table)
    old = t.read()
    high = None if old is None else old.agg(F.max(mark)).first()[0]
    new = rows.where(F.col(mark).isNotNull() if high is None else F.col(mark) > high)
    n = new.count()
    if n:
        t.replace(new if old is None else old.unionByName(new, allowMissingColumns=True))
        t.drop_old()
    return n


def hourly(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Matches and wins per hour; rows later than the watermark are left out."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"))
    return g.agg(F.count(F.lit(1)).alias("matches"), F.sum(F.col("is_winner").cast("long")).alias("wins")).select(F.col("window.start").alias("hour"), "matches", "wins")


def sessions(stream: DataFrame, ts: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Runs of matches of a user without a longer gap."""
    g = stream.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap))
    return g.agg(F.count(F.lit(1)).alias("matches")).select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "matches")


def next_state(state: str, misses: int, found: bool, started: bool, finalized: bool, idle_s: float) -> tuple[str, int]:
    """A tournament's state after one look: scheduled, in_progress, completed, stale or deleted (missed three times)."""
    if not found:
        return ("deleted" if misses + 1 >= 3 else state), misses + 1
    if finalized:
        return "completed", 0
    if started:
        return ("stale" if idle_s > STALE_S else "in_progress"), 0
    return "scheduled", 0


def lifecycle(looks: DataFrame) -> DataFrame:
    """(tournament_id, state, misses, at): state machine over a stream of looks (tournament_id, at, found, started,
    finalized, idle_s). A tournament's state is kept between batches until it is completed or deleted; another look then
    begins anew, and shows the same."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, misses, at = state.get if state.exists else ("unknown", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for r in rows.itertuples(index=False):
            name, misses = next_state(name, misses, bool(r.found), bool(r.started), bool(r.finalized), float(r.idle_s))
            at = max(at, float(r.at))
        if name in ("completed", "deleted"):
            if state.exists:
                state.remove()
        else:
            state.update((name, misses, at))
        yield pd.DataFrame({"tournament_id": [key[0]], "state": [name], "misses": [misses], "at": [at]})

    return looks.groupBy("tournament_id").applyInPandasWithState(run, "tournament_id long, state string, misses long, at double", "state string, misses long, at double", "update", GroupStateTimeout.NoTimeout)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a stream's checkpoint or table."""
    return f"{shared_dir(spark)}/podium/{name}-{uuid.uuid4().hex}"
