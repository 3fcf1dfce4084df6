"""Streams with late rows, sessions, and small expressions."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.operators import predict, synth
from podium.streaming import incremental


def _stream(spark, tmp_path, batches):
    kind = "user_id long, ts timestamp, is_winner boolean"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(u, datetime(2024, 1, 1, h, m), w) for u, h, m, w in rows], kind)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def _run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[(1, 10, 0, True), (1, 13, 30, False)], [(2, 13, 40, True)], [(3, 10, 30, True), (3, 13, 5, True)]])
    _run(incremental.hourly(stream, "ts", "1 hour"), "hours", tmp_path, "update")
    last = {}
    for r in spark.table("hours").collect():
        h = r["hour"].hour
        last[h] = max(last.get(h, (0, 0)), (r["matches"], r["wins"]))
    assert last == {10: (1, 1), 13: (3, 2)}  # the one at 10:30 came after 12:30 had passed


def test_sessions_end_at_gaps(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[(1, 10, 0, True), (1, 11, 0, True), (1, 15, 0, True)], [(1, 23, 0, True)]])
    _run(incremental.sessions(stream, "ts", "2 hours", "1 hour"), "runs", tmp_path, "append")
    got = {(r["user_id"], r["first"].hour, r["matches"]) for r in spark.table("runs").collect()}
    assert got >= {(1, 10, 2), (1, 15, 1)}


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[(1, 10, 0, True)], [(1, 11, 0, False), (2, 9, 0, True)]])
    prepare = lambda b: b.select(F.unix_micros("ts").alias("match_id"), "user_id", F.unix_micros("ts").alias("created_us"), "is_winner")
    table = f"file://{tmp_path}/table"
    incremental.keep_latest(stream, prepare, table, f"{tmp_path}/c1")
    want = {(1, 2, 1), (2, 1, 1)}
    read = lambda: {(r["user_id"], r["matches"], r["wins"]) for r in incremental.Versioned(spark, table).read().collect()}
    assert read() == want
    incremental.keep_latest(stream, prepare, table, f"{tmp_path}/c2")  # all batches once more, from a lost checkpoint
    assert read() == want


def test_small_expressions(spark):
    df = spark.createDataFrame([(" A b--C! ", "Yes", 1), (None, None, 2), ("", "0", 3)], "s string, t string, old int")
    r = df.select(scalar.slug(F.col("s")), scalar.truthy(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [("a-b-c", True), (None, False), ("", False)]
    assert scalar.renamed(df, {"old": "new", "s": "t", "no": "x"}).columns == ["s", "t", "new"]
    p = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(predict.win_probability(F.col("a"), F.col("b"), 2.0, -1.0)).first()[0]
    assert abs(p - 1 / (1 + np.exp(-1))) < 1e-12


def test_drift_settles(spark):
    d = synth.drifted(synth.players(spark, 400), 60, theta=0.3, sigma=0.5)
    first, last = (d.where(F.col("step") == k).agg(F.stddev("skill")).first()[0] for k in (0, 60))
    assert abs(first - 1) < 0.15 and abs(last - synth.stationary_sd(0.3, 0.5)) < 0.12
