"""Strength of teams, seeds, divisions, outcome calibration and simulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.summary import numbered
from podium.runtime import parallelism, ranked, written

#: Simulated orders that a row of work has.
RUNS = 500


def team_log_rating(members: DataFrame, alpha: float = 1.0, top_k: int | None = None) -> DataFrame:
    """(tournament_id, team_id, log_rating, members): log-sum-exp of alpha x score, of the k best if given.

    Unrated members don't count; `members` holds (tournament_id, team_id, user_id, score).
    """
    m = members.where("score is not null")
    if top_k:
        w = Window.partitionBy("tournament_id", "team_id").orderBy(F.desc("score"), "user_id")
        m = m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_k)
    g = m.groupBy("tournament_id", "team_id").agg(F.max(alpha * F.col("score")).alias("hi"), F.collect_list(alpha * F.col("score")).alias("x"))
    s = F.aggregate(F.array_sort("x"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("hi")))
    return g.select("tournament_id", "team_id", (F.col("hi") + F.log(s)).alias("log_rating"), F.size("x").cast("long").alias("members"))


def entropy_rating(members: DataFrame, top_n: int = 4, pad: float = -10.0) -> DataFrame:
    """Baseline O of the n best (missing ones padded) plus ln(1 + lambda x rho): rho is how far log-sum-exp exceeds O,
    lambda the entropy of the real members' softmax over its maximum."""
    w = Window.partitionBy("tournament_id", "team_id").orderBy(F.desc("score"), "user_id")
    m = members.where("score is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= top_n)
    g = m.groupBy("tournament_id", "team_id").agg(F.array_sort(F.collect_list("score")).alias("x"))
    n = F.size("x")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, v: a + f(v))
    g = g.withColumn("o", (total("x", lambda v: v) + (top_n - n) * pad) / top_n).withColumn("e", total("x", F.exp))
    g = g.withColumn("rho", F.exp(F.log(F.col("e") + (top_n - n) * math.exp(pad)) - F.col("o")) - 1)
    h = -total("x", lambda v: F.exp(v) / F.col("e") * F.log(F.exp(v) / F.col("e") + 1e-10))
    lam = F.when(n > 1, F.least(F.greatest(h / F.log(F.least(n, F.lit(4)).cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return g.select("tournament_id", "team_id", F.col("o").alias("baseline"), (F.col("o") + F.log(1 + lam * F.col("rho"))).alias("rating"))


def seeds(teams: DataFrame) -> DataFrame:
    """Seed of each team in its tournament by rating (ties by id), confidence 1 - exp(-gap to the nearer neighbour)."""
    w = Window.partitionBy("tournament_id").orderBy(F.desc("log_rating"), "team_id")
    t = teams.withColumns({"seed": F.row_number().over(w).cast("long"), "above": F.lag("log_rating").over(w), "below": F.lead("log_rating").over(w)})
    inf = F.lit(float("inf"))
    gap = F.least(F.coalesce(F.col("above") - F.col("log_rating"), inf), F.coalesce(F.col("log_rating") - F.col("below"), inf))
    return t.select("tournament_id", "team_id", "log_rating", "seed", (1 - F.exp(-gap)).alias("confidence"))


def divisions(teams: DataFrame, value: str, key: list[str], sizes: list[tuple[str, int]] = (("Division 1", 16), ("Division 2", 32), ("Division 3", 64)), overflow: str | None = None) -> DataFrame:
    """Teams filled into divisions of given sizes in the order of their rating; the rest go to the overflow (the last)."""
    t = numbered(teams, [F.desc(value), *key], "place")
    upto, out = 0, None
    for name, size in sizes:
        upto += size
        out = F.when(F.col("place") <= upto, name) if out is None else out.when(F.col("place") <= upto, name)
    return t.withColumn("division", out.otherwise(overflow or sizes[-1][0]))


def win_probability(a: Column, b: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(slope * (a - b) + intercept)))


def calibrate(gaps: DataFrame, gap: str = "gap", rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of mirrored results: each row is a won gap and a lost negative one.

    Newton steps; per step one aggregation brings five sums to the driver.
    """
    b = np.zeros(2)
    d = gaps.where(F.col(gap).isNotNull()).select(F.inline(F.array(F.struct(F.col(gap).alias("x"), F.lit(1.0).alias("y")), F.struct((-F.col(gap)).alias("x"), F.lit(0.0).alias("y")))))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(float(b[0]) * F.col("x") + float(b[1]))))
        v, e = p * (1 - p), F.col("y") - p
        g = d.agg(F.sum(e * F.col("x")), F.sum(e), F.sum(v * F.col("x") * F.col("x")), F.sum(v * F.col("x")), F.sum(v)).first()
        if g[0] is None:
            return 1.0, 0.0
        step = np.linalg.solve(np.array([[g[2], g[3]], [g[3], g[4]]]) + 1e-9 * np.eye(2), np.array([g[0], g[1]]))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def calibrate_by(gaps: DataFrame, by: str, gap: str = "gap", least: int = 20, rounds: int = 25) -> DataFrame:
    """(by, rows, slope, intercept): a logistic fit of mirrored results per format, all formats at once by Newton steps.

    A format with fewer than `least` mirrored rows (or without spread) has the slope and intercept of all rows. Mirrored
    rows leave the intercept at 0; per step one aggregation brings two sums per format to the driver, of which there are a
    handful.
    """
    d = written(gaps.where(F.col(gap).isNotNull()).select(F.col(by).alias("by"), F.col(gap).cast("double").alias("x")), "gaps")
    base = calibrate(d, "x", rounds)
    n = {r["by"]: 2 * r["count"] for r in d.groupBy("by").count().collect()}
    slope = {k: 0.0 for k, v in n.items() if v >= least}
    todo = set(slope)
    for _ in range(rounds):
        if not todo:
            break
        b = d.sparkSession.createDataFrame([(k, slope[k]) for k in todo], f"by {d.schema['by'].dataType.simpleString()}, b double")
        p = 1 / (1 + F.exp(-F.col("b") * F.col("x")))
        sums = d.join(F.broadcast(b), d["by"].eqNullSafe(b["by"])).groupBy(b["by"].alias("k")).agg(F.sum((1 - p) * F.col("x")).alias("g"), F.sum(p * (1 - p) * F.col("x") * F.col("x")).alias("h"))
        for r in sums.collect():
            step = float(np.clip(r["g"] / (r["h"] + 1e-9), -5, 5))
            slope[r["k"]] += step
            if abs(step) < 1e-8 or abs(slope[r["k"]]) > 1e3:
                todo.discard(r["k"])
    rows = [(k, n[k] // 2, *((slope[k], 0.0) if k in slope and abs(slope[k]) <= 1e3 else base)) for k in n]
    return d.sparkSession.createDataFrame(rows, f"`{by}` {d.schema['by'].dataType.simpleString()}, rows long, slope double, intercept double")


def calibration_scores(gaps: DataFrame, order: list, gap: str = "gap", splits: int = 5) -> DataFrame:
    """(split, train, test, slope, log_loss, brier, accuracy): each of `splits` equal parts in time is predicted by a fit of
    all rows before it; the first of splits + 1 parts is only learned from."""
    d = ranked(gaps.where(F.col(gap).isNotNull()), order, "at").select("at", F.col(gap).cast("double").alias("x"))
    n = d.count()
    size = n // (splits + 1)
    out = None
    for k in range(1, splits + 1 if size else 1):
        start = n - (splits - k + 1) * size
        a, b = calibrate(d.where(F.col("at") < start), "x")
        p = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        clip = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
        t = d.where((F.col("at") >= start) & (F.col("at") < start + size))
        row = t.agg(F.lit(k).alias("split"), F.lit(start).cast("long").alias("train"), F.count(F.lit(1)).alias("test"), F.lit(a).alias("slope"), F.avg(-F.log(clip)).alias("log_loss"), F.avg((1 - p) * (1 - p)).alias("brier"), F.avg((p > 0.5).cast("double")).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else d.sparkSession.createDataFrame([], "split int, train long, test long, slope double, log_loss double, brier double, accuracy double")


def adaptive(results: DataFrame, key: str, order: list[str], gap: str = "gap", won: str = "won", rate: float = 0.01, warm: int = 100, slope: float = 1.0, intercept: float = 0.0) -> DataFrame:
    """Results with `p`, `slope` and `intercept` as they were before each: an online logistic fit per key, a gradient step a
    result from the `warm`-th on. Keys are spread, a key's rows stream through one task in order; only two numbers are kept."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in results.schema.fields)}, p double, slope double, intercept double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, a, b = object(), 0, slope, intercept
        for f in frames:
            got = []
            for k, x, y in zip(f[key], f[gap], f[won], strict=True):
                if k != at:
                    at, n, a, b = k, 0, slope, intercept
                p = 1 / (1 + math.exp(-max(-700.0, min(700.0, a * x + b))))
                got.append((p, a, b))
                n += 1
                if n >= warm:
                    e = float(y) - p
                    a, b = a + rate * e * x, b + rate * e
            yield f.assign(**dict(zip(("p", "slope", "intercept"), (list(c) for c in zip(*got, strict=True)) if got else ([], [], []), strict=True)))

    d = results.where(F.col(key).isNotNull() & F.col(gap).isNotNull() & F.col(won).isNotNull())
    return d.repartition(parallelism(d), key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def weighted_strength(members: DataFrame, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """(tournament_id, team_id, strength, members): the sum of weight x exp(alpha x score); without a weight column all have 1."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    g = members.where("score is not null").groupBy("tournament_id", "team_id")
    return g.agg(F.sum(w * F.exp(alpha * F.col("score"))).alias("strength"), F.count(F.lit(1)).alias("members"))


def seed_accuracy(seeds: DataFrame, places: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Per tournament: teams, and the shares whose place is the seed's, within one and within two of it.

    `adjustments` (tournament_id, team_id, seed) replaces seeds by hand.
    """
    s = seeds.select("tournament_id", "team_id", F.col("seed").alias("__s"))
    if adjustments is not None:
        s = s.join(adjustments.select("tournament_id", "team_id", F.col("seed").alias("__by_hand")), ["tournament_id", "team_id"], "left").withColumn("__s", F.coalesce("__by_hand", "__s"))
    j = s.join(places.select("tournament_id", "team_id", F.col("place").alias("__p")), ["tournament_id", "team_id"])
    off = F.abs(F.col("__s") - F.col("__p"))
    return j.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("teams"), *[F.avg((off <= k).cast("double")).alias(n) for k, n in ((0, "exact"), (1, "within_1"), (2, "within_2"))])


def division_statistics(teams: DataFrame, value: str) -> DataFrame:
    """(division, teams, mean, lowest, highest) of divided teams."""
    return teams.groupBy("division").agg(F.count(F.lit(1)).alias("teams"), F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def brackets(teams: DataFrame, group: str, value: str, key: list[str], sizes: list[tuple[str, int]]) -> DataFrame:
    """Teams of every division filled into brackets of given sizes in the order of their rating; the rest are in none."""
    w = Window.partitionBy(group).orderBy(F.desc(value), *key)
    t = teams.withColumn("seed", F.row_number().over(w))
    upto, out = 0, F.lit(None).cast("string")
    cuts = []
    for name, size in sizes:
        upto += size
        cuts.append((upto, name))
    for n, name in reversed(cuts):
        out = F.when(F.col("seed") <= n, name).otherwise(out)
    return t.withColumn("bracket", out)


def series_probability(p: Column, best_of: int = 3) -> Column:
    """Chance to win a series of `best_of` games with the chance `p` of each."""
    need = best_of // 2 + 1
    return sum((math.comb(need - 1 + k, k) * F.pow(p, F.lit(need)) * F.pow(1 - p, F.lit(k)) for k in range(need)), F.lit(0.0))


def _hash_int(x: int | np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int (0 or more) that follows what `seed` is the hash of."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (np.asarray(x, np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def monte_carlo(teams: DataFrame, runs: int = 200, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """Chance of each team to come first and to be among four in noisy orders of its tournament, brackets aside.

    Noise is Gumbel-distributed by a hash of run and team, so first places follow softmax of the ratings. A tournament's
    teams are one row, of which arrays draw `RUNS` orders at a time; only their sums per team leave the task, so neither
    the disk nor a shuffle ever holds a row per run.
    """
    team = F.struct("team_id", "log_rating", F.xxhash64("tournament_id", "team_id").alias("h"))
    g = teams.groupBy("tournament_id").agg(F.array_sort(F.collect_list(team)).alias("t"))
    starts = F.explode(F.sequence(F.lit(1), F.lit(runs), F.lit(RUNS))).alias("first")
    rows = g.select("tournament_id", F.col("t.team_id").alias("team_id"), F.col("t.log_rating").alias("x"), F.col("t.h").alias("h"), starts)
    rows = rows.repartition(parallelism(teams), "tournament_id", "first")

    def drawn(x: np.ndarray, h: np.ndarray, first: int, last: int) -> np.ndarray:
        k, sums = len(x), np.zeros((4, len(x)), np.int64)
        step = max(1, 500_000 // max(1, k))
        for a in range(first, last + 1, step):
            r = np.arange(a, min(a + step, last + 1), dtype=np.uint64)[:, None]
            u = ((_hash_int(seed, _hash_int(r, h[None, :])) & np.uint64((1 << 52) - 1)).astype(np.float64) + 0.5) / float(1 << 52)
            y = x - noise * np.log(-np.log(u))
            # Teams are in the order of their ids, which a stable sort keeps among equals.
            place = np.empty(y.shape, np.int64)
            np.put_along_axis(place, np.argsort(-y, axis=1, kind="stable"), np.arange(1, k + 1)[None, :], axis=1)
            sums += np.stack([(place == 1).sum(0), (place <= 4).sum(0), place.sum(0), np.full(k, len(y))])
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, first in enumerate(b["first"].to_pylist()):
                ids, x, h = (b[c][i].values for c in ("team_id", "x", "h"))
                sums = drawn(x.to_numpy(zero_copy_only=False), h.to_numpy().view(np.uint64), first, min(first + RUNS - 1, runs))
                where = pa.array([b["tournament_id"][i].as_py()] * len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([where, ids, *(pa.array(s, pa.int64()) for s in sums)], names=["tournament_id", "team_id", "first", "top4", "places", "n"])

    s = rows.mapInArrow(run, "tournament_id long, team_id long, first long, top4 long, places long, n long")
    n = F.sum("n")
    return s.groupBy("tournament_id", "team_id").agg((F.sum("first") / n).alias("p_first"), (F.sum("top4") / n).alias("p_top4"), (F.sum("places") / n).alias("mean_place"))


def first_chances(teams: DataFrame, noise: float = 1.0) -> DataFrame:
    """(tournament_id, team_id, p_first) that the simulation approaches: the softmax of the ratings over the noise."""
    hi = teams.groupBy("tournament_id").agg(F.max("log_rating").alias("__hi"))
    x = teams.join(hi, "tournament_id").withColumn("__e", F.exp((F.col("log_rating") - F.col("__hi")) / noise))
    total = x.groupBy("tournament_id").agg(F.sum("__e").alias("__total"))
    return x.join(total, "tournament_id").select("tournament_id", "team_id", (F.col("__e") / F.col("__total")).alias("p_first"))
