"""Analytics of matchmaking queues: seasons, slots, rolling and running figures per player.

Null players or times are left out; equal times of a player go by match id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, cumulated, ranked, written

SEASON_BREAK_S = 2 * 86400


def seasons(matches: DataFrame, gap_s: int = SEASON_BREAK_S) -> DataFrame:
    """Matches (match_id, created_s) with `season`, which grows at every gap of more than `gap_s` between starts.

    Gaps are found between calendar days: the distinct days are few, so only they meet in one ordered window.
    """
    day = F.floor(F.col("created_s") / 86400)
    d = matches.where("created_s is not null").groupBy(day.alias("day")).agg(F.min("created_s").alias("lo"), F.max("created_s").alias("hi"))
    d = written(d, "days")  # one row per calendar day of the whole history
    w = Window.orderBy("day")
    d = d.withColumn("season", F.sum(F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap_s).cast("long"), F.lit(0))).over(w))
    # With a break of two days or more no gap lies within a day.
    return matches.withColumn("day", day).join(broadcast_if_small(d.select("day", "season")), "day").drop("day")


def season_metadata(matches: DataFrame) -> DataFrame:
    return matches.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), F.min("created_s").alias("first_s"), F.max("created_s").alias("last_s"))


def rolling(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Per player and time window (t - w, t]: matches and wins, and wins before the match itself.

    A player's time is cut into blocks as long as the longest window; a row counts in its own block and, as what is carried
    over, in the next one, so a player with very many matches is spread over tasks.
    """
    block = F.floor(F.col("created_us") / (max(windows.values()) * 1_000_000))
    out = rows.withColumn("__carry", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__block", block + F.col("__carry"))
    for name, seconds in windows.items():
        w = Window.partitionBy("user_id", "__block").orderBy("created_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
        out = out.withColumns({f"count_{name}": F.count("is_winner").over(w), f"won_{name}": F.sum(F.col("is_winner").cast("long")).over(w)})
        out = out.withColumn(f"won_prior_{name}", F.col(f"won_{name}") - F.col("is_winner").cast("long"))
    return out.where("__carry = 0").drop("__carry", "__block")


def rolling_std(rows: DataFrame, value: str, n: int = 7) -> DataFrame:
    """Sample standard deviation over a player's last n matches, null until there are n."""
    w = Window.partitionBy("user_id").orderBy("created_us", "match_id").rowsBetween(1 - n, 0)
    return rows.withColumn(f"{value}_std_{n}", F.when(F.count(value).over(w) == n, F.stddev_samp(value).over(w)))


def cumulative(rows: DataFrame) -> DataFrame:
    """`cum_matches`: a player's earlier matches that weren't cancelled; 0 for cancelled ones.

    Counted in one order over all players by ranges, less what came before a player's first row: no task holds a player.
    """
    live = F.coalesce(F.col("winner") != "cancelled", F.lit(False))
    x = cumulated(rows.withColumn("__live", live.cast("long")), [F.asc("user_id"), F.asc("created_us"), F.asc("match_id")], "__live", "__before")
    x = written(x, "cumulated")
    first = written(x.groupBy(F.col("user_id").alias("__user")).agg(F.min("__before").alias("__first")), "firsts")
    x = x.join(broadcast_if_small(first), F.col("user_id").eqNullSafe(F.col("__user")))
    return x.withColumn("cum_matches", F.when(F.col("__live") == 1, F.col("__before") - F.col("__first")).otherwise(0).cast("long")).select(*rows.columns, "cum_matches")


def corrected(rows: DataFrame) -> DataFrame:
    """`after_sp`: points plus the running sum of differences since the player's points last changed; null differences are 0."""
    w = Window.partitionBy("user_id").orderBy("created_us", "match_id")
    x = rows.withColumn("changed", F.coalesce((F.col("sp") != F.lag("sp").over(w)).cast("long"), F.lit(0)))
    x = x.withColumn("segment", F.sum("changed").over(w))
    seg = Window.partitionBy("user_id", "segment").orderBy("created_us", "match_id")
    return x.withColumn("after_sp", F.col("sp") + F.sum(F.coalesce("sp_diff", F.lit(0.0))).over(seg)).drop("changed", "segment")


def latest(rows: DataFrame) -> DataFrame:
    """A player's last match that wasn't cancelled."""
    return rows.where("winner != 'cancelled'").groupBy("user_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "user_id"]), F.struct("created_us", "match_id")).alias("r")).select("user_id", "r.*")


def slots(matches: DataFrame) -> DataFrame:
    """`slot`: the first row of a chart that is free (its last match reported before this one was created), per season.

    First fit is sequential within a season: rows stream through in order, and only the open slots are held.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in matches.schema.fields)}, slot long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        season, free, busy, n = None, [], [], 0
        for f in frames:
            got = []
            for s, start, end in zip(f["season"], f["created_s"], f["reported_s"], strict=True):
                if s != season:
                    season, free, busy, n = s, [], [], 0
                while busy and busy[0][0] < start:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                k = heapq.heappop(free) if free else n
                n = max(n, k + 1)
                got.append(k)
                heapq.heappush(busy, (end, k))
            yield f.assign(slot=got)

    n = max(1, int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return matches.repartition(n, "season").sortWithinPartitions("season", "created_s", "match_id").mapInPandas(run, schema)


def logz(rows: DataFrame, value: str) -> DataFrame:
    """`{value}_logz`: the logarithm of the value, standardised over all rows (population deviation)."""
    mean, sd = rows.agg(F.avg(F.log(value)), F.stddev_pop(F.log(value))).first()
    return rows.withColumn(f"{value}_logz", (F.log(value) - F.lit(mean)) / F.lit(sd) if sd else F.lit(None).cast("double"))


def against_group(rows: DataFrame, value: str, mates: int = 3, enemies: int = 4) -> DataFrame:
    """Difference of a player's value to the mean of teammates and of the enemy group in each match."""
    g = rows.groupBy("match_id", "group_id").agg(F.sum(value).alias("s"), F.stddev_samp(value).alias("sd"))
    own = rows.join(g.select("match_id", "group_id", F.col("s").alias("own_sum"), F.col("sd").alias("own_std")), ["match_id", "group_id"], "left")
    enemy = g.select("match_id", F.col("group_id").alias("enemy_group_id"), F.col("s").alias("enemy_sum"), F.col("sd").alias("enemy_std"))
    x = own.join(enemy, ["match_id", "enemy_group_id"], "left")
    return x.withColumns({"teammate_diff": F.col(value) - (F.col("own_sum") - F.col(value)) / mates, "enemy_diff": F.col(value) - F.col("enemy_sum") / enemies})



# ---- log-normal points


def lognormal(rows: DataFrame, value: str, grid: int = 24, rounds: int = 5) -> tuple[float, float, float] | None:
    """(shape, location, scale) of a three-parameter log-normal law by maximum likelihood; None without spread.

    For a given location the other two follow from means of logarithms, so the likelihood is a function of the location
    alone. A grid of locations is evaluated in one pass and closes in around the best; the likelihood's pole at the smallest
    value is kept out by a distance of a thousandth of the range.
    """
    x = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("x")), "points")
    n, low, high = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n or high <= low:
        return None
    near, far = math.log((high - low) * 1e-3), math.log((high - low) * 1e2)
    for _ in range(rounds):
        gaps = np.linspace(near, far, grid)
        logs = [F.log(F.col("x") - (low - math.exp(g))) for g in gaps]
        got = x.agg(*[f(c) for c in logs for f in (F.avg, F.var_pop)]).first()
        fit = [0.5 * math.log(max(got[2 * i + 1], 1e-300)) + got[2 * i] for i in range(grid)]
        best = int(np.argmin(fit))
        near, far = gaps[max(0, best - 1)], gaps[min(grid - 1, best + 1)]
    return math.sqrt(got[2 * best + 1]), low - math.exp(gaps[best]), math.exp(got[2 * best])


def kolmogorov(rows: DataFrame, value: str, shape: float, location: float, scale: float) -> float | None:
    """The largest distance between the values' distribution and a log-normal one."""
    x = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    r = ranked(x, [F.asc("x")], "at")
    n = r.count()
    erf = np.vectorize(math.erf, otypes=[float])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = 0.0
        for b in batches:
            v, at = b.column(0).to_numpy() - location, b.column(1).to_numpy()
            if len(v):
                cdf = np.where(v > 0, 0.5 * (1 + erf(np.log(np.where(v > 0, v, 1.0) / scale) / shape / math.sqrt(2))), 0.0)
                worst = max(worst, float(np.abs(cdf - at / n).max()), float(np.abs(cdf - (at + 1) / n).max()))
        yield pa.RecordBatch.from_arrays([pa.array([worst])], names=["d"])

    return r.mapInArrow(run, "d double").agg(F.max("d")).first()[0] if n else None


def latest_rated(rows: DataFrame) -> DataFrame:
    """Each player's last reported match that wasn't cancelled, if its points were calculated or enough matches are there."""
    ok = F.coalesce("skill_difference_calculated", F.lit(False)) | F.coalesce(F.col("skill_difference_matches_count") == F.col("skill_difference_matches_count_needed"), F.lit(False))
    return latest(rows.withColumn("created_us", F.col("reported_at"))).where(ok)


def player_rows(merged: DataFrame, law: tuple[float, float, float] | None = None) -> DataFrame:
    """The statistics of every player and match: corrected points, their log-z by the fitted law, sums over own and enemy
    group, differences to mates and enemies, rolling matches and wins, rolling deviations, earlier matches."""
    x = merged.withColumn("created_us", F.col("created_at") * 1_000_000)
    x = corrected(x.withColumn("sp_diff", F.col("skill_difference_sp_diff"))).drop("sp_diff")
    if law is None:
        law = lognormal(latest_rated(x), "after_sp")
    shape, _, scale = law or (1.0, 0.0, 1.0)
    z = lambda c: (F.log(c) - math.log(scale)) / shape
    x = x.withColumns({"sp_logz": z("sp"), "after_sp_logz": z("after_sp")}).withColumn("sp_diff_logz", F.col("after_sp_logz") - F.col("sp_logz"))
    sums = [f(c).alias(f"{c}_{n}") for c in ("sp_logz", "sp_diff_logz") for n, f in (("sum", lambda c: F.coalesce(F.sum(c), F.lit(0.0))), ("std", F.stddev_samp))]
    g = written(x.groupBy("match_id", "group_id").agg(*sums), "groups")
    x = x.join(g, ["match_id", "group_id"], "left")
    x = x.join(g.select("match_id", F.col("group_id").alias("enemy_group_id"), *[F.col(c).alias(f"enemy_{c}") for c in g.columns[2:]]), ["match_id", "enemy_group_id"], "left")
    x = x.withColumns({"teammate_sp_logz_diff": F.col("sp_logz") - (F.col("sp_logz_sum") - F.col("sp_logz")) / 3, "enemy_sp_logz_diff": F.col("sp_logz") - F.col("enemy_sp_logz_sum") / 4})
    x = rolling(x, {"7D": 7 * 86400, "24H": 86400}).withColumnsRenamed({f"{a}_{n}": f"{b}_{n}" for n in ("7D", "24H") for a, b in (("won", "won_matches"), ("won_prior", "won_matches_prior"))})
    for c in ("after_sp", "after_sp_logz", "teammate_sp_logz_diff", "enemy_sp_logz_diff"):
        x = rolling_std(x, c)
    x = cumulative(x).withColumnRenamed("cum_matches", "cumulative_matches")
    return x.withColumn("has_calculated_7", F.col("after_sp_std_7").isNotNull()).drop("created_us")


def rebuilt(merged_rows: DataFrame, matches: DataFrame) -> DataFrame:
    """All seasons but the first (0) anew: each season's rows by its own law, with `season`."""
    s = written(seasons(matches.select("match_id", F.col("created_at").alias("created_s"))).select("match_id", "season"), "seasons")
    rows = written(merged_rows.join(s, "match_id"), "merged")
    out = None
    for r in s.where("season > 0").select("season").distinct().orderBy("season").collect():  # a few seasons
        part = player_rows(rows.where(F.col("season") == r[0]))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else player_rows(rows.limit(0), (1.0, 0.0, 1.0))
