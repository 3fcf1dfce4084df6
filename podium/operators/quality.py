"""How well predicted orders and chances agree with what happened, and how far results hold up.

Orders are compared by places, positions from 0 among the items of a group in a total order; equal values go by the item.
Places are counted over ranges, so a group may be of any size. Groups with a single item agree by definition; an empty
input gives no groups, and overall figures of it are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.operators import evaluate
from podium.runtime import beside, broadcast_if_small, quantile, ranked, ranked_within, written

#: Rows whose inversions one task counts, and parts that a group is cut into at most for that.
BLOCK, PARTS = 50_000, 1_000


# ---- orders


def placed(df: DataFrame, group: list[str], item: str, predicted: Column, actual: Column) -> DataFrame:
    """(group..., item, seed, place): positions by the predicted and by the actual order, smallest value first."""
    d = df.select(*group, item, predicted.alias("__p"), actual.alias("__a")).where("__p is not null and __a is not null")
    d = ranked_within(d, group, [F.asc("__p"), F.asc(item)], "seed")
    return written(ranked_within(d, group, [F.asc("__a"), F.asc(item)], "place").select(*group, item, "seed", "place"), "placed")


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], of different whole numbers from 0: by their highest differing bit, one pass per bit."""
    total = 0
    for b in range(int(y.max()).bit_length() if len(y) else 0):
        high, bit = y >> (b + 1), (y >> b) & 1
        order = np.argsort(high, kind="stable")
        high, bit = high[order], bit[order]
        ones = np.cumsum(bit)
        first = np.searchsorted(high, high, side="left")
        total += int(((1 - bit) * (ones - ones[first] + bit[first])).sum())
    return total


def discordant(orders: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """(group..., items, discordant): pairs of items that `seed` and `place` order differently.

    A pair lies in one block of seeds, in one block of places, in both, or in neither; the first three are counted within
    blocks, and those in neither from the blocks' sizes. No pairs are made, and no task has more than a block.
    """
    n = orders.agg(F.max("seed")).first()[0]
    if n is not None:
        block = max(block, -(-(n + 1) // PARTS))
    d = orders.select(*group, "seed", "place", F.floor(F.col("seed") / block).alias("i"), F.floor(F.col("place") / block).alias("j"))
    kinds = {f.name: f.dataType.simpleString() for f in orders.schema}
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "n long"])

    def count(t: pa.Table) -> pa.Table:
        order = np.argsort(t["seed"].to_numpy(), kind="stable")
        found = inversions(t["place"].to_numpy()[order])
        return pa.table({g: t[g][:1] for g in group} | {"n": pa.array([found], pa.int64())})

    def across(t: pa.Table) -> pa.Table:
        i, j, c = (t[x].to_numpy() for x in ("i", "j", "count"))
        m = np.zeros((int(i.max()) + 1, int(j.max()) + 1), np.int64)
        m[i, j] = c
        later = np.cumsum(m[::-1], 0)[::-1]  # this block of seeds and later ones
        smaller = np.cumsum(later, 1)  # this block of places and earlier ones
        found = int((m[:-1, 1:] * smaller[1:, :-1]).sum()) if min(m.shape) > 1 else 0
        return pa.table({g: t[g][:1] for g in group} | {"n": pa.array([found], pa.int64())})

    within = d.groupBy(*group, "i").applyInArrow(count, schema)
    if n is not None and n >= block:
        both = d.groupBy(*group, "i", "j").applyInArrow(count, schema).withColumn("n", -F.col("n"))
        within = within.unionByName(d.groupBy(*group, "j").applyInArrow(count, schema)).unionByName(both)
        within = within.unionByName(d.groupBy(*group, "i", "j").count().groupBy(*group).applyInArrow(across, schema))
    size = d.groupBy(*group).agg(F.count(F.lit(1)).alias("items"))
    found = within.groupBy(*group).agg(F.sum("n").alias("discordant"))
    return size.join(found, group)


def order_agreement(orders: DataFrame, group: list[str]) -> DataFrame:
    """Per group: NDCG at 4, 8 and all, Spearman plain and weighted by 1 / (1 + position), mean seed errors, and the share of
    pairs in the same order (agreement) and in different ones (Kendall's distance)."""
    seed, place, n = F.col("seed"), F.col("place"), F.col("__n")
    size = orders.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    d = orders.join(size, group)
    gain, ideal = (n - place) / F.log2(seed + 2), (n - place) / F.log2(place + 2)
    w = 1 / (1.0 + seed)
    sums = {"w": w, "wx": w * seed, "wy": w * place, "wxx": w * seed * seed, "wyy": w * place * place, "wxy": w * seed * place}
    aggs = [F.try_divide(F.sum(F.when(seed < k, gain)), F.sum(F.when(place < k, ideal))).alias(f"ndcg_{k}") for k in (4, 8)]
    aggs += [F.try_divide(F.sum(gain), F.sum(ideal)).alias("ndcg"), F.corr(seed, place).alias("spearman"), F.avg(F.abs(seed - place)).alias("mae")]
    aggs += [F.avg(F.when(seed < k, F.abs(seed - place))).alias(f"mae_{k}") for k in (4, 8)]
    g = d.groupBy(*group).agg(*aggs, *[F.sum(x).alias(f"__{k}") for k, x in sums.items()])
    cov, vx, vy = (F.col(f"__{a}") / F.col("__w") - F.col(f"__{b}") * F.col(f"__{c}") / (F.col("__w") * F.col("__w")) for a, b, c in (("wxy", "wx", "wy"), ("wxx", "wx", "wx"), ("wyy", "wy", "wy")))
    g = g.withColumn("weighted_spearman", F.when((vx > 1e-15) & (vy > 1e-15), cov / F.sqrt(vx * vy)).otherwise(0.0)).drop(*[f"__{k}" for k in sums])
    k = discordant(orders, group)
    pairs = F.col("items") * (F.col("items") - 1) / 2
    k = k.select(*group, "items", "discordant", F.coalesce(F.try_divide("discordant", pairs), F.lit(0.0)).alias("kendall_distance"), F.coalesce(1 - F.try_divide("discordant", pairs), F.lit(1.0)).alias("agreement"))
    return g.join(k, group)


def weighted_correlations(df: DataFrame, true: str, predicted: str, decay: float = 0.1) -> DataFrame:
    """(weighting, correlation) of ranks from 1, by falling weight of the true rank: exponential, logarithmic, hyperbolic.

    1 - 6 x weighted mean square difference / (m (m^2 - 1)) with m the weights' effective number, within -1 and 1.
    """
    r, d = F.col(true), F.col(predicted) - F.col(true)
    ways = {"exponential": F.exp(-decay * (r - 1)), "logarithmic": 1 / F.log(r + 1.0), "hyperbolic": 1.0 / r}
    a = df.where(r.isNotNull() & d.isNotNull()).agg(*[F.struct(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * d * d).alias("d")).alias(k) for k, w in ways.items()])
    a = a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("weighting"), F.col(f"{k}.w").alias("w"), F.col(f"{k}.ww").alias("ww"), F.col(f"{k}.d").alias("d")) for k in ways])))
    m = F.col("w") * F.col("w") / F.col("ww")
    return a.select("weighting", F.least(F.greatest(1 - F.try_divide(6 * F.col("d") / F.col("w"), m * (m * m - 1)), F.lit(-1.0)), F.lit(1.0)).alias("correlation"))


def weighted_spearman(df: DataFrame, true: str, predicted: str, weight: Column, by: list[str] = ()) -> DataFrame:
    """(by..., correlation, n): correlation of ranks weighted by trust or activity; null without spread, or fewer than two."""
    t, p = F.col(true).cast("double"), F.col(predicted).cast("double")
    d = df.where(t.isNotNull() & p.isNotNull()).withColumn("__w", weight).where("__w > 0")
    w = F.col("__w")
    sums = {"w": w, "t": w * t, "p": w * p, "tt": w * t * t, "pp": w * p * p, "tp": w * t * p}
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"__{k}") for k, x in sums.items()])
    cov, vt, vp = (F.col(f"__{x}") / F.col("__w") - F.col(f"__{a}") * F.col(f"__{b}") / (F.col("__w") * F.col("__w")) for x, a, b in (("tp", "t", "p"), ("tt", "t", "t"), ("pp", "p", "p")))
    return g.select(*by, F.when((F.col("n") > 1) & (vt > 1e-12) & (vp > 1e-12), cov / F.sqrt(vt * vp)).alias("correlation"), "n")


def top_k_accuracy(df: DataFrame, true: str, predicted: str, ks: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """(k, accuracy, jaccard): of the true first k those predicted among them, weighted by 1 / true rank; and the overlap of
    both first k. Values of k beyond the number of items are left out."""
    t, p = F.col(true), F.col(predicted)
    cols = []
    for k in ks:
        acc = F.try_divide(F.sum(F.when((t <= k) & (p <= k), 1.0 / t).otherwise(0.0)), F.sum(F.when(t <= k, 1.0 / t).otherwise(0.0)))
        jac = F.try_divide(F.count_if((t <= k) & (p <= k)), F.count_if((t <= k) | (p <= k)))
        cols.append(F.struct(F.lit(k).alias("k"), F.coalesce(acc, F.lit(0.0)).alias("accuracy"), jac.alias("jaccard"), (F.count(F.lit(1)) >= k).alias("there")))
    return df.agg(F.array(*cols).alias("x")).select(F.inline("x")).where("there").drop("there")


def rank_differences(df: DataFrame, true: str, predicted: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row: mean, median, largest and percentiles of how far ranks are apart, and the means of the true first 10 and 50."""
    d = written(df.select(F.col(true).alias("t"), F.abs(F.col(predicted) - F.col(true)).cast("double").alias("d")).dropna(), "differences")
    top = lambda k, f: f(F.when(F.col("t") <= k, F.col("d")))
    a = d.agg(F.avg("d").alias("mean_abs_diff"), F.max("d").alias("max_abs_diff"), top(10, F.avg).alias("top_10_mean_diff"), top(10, F.max).alias("top_10_max_diff"), top(50, F.avg).alias("top_50_mean_diff"))
    q = {p: quantile(d, "d", p / 100) for p in {*percents, 50}}
    return a.withColumns({"median_abs_diff": F.lit(q[50]).cast("double")} | {f"p{p}_abs_diff": F.lit(q[p]).cast("double") for p in percents})


# ---- predictions


def high_confidence_accuracy(pred: DataFrame, by: list[str], threshold: float = 0.65) -> DataFrame:
    """Per group: predictions of at least `threshold`, and the share of them above one half (null without any)."""
    p = F.col("p")
    g = pred.where("p is not null").groupBy(*by)
    return g.agg(F.count(F.lit(1)).alias("matches"), F.count_if(p >= threshold).alias("confident"), F.avg(F.when(p >= threshold, (p > 0.5).cast("double"))).alias("accuracy"), F.try_divide(F.avg((p < 0.5).cast("double")), F.avg(1 - p)).alias("upset_ratio"), F.avg(F.abs(p - 0.5)).alias("separation"))


def strict_concordance(pred: DataFrame) -> DataFrame:
    """Share of matches whose winner is rated strictly higher; an unrated side counts as 0."""
    w, l = (F.coalesce(f"{s}_rating", F.lit(0.0)) for s in ("winner", "loser"))
    return pred.agg(F.avg((w > l).cast("double")).alias("concordance"), F.count(F.lit(1)).alias("matches"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often only the first and only the second was right, the statistic with continuity correction, and its
    p-value (chi-square with one degree of freedom)."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    only_a, only_b = df.agg(F.count_if(x & ~y), F.count_if(y & ~x)).first()
    n = only_a + only_b
    stat = (abs(only_a - only_b) - 1) ** 2 / n if n > 1 else 0.0
    p = 1.0 if n == 0 else math.erfc(math.sqrt(stat / 2))
    return df.sparkSession.createDataFrame([(only_a, only_b, float(stat), p)], "only_first long, only_second long, statistic double, p_value double")


def interval_coverage(df: DataFrame, low: str, high: str, outcome: str, level: float = 0.95) -> DataFrame:
    """One row: share of outcomes within their interval, how far that is from `level`, its standard error, and widths."""
    d = df.where(F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(outcome).isNotNull())
    y, width = F.col(outcome).cast("double"), F.col(high) - F.col(low)
    a = d.agg(F.count(F.lit(1)).alias("n"), F.avg(((y >= F.col(low)) & (y <= F.col(high))).cast("double")).alias("coverage"), F.avg(width).alias("mean_width"), F.stddev_pop(width).alias("sd_width"))
    c = F.col("coverage")
    return a.select("n", "coverage", F.lit(level).alias("expected"), F.abs(c - level).alias("error"), F.sqrt(c * (1 - c) / F.col("n")).alias("se"), "mean_width", "sd_width")


def shuffled(ratings: DataFrame, k: int) -> DataFrame:
    """Ratings dealt out again among the same ids by the k-th of a row of fixed permutations.

    Ids are ordered by a multiple of theirs modulo 2^32, another multiplier for each k; the rating at place i of the ids'
    own order goes to place i of that one. `ratings` holds (id, rating, at), `at` the place of the id.
    """
    key = F.pmod(F.pmod(F.col("id"), F.lit(1 << 32)) * F.lit(1103515245 + 15308642 * k), F.lit(1 << 32))
    order = ranked(ratings.select("id", key.alias("key")), [F.asc("key"), F.asc("id")], "at")
    return order.select("id", "at").join(ratings.select("at", "rating"), "at").select("id", "rating")


def skill(matches: DataFrame, ratings: DataFrame, permutations: int = 10) -> DataFrame:
    """One row: mean loss, that of shuffled ratings, and 1 minus their quotient."""
    r = ranked(ratings.where("rating is not null"), [F.asc("id")], "at")
    matches = written(matches.select("winner_team_id", "loser_team_id"), "matches")
    mean = lambda x: evaluate.predicted(matches, x).agg(F.avg(evaluate.loss(F.col("p"))).alias("x"))
    base = None
    for k in range(1, permutations + 1):
        one = mean(shuffled(r, k))
        base = one if base is None else base.unionByName(one)
    a, b = mean(r).withColumnRenamed("x", "loss"), base.agg(F.avg("x").alias("shuffled_loss"))
    return beside(a, b).withColumn("skill", 1 - F.try_divide("loss", "shuffled_loss"))


# ---- figures of several runs


def described(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., metric, n, mean, sd, min, max): of each column over its values that aren't null; sd is the sample's."""
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])))
    g = long.where("x is not null and not isnan(x)").groupBy(*by, "metric")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, q1, median, q3, trimmed_mean): the trimmed mean is that of the values between the 10 % and 90 % quantiles."""
    rows = []
    for c in columns:
        q = [quantile(df, c, x) for x in (0.25, 0.5, 0.75, 0.1, 0.9)]
        inner = df.where(F.col(c).between(q[3], q[4])).agg(F.avg(c)).first()[0] if q[3] is not None else None
        rows.append((c, *q[:3], None if inner is None else float(inner)))
    return df.sparkSession.createDataFrame(rows, "metric string, q1 double, median double, q3 double, trimmed_mean double")


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / min(1 + num * d, -1e-300)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * (f - 1) / a


def paired_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean difference of two models' figures over the same folds, Student's t and its two-sided p-value."""
    d = F.col(a) - F.col(b)
    n, mean, sd = df.where(d.isNotNull()).agg(F.count(F.lit(1)), F.avg(d), F.stddev_samp(d)).first()
    t = mean / (sd / math.sqrt(n)) if n > 1 and sd else None
    p = None if t is None else _beta((n - 1) / (n - 1 + t * t), (n - 1) / 2, 0.5)
    return df.sparkSession.createDataFrame([(n, mean, t, p)], "n long, mean_difference double, t double, p_value double")


def effect_size(df: DataFrame, value: str, positive: str) -> DataFrame:
    """One row: Cohen's d of the two classes, their overlap over 50 common bins, and the share of positives among the best tenth."""
    d = written(df.where(F.col(value).isNotNull() & F.col(positive).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(positive).cast("int").alias("y")), "classes")
    y = F.col("y") == 1
    s = d.agg(*[f(F.when(c, F.col("x"))).alias(f"{k}{i}") for i, c in enumerate((y, ~y)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))], F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    pooled = ((s["n0"] - 1) * (s["v0"] or 0) + (s["n1"] - 1) * (s["v1"] or 0)) / max(1, s["n0"] + s["n1"] - 2)
    cohen = (s["m0"] - s["m1"]) / math.sqrt(pooled) if pooled > 0 and s["n0"] and s["n1"] else None
    overlap = cut = best = None
    if s["n0"] and s["n1"]:
        width = (s["hi"] - s["lo"]) / 50 or 1.0
        bins = d.groupBy(F.least(F.floor((F.col("x") - s["lo"]) / width), F.lit(49)).alias("bin")).agg(F.count_if(y).alias("a"), F.count_if(~y).alias("b"))
        overlap = bins.agg(F.sum(F.least(F.col("a") / s["n0"], F.col("b") / s["n1"]))).first()[0]
        cut = quantile(d, "x", 0.9)
        best = d.where(F.col("x") >= cut).agg(F.avg(y.cast("double"))).first()[0]
    return df.sparkSession.createDataFrame([(cohen, overlap, best)], "cohens_d double, overlap double, top_decile double")


def density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """(x, density, peak): a Gaussian kernel estimate with Silverman's width on a grid from the smallest to the largest value;
    peaks are the points higher than both neighbours. Values are binned on the grid first, so the driver holds `points` counts."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("x"))
    n, lo, hi, sd = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.stddev_samp("x")).first()
    schema = "x double, density double, peak boolean"
    if not n or not sd:
        return df.sparkSession.createDataFrame([], schema)
    step = (hi - lo) / (points - 1)
    count = np.zeros(points)
    for r in x.groupBy(F.round((F.col("x") - lo) / step).cast("int").alias("i")).count().collect():
        count[r["i"]] = r["count"]
    width = 1.06 * sd * n**-0.2
    grid = lo + step * np.arange(points)
    kernel = np.exp(-0.5 * ((grid[:, None] - grid[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    y = kernel @ count / n
    left, right = np.concatenate([[-1.0], y[:-1]]), np.concatenate([y[1:], [-1.0]])
    return df.sparkSession.createDataFrame([(float(a), float(b), bool(c)) for a, b, c in zip(grid, y, (y > left) & (y > right), strict=True)], schema)


def backtest(matches: DataFrame, rate: Callable[[DataFrame], DataFrame], least: int = 10, splits: int | None = None) -> DataFrame:
    """Per tournament held out (as in `evaluate.sequential_holdout`): how the order of its teams by ratings from before agrees
    with that by wins. `rate` makes (id, rating) of teams or their likes from earlier matches; unrated teams are left out."""
    t = matches.where("ts is not null").groupBy("tournament_id").agg(F.min("ts").alias("start"))
    order = [r[0] for r in t.orderBy("start", "tournament_id").collect()]  # one row per tournament
    at = list(range(least, len(order)))
    if splits is not None and splits < len(at):
        at = [at[-1]] if splits == 1 else sorted({at[round(i)] for i in np.linspace(0, len(at) - 1, splits)})
    place = matches.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], "tournament_id long, __at int")
    m = written(matches.join(broadcast_if_small(place), "tournament_id"), "backtest")
    out = None
    for i in at:
        ratings = rate(m.where(F.col("__at") < i).drop("__at"))
        test = m.where(F.col("__at") == i)
        wins = test.select(F.col("winner_team_id").alias("id"), F.lit(1).alias("w")).unionByName(test.select(F.col("loser_team_id").alias("id"), F.lit(0).alias("w")))
        wins = wins.groupBy("id").agg(F.sum("w").alias("wins"))
        one = wins.join(ratings, "id").select(F.lit(order[i]).cast("long").alias("tournament_id"), "id", "wins", "rating")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = matches.sparkSession.createDataFrame([], "tournament_id long, id long, wins long, rating double")
    o = placed(written(out, "held"), ["tournament_id"], "id", -F.col("rating"), -F.col("wins"))
    return order_agreement(o, ["tournament_id"])


# ---- robustness


def monotonicity(df: DataFrame, value: str, outcome: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_value, mean_outcome, rises): equal bins by the value's order, and whether the mean outcome is at least
    that of the bin below."""
    d = ranked(df.where(F.col(value).isNotNull() & F.col(outcome).isNotNull()).select(F.col(value).alias("v"), F.col(outcome).cast("double").alias("y")), [F.asc("v"), F.asc("y")], "at")
    n = max(1, d.count())
    g = d.groupBy(F.floor(F.col("at") * bins / n).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"), F.avg("y").alias("mean_outcome"))
    below = g.select((F.col("bin") + 1).alias("bin"), F.col("mean_outcome").alias("below"))
    return g.join(F.broadcast(below), "bin", "left").select("bin", "n", "mean_value", "mean_outcome", (F.col("mean_outcome") >= F.col("below")).alias("rises"))  # `bins` rows


def null_shuffle(edges: DataFrame, seed: int = 1) -> DataFrame:
    """Edges with the results turned round by a number from their ends: what a rating finds in them is chance."""
    turn = evaluate.edge_number(F.least("loser", "winner"), F.greatest("loser", "winner") + (F.col("loser") < F.col("winner")).cast("long") * 99_991, seed) % 2 == 0
    e = edges.select(F.when(turn, F.col("winner")).otherwise(F.col("loser")).alias("loser"), F.when(turn, F.col("loser")).otherwise(F.col("winner")).alias("winner"), "weight_sum")
    return e.groupBy("loser", "winner").agg(F.sum("weight_sum").alias("weight_sum"))


def sensitivity(base: DataFrame, variants: dict[str, Callable[[], DataFrame]], key: str = "id", score: str = "score") -> DataFrame:
    """(variant, spearman, n): rank correlation of each variant's scores with the base's; scores equal to 12 decimals are ties."""
    out = None
    base = written(base.select(key, F.round(score, 12).alias("x")), "base")
    for name, make in variants.items():
        other = make().select(key, F.round(score, 12).alias("y"))
        c = evaluate.spearman(written(base.join(other, key), "variant"), "x", "y").withColumn("variant", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


