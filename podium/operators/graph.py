"""Ratings from win graphs: smoothing, teleport, PageRank and the engines on top of it.

Edges are (loser, winner, weight_sum). A PageRank runs in one of two ways with the same formulas: up to `EDGES` edges
(counted first) they come to the driver as arrays, beyond that every step is a join and an aggregation of frames whose
result is written to the shared folder.

Where all pairs of a match's two sides are edges of one weight, they aren't made: a step sums each match's losing side and
gives that to its winning side. Up to `PLACES` places of players in matches (counted first) one task on an executor holds
them as arrays; nothing comes to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.operators import convert
from podium.runtime import broadcast_if_small, dropped, quantile, ranked, written

#: Edges that may come to the driver: 24 bytes each.
EDGES = 4_000_000
#: Players' places in matches that one task may hold: some 40 bytes each while it runs.
PLACES = 20_000_000


# ---- denominators


def smoothed(mode: str | Callable[[Column, Column], Column], loss: Column, win: Column, gamma: float = 0.02, cap: float = 1.0, eps: float = 1e-6, base: float = 0.1, scale: float = 100.0) -> Column:
    """A node's denominator from its summed losses and wins, by a named way or one's own of (loss, win)."""
    if callable(mode):
        return mode(loss, win)
    ways = {
        "none": loss,
        "wins_proportional": loss + F.least(gamma * win, cap * loss),
        "constant": loss + eps,
        "adaptive": loss + base / (1 + (loss + win) / scale) * win,
        "hybrid": loss + eps + gamma * win,
    }
    return ways[mode]


def denominators(edges: DataFrame, mode: str = "wins_proportional", **kw: float) -> DataFrame:
    """(id, loss_weights, win_weights, denom, lambda) of every node that lost."""
    loss = edges.groupBy(F.col("loser").alias("id")).agg(F.sum("weight_sum").alias("loss_weights"))
    win = edges.groupBy(F.col("winner").alias("id")).agg(F.sum("weight_sum").alias("win_weights"))
    d = loss.join(win, "id", "left").withColumn("win_weights", F.coalesce("win_weights", F.lit(0.0)))
    d = d.withColumn("denom", smoothed(mode, F.col("loss_weights"), F.col("win_weights"), **kw))
    return d.withColumn("lambda", F.col("denom") - F.col("loss_weights"))


def normalized(edges: DataFrame, denoms: DataFrame) -> DataFrame:
    """Edges with normalized_weight = weight / the loser's denominator."""
    e = edges.join(denoms.select(F.col("id").alias("loser"), "denom"), "loser")
    return e.withColumn("normalized_weight", F.col("weight_sum") / F.col("denom"))


# ---- teleport


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("loser").alias("id")).unionByName(edges.select(F.col("winner").alias("id"))).distinct()


def teleport(edges: DataFrame, mode: str | Callable[[DataFrame], DataFrame] = "volume_inverse", custom: DataFrame | None = None, participation: DataFrame | None = None, eta: float = 0.3, gamma: float = 0.5, eps: float = 1.0) -> DataFrame:
    """(id, v) summing to 1: uniform, volume_inverse (1/sqrt of the number of losing edges), custom (id, w) weights with
    1 for the rest, volume_mix of uniform with participation (id, volume) to a negative power, or a function from the edges
    to (id, raw) for nodes that aren't 0; raw weights below 1e-10 count as that."""
    n = nodes(edges)
    if callable(mode):
        n = n.join(mode(edges).select("id", "raw"), "id", "left").select("id", F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(1e-10)).alias("raw"))
    elif mode == "volume_inverse":
        deg = edges.groupBy(F.col("loser").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        n = n.join(deg, "id", "left").select("id", (1 / F.sqrt(F.coalesce("deg", F.lit(1)))).alias("raw"))
    elif mode == "custom":
        n = n.join(custom, "id", "left").select("id", F.coalesce("w", F.lit(1.0)).alias("raw"))
    elif mode == "volume_mix":
        n = n.join(participation, "id", "left").select("id", F.pow(eps + F.coalesce("volume", F.lit(0.0)), F.lit(-gamma)).alias("raw"))
    else:
        n = n.select("id", F.lit(1.0).alias("raw"))
    total, count = n.agg(F.sum("raw"), F.count(F.lit(1))).first()
    v = F.col("raw") / F.lit(total or 1.0)
    return n.select("id", (eta / (count or 1) * (1 if mode == "volume_mix" else 0) + (1 - eta if mode == "volume_mix" else 1) * v).alias("v"))


# ---- pagerank


@dataclass(frozen=True)
class PageRank:
    alpha: float = 0.85
    tol: float = 1e-8
    max_iter: int = 200
    #: deficit: what a row lacks to 1 teleports and the result isn't brought to sum 1; rows are taken as they are.
    deficit: bool = False


def pagerank(edges: DataFrame, weight: str, v: DataFrame, cfg: PageRank = PageRank(), edges_bound: int = EDGES) -> DataFrame:
    """(id, score): mass goes from `loser` to `winner` in proportion to `weight` of the loser's edges."""
    e, v = _narrow(edges, weight), _once(v.select("id", F.col("v").cast("double").alias("v")), v, "teleport")
    if e.count() > edges_bound:
        return _pagerank_frames(e, v, cfg)
    ids, src, dst, w, tv = _arrays(e, v)
    return _scored(v, ids, score=step_arrays(src, dst, w, tv, cfg) if len(ids) else np.zeros(0))


def pagerank_both(edges: DataFrame, v: DataFrame, cfg: PageRank = PageRank(), edges_bound: int = EDGES) -> DataFrame:
    """(id, win_pr, loss_pr): PageRank along the edges and against them, the edges read once."""
    e, v = _narrow(edges, "weight_sum"), _once(v.select("id", F.col("v").cast("double").alias("v")), v, "teleport")
    if e.count() > edges_bound:
        back = e.select(F.col("winner").alias("loser"), F.col("loser").alias("winner"), "w")
        win, loss = _pagerank_frames(e, v, cfg), _pagerank_frames(back, v, cfg)
        return win.withColumnRenamed("score", "win_pr").join(loss.withColumnRenamed("score", "loss_pr"), "id")
    ids, src, dst, w, tv = _arrays(e, v)
    win, loss = (step_arrays(a, b, w, tv, cfg) if len(ids) else np.zeros(0) for a, b in ((src, dst), (dst, src)))
    return _scored(v, ids, win_pr=win, loss_pr=loss)


def _once(df: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """`df`, written unless it only picks columns of `source`, which is written already."""
    return df if hasattr(source, "_podium_path") else written(df, name)


def _narrow(edges: DataFrame, weight: str) -> DataFrame:
    return _once(edges.select("loser", "winner", F.col(weight).cast("double").alias("w")), edges, "edges")


def step_arrays(src: np.ndarray, dst: np.ndarray, w: np.ndarray, v: np.ndarray, cfg: PageRank) -> np.ndarray:
    n = len(v)
    total = np.bincount(src, weights=w, minlength=n)
    sums = np.ones(n) if cfg.deficit else total
    inv = np.divide(1.0, sums, out=np.zeros(n), where=sums > 0)
    if cfg.deficit:
        r = np.full(n, 1 / max(n, 1))
    else:
        r = v / v.sum()
    p = w * inv[src]
    for _ in range(cfg.max_iter):
        lost = ((1 - total) * r).sum() if cfg.deficit else r[sums <= 0].sum()
        new = cfg.alpha * np.bincount(dst, weights=r[src] * p, minlength=n) + (1 - cfg.alpha) * v + cfg.alpha * lost * v
        if not cfg.deficit:
            new /= new.sum()
        change = np.abs(new - r).sum()
        r = new
        if change < cfg.tol:
            break
    else:
        _unsettled(cfg, change)
    return r


def _unsettled(cfg: PageRank, change: float) -> None:
    if cfg.tol > 0 and cfg.max_iter > 0:
        warnings.warn(f"scores still change by {change:.3g} in all after {cfg.max_iter} steps", stacklevel=3)


def _arrays(e: DataFrame, v: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, sources and destinations as places in them, weights, teleport."""
    vt, et = v.toArrow(), e.toArrow()
    ids = vt["id"].to_numpy()
    order = np.argsort(ids)
    ids, tv = ids[order], vt["v"].to_numpy()[order]
    src, dst = (np.searchsorted(ids, et[c].to_numpy()).astype(np.int32) for c in ("loser", "winner"))
    return ids, src, dst, et["w"].to_numpy(), tv


def _scored(v: DataFrame, ids: np.ndarray, **scores: np.ndarray) -> DataFrame:
    cols = {"id": pa.array(ids, pa.int64())} | {n: pa.array(x, pa.float64()) for n, x in scores.items()}
    return v.sparkSession.createDataFrame(pa.table(cols))


def step_sides(src: np.ndarray, src_n: np.ndarray, dst: np.ndarray, dst_n: np.ndarray, w: np.ndarray, v: np.ndarray, cfg: PageRank) -> np.ndarray:
    """`step_arrays` (without deficit) over an edge of weight w[i] from each of match i's sources to each of its destinations.

    src and dst hold the matches' players one after the other, src_n and dst_n how many each has (none is 0).
    """
    n = len(v)
    out = np.bincount(src, weights=np.repeat(w * dst_n, src_n), minlength=n)
    inv = np.divide(1.0, out, out=np.zeros(n), where=out > 0)
    first, ends, r = np.cumsum(src_n) - src_n, out <= 0, v / v.sum()
    for _ in range(cfg.max_iter):
        lost = r[ends].sum()
        mass = w * np.add.reduceat((r * inv)[src], first) if len(w) else w
        new = cfg.alpha * np.bincount(dst, weights=np.repeat(mass, dst_n), minlength=n) + (1 - cfg.alpha + cfg.alpha * lost) * v
        new /= new.sum()
        change = np.abs(new - r).sum()
        r = new
        if change < cfg.tol:
            break
    else:
        _unsettled(cfg, change)
    return r


def places(sides: DataFrame) -> int:
    """Places of players in the matches of `sides` (winners, losers)."""
    return sides.agg(F.sum(F.size("winners").cast("long") + F.size("losers"))).first()[0] or 0


def _pagerank_sides(sides: DataFrame, v: DataFrame, cfg: PageRank, both: bool) -> DataFrame:
    """(id, score) of the pairs of (winners, losers, w), or (id, win_pr, loss_pr), in one task; to be written by the caller."""
    none = F.lit(None)
    e = sides.select(none.cast("long").alias("id"), "winners", "losers", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    rows = v.select("id", none.cast("array<bigint>").alias("winners"), none.cast("array<bigint>").alias("losers"), F.col("v").cast("double").alias("w")).unionByName(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        for b in batches:
            node = b["id"].is_valid()
            x = b.filter(node)
            y = b.filter(pc.and_(pc.invert(node), pc.and_(pc.greater(pc.list_value_length(b["winners"]), 0), pc.greater(pc.list_value_length(b["losers"]), 0))))
            parts = [x["id"], x["w"], y["w"]]
            for side in (y["winners"], y["losers"]):
                parts += [side.flatten(), pc.list_value_length(side)]
            for k, p in zip(got, parts, strict=True):
                k.append(p.to_numpy(zero_copy_only=False))
        ids, tv, w, win, win_n, loss, loss_n = (np.concatenate(k) if k else np.zeros(0) for k in got)
        got.clear()
        if not len(ids):
            return
        order = np.argsort(ids)
        ids, tv = ids[order], tv[order]
        win, loss = np.searchsorted(ids, win).astype(np.int32), np.searchsorted(ids, loss).astype(np.int32)
        cols = [pa.array(ids, pa.int64()), pa.array(step_sides(loss, loss_n, win, win_n, w, tv, cfg))]
        if both:
            cols.append(pa.array(step_sides(win, win_n, loss, loss_n, w, tv, cfg)))
        yield pa.RecordBatch.from_arrays(cols, names=["id", *names])

    names = ("win_pr", "loss_pr") if both else ("score",)
    return rows.coalesce(1).mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))


def pagerank_sides(sides: DataFrame, v: DataFrame, cfg: PageRank = PageRank(), places_bound: int = PLACES) -> DataFrame:
    """`pagerank_both` of the edges from each of a match's losers to each of its winners, by `share`."""
    sides = _once(sides.select("winners", "losers", F.col("share").alias("w")), sides, "sides")
    v = _once(v.select("id", F.col("v").cast("double").alias("v")), v, "teleport")
    if cfg.deficit or places(sides) > places_bound:
        return pagerank_both(convert.share_edges(sides.withColumnRenamed("w", "share")), v, cfg)
    return _pagerank_sides(sides, v, cfg, both=True)


def _pagerank_frames(e: DataFrame, v: DataFrame, cfg: PageRank) -> DataFrame:
    sums = e.groupBy(F.col("loser").alias("id")).agg(F.sum("w").alias("s"))
    e = e.join(sums.withColumnRenamed("id", "loser"), "loser")
    e = written(e.where("s > 0").select("loser", "winner", (F.col("w") if cfg.deficit else F.col("w") / F.col("s")).alias("p")), "shares")
    base = written(v.join(sums, "id", "left").na.fill(0.0, ["s"]), "nodes")
    n, tv = base.agg(F.count(F.lit(1)), F.sum("v")).first()
    start = F.lit(1.0 / max(n, 1)) if cfg.deficit else F.col("v") / F.lit(tv)
    r = last = written(base.withColumn("score", start), "rank")
    for _ in range(cfg.max_iter):
        mass = F.sum((1 - F.col("s")) * F.col("score")) if cfg.deficit else F.sum(F.when(F.col("s") <= 0, F.col("score")))
        lost = r.agg(mass).first()[0] or 0.0
        got = e.join(r.select(F.col("id").alias("loser"), "score"), "loser").groupBy(F.col("winner").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("in"))
        new = cfg.alpha * F.coalesce("in", F.lit(0.0)) + (1 - cfg.alpha + cfg.alpha * lost) * F.col("v")
        nxt = written(r.withColumnRenamed("score", "was").join(got, "id", "left").withColumn("score", new).drop("in"), "rank")
        total, change = nxt.agg(F.sum("score"), F.sum(F.abs(F.col("score") - F.col("was")))).first()
        dropped(last)
        last, r = nxt, nxt.drop("was") if cfg.deficit else nxt.drop("was").withColumn("score", F.col("score") / F.lit(total))
        if change < cfg.tol:
            break
    else:
        _unsettled(cfg, change)
    return r.select("id", "score")


# ---- influence of tournaments


METHODS = ("arithmetic", "mean", "sum", "median", "geometric", "top_20_sum", "log_top_20_sum", "sqrt_top_20_sum", "top_10_sum", "top_20_mean", "top_20_geom")


def influences(scores: DataFrame, participants: DataFrame, methods: tuple[str, ...] = METHODS, prior: float | None = None, eps: float = 1e-10) -> DataFrame:
    """(tournament_id, one column per method), each with mean 1, from the participants' scores; unrated ones have the 5 % quantile.

    One aggregation gives means and sums. The k best come from row numbers, of which every task keeps at most k per
    tournament before rows move; medians from places in one order over all tournaments. No task holds a whole one.
    """
    if prior is None:
        prior = quantile(scores, "score", 0.05) or 0.0
    p = participants.select("tournament_id", "user_id").distinct().join(scores.withColumnRenamed("id", "user_id"), "user_id", "left")
    p = p.withColumn("score", F.coalesce("score", F.lit(prior)))
    tops = [m for m in methods if "top_" in m]
    if tops or "median" in methods:
        p = written(p, "members")
    x = F.col("score")
    plain = {"arithmetic": F.avg(x), "mean": F.avg(x), "sum": F.sum(x), "geometric": scalar.geometric_mean(x, eps)}
    g = p.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("__n"), *[plain[m].alias(m) for m in methods if m in plain])
    if tops:
        n = F.col("n")
        best = p.withColumn("n", F.row_number().over(Window.partitionBy("tournament_id").orderBy(F.desc("score"), "user_id"))).where(n <= 20)
        sums = {
            "top_20_sum": F.sum(x), "log_top_20_sum": F.sum(x), "sqrt_top_20_sum": F.sqrt(F.greatest(F.sum(x), F.lit(0.0))), "top_10_sum": F.sum(F.when(n <= 10, x)),
            "top_20_mean": F.avg(x), "top_20_geom": scalar.geometric_mean(x, eps),
        }
        g = g.join(best.groupBy("tournament_id").agg(*[sums[m].alias(m) for m in tops]), "tournament_id")
    if "median" in methods:
        r = ranked(p.select("tournament_id", "score", "user_id"), [F.asc("tournament_id"), F.asc("score"), F.asc("user_id")], "place")
        at = r.groupBy("tournament_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k"))
        at = broadcast_if_small(written(at, "firsts"))
        i = F.col("place") - F.col("first")
        mid = r.join(at, "tournament_id").where((i == F.floor((F.col("k") - 1) / 2)) | (i == F.floor(F.col("k") / 2)))
        g = g.join(mid.groupBy("tournament_id").agg(F.avg("score").alias("median")), "tournament_id")
    g = written(g.drop("__n"), "influence")
    g = _mean_one(g, methods)
    if "log_top_20_sum" in methods:
        g = _mean_one(g.withColumn("log_top_20_sum", F.log1p(F.greatest("log_top_20_sum", F.lit(0.0)))), ("log_top_20_sum",))
    return g


def _mean_one(g: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    means = g.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return g.withColumns({c: F.col(c) / F.lit(means[c] or 1.0) for c in cols})


def influence(scores: DataFrame, participants: DataFrame, method: str = "arithmetic", prior: float | None = None, eps: float = 1e-10) -> DataFrame:
    """(tournament_id, strength) by one method of `influences`."""
    return influences(scores, participants, (method,), prior, eps).withColumnRenamed(method, "strength")


def rescaled(infl: DataFrame, method: str = "minmax") -> DataFrame:
    """Influence brought to [0.5, 2] (minmax), around 1 by clipped z-scores, or to a range of one doubling (log)."""
    x = F.col("strength")
    logx = F.log(x + 1e-10)
    low, high, mean, sd, l0, l1 = infl.agg(F.min(x), F.max(x), F.avg(x), F.stddev_pop(x), F.min(logx), F.max(logx)).first()
    if method == "none" or low is None:
        return infl
    if method == "minmax":
        y = 0.5 + 1.5 * (x - low) / (high - low) if high > low else F.lit(1.0)
    elif method == "zscore":
        y = 1 + 0.5 * scalar.clipped((x - mean) / sd, -2, 2) if sd > 0 else F.lit(1.0)
    else:
        y = F.exp(F.lit(l0) + (logx - l0) * (float(np.log(2)) / (l1 - l0))) if l1 > l0 else F.lit(1.0)
    return infl.withColumn("strength", y)


def averaged(rounds: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of several rounds' influence, over the rounds that have a tournament."""
    out = None
    for df, w in zip(rounds, weights or [1.0] * len(rounds), strict=True):
        part = df.select("tournament_id", "strength", F.lit(float(w)).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tournament_id").agg((F.sum(F.col("strength") * F.col("w")) / F.sum("w")).alias("strength"))


def retrospective(edges: DataFrame, scores: DataFrame, rate: float = 0.005) -> DataFrame:
    """(id, strength): summed scores of the beaten, by weight x exp(-rate x weight)."""
    e = edges.join(scores.withColumnRenamed("id", "loser"), "loser")
    w = F.col("weight_sum")
    return e.groupBy(F.col("winner").alias("id")).agg(F.sum(F.col("score") * w * F.exp(-rate * w)).alias("strength"))


# ---- engines


@dataclass(frozen=True)
class Engine:
    now: float = 1751328000.0
    half_life_days: float = 30.0
    beta: float = 1.0
    pagerank: PageRank = field(default_factory=PageRank)
    smoothing: str = "wins_proportional"
    influence_method: str = "arithmetic"
    max_ticks: int = 5
    tick_tol: float = 1e-4
    fixed_lambda: float | None = None
    min_exposure: float | None = None
    score_decay_days: float = 30.0
    score_decay_rate: float = 0.0
    surprisal_rounds: int = 0

    @classmethod
    def of(cls, base: Engine | None = None, **settings: object) -> Engine:
        """`base` (or the defaults) with other settings, PageRank's (alpha, tol, max_iter, deficit) among them; unknown ones
        are an error."""
        own = {k: v for k, v in settings.items() if k in cls.__dataclass_fields__}
        inner = {k: v for k, v in settings.items() if k in PageRank.__dataclass_fields__}
        if unknown := settings.keys() - own.keys() - inner.keys():
            raise TypeError(f"no such settings: {', '.join(sorted(unknown))}")
        base = base or cls()
        return replace(base, **own | ({"pagerank": replace(own.get("pagerank", base.pagerank), **inner)} if inner else {}))

    @property
    def rate(self) -> float:
        return scalar.half_life_rate(self.half_life_days)


def participants(matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """(tournament_id, user_id) on rosters of teams that played."""
    m = convert.valid(matches)
    used = m.select("tournament_id", F.col("winner_team_id").alias("team_id")).unionByName(m.select("tournament_id", F.col("loser_team_id").alias("team_id"))).distinct()
    return rosters.join(used, ["tournament_id", "team_id"]).select("tournament_id", "user_id").distinct()


def row_pagerank(edges: DataFrame, v: DataFrame, cfg: Engine) -> DataFrame:
    """(id, score) of players from losers to winners.

    Without deficit the rows are normalised in the PageRank itself, which cancels any smoothed denominators; they only
    count with deficit.
    """
    if not cfg.pagerank.deficit:
        return pagerank(edges, "weight_sum", v, cfg.pagerank)
    edges = written(edges, "edges")
    return pagerank(normalized(edges, denominators(edges, cfg.smoothing)), "normalized_weight", v, cfg.pagerank)


def tick_tock(matches: DataFrame, rosters: DataFrame, cfg: Engine = Engine(), edges_bound: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """((id, score), influence): ratings and tournaments' influence re-estimated in turn until it settles.

    Two teams' matches of a tournament become one row with both rosters and their decayed weight, once; a tick only scales
    it. Up to `edges_bound` places on these rosters no pairs of players are made but for the teleport.
    """
    who = written(participants(matches, rosters), "participants")
    infl = written(matches.select("tournament_id").dropna().distinct().withColumn("strength", F.lit(1.0)), "influence")
    w = convert.weighted(matches, cfg.now, cfg.rate)
    sides = written(convert.roster_sides(w, rosters), "sides")
    factored = not cfg.pagerank.deficit and places(sides) <= edges_bound
    base = None if factored else written(convert.player_edges(w, rosters, ["tournament_id"]), "pairs")
    links = written(convert.share_edges(sides.withColumn("share", F.lit(0.0))) if factored else base.select("loser", "winner").distinct(), "links")
    v = written(teleport(links, "volume_inverse"), "teleport")
    dropped(links)
    scores = None
    for _ in range(cfg.max_ticks):
        scaled = (sides if factored else base).join(broadcast_if_small(infl), "tournament_id", "left")
        w = F.col("weight_sum") * F.pow(F.coalesce("strength", F.lit(1.0)), F.lit(cfg.beta))
        if factored:
            rated = _pagerank_sides(scaled.select("winners", "losers", w.alias("w")), v, cfg.pagerank, both=False)
        else:
            rated = row_pagerank(scaled.groupBy("loser", "winner").agg(F.sum(w).alias("weight_sum")), v, cfg)
        last, scores = scores, written(rated, "scores")
        new = written(influence(scores, who, cfg.influence_method), "influence")
        both = new.withColumnRenamed("strength", "new").join(infl, "tournament_id", "full")
        change = both.agg(F.avg(F.abs(F.coalesce("new", F.lit(1.0)) - F.coalesce("strength", F.lit(1.0))))).first()[0] or 0.0
        dropped(last, infl)
        infl = new
        if change < cfg.tick_tol:
            break
    return scores, infl


def log_odds(compacted: DataFrame, cfg: Engine = Engine()) -> DataFrame:
    """(id, score, win_pr, loss_pr, rho, exposure): log of smoothed win over loss PageRank with exposure as teleport."""
    return _log_odds(compacted, cfg).drop("quality_mass")


def _log_odds(compacted: DataFrame, cfg: Engine) -> DataFrame:
    """`log_odds` with quality_mass, the smoothed win PageRank's part of smoothed win and loss."""
    compacted = _once(compacted, compacted, "compact")
    ex = written(convert.exposure(compacted), "exposure")
    total = ex.agg(F.sum(F.col("e_share") + 1e-12)).first()[0] or 1.0
    ex = ex.withColumn("rho", (F.col("e_share") + 1e-12) / F.lit(total))
    ex = written(ex, "rho")
    out = written(ex.join(pagerank_sides(compacted, ex.select("id", F.col("rho").alias("v")), cfg.pagerank), "id"), "log_odds")
    lam = cfg.fixed_lambda
    if lam is None:
        w, r = quantile(out, "win_pr", 0.5), quantile(out, "rho", 0.5)
        lam = 0.025 * w / r if r else 0.0
    win, loss = F.col("win_pr") + lam * F.col("rho"), F.col("loss_pr") + lam * F.col("rho")
    out = out.withColumn("quality_mass", win / (win + loss))
    score = F.log(win / loss)
    if cfg.score_decay_rate > 0:
        out = out.join(convert.last_activity(compacted), "id")
        score = convert.inactivity(score, F.col("last_ts"), cfg.now, cfg.score_decay_days, cfg.score_decay_rate)
    out = out.withColumn("score", score)
    if cfg.min_exposure is not None:
        out = out.where(F.col("exposure") >= cfg.min_exposure)
    return out.select("id", "score", "win_pr", "loss_pr", "rho", "exposure", "quality_mass")


def surprisal(compacted: DataFrame, cfg: Engine = Engine(surprisal_rounds=2), eps: float = 1e-6) -> DataFrame:
    """`log_odds` in rounds that weight each match by how surprising it was: share x -ln of the chance that the winners' mean
    standardised score gave them (logistic). Exposure, teleport and lambda stay those of the first round."""
    c = written(compacted, "compact")
    first = written(log_odds(c, cfg), "round")
    lam = cfg.fixed_lambda
    if lam is None:
        w, r = quantile(first, "win_pr", 0.5), quantile(first, "rho", 0.5)
        lam = 0.025 * w / r if r else 0.0
    scores = first
    v = written(first.select("id", F.col("rho").alias("v")), "teleport")
    for _ in range(max(1, cfg.surprisal_rounds) - 1):
        mean, sd = scores.agg(F.avg("score"), F.stddev_pop("score")).first()
        z = broadcast_if_small(written(scores.select("id", ((F.col("score") - mean) / (sd + 1e-8)).alias("z")), "z"))
        side = lambda s: c.select("match_id", F.explode(s).alias("id")).join(z, "id", "left").groupBy("match_id").agg(F.avg(F.coalesce("z", F.lit(0.0))).alias(f"z_{s}"))  # noqa: B023, E731
        p = 1 / (1 + F.exp(F.col("z_losers") - F.col("z_winners")))
        e = c.join(side("winners"), "match_id").join(side("losers"), "match_id").withColumn("share", F.col("share") * -F.log(F.greatest(p, F.lit(eps))))
        edges = written(convert.share_edges(e), "edges")
        both = pagerank_both(edges, v, cfg.pagerank)
        score = F.log((F.col("win_pr") + lam * F.col("rho")) / (F.col("loss_pr") + lam * F.col("rho")))
        last, scores = scores, written(first.select("id", "rho", "exposure").join(both, "id").withColumn("score", score), "round")
        if last is not first:
            dropped(last)
    return scores.select("id", "score", "win_pr", "loss_pr", "rho", "exposure")


def tick_tock_log_odds(matches: DataFrame, rosters: DataFrame, appearances: DataFrame | None, cfg: Engine = Engine(), damping: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Log-odds ratings in a loop with influence from the participants' quality mass, brought to [0.5, 2] and damped,
    until its mean change before damping is under `cfg.tick_tol`.

    Matches' sides and their decayed weights are found once; a tick only scales these.
    """
    who = written(participants(matches, rosters), "participants")
    base = written(convert.compact(convert.weighted(matches, cfg.now, cfg.rate), rosters, appearances), "compact")
    infl, scores, rated = None, None, None
    for _ in range(cfg.max_ticks):
        c = base if infl is None else written(convert.scaled(base, infl, cfg.beta), "scaled")
        last, rated = rated, written(_log_odds(c, cfg), "scores")
        scores = rated.drop("quality_mass")
        new = written(rescaled(influence(rated.select("id", F.col("quality_mass").alias("score")), who, cfg.influence_method)), "influence")
        dropped(last, None if infl is None else c)
        if infl is None:
            infl = new
            continue
        both = infl.join(new.withColumnRenamed("strength", "new"), "tournament_id", "left")
        change = both.agg(F.avg(F.abs(F.col("strength") - F.coalesce("new", F.lit(1.0))))).first()[0] or 0.0
        if change < cfg.tick_tol:
            break
        infl = written(averaged([new, infl], [damping, 1 - damping]), "influence")
    return scores, infl


@dataclass(frozen=True)
class Result:
    """What an engine gives: (id, score, ...), the tournaments' influence if it estimates it, and its settings."""

    scores: DataFrame
    influence: DataFrame | None
    config: Engine

    def top(self, n: int) -> DataFrame:
        """The n best, equal scores by the smaller id."""
        return self.scores.orderBy(F.desc("score"), F.asc("id")).limit(n)


def rate(engine: str, matches: DataFrame, rosters: DataFrame, appearances: DataFrame | None = None, cfg: Engine | None = None, **settings: object) -> Result:
    """Ratings by an engine's name: tick_tock, log_odds, tick_tock_log_odds, surprisal, players (PageRank) or teams."""
    cfg = Engine.of(cfg, **settings)
    infl = None
    if engine == "tick_tock":
        scores, infl = tick_tock(matches, rosters, cfg)
    elif engine == "tick_tock_log_odds":
        scores, infl = tick_tock_log_odds(matches, rosters, appearances, cfg)
    elif engine in ("log_odds", "surprisal"):
        c = convert.compact(convert.weighted(matches, cfg.now, cfg.rate), rosters, appearances)
        scores = (log_odds if engine == "log_odds" else surprisal)(c, cfg)
    elif engine in ("players", "teams"):
        w = convert.weighted(matches, cfg.now, cfg.rate)
        e = written(convert.team_edges(w) if engine == "teams" else convert.player_edges(w, rosters), "edges")
        scores = row_pagerank(e, teleport(e), cfg)
    else:
        raise ValueError(f"no engine {engine!r}")
    return Result(scores, infl, cfg)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is connected to a node, directions aside.

    Labels are lowered to the smallest of the neighbours', and then to their label's own, until none changes: a few rounds
    even for long chains, each a join and an aggregation.
    """
    a = edges.select(F.col("loser").alias("x"), F.col("winner").alias("y"))
    both = written(a.unionByName(a.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    label = written(both.select(F.col("x").alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("c"))
        low = written(label.join(near, "id").select("id", F.least("component", "c").alias("c"), F.col("component").alias("was")), "lower")
        # What a node's old label has found out counts for the node too.
        told = low.groupBy(F.col("was").alias("root")).agg(F.min("c").alias("best"))
        jump = low.join(told, F.col("was") == F.col("root")).select("id", F.least("c", "best").alias("component"), "was")
        nxt = written(jump, "labels")
        changed = nxt.where("component != was").limit(1).count()
        dropped(label, low)
        label = nxt
        if not changed:
            return label.select("id", "component")


def loo_flux(compacted: DataFrame, scores: DataFrame, alpha: float = 0.85) -> DataFrame:
    """(match_id, id, is_win, flux): alpha x score of the source x its edge's share over the source's outgoing weight."""
    e = compacted.select("match_id", F.explode("winners").alias("winner"), "losers", "share").select("match_id", "winner", F.explode("losers").alias("loser"), "share")
    out = e.groupBy("loser").agg(F.sum("share").alias("out"))
    inn = e.groupBy("winner").agg(F.sum("share").alias("in"))
    w = e.join(out, "loser").join(scores.select(F.col("id").alias("loser"), F.col("win_pr").alias("s")), "loser")
    w = w.groupBy("match_id", F.col("winner").alias("id")).agg(F.sum(alpha * F.col("s") * F.col("share") / F.col("out")).alias("flux"))
    l = e.join(inn, "winner").join(scores.select(F.col("id").alias("winner"), F.col("loss_pr").alias("s")), "winner")
    l = l.groupBy("match_id", F.col("loser").alias("id")).agg(F.sum(alpha * F.col("s") * F.col("share") / F.col("in")).alias("flux"))
    return w.withColumn("is_win", F.lit(True)).unionByName(l.withColumn("is_win", F.lit(False)))
