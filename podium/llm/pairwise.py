"""One global ranking from contests between teams, by offence-defence scaling.

A decided match adds weight 1 to the win matrix, spread evenly over the pairs of a winning and a losing member.
Smoothing lets everyone win and lose `smooth` of a match against a virtual opponent of mean offence and defence.
Sinkhorn iterations rescale rows and columns in turn: offence o_i = smooth + sum over beaten j of w_ij / d_j, defence
d_j = smooth + sum over winners i of w_ij / o_i, each normalised to geometric mean 1. Strength is o / d; it reads as
odds, as members mostly play beside and against their like, so a pair's result is their team's.

Pairs are never made: within a match the sum over pairs factors into a sum per side. Two physical ways give the same
numbers. Up to `PLAYERS` players and `SIDE` members a side, matches are packed as index arrays and the two vectors,
of proven size, go to the executors each half-round, which return partial vectors that are summed by chunk up a tree of
`FAN` parts a node. Beyond either bound a half-round is two joins and two aggregations of rows, whose sums start on the map side.

Defined results: byes, undecided matches and rows without player or match are left out; of several decided rows of a
match the latest arrived counts (ties: larger winner, then larger loser); an appearance without team takes its roster's
if that is one side of the match; who would be on both sides of a match is on neither; matches with an empty side
rate nobody; players without a rated match have no strength and no rank.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.runtime import broadcast_if_small, dropped, quantile, ranked, written

#: Bounds of the vector way: players (two vectors of 8 MB) and members of one side of a match.
PLAYERS, SIDE, CHUNK = 1_000_000, 1_000, 65_536
#: Parts of a chunk (512 KB each) that one task sums, and bytes that a task of a half-round reads for each it returns.
FAN, READ = 32, 8
SMOOTH, TOLERANCE, ROUNDS = 0.05, 0.005, 40


def decided(matches: DataFrame) -> DataFrame:
    """(match_id, winner, loser): one row per decided match."""
    m = matches.where("is_bye is not true and winner_team_id is not null and loser_team_id is not null and match_id is not null")
    at = F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))).alias("at"), F.col("winner_team_id").alias("winner"), F.col("loser_team_id").alias("loser"))
    return m.groupBy("match_id").agg(F.max(at).alias("m")).select("match_id", "m.winner", "m.loser")


def sides(appearances: DataFrame, matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """(match_id, player_id, won): every player of every decided match; `won` is null where the side isn't known."""
    m = broadcast_if_small(written(decided(matches), "decided"))
    a = appearances.where("match_id is not null and player_id is not null").select("tournament_id", "match_id", "player_id", "team_id").join(m, "match_id")
    own = lambda c: F.when(F.col(c) == F.col("winner"), True).when(F.col(c) == F.col("loser"), False)
    a = a.withColumn("own", own("team_id"))
    # A player's teams in a tournament: a few, as an array, so that the join keeps one row per appearance.
    r = rosters.select("tournament_id", "player_id", F.col("team_id").alias("roster_team")).dropna().groupBy("tournament_id", "player_id")
    r = r.agg(F.collect_set("roster_team").alias("teams"))
    need = a.where("own is null").join(r, ["tournament_id", "player_id"], "left")
    has = lambda c: F.coalesce(F.array_contains("teams", F.col(c)), F.lit(False))
    guess = F.when(has("winner") & ~has("loser"), True).when(has("loser") & ~has("winner"), False)
    both = a.where("own is not null").select("match_id", "player_id", "own", F.lit(None).cast("boolean").alias("guess"))
    both = both.unionByName(need.select("match_id", "player_id", F.lit(None).cast("boolean").alias("own"), guess.alias("guess")))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    g = both.groupBy("match_id", "player_id").agg(F.count("own").alias("n"), one("own").alias("own"), one("guess").alias("guess"))
    return g.select("match_id", "player_id", F.when(F.col("n") > 0, F.col("own")).otherwise(F.col("guess")).alias("won"))


def _factors(rated: DataFrame) -> DataFrame:
    """(match_id, w): 1 / (winners x losers) of matches with two sides."""
    g = rated.groupBy("match_id").agg(F.count_if("won").alias("nw"), F.count_if(~F.col("won")).alias("nl"))
    return g.where("nw > 0 and nl > 0").select("match_id", (1 / (F.col("nw").cast("double") * F.col("nl"))).alias("w"), "nw", "nl")


def strengths(side_rows: DataFrame, smooth: float = SMOOTH, players_bound: int = PLAYERS, side_bound: int = SIDE) -> DataFrame:
    """(player_id, offence, defence, strength) of every player with a rated match."""
    rated = side_rows.where("won is not null").select("match_id", "player_id", "won")
    f = written(_factors(rated), "factors")
    widest = f.agg(F.max(F.greatest("nw", "nl"))).first()[0]
    spark = side_rows.sparkSession
    schema = "player_id long, offence double, defence double, strength double"
    if widest is None:
        return spark.createDataFrame([], schema)
    if widest <= side_bound:
        lists = rated.groupBy("match_id").agg(F.collect_list(F.when(F.col("won"), F.col("player_id"))).alias("ws"), F.collect_list(F.when(~F.col("won"), F.col("player_id"))).alias("ls"))
        lists = written(lists.where("size(ws) > 0 and size(ls) > 0").select("ws", "ls"), "lists")
        ids = lists.select(F.explode(F.concat("ws", "ls")).alias("player_id")).distinct()
        known = np.sort(ids.limit(players_bound + 1).toArrow()["player_id"].to_numpy())
        if len(known) <= players_bound:
            # Every task returns a vector: as few tasks as keep that small beside what they read, by the members' number.
            members = f.agg(F.sum(F.col("nw") + F.col("nl"))).first()[0]
            tasks = max(1, round(4 * members / (READ * 8 * len(known))))
            if tasks < lists.rdd.getNumPartitions():
                lists = lists.coalesce(tasks)
            o, d = _by_vectors(lists, known, smooth)
            frame = pa.table({"player_id": known, "offence": o, "defence": d, "strength": o / d})
            return written(spark.createDataFrame(frame), "strengths")
    return _by_frames(rated.join(f.select("match_id", "w"), "match_id"), smooth)


def _by_vectors(lists: DataFrame, known: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(known)
    sc = lists.sparkSession.sparkContext
    ids = sc.broadcast(known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for c in (b.column(0), b.column(1)):
                at = np.searchsorted(ids.value, c.flatten().to_numpy()).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]).astype(np.int32)), pa.array(at)))
            yield pa.RecordBatch.from_arrays(cols, names=["ws", "ls"])

    packed = written(lists.mapInArrow(index, "ws array<int>, ls array<int>"), "packed")
    tasks = packed.rdd.getNumPartitions()

    def half(vector: np.ndarray, give: int) -> np.ndarray:
        """smooth + for every player of side `give`, the weighted sum of 1 / vector over the other side."""
        shared = sc.broadcast(1 / vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n)
            for b in batches:
                mine, other = b.column(give), b.column(1 - give)
                nm, no = mine.value_lengths().to_numpy(), other.value_lengths().to_numpy()
                s = np.add.reduceat(shared.value[other.flatten().to_numpy()], np.concatenate([[0], np.cumsum(no)[:-1]])) if len(no) else np.zeros(0)
                out += np.bincount(mine.flatten().to_numpy(), weights=np.repeat(s / (nm * no), nm), minlength=n)
            for c in range(0, n, CHUNK):
                part = out[c : c + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "slot", "v"])

        def add(t: pa.Table) -> pa.Table:
            v = np.zeros(len(t["v"][0].as_py()) // 8)
            for x in t["v"]:
                v += np.frombuffer(x.as_py())
            return pa.table({"chunk": t["chunk"][:1], "slot": t["slot"][:1], "v": pa.array([v.tobytes()], pa.binary())})

        kind = "chunk long, slot long, v binary"
        parts, slots = packed.mapInArrow(run, kind), tasks
        while True:
            slots = -(-slots // FAN)
            parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy("chunk", "slot").applyInArrow(add, kind)
            if slots <= 1:
                break
        got = np.full(n, smooth)
        for r in parts.collect():  # one row per chunk
            v = np.frombuffer(r["v"])
            got[r["chunk"] : r["chunk"] + len(v)] += v
        shared.destroy()
        return got / np.exp(np.log(got).mean())

    o, d = np.ones(n), np.ones(n)
    for _ in range(ROUNDS):
        new = half(d, 0)
        d = half(new, 1)
        change, o = np.abs(np.log(new / o)).max(), new
        if change < TOLERANCE:
            break
    else:
        _unsettled(change)
    ids.destroy()
    return o, d


def _unsettled(change: float) -> None:
    warnings.warn(f"strengths still change by a factor of up to {np.exp(change):.4f} after {ROUNDS} rounds", stacklevel=2)


def _by_frames(rated: DataFrame, smooth: float) -> DataFrame:
    """The same by joins: `rated` holds (match_id, player_id, won, w)."""
    rated = written(rated, "rated")
    players = rated.select("player_id").distinct()

    def half(vector: DataFrame, gives: bool) -> DataFrame:
        other = rated.where(F.col("won") != F.lit(gives)).join(vector, "player_id").groupBy("match_id", "w").agg((F.sum(1 / F.col("v")) * F.col("w")).alias("s"))
        got = rated.where(F.col("won") == F.lit(gives)).select("match_id", "player_id").join(other.select("match_id", "s"), "match_id")
        got = got.groupBy("player_id").agg(F.sum("s").alias("s"))
        raw = written(players.join(got, "player_id", "left").select("player_id", (F.lit(smooth) + F.coalesce("s", F.lit(0.0))).alias("v")), "half")
        scale = raw.agg(F.exp(F.avg(F.log("v")))).first()[0]
        out = raw.select("player_id", (F.col("v") / F.lit(scale)).alias("v"))
        made[id(out)] = raw
        return out

    made: dict[int, DataFrame] = {}
    o = written(players.select("player_id", F.lit(1.0).alias("v")), "ones")
    d = o
    for _ in range(ROUNDS):
        new = half(d, True)
        was, d = d, half(new, False)
        dropped(made.pop(id(was), None))
        change = new.join(o.withColumnRenamed("v", "was"), "player_id").agg(F.max(F.abs(F.log(F.col("v") / F.col("was"))))).first()[0]
        dropped(made.pop(id(o), None))
        o = new
        if change < TOLERANCE:
            break
    else:
        _unsettled(change)
    both = o.withColumnRenamed("v", "offence").join(d.withColumnRenamed("v", "defence"), "player_id")
    return written(both.withColumn("strength", F.col("offence") / F.col("defence")), "strengths")


def rating(appearances: DataFrame, matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """(player_id, matches, offence, defence, strength, odds): odds are against the player of median strength.

    `matches` counts the decided matches a player appears in; the median is over all players with a strength.
    """
    s = written(sides(appearances, matches, rosters), "sides")
    played = s.groupBy("player_id").agg(F.count(F.lit(1)).alias("matches"))
    rated = strengths(s)
    middle = quantile(rated, "strength", 0.5)
    odds = F.col("strength") / F.lit(float(middle)) if middle else F.lit(None).cast("double")
    return played.join(rated.withColumn("odds", odds), "player_id", "left")


def ranking(rated: DataFrame) -> DataFrame:
    """The rated players in one order, place from 1; strengths that are equal to nine decimals go by the smaller player_id."""
    r = ranked(rated.where("strength is not null"), [F.desc(F.round("strength", 9)), F.asc("player_id")], "place")
    return r.withColumn("place", F.col("place") + 1)
