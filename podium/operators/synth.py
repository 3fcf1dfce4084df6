"""Synthetic players, brackets and results, reproducible from a seed, and checks of their consistency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.runtime import beside, ranked, ranked_within, written


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that follows from the keys alone, whatever the partitions."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*keys: Column) -> Column:
    """Box-Muller from two hashed numbers."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit("u")))) * F.cos(2 * math.pi * uniform(*keys, F.lit("v")))


def players(spark: SparkSession, n: int, how: str = "normal", mean: float = 0.0, sd: float = 1.0, seed: int = 42) -> DataFrame:
    """(player_id, skill) by a distribution: normal, uniform, bimodal, exponential or lognormal."""
    i, s = F.col("id"), F.lit(seed)
    z, u = normal(i, s), uniform(i, s, F.lit("w"))
    ways = {
        "normal": mean + sd * z, "uniform": mean + sd * math.sqrt(12) * (u - 0.5), "bimodal": mean + F.when(u < 0.5, -1.5).otherwise(1.5) * sd + 0.5 * sd * z,
        "exponential": mean - sd * F.log(u), "lognormal": F.exp(mean + sd * z),
    }
    return spark.range(n).select((i + 1).alias("player_id"), ways[how].alias("skill"))


def elite(spark: SparkSession, n: int, least: float = 2.0, mean: float = 0.0, sd: float = 1.0, seed: int = 42) -> DataFrame:
    """Players of the normal law's tail beyond `least` deviations, by its inverse over the tail's chances."""
    from statistics import NormalDist

    nd = NormalDist()
    tail = 1 - nd.cdf(least)
    grid = [nd.inv_cdf(1 - tail * (i + 0.5) / 1000) for i in range(1000)]  # the tail in a thousand steps
    at = F.floor(uniform(F.col("id"), F.lit(seed), F.lit("elite")) * 1000).cast("int")
    return spark.range(n).select((F.col("id") + 1).alias("player_id"), (mean + sd * F.element_at(F.array(*[F.lit(x) for x in grid]), at + 1)).alias("skill"))


def pool(spark: SparkSession, n: int, shares: tuple[float, float, float] = (0.1, 0.3, 0.6), means: tuple[float, float, float] = (2.0, 0.5, -0.7), sd: float = 0.5, seed: int = 42) -> DataFrame:
    """(player_id, tier, skill): top, middle and lower players in the given shares."""
    a, b = int(n * shares[0]), int(n * (shares[0] + shares[1]))
    tier = F.when(F.col("id") < a, "top").when(F.col("id") < b, "middle").otherwise("lower")
    mean = F.when(F.col("id") < a, means[0]).when(F.col("id") < b, means[1]).otherwise(means[2])
    return spark.range(n).select((F.col("id") + 1).alias("player_id"), tier.alias("tier"), (mean + sd * normal(F.col("id"), F.lit(seed))).alias("skill"))


def stationary_sd(theta: float, sigma: float) -> float:
    """Spread that an Ornstein-Uhlenbeck walk settles at."""
    return sigma / math.sqrt(2 * theta)


def slope_for(p: float, gap: float) -> float:
    """The slope at which a lead of `gap` wins with the chance p."""
    return math.log(p / (1 - p)) / gap


def drifted(df: DataFrame, steps: int, theta: float = 0.1, sigma: float = 0.2, seed: int = 42) -> DataFrame:
    """Skills after each step of an Ornstein-Uhlenbeck walk towards 0, in closed form from the hashed shocks."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    x = df.withColumn("step", k)
    a = math.exp(-theta)
    sd = sigma * math.sqrt((1 - a * a) / (2 * theta))
    shock = lambda j: normal(F.col("player_id"), j, F.lit(seed))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("step"), F.lit(1))), F.col("skill"), lambda s, j: s * a + sd * shock(j))
    return x.select("player_id", "step", F.when(F.col("step") == 0, F.col("skill")).otherwise(walk).alias("skill"))


def teams(df: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(team_id, player_id, skill): players grouped at random; those left over have no team."""
    n = df.count() // size
    order = written(df.withColumn("h", F.xxhash64("player_id", F.lit(seed))), "pool")
    r = ranked(order, [F.asc("h"), F.asc("player_id")], "place")
    return r.withColumn("team_id", F.floor(F.col("place") / size) + 1).where(F.col("team_id") <= n).select("team_id", "player_id", "skill")


def round_robin(team_ids: list[int]) -> list[tuple[int, int, int]]:
    """(round, a, b) in which everyone meets everyone once, by the circle method."""
    t: list = list(team_ids) + ([None] if len(team_ids) % 2 else [])
    out = []
    for r in range(len(t) - 1):
        out += [(r + 1, a, b) for a, b in zip(t[: len(t) // 2], reversed(t[len(t) // 2 :]), strict=True) if a is not None and b is not None]
        t = [t[0], t[-1], *t[1:-1]]
    return out


def seed_order(n: int) -> list[int]:
    """Seeds in bracket order, so that the best meet last; n is a power of two."""
    order = [1]
    while len(order) < n:
        order = [x for s in order for x in (s, 2 * len(order) + 1 - s)]
    return order


def single_elimination(team_ids: list[int], beats) -> list[tuple[int, int, int | None, int]]:
    """(round, a, b or None for a bye, winner); `beats(a, b)` says whether a wins."""
    size = 1 << max(0, (len(team_ids) - 1).bit_length())
    field = [team_ids[s - 1] if s <= len(team_ids) else None for s in seed_order(size)]
    out, r = [], 1
    while len(field) > 1:
        nxt = []
        for a, b in zip(field[::2], field[1::2], strict=True):
            a, b = (b, a) if a is None else (a, b)
            w = a if b is None or beats(a, b) else b
            if a is not None:
                out.append((r, a, b, w))
            nxt.append(w)
        field, r = nxt, r + 1
    return out


def swiss(team_ids: list[int], rounds: int, beats) -> list[tuple[int, int, int, int]]:
    """(round, a, b, winner): neighbours by points who haven't met; whoever is left over sits out."""
    points, met, out = dict.fromkeys(team_ids, 0), set(), []
    for r in range(1, rounds + 1):
        free = sorted(team_ids, key=lambda t: (-points[t], team_ids.index(t)))
        while len(free) > 1:
            a = free.pop(0)
            b = next((x for x in free if (min(a, x), max(a, x)) not in met), None)
            if b is None:
                continue
            free.remove(b)
            met.add((min(a, b), max(a, b)))
            w = a if beats(a, b) else b
            points[w] += 1
            out.append((r, a, b, w))
    return out


def double_elimination(team_ids: list[int], beats) -> list[tuple[str, int, int, int, int]]:
    """(bracket, round, a, b, winner): who loses in the winners' bracket goes on in the losers'; the final is played again if
    the losers' champion wins it. Free places let their opponent pass without a match."""
    size = 1 << max(1, (len(team_ids) - 1).bit_length())
    field = [team_ids[s - 1] if s <= len(team_ids) else None for s in seed_order(size)]
    out: list = []

    def play(name: str, r: int, a: int | None, b: int | None) -> tuple[int | None, int | None]:
        if a is None or b is None:
            return (b if a is None else a), None
        w = a if beats(a, b) else b
        out.append((name, r, a, b, w))
        return w, b if w == a else a

    down: list = []
    r = 0
    while len(field) > 1:
        r += 1
        pairs = [play("winners", r, a, b) for a, b in zip(field[::2], field[1::2], strict=True)]
        field, fallen = [w for w, _ in pairs], [x for _, x in pairs]
        if r == 1:
            down = [play("losers", 1, a, b)[0] for a, b in zip(fallen[::2], fallen[1::2], strict=True)] if len(fallen) > 1 else fallen
            continue
        # Those who fall meet the survivors in reverse, so that few meet again soon; then the survivors halve.
        down = [play("losers", 2 * r - 2, a, b)[0] for a, b in zip(down, reversed(fallen), strict=True)]
        if len(down) > 1:
            down = [play("losers", 2 * r - 1, a, b)[0] for a, b in zip(down[::2], down[1::2], strict=True)]
    if down and down[0] is not None and field[0] is not None:
        w, _ = play("final", 1, field[0], down[0])
        if w == down[0]:
            play("final", 2, field[0], down[0])
    return out


def groups(team_ids: list[int], size: int) -> list[list[int]]:
    """Teams dealt to groups back and forth by their order, so that groups are equally strong."""
    n = max(1, -(-len(team_ids) // size))
    out: list[list[int]] = [[] for _ in range(n)]
    for i, t in enumerate(team_ids):
        k, turn = i % n, i // n % 2
        out[n - 1 - k if turn else k].append(t)
    return out


def multi_stage(team_ids: list[int], beats, size: int = 4, advance: int = 2) -> list[tuple[str, int, int, int, int]]:
    """(stage, round, a, b, winner): groups in round robin, the best of each (wins, then order) in a single elimination."""
    out, through = [], []
    for k, g in enumerate(groups(team_ids, size)):
        wins = dict.fromkeys(g, 0)
        for r, a, b in round_robin(g):
            w = a if beats(a, b) else b
            wins[w] += 1
            out.append((f"group {k + 1}", r, a, b, w))
        best = sorted(g, key=lambda t: (-wins[t], team_ids.index(t)))[:advance]
        through += list(enumerate(best))
    field = [t for _, t in sorted(through, key=lambda x: (x[0], team_ids.index(x[1])))]
    return out + [("final stage", r, a, b, w) for r, a, b, w in single_elimination(field, beats) if b is not None]


def circuit(spark: SparkSession, player_pool: DataFrame, events: int, teams_per_event: int, size: int = 4, seed: int = 42) -> DataFrame:
    """(tournament_id, team_id, player_id, skill): the rosters of a row of events.

    A player's activity follows from its id alone, and with it to how many events it comes, half as many again as there is
    room for; which ones is drawn by hash. Teams are drawn from those present, full ones only, in an order by hash; places
    come from ranges, so pool and events may be of any number.
    """
    need = teams_per_event * size
    p = written(player_pool.withColumn("activity", F.exp(normal(F.col("player_id"), F.lit(seed), F.lit("activity")))), "pool")
    total = p.agg(F.sum("activity")).first()[0] or 1.0
    rate = F.least(F.col("activity") * (1.5 * need * events / total), F.lit(float(events)))
    k = (F.floor(rate) + (uniform(F.col("player_id"), F.lit(seed), F.lit("k")) < rate - F.floor(rate)).cast("int")).cast("int")
    x = p.withColumn("k", k).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    x = x.withColumn("tournament_id", F.floor(uniform(F.col("player_id"), F.col("i"), F.lit(seed)) * events) + 1)
    x = x.groupBy("tournament_id", "player_id").agg(F.first("skill").alias("skill")).withColumn("race", F.xxhash64("player_id", "tournament_id", F.lit(seed)))
    r = written(ranked_within(x, ["tournament_id"], [F.asc("race"), F.asc("player_id")]), "places")
    full = r.groupBy("tournament_id").agg(F.least(F.floor(F.count(F.lit(1)) / size), F.lit(teams_per_event)).alias("full"))
    r = r.join(full, "tournament_id").where(F.col("place") < F.col("full") * size)
    team = F.col("tournament_id") * 100_000 + F.floor(F.col("place") / size) + 1
    return r.select("tournament_id", team.alias("team_id"), "player_id", "skill")


def with_scores(matches: DataFrame, seed: int = 42) -> DataFrame:
    """(match_id, a, b, winner, gap) with plausible scores of a series of five: close ones (gap below 2) 3-2 or 3-1, others
    3-0 or 3-1."""
    u = uniform(F.col("match_id"), F.lit(seed), F.lit("score"))
    low = F.when(F.abs("gap") < 2.0, F.when(u < 0.6, 2).otherwise(1)).otherwise(F.when(u < 0.7, 0).otherwise(1))
    a = F.col("winner") == F.col("a")
    return matches.withColumns({"score_a": F.when(a, 3).otherwise(low), "score_b": F.when(a, low).otherwise(3)})


def documents(rosters: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc): synthetic tournaments as documents that ingestion reads back; matches are (tournament_id, match_id, a, b, winner,
    score_a, score_b)."""
    opp = lambda s: F.struct(F.col(s).alias("id"), F.col(f"score_{s}").alias("score"), F.when(F.col("winner") == F.col(s), "win").otherwise("loss").alias("result"))
    m = matches.groupBy("tournament_id").agg(F.collect_list(F.struct(F.col("match_id").alias("id"), opp("a").alias("opponent1"), opp("b").alias("opponent2"))).alias("match"))
    t = rosters.groupBy("tournament_id", "team_id").agg(F.collect_list(F.struct(F.col("player_id").alias("userId"))).alias("members"))
    t = t.groupBy("tournament_id").agg(F.collect_list(F.struct(F.col("team_id").alias("id"), "members")).alias("teams"))
    j = t.join(m, "tournament_id", "left")
    ctx = F.struct(F.col("tournament_id").alias("id"), F.concat(F.lit("Synthetic "), F.col("tournament_id").cast("string")).alias("name"), "teams")
    return j.select(F.to_json(F.struct(F.struct(F.struct("match").alias("data"), ctx.alias("ctx")).alias("tournament"))).alias("doc"))


def patterns(matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """One row of figures that synthetic data should share with real data: matches and teams per tournament, tournaments per
    player, share of players seen once, mean score of the losers."""
    per = matches.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("n"))
    teams_ = rosters.groupBy("tournament_id").agg(F.countDistinct("team_id").alias("n"))
    who = rosters.groupBy("user_id").agg(F.countDistinct("tournament_id").alias("n"))
    a = per.agg(F.avg("n").alias("matches_per_tournament"))
    b = teams_.agg(F.avg("n").alias("teams_per_tournament"))
    c = who.agg(F.avg("n").alias("tournaments_per_player"), F.avg((F.col("n") == 1).cast("double")).alias("seen_once"))
    d = matches.agg(F.avg(F.least("team1_score", "team2_score")).alias("mean_low_score"))
    return beside(a, b, c, d)


def results(pairs: DataFrame, strengths: DataFrame, best_of: int = 5, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """Scores of best-of-n series for (match_id, a, b): games are independent, with logistic chances from the strengths."""
    m = pairs
    for s in ("a", "b"):
        m = m.join(strengths.select(F.col("team_id").alias(s), F.col("strength").alias(f"s{s}")), s)
    p = 1 / (1 + F.exp(-(F.col("sa") - F.col("sb")) / noise))
    need = best_of // 2 + 1
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))

    def game(acc: Column, g: Column) -> Column:
        over = (acc["x"] >= need) | (acc["y"] >= need)
        won = uniform(F.col("match_id"), g, F.lit(seed)) < p
        return F.struct(F.when(over | ~won, acc["x"]).otherwise(acc["x"] + 1).alias("x"), F.when(over | won, acc["y"]).otherwise(acc["y"] + 1).alias("y"))

    r = F.aggregate(F.sequence(F.lit(1), F.lit(best_of)), start, game)
    m = m.withColumn("r", r).select("match_id", "a", "b", F.col("r.x").alias("score_a"), F.col("r.y").alias("score_b"))
    return m.withColumn("winner", F.when(F.col("score_a") > F.col("score_b"), F.col("a")).otherwise(F.col("b")))


def violations(matches: DataFrame, rosters: DataFrame, tournaments: DataFrame) -> DataFrame:
    """(check, violations) of structure and references between tables."""
    m = matches
    t = tournaments.select("tournament_id").distinct()
    played = m.select("tournament_id", F.explode(F.array("team1_id", "team2_id")).alias("team_id")).dropna()
    both = m.where("team1_id is not null and team2_id is not null")
    checks = {
        "match_without_tournament": m.join(t, "tournament_id", "left_anti"),
        "roster_without_tournament": rosters.join(t, "tournament_id", "left_anti"),
        "team_without_roster": played.distinct().join(rosters, ["tournament_id", "team_id"], "left_anti"),
        "team_against_itself": both.where("team1_id = team2_id"),
        "winner_not_in_match": both.where("winner_team_id is not null and winner_team_id not in (team1_id, team2_id)"),
        "winner_with_fewer_games": both.where("(winner_team_id = team1_id and team1_score < team2_score) or (winner_team_id = team2_id and team2_score < team1_score)"),
        "player_on_two_rosters": rosters.groupBy("tournament_id", "user_id").agg(F.countDistinct("team_id").alias("n")).where("n > 1"),
    }
    out = None
    for name, bad in checks.items():
        x = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = x if out is None else out.unionByName(x)
    return out
