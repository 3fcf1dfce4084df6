"""Ranks, grades, summaries, comparisons and confidence of rated players."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.runtime import broadcast_if_small, cumulated, ranked, written

# Grading systems, right-closed breaks and labels from low to high (percentiles: from the best).
SCORE_BREAKS = [-5, -4, -3, -2, -1, 0, 0.8, 1.5, 2.4, 4, 5]
SCORE_LABELS = ["XB-", "XB", "XB+", "XA-", "XA", "XA+", "XS-", "XS", "XS+", "XX", "XX+", "XX★"]
PERCENTILE_BREAKS = [0.003, 0.03, 0.10, 0.25, 0.50, 0.75, 0.90, 0.97]
PERCENTILE_LABELS = ["X★", "X+", "X", "S+", "S", "S-", "A+", "A", "A-"]
ELO_BREAKS = [1200, 1400, 1600, 1800, 2000, 2200, 2400, 2600]
ELO_LABELS = ["Beginner", "Novice", "Intermediate", "Advanced", "Expert", "Master", "Grandmaster", "Super GM", "Elite"]
QUEUE_BREAKS = [-3, -2, -1, 0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]
QUEUE_LABELS = ["C", "C+", "B-", "B", "B+", "A-", "A", "A+", "S-", "S", "S+", "X-", "X", "X+", "X★"]
QUEUE_PERCENTILE_BREAKS = [0.003, 0.03, 0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90]
QUEUE_PERCENTILE_LABELS = ["X★", "X+", "X", "S+", "S", "S-", "A+", "A", "A-", "B"]
#: Grading systems by name: what is graded (score, pct from the best, elo), breaks and labels.
SYSTEMS = {
    "score": ("score", SCORE_BREAKS, SCORE_LABELS), "percentile": ("pct", PERCENTILE_BREAKS, PERCENTILE_LABELS), "elo": ("elo", ELO_BREAKS, ELO_LABELS),
    "queue": ("score", QUEUE_BREAKS, QUEUE_LABELS), "queue_percentile": ("pct", QUEUE_PERCENTILE_BREAKS, QUEUE_PERCENTILE_LABELS),
}
SYSTEMS_SQL = [("score", "score", SCORE_BREAKS, SCORE_LABELS), ("percentile", "pct", PERCENTILE_BREAKS, PERCENTILE_LABELS), ("elo", "elo", ELO_BREAKS, ELO_LABELS)]


def numbered(df: DataFrame, order: list, col: str) -> DataFrame:
    """`df` numbered from 1 in a total order, by ranges."""
    return ranked(df, order, col).withColumn(col, F.col(col) + 1)


def competition_rank(df: DataFrame, value: str, col: str, mean: bool = False) -> DataFrame:
    """Rank 1, 2, 2, 4 by falling value, nulls last: the smallest number of the equal ones, or the mean of theirs.

    Distinct values are counted, ordered by ranges and their counts cumulated, so equal values never meet in one task.
    """
    n = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    c = cumulated(n, [F.desc_nulls_last("__v")], "__n", "__before")
    at = F.col("__before") + ((F.col("__n") + 1) / 2 if mean else 1)
    c = written(c.select("__v", at.alias(col)), "ranks")
    return df.join(broadcast_if_small(c), F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def post_processed(run: DataFrame, stats: DataFrame, now: float, min_tournaments: int = 3, inactive_days: float | None = None) -> DataFrame:
    """Eligible players numbered by score, with grade, display score and win/loss ratios."""
    r = run.where("score is not null").join(stats, "player_id").where(F.col("tournament_count") >= min_tournaments)
    if inactive_days is not None:
        r = r.where(F.col("last_active_ms") >= (now - inactive_days * scalar.DAY) * 1000)
    r = numbered(r, [F.desc("score"), F.asc("player_id")], "rank")
    return r.withColumns({
        "grade": scalar.cut(F.col("score"), SCORE_BREAKS, SCORE_LABELS),
        "display_score": F.col("score") * 25,
        "win_loss_ratio": F.col("win_pr") / F.greatest("loss_pr", F.lit(1e-10)),
        "win_loss_diff": F.col("win_pr") - F.col("loss_pr"),
    })


def grade_distribution(run: DataFrame) -> DataFrame:
    """(system, grade, percent) of every grading system."""
    n = numbered(run, [F.desc("score"), F.asc("player_id")], "n")
    total = n.count() or 1
    n = n.withColumns({"elo": 1500 + 400 * F.col("score"), "pct": F.col("n") / F.lit(float(total))})
    each = F.array(*[F.struct(F.lit(name).alias("system"), scalar.cut(F.col(x), b, g).alias("grade")) for name, x, b, g in SYSTEMS_SQL])
    g = n.select(F.inline(each)).groupBy("system", "grade").agg(F.count(F.lit(1)).alias("c"))
    return g.select("system", "grade", F.round(100.0 * F.col("c") / F.lit(float(total)), 6).alias("percent"))


def graded(run: DataFrame, systems: dict[str, tuple] | tuple[str, ...] = tuple(SYSTEMS), prefix: str = "grade_") -> DataFrame:
    """`run` with a grade per system, named ones or one's own as (column or expression of score, pct, elo; breaks; labels)."""
    chosen = systems if isinstance(systems, dict) else {n: SYSTEMS[n] for n in systems}
    n = numbered(run.where("score is not null"), [F.desc("score"), F.asc("player_id")], "__n")
    total = n.count() or 1
    n = n.withColumns({"elo": 1500 + 400 * F.col("score"), "pct": F.col("__n") / F.lit(float(total))})
    cols = {f"{prefix}{name}": scalar.cut(F.col(x) if isinstance(x, str) else x, b, g) for name, (x, b, g) in chosen.items()}
    return n.withColumns(cols).drop("__n", "elo", "pct")


def grade_table(distribution: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """Percentages with a row per grade and a column per system, 0 where a system doesn't give it."""
    return distribution.groupBy("grade").pivot("system", list(systems)).agg(F.first("percent")).na.fill(0.0)


def displayed(rankings: DataFrame, now: float, delay_days: float = 30.0, rate: float = 0.01, score: str = "display_score", last: str = "last_active") -> DataFrame:
    """`rankings` with `display_score_decayed`: the score times exp(-rate x days beyond the delay since the last activity."""
    idle = (F.lit(now) - F.col(last)) / scalar.DAY
    return rankings.withColumns({"days_inactive": idle, "display_score_decayed": F.when(idle > delay_days, F.col(score) * F.exp(-(idle - delay_days) * rate)).otherwise(F.col(score))})


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Players in both runs with both competition ranks and scores."""
    a = competition_rank(old, "score", "old_rank").select("player_id", "old_rank", F.col("score").alias("old_score"))
    b = competition_rank(new, "score", "new_rank").select("player_id", "new_rank", F.col("score").alias("new_score"))
    return a.join(b, "player_id")


def head_to_head(matches: DataFrame) -> DataFrame:
    """Records of every two teams that met."""
    a, b = F.least("winner_team_id", "loser_team_id"), F.greatest("winner_team_id", "loser_team_id")
    first = F.col("winner_team_id") < F.col("loser_team_id")
    g = matches.groupBy(a.alias("team_a"), b.alias("team_b"))
    g = g.agg(F.count(F.lit(1)).alias("matches"), F.count_if(first).alias("wins_a"), F.count_if(F.col("winner_team_id") > F.col("loser_team_id")).alias("wins_b"), F.max("ts").alias("last_ts"))
    return g.withColumn("rate_a", F.col("wins_a") / F.col("matches"))


def history(compacted: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Wins and losses of every player."""
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias("opponents")
    common = ["match_id", "ts", "tournament_id"]
    w = compacted.select(F.explode("winners").alias("player_id"), F.lit(True).alias("is_win"), *common, text("losers"))
    l = compacted.select(F.explode("losers").alias("player_id"), F.lit(False).alias("is_win"), *common, text("winners"))
    h = w.unionByName(l).join(tournaments.select("tournament_id", F.col("name").alias("tournament")), "tournament_id", "left")
    return h.select("player_id", "match_id", "is_win", "ts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("match_date"), "tournament", "opponents")


# What each tier of confidence asks for, and the composite's weights.
TIERS = {"high": {"tournaments": 15, "connected": 10}, "medium": {"tournaments": 10, "few": 5, "opponents": 100, "connectivity": 2}, "low": {"tournaments": 5, "few": 3, "opponents": 50}}
COMPOSITE = {"tournaments": 0.4, "opponents": 0.4, "connectivity": 0.2}


def named(matches: DataFrame, teams: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Matches (match_id, tournament_id, winner_team_id, loser_team_id, ts) with names, day, ISO weekday (Monday 1) and week.

    `teams` holds (team_id, name), `tournaments` (tournament_id, name), one row each; what has no name has null.
    """
    m = matches.select("match_id", "tournament_id", "winner_team_id", "loser_team_id", "ts").join(tournaments.select("tournament_id", F.col("name").alias("tournament")), "tournament_id", "left")
    for side in ("winner", "loser"):
        m = m.join(teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(side)), f"{side}_team_id", "left")
    at = F.timestamp_seconds("ts")
    return m.select("match_id", "tournament", "winner", "loser", F.date_format(at, "yyyy-MM-dd").alias("played_on"), (F.weekday(at) + 1).cast("long").alias("weekday"), F.weekofyear(at).cast("long").alias("week"))


def last_active(matches: DataFrame, rosters: DataFrame, starts: DataFrame, cutoff: float) -> DataFrame:
    """(player_id, last_active): the latest of a player's teams' matches and of its tournaments' starts up to the cutoff.

    `matches` holds (tournament_id, team1_id, team2_id, ts), `starts` (tournament_id, ts).
    """
    m = matches.where(F.col("ts") <= cutoff).select("tournament_id", F.explode(F.array("team1_id", "team2_id")).alias("team_id"), "ts").dropna()
    m = m.groupBy("tournament_id", "team_id").agg(F.max("ts").alias("ts"))
    by_match = rosters.join(m, ["tournament_id", "team_id"]).select("user_id", "ts")
    by_start = rosters.select("tournament_id", "user_id").distinct().join(starts.where(F.col("ts") <= cutoff), "tournament_id").select("user_id", "ts")
    return by_match.unionByName(by_start).groupBy(F.col("user_id").alias("player_id")).agg(F.max("ts").alias("last_active"))


def with_mates(compacted: DataFrame) -> DataFrame:
    """(player_id, match_id, mates): the others on a player's side of each match, as text."""
    side = lambda c: compacted.select("match_id", F.col(c).alias("side"), F.explode(c).alias("player_id"))
    others = F.array_join(F.transform(F.array_sort(F.array_remove("side", F.col("player_id"))), lambda x: x.cast("string")), ",")
    return side("winners").unionByName(side("losers")).select("player_id", "match_id", others.alias("mates"))


def confidence(compacted: DataFrame, high_tournaments: int = 20, high_opponents: int = 200, high_connectivity: float = 5.0) -> DataFrame:
    """How well a rating is founded: events, matches, opponents met, composite and tier."""
    e = compacted.select("match_id", "tournament_id", F.explode("winners").alias("a"), "losers").select("match_id", "tournament_id", "a", F.explode("losers").alias("b"))
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("opp")), F.struct(F.col("b").alias("id"), F.col("a").alias("opp")))
    e = e.select("match_id", "tournament_id", F.inline(both))
    # Three distinct counts as three narrow aggregations rather than one that expands every row threefold.
    opp = e.groupBy("id", "opp").agg(F.lit(1)).groupBy("id").agg(F.count(F.lit(1)).alias("opponents"))
    per = e.select("id", "match_id", "tournament_id").distinct()
    m = per.groupBy("id", "tournament_id").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("tournaments"))
    g = written(m.join(opp, "id"), "confidence")
    players = g.count() or 1
    t, o, c = F.col("tournaments"), F.col("opponents"), F.col("connectivity")
    g = g.withColumn("connectivity", 100.0 * F.col("opponents") / F.lit(players))
    parts = {"tournaments": t / high_tournaments, "opponents": o / high_opponents, "connectivity": c / high_connectivity}
    score = sum((w * F.least(parts[k], F.lit(1)) for k, w in COMPOSITE.items()), F.lit(0.0))
    h, m, l = (TIERS[k] for k in ("high", "medium", "low"))
    tier = (
        F.when((t >= high_tournaments) | ((t >= h["tournaments"]) & (o >= high_opponents)) | ((t >= h["connected"]) & (c >= high_connectivity)), "high")
        .when((t >= m["tournaments"]) | ((t >= m["few"]) & ((o >= m["opponents"]) | (c >= m["connectivity"]))), "medium")
        .when((t >= l["tournaments"]) | ((t >= l["few"]) & (o >= l["opponents"])), "low")
        .otherwise("provisional")
    )
    effective = F.floor(F.col("matches") * F.least(F.col("opponents") / F.col("matches"), F.lit(1.0))).cast("long")
    return g.select(F.col("id").alias("player_id"), "tournaments", "matches", "opponents", "connectivity", score.alias("confidence"), tier.alias("tier"), effective.alias("effective_comparisons"))


AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "std": F.stddev_samp, "count": F.count}


def team_rating(rosters: DataFrame, ratings: DataFrame, how: str = "log_centered_mean") -> DataFrame:
    """(team_id, rating) from the members' ratings, which are positive: the geometric mean, the same after dividing all by
    their geometric mean, or an aggregate by name."""
    r = ratings.where("score is not null").select(F.col("player_id").alias("user_id"), "score")
    if how == "log_centered_mean":
        centre = r.agg(F.avg(F.log(F.col("score") + 1e-10))).first()[0] or 0.0
        r = r.withColumn("score", F.col("score") / F.lit(math.exp(centre)))
    j = rosters.select("team_id", "user_id").distinct().join(r, "user_id").groupBy("team_id")
    x = F.col("score")
    return j.agg((scalar.geometric_mean(x) if how in ("geometric", "log_centered_mean") else AGGREGATES[how](x)).alias("rating"))


def team_summary(rosters: DataFrame, matches: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per team: tournaments, members, wins, losses, mean rating."""
    size = rosters.groupBy("team_id").agg(F.countDistinct("tournament_id").alias("tournaments"), F.countDistinct("user_id").alias("members"))
    won = matches.select(F.col("winner_team_id").alias("team_id"), F.lit(1).alias("w")).unionByName(matches.select(F.col("loser_team_id").alias("team_id"), F.lit(0).alias("w")))
    won = won.groupBy("team_id").agg(F.sum("w").alias("wins"), F.sum(1 - F.col("w")).alias("losses"))
    return size.join(won, "team_id", "left").na.fill(0, ["wins", "losses"]).join(team_rating(rosters, ratings, "mean"), "team_id", "left")


def team_ratings(rosters: DataFrame, ratings: DataFrame) -> DataFrame:
    j = rosters.join(ratings.where("score is not null").select(F.col("player_id").alias("user_id"), "score"), "user_id").groupBy("tournament_id", "team_id")
    r7 = lambda c: F.round(c, 7)
    return j.agg(F.count("score").alias("rated"), r7(scalar.geometric_mean(F.exp("score"))).alias("geometric"), r7(F.avg("score")).alias("mean"), r7(F.max("score")).alias("best"), r7(F.median("score")).alias("median"))


def scaled(df: DataFrame, value: str, log: bool = False, eps: float = 1e-10) -> DataFrame:
    """`df` with the value (or its logarithm, from `eps` up) brought to 0..100 by its range, and its competition rank."""
    df = written(df, "scaled")
    x = F.log(F.greatest(F.col(value), F.lit(eps))) if log else F.col(value)
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = (high - low) if low is not None and high > low else None
    s = 100 * (x - F.lit(low)) / F.lit(width) if width else F.lit(0.0)
    return competition_rank(df.withColumn("scaled", s), value, "rank")

