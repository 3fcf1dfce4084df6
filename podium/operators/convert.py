"""Matches as weighted contests between lists of players.

Inputs: matches (match_id, tournament_id, winner_team_id, loser_team_id, ts, is_bye), rosters (tournament_id, team_id,
user_id), appearances (tournament_id, match_id, user_id, team_id). Null keys never match; a null bye is none; repeated
rows of rosters and appearances count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.runtime import broadcast_if_small


def valid(matches: DataFrame) -> DataFrame:
    """Matches with two teams that aren't byes."""
    ok = F.col("winner_team_id").isNotNull() & F.col("loser_team_id").isNotNull()
    return matches.where(ok & ~F.coalesce(F.col("is_bye"), F.lit(False)) if "is_bye" in matches.columns else ok)


def weighted(matches: DataFrame, now: float, rate: float, influence: DataFrame | None = None, beta: float = 1.0) -> DataFrame:
    """Valid matches with weight = decay x influence^beta; a tournament without influence has 1."""
    m = valid(matches)
    w = scalar.decay(F.col("ts"), now, rate)
    if influence is not None and beta:
        m = m.join(broadcast_if_small(influence.select("tournament_id", "strength")), "tournament_id", "left")
        w = w * F.pow(F.coalesce("strength", F.lit(1.0)), F.lit(beta))
        return m.withColumn("weight", w).drop("strength")
    return m.withColumn("weight", w)


def roster_lists(rosters: DataFrame) -> DataFrame:
    g = rosters.dropna(subset=["tournament_id", "team_id", "user_id"]).groupBy("tournament_id", "team_id")
    return g.agg(F.array_sort(F.collect_set("user_id")).alias("roster"))


def inferred(appearances: DataFrame, rosters: DataFrame) -> DataFrame:
    """Appearances with `team_id` from the roster where it is null: one row per possible team."""
    r = rosters.select("tournament_id", "user_id", F.col("team_id").alias("roster_team")).dropna().distinct()
    a = appearances.join(r, ["tournament_id", "user_id"], "left")
    return a.withColumn("team_id", F.coalesce("team_id", "roster_team")).drop("roster_team")


def played_lists(appearances: DataFrame, rosters: DataFrame, named: bool = False) -> DataFrame:
    a = (appearances if named else inferred(appearances, rosters)).dropna(subset=["tournament_id", "match_id", "team_id", "user_id"])
    return a.groupBy("tournament_id", "match_id", "team_id").agg(F.array_sort(F.collect_set("user_id")).alias("played"))


def compact(weights: DataFrame, rosters: DataFrame, appearances: DataFrame | None = None, share: bool = True, named: bool = False) -> DataFrame:
    """One row per match: winners, losers (who played, else the roster), weight, ts, counts and the share of a pair.

    named: every appearance names its team, so no roster is asked for it.
    """
    rl = roster_lists(rosters)
    m = weights
    for side in ("winner", "loser"):
        m = m.join(rl.withColumnsRenamed({"team_id": f"{side}_team_id", "roster": f"{side}_roster"}), ["tournament_id", f"{side}_team_id"], "left")
    if appearances is not None:
        pl = played_lists(appearances, rosters, named)
        for side in ("winner", "loser"):
            m = m.join(pl.withColumnsRenamed({"team_id": f"{side}_team_id", "played": f"{side}_played"}), ["tournament_id", "match_id", f"{side}_team_id"], "left")
    who = lambda s: F.coalesce(*([F.col(f"{s}_played")] if appearances is not None else []), F.col(f"{s}_roster"))
    m = m.select("match_id", "tournament_id", who("winner").alias("winners"), who("loser").alias("losers"), "weight", "ts").where("winners is not null and losers is not null")
    if not share:
        return m
    m = m.withColumns({"winner_count": F.size("winners"), "loser_count": F.size("losers")})
    return m.withColumn("share", F.col("weight") / (F.col("winner_count") * F.col("loser_count")))


def scaled(compacted: DataFrame, influence: DataFrame, beta: float = 1.0) -> DataFrame:
    """Compact matches with weight and share x influence^beta, as `compact` of matches `weighted` by influence has them."""
    x = F.pow(F.coalesce("strength", F.lit(1.0)), F.lit(beta))
    j = compacted.join(broadcast_if_small(influence.select("tournament_id", "strength")), "tournament_id", "left")
    return j.withColumns({c: F.col(c) * x for c in ("weight", "share") if c in compacted.columns}).select(*compacted.columns)


def team_edges(weights: DataFrame) -> DataFrame:
    """(loser, winner, weight_sum) between teams."""
    g = weights.groupBy(F.col("loser_team_id").alias("loser"), F.col("winner_team_id").alias("winner"))
    return g.agg(F.sum("weight").alias("weight_sum"))


def player_edges(weights: DataFrame, rosters: DataFrame, also: list[str] = ()) -> DataFrame:
    """(loser, winner, weight_sum) between the rosters' players, over all pairs of a match, and per `also` columns."""
    r = rosters.select("tournament_id", "team_id", "user_id").dropna().distinct()
    side = lambda s: weights.select("match_id", "tournament_id", F.col(f"{s}_team_id").alias("team_id"), "weight").join(r, ["tournament_id", "team_id"])
    pairs = side("loser").select("match_id", "tournament_id", "weight", F.col("user_id").alias("loser"))
    pairs = pairs.join(side("winner").select("match_id", "tournament_id", F.col("user_id").alias("winner")), ["match_id", "tournament_id"])
    return pairs.groupBy("loser", "winner", *also).agg(F.sum("weight").alias("weight_sum"))


def roster_sides(weights: DataFrame, rosters: DataFrame) -> DataFrame:
    """(tournament_id, winners, losers, weight_sum): the rosters and the summed weight of a tournament's matches that one team
    won against another. Each pair of a loser and a winner has that weight in `player_edges`."""
    m = weights.where("match_id is not null").groupBy("tournament_id", "winner_team_id", "loser_team_id").agg(F.sum("weight").alias("weight_sum"))
    rl = roster_lists(rosters)
    for team, who in (("winner_team_id", "winners"), ("loser_team_id", "losers")):
        m = m.join(rl.withColumnsRenamed({"team_id": team, "roster": who}), ["tournament_id", team])
    return m.select("tournament_id", "winners", "losers", "weight_sum")


def share_edges(compacted: DataFrame) -> DataFrame:
    """(loser, winner, weight_sum) of the shares of compact matches."""
    e = compacted.select(F.explode("winners").alias("winner"), "losers", "share").select("winner", F.explode("losers").alias("loser"), "share")
    return e.groupBy("loser", "winner").agg(F.sum("share").alias("weight_sum"))


def exposure(compacted: DataFrame) -> DataFrame:
    """(id, exposure, e_share): summed weight and share of the matches that a player was in."""
    e = compacted.select(F.explode(F.concat("winners", "losers")).alias("id"), "weight", "share")
    return e.groupBy("id").agg(F.sum("weight").alias("exposure"), F.sum("share").alias("e_share"))


def last_activity(compacted: DataFrame) -> DataFrame:
    e = compacted.select(F.explode(F.concat("winners", "losers")).alias("id"), "ts")
    return e.groupBy("id").agg(F.max("ts").alias("last_ts"))


def inactivity(score: Column, last_ts: Column, now: float, delay_days: float, rate: float, compound: bool = False) -> Column:
    """score x exp(-rate x days beyond the delay), or x (1 - rate)^days. A negative score moves up to 0 by it too."""
    late = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(last_ts, F.lit(now))) / scalar.DAY - delay_days)
    return score * (F.pow(F.lit(1 - rate), late) if compound else F.exp(-rate * late))


def strict_4v4(matches: DataFrame, rosters: DataFrame, appearances: DataFrame | None, size: int = 4) -> DataFrame:
    """Matches with exactly four different players seen on each side; all of them if nobody's appearance is known."""
    if appearances is None:
        return matches
    a = inferred(appearances, rosters).dropna(subset=["match_id", "team_id", "user_id"])
    n = a.groupBy("tournament_id", "match_id", "team_id").agg(F.countDistinct("user_id").alias("n")).where(F.col("n") == size)
    m = matches
    for side in ("winner", "loser"):
        m = m.join(n.select("tournament_id", "match_id", F.col("team_id").alias(f"{side}_team_id")), ["tournament_id", "match_id", f"{side}_team_id"], "left_semi")
    return m


def borrowed_rosters(matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """Rosters, and for teams that played without one that of the same team in its smallest tournament."""
    used = matches.select("tournament_id", F.col("winner_team_id").alias("team_id")).unionByName(matches.select("tournament_id", F.col("loser_team_id").alias("team_id")))
    missing = used.dropna().distinct().join(rosters, ["tournament_id", "team_id"], "left_anti")
    source = rosters.groupBy("team_id").agg(F.min("tournament_id").alias("from_tournament"))
    lent = missing.join(source, "team_id").join(rosters.withColumnRenamed("tournament_id", "from_tournament"), ["from_tournament", "team_id"])
    return rosters.select("tournament_id", "team_id", "user_id").unionByName(lent.select("tournament_id", "team_id", "user_id")).distinct()


def promoted(appearances: DataFrame, rosters: DataFrame) -> DataFrame:
    """(tournament_id, user_id, team_id) of those who appear for a team but are on no roster: their most frequent team."""
    a = appearances.dropna(subset=["tournament_id", "user_id", "team_id"]).join(rosters, ["tournament_id", "user_id"], "left_anti")
    n = a.groupBy("tournament_id", "user_id", "team_id").count()
    best = F.min_by("team_id", F.struct(-F.col("count"), F.col("team_id")))
    return n.groupBy("tournament_id", "user_id").agg(best.alias("team_id"))


def legacy_appearances(appearances: DataFrame, matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """Distinct appearances in the given matches of players on a roster of their tournament, with their team; those whose
    team isn't known are left out."""
    a = appearances.join(matches.select("tournament_id", "match_id").dropna().distinct(), ["tournament_id", "match_id"], "left_semi")
    r = rosters.select("tournament_id", "user_id", F.col("team_id").alias("roster_team")).dropna(subset=["tournament_id", "user_id"]).distinct()
    a = a.join(r, ["tournament_id", "user_id"]).withColumn("team_id", F.coalesce("team_id", "roster_team"))
    return a.where("team_id is not null").select("tournament_id", "match_id", "user_id", "team_id").distinct()


def enriched(appearances: DataFrame, matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """Appearances with a team where none is named: the roster's, else the side of the match whose roster has fewer of the
    match's players; equal sides leave it open.

    `matches` holds (match_id, team1_id, team2_id). Sides are counted per match, players are never compared with each other.
    """
    base = inferred(appearances, rosters)
    sides = matches.select("match_id", "team1_id", "team2_id").where("team1_id is not null and team2_id is not null")
    r = rosters.select("tournament_id", "user_id", F.col("team_id").alias("__t")).dropna().distinct()
    seen = appearances.select("tournament_id", "match_id", "user_id").distinct().join(r, ["tournament_id", "user_id"]).join(sides, "match_id")
    n = seen.groupBy("tournament_id", "match_id").agg(F.count_if(F.col("__t") == F.col("team1_id")).alias("__n1"), F.count_if(F.col("__t") == F.col("team2_id")).alias("__n2"))
    j = base.join(sides, "match_id", "left").join(n, ["tournament_id", "match_id"], "left").na.fill(0, ["__n1", "__n2"])
    smaller = F.when(F.col("__n1") < F.col("__n2"), F.col("team1_id")).when(F.col("__n2") < F.col("__n1"), F.col("team2_id"))
    return j.withColumn("team_id", F.coalesce("team_id", smaller)).select(*base.columns)


def from_cache(appearances: DataFrame, cache: DataFrame) -> DataFrame:
    """Appearances with the cache's team where they name none; of several cached teams the largest counts."""
    c = cache.dropna(subset=["tournament_id", "match_id", "user_id"]).groupBy("tournament_id", "match_id", "user_id").agg(F.max("team_id").alias("__cached"))
    j = appearances.join(c, ["tournament_id", "match_id", "user_id"], "left")
    return j.withColumn("team_id", F.coalesce("team_id", "__cached")).drop("__cached")


def unrated_filter(matches: DataFrame, rosters: DataFrame, ratings: DataFrame, most: int = 1) -> DataFrame:
    """Matches with at most `most` unrated players on either roster; a missing roster has none."""
    return rated_ratio(matches, rosters, ratings).where((F.col("winner_unrated") <= most) & (F.col("loser_unrated") <= most))


def exclusion_impact(matches: DataFrame, rosters: DataFrame, ratings: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Per tournament: matches kept and left out by the rated-share filter, and the share left out."""
    x = rated_ratio(matches, rosters, ratings)
    kept = (F.col("winner_ratio") >= threshold) & (F.col("loser_ratio") >= threshold)
    g = x.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(kept).alias("kept"))
    return g.withColumns({"excluded": F.col("matches") - F.col("kept"), "excluded_share": 1 - F.col("kept") / F.col("matches")})


def ranked_stats(tournaments: DataFrame, matches: DataFrame, rosters: DataFrame, ranked: DataFrame) -> DataFrame:
    """(what, total, ranked, percent): tournaments, matches, teams and players, and those of the ranked tournaments."""
    ids = ranked.select("tournament_id").distinct()
    parts = {"tournaments": tournaments.select("tournament_id").distinct(), "matches": matches.select("tournament_id", "match_id"), "teams": rosters.select("tournament_id", "team_id").distinct(), "entries": rosters}
    out = None
    for name, df in parts.items():
        j = df.join(ids.withColumn("__ok", F.lit(True)), "tournament_id", "left")
        row = j.agg(F.count(F.lit(1)).alias("total"), F.count("__ok").alias("ranked")).select(F.lit(name).alias("what"), "total", "ranked")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("ranked"), "total"), F.lit(0.0)))


def player_stats(matches: DataFrame, rosters: DataFrame, appearances: DataFrame | None = None) -> DataFrame:
    """(user_id, tournament_count, last_active_ms): by appearances if there are any, else by rosters."""
    t = matches.groupBy("tournament_id").agg(F.max("ts").alias("last"))
    who = (rosters if appearances is None else appearances).select("tournament_id", "user_id").dropna().distinct()
    return who.join(t, "tournament_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("tournament_count"), (F.max("last") * 1000).alias("last_active_ms"))


def ranked_tournaments(tournaments: DataFrame, matches: DataFrame, rosters: DataFrame, min_teams: int = 4, min_players: int = 16, min_matches: int = 10, force_include: list[int] | None = None, before: float | None = None, buffer_weeks: float = 0.0) -> DataFrame:
    """Ids of tournaments that are large enough and no tests by name, and those that are always included; with `before` (s)
    only those whose last match ended at least `buffer_weeks` earlier."""
    teams = rosters.groupBy("tournament_id").agg(F.countDistinct("team_id").alias("teams"), F.countDistinct("user_id").alias("players"))
    games = matches.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("matches"))
    named = tournaments.groupBy("tournament_id").agg(F.max(F.coalesce("name", F.lit(""))).alias("name"))
    t = named.join(teams, "tournament_id", "left").join(games, "tournament_id", "left").na.fill(0, ["teams", "players", "matches"])
    ok = (F.col("teams") >= min_teams) & (F.col("players") >= min_players) & (F.col("matches") >= min_matches) & ~F.col("name").rlike("(?i)test|debug|demo|practice")
    if before is not None:
        t = t.join(matches.groupBy("tournament_id").agg(F.max("ts").alias("__last")), "tournament_id", "left").where(F.col("__last") <= before - buffer_weeks * 7 * scalar.DAY)
    return t.where(ok | F.col("tournament_id").isin(force_include or [])).select("tournament_id", "teams", "players", "matches")


def rated_ratio(matches: DataFrame, rosters: DataFrame, ratings: DataFrame) -> DataFrame:
    """Matches with the rated share and unrated number of both rosters; an empty roster has ratio 0 and nobody unrated."""
    r = rosters.select("tournament_id", "team_id", "user_id").dropna().distinct().join(ratings.select(F.col("id").alias("user_id"), F.lit(1).alias("rated")), "user_id", "left")
    g = r.groupBy("tournament_id", "team_id").agg((F.count("rated") / F.count(F.lit(1))).alias("ratio"), (F.count(F.lit(1)) - F.count("rated")).alias("unrated"))
    m = matches
    for s in ("winner", "loser"):
        m = m.join(g.withColumnsRenamed({"team_id": f"{s}_team_id", "ratio": f"{s}_ratio", "unrated": f"{s}_unrated"}), ["tournament_id", f"{s}_team_id"], "left")
    return m.na.fill(0.0, ["winner_ratio", "loser_ratio"]).na.fill(0, ["winner_unrated", "loser_unrated"])
