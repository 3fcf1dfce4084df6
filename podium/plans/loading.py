"""Queries of loaders, filters, summaries, the production run and the queue's documents, each with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.operators import batch, convert, evaluate, graph, loo, predict, quality, queue, summary
from podium.plans import analytics, reference
from podium.plans.analytics import evaluated
from podium.runtime import table, written
from podium.sources import domain, loaders, queue_docs, store
from podium.sources.domain import NOW, sql
from podium.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The window of the loaders' queries: the year 2024.
SINCE, UNTIL = 1704067200000, 1735689600000


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_round = analytics._round

# ---- loaders

_START = f"""SELECT tournament_id, CAST(floor({domain._epoch_sql("x")} * 1000) AS BIGINT) AS start_ms FROM (SELECT tournament_id, start_time_ms::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY tournament_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(start_time_ms, -1) DESC) AS rn FROM tournaments WHERE tournament_id IS NOT NULL) WHERE rn = 1)"""
_LOADED = "SELECT mm.*, coalesce(mm.ts * 1000, start_ms) AS event_ms FROM mm LEFT JOIN st USING (tournament_id)"


@query(sql("mm", "SELECT match_id, tournament_id, winner_team_id, loser_team_id, event_ms FROM x", st=_START, x=_LOADED))
def load_all_matches(s, d):
    """Every match with its end, creation or tournament's start."""
    return loaders.matches(s, d).select("match_id", "tournament_id", "winner_team_id", "loser_team_id", "event_ms")


@query(sql("mm t", f"SELECT match_id, x.tournament_id, event_ms FROM x JOIN t ON t.tournament_id = x.tournament_id AND t.is_ranked WHERE event_ms >= {SINCE} AND event_ms <= {UNTIL}", st=_START, x=_LOADED))
def load_window_matches(s, d):
    """Ranked matches of a year."""
    return loaders.matches(s, d, SINCE, UNTIL, only_ranked=True).select("match_id", "tournament_id", "event_ms")


@query(sql("mm a", f"SELECT tournament_id, match_id, user_id, team_id FROM a WHERE match_id IN (SELECT match_id FROM x WHERE event_ms >= {SINCE} AND event_ms <= {UNTIL})", st=_START, x=_LOADED))
def load_window_appearances(s, d):
    """Appearances in the matches of a year."""
    return loaders.appearances(s, d, SINCE, UNTIL).select("tournament_id", "match_id", "user_id", "team_id")


@query(sql("a", "SELECT tournament_id, match_id, user_id, team_id FROM a WHERE team_id IS NOT NULL"))
def load_appearance_teams(s, d):
    return loaders.appearance_teams(s, d)


@query("SELECT count(*) AS rows, count(DISTINCT player_id) AS players FROM rankings WHERE player_id IS NOT NULL AND build_version = (SELECT max(build_version) FROM rankings) AND calculated_at_ms = (SELECT max(calculated_at_ms) FROM rankings WHERE build_version = (SELECT max(build_version) FROM rankings))")
def load_ranking_stats(s, d):
    """The rows of one build and run."""
    r = table(s, d, "rankings")
    build = r.agg(F.max("build_version")).first()[0]
    at = r.where(F.col("build_version") == build).agg(F.max("calculated_at_ms")).first()[0]
    return loaders.ranking_stats(s, d, build, at).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("player_id").alias("players"))


@query("SELECT CAST(coalesce(max(match_id), 0) AS BIGINT) AS latest FROM matches")
def latest_match_number(s, d):
    return s.createDataFrame([(loaders.latest_number(table(s, d, "matches")),)], "latest long")


@query(sql("t mm", "SELECT t.name, count(*) AS matches FROM t JOIN mm USING (tournament_id) WHERE mm.ts >= 1704067200 GROUP BY 1"))
def statement_with_parameters(s, d):
    """A statement over registered tables with a named parameter."""
    domain.matches(s, d).createOrReplaceTempView("podium_matches")
    domain.tournaments(s, d).createOrReplaceTempView("podium_tournaments")
    return loaders.read_sql(s, "SELECT t.name, count(*) AS matches FROM podium_tournaments t JOIN podium_matches m USING (tournament_id) WHERE m.ts >= :since GROUP BY 1", since=1704067200)


# ---- filters and summaries

_RATIOS = reference._RATIO


@query(sql("m r last", "SELECT m.match_id, coalesce(w.unrated, 0) AS winner_unrated, coalesce(l.unrated, 0) AS loser_unrated FROM m LEFT JOIN q w ON w.tournament_id = m.tournament_id AND w.team_id = winner_team_id LEFT JOIN q l ON l.tournament_id = m.tournament_id AND l.team_id = loser_team_id WHERE coalesce(w.unrated, 0) <= 1 AND coalesce(l.unrated, 0) <= 1", q=_RATIOS))
def unrated_count_filter(s, d):
    rated = domain.latest_run(s, d).where("score is not null").select(F.col("player_id").alias("id"))
    return convert.unrated_filter(domain.played(s, d), domain.rosters(s, d), rated).select("match_id", "winner_unrated", "loser_unrated")


@query(sql("m r last", "SELECT tournament_id, count(*) AS matches, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS excluded, round(avg((NOT ok)::INT), 8) AS excluded_share FROM (SELECT m.tournament_id, coalesce(w.ratio, 0) >= 0.75 AND coalesce(l.ratio, 0) >= 0.75 AS ok FROM m LEFT JOIN q w ON w.tournament_id = m.tournament_id AND w.team_id = winner_team_id LEFT JOIN q l ON l.tournament_id = m.tournament_id AND l.team_id = loser_team_id) GROUP BY 1", q=_RATIOS))
def exclusion_impact(s, d):
    """What the rated-share filter leaves out, per tournament."""
    rated = domain.latest_run(s, d).where("score is not null").select(F.col("player_id").alias("id"))
    return _round(convert.exclusion_impact(domain.played(s, d), domain.rosters(s, d), rated), 8)


_PARTS = {"tournaments": "SELECT DISTINCT tournament_id FROM t", "matches": "SELECT tournament_id FROM m", "teams": "SELECT DISTINCT tournament_id, team_id FROM r", "entries": "SELECT * FROM r"}


@query(sql("t m r", " UNION ALL ".join(f"SELECT '{k}' AS what, count(*) AS total, count(*) FILTER (tournament_id IN (SELECT tournament_id FROM ok)) AS ranked, round(100.0 * count(*) FILTER (tournament_id IN (SELECT tournament_id FROM ok)) / count(*), 6) AS percent FROM ({q})" for k, q in _PARTS.items()), ok=reference._RANKED))
def ranked_share(s, d):
    """How much of everything belongs to ranked tournaments."""
    t, m, r = domain.tournaments(s, d), domain.played(s, d), domain.rosters(s, d)
    return _round(convert.ranked_stats(t, m, r, convert.ranked_tournaments(t, m, r)), 6)


@query(sql("t m r", "SELECT x.tournament_id FROM ok x JOIN (SELECT tournament_id, max(ts) AS last FROM m GROUP BY 1) USING (tournament_id) WHERE last <= 1735689600 - 4 * 604800", ok=reference._RANKED))
def ranked_before(s, d):
    """Ranked tournaments that ended at least four weeks before 2025."""
    return convert.ranked_tournaments(domain.tournaments(s, d), domain.played(s, d), domain.rosters(s, d), before=1735689600.0, buffer_weeks=4).select("tournament_id")


_KEPT = "SELECT DISTINCT a.tournament_id, a.match_id, a.user_id, coalesce(a.team_id, r.team_id) AS team_id FROM a JOIN m ON m.match_id = a.match_id AND m.tournament_id = a.tournament_id JOIN r ON r.tournament_id = a.tournament_id AND r.user_id = a.user_id"


@query(sql("m a r", _KEPT))
def legacy_appearances(s, d):
    """Appearances in played matches by players on a roster, with their team."""
    return convert.legacy_appearances(domain.appearances(s, d), domain.played(s, d), domain.rosters(s, d))


@query(sql("mm a r", """SELECT b.tournament_id, b.match_id, b.user_id, coalesce(b.team_id, CASE WHEN n1 < n2 THEN team1_id WHEN n2 < n1 THEN team2_id END) AS team_id FROM b LEFT JOIN sides ON sides.match_id = b.match_id LEFT JOIN n ON n.tournament_id = b.tournament_id AND n.match_id = b.match_id""",
  b="SELECT a.tournament_id, a.match_id, a.user_id, coalesce(a.team_id, r.team_id) AS team_id FROM a LEFT JOIN r ON r.tournament_id = a.tournament_id AND r.user_id = a.user_id",
  sides="SELECT match_id, team1_id, team2_id FROM mm WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL",
  n="SELECT b.tournament_id, b.match_id, coalesce(any_value(n1), 0) AS n1, coalesce(any_value(n2), 0) AS n2 FROM b LEFT JOIN (SELECT a.tournament_id, a.match_id, count(*) FILTER (r.team_id = team1_id) AS n1, count(*) FILTER (r.team_id = team2_id) AS n2 FROM a JOIN r ON r.tournament_id = a.tournament_id AND r.user_id = a.user_id JOIN sides ON sides.match_id = a.match_id GROUP BY ALL) c ON c.tournament_id = b.tournament_id AND c.match_id = b.match_id GROUP BY ALL"))
def enriched_appearances(s, d):
    """Appearances with the team that the roster or the shorter side suggests."""
    return convert.enriched(domain.appearances(s, d), domain.matches(s, d), domain.rosters(s, d)).select("tournament_id", "match_id", "user_id", "team_id")


@query(sql("a r", "SELECT a.tournament_id, a.match_id, a.user_id, coalesce(a.team_id, c.team_id) AS team_id FROM a LEFT JOIN (SELECT a.tournament_id, a.match_id, a.user_id, max(r.team_id) AS team_id FROM a JOIN r ON r.tournament_id = a.tournament_id AND r.user_id = a.user_id GROUP BY ALL) c ON c.tournament_id = a.tournament_id AND c.match_id = a.match_id AND c.user_id = a.user_id"))
def cached_appearances(s, d):
    """Appearances with a cache of earlier assignments (here the rosters') where they name no team."""
    a = domain.appearances(s, d)
    cache = a.drop("team_id").join(domain.rosters(s, d), ["tournament_id", "user_id"])
    return convert.from_cache(a, cache).select("tournament_id", "match_id", "user_id", "team_id")


def _cased(x: str, breaks: list, labels: list) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN '{g}'" for b, g in zip(breaks, labels, strict=False)) + f" ELSE '{labels[-1]}' END"


@query(sql("last", "SELECT player_id, " + ", ".join(f"{_cased(x, b, g)} AS grade_{n}" for n, (x, b, g) in summary.SYSTEMS.items()) + " FROM z", z="SELECT player_id, score, 1500 + 400 * score AS elo, row_number() OVER (ORDER BY score DESC, player_id) * 1.0 / count(*) OVER () AS pct FROM last WHERE score IS NOT NULL"))
def graded_players(s, d):
    """Players' grades under five systems."""
    return summary.graded(domain.latest_run(s, d)).select("player_id", *[f"grade_{n}" for n in summary.SYSTEMS])


@query("SELECT grade, coalesce(max(percent) FILTER (system = 'score'), 0) AS score, coalesce(max(percent) FILTER (system = 'percentile'), 0) AS percentile, coalesce(max(percent) FILTER (system = 'elo'), 0) AS elo FROM (" + reference.SQL["grade_distributions"] + ") GROUP BY 1")
def grade_table(s, d):
    """Percentages of grades, a column per system."""
    return summary.grade_table(reference.grade_distributions(s, d), ("score", "percentile", "elo"))


@query(sql("m a last", f"""SELECT player_id, round({NOW} / 86400.0 - last_active_ms / 86400000.0, 6) AS days_inactive, round(CASE WHEN {NOW} / 86400.0 - last_active_ms / 86400000.0 > 30 THEN score * 25 * exp(-({NOW} / 86400.0 - last_active_ms / 86400000.0 - 30) * 0.01) ELSE score * 25 END, 6) AS display_score_decayed FROM last JOIN q ON q.user_id = player_id WHERE score IS NOT NULL""", q=reference._STATS))
def decayed_display(s, d):
    """Display scores that fall with inactivity."""
    st = convert.player_stats(domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d)).withColumnRenamed("user_id", "player_id")
    r = domain.latest_run(s, d).where("score is not null").join(st, "player_id").select("player_id", (F.col("score") * 25).alias("display_score"), (F.col("last_active_ms") / 1000).alias("last_active"))
    return _round(summary.displayed(r, NOW).select("player_id", "days_inactive", "display_score_decayed"), 6)


@query(sql("last", "SELECT player_id, round(100 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS scaled, rank() OVER (ORDER BY win_pr DESC) AS rank FROM (SELECT player_id, win_pr, ln(greatest(win_pr, 1e-10)) AS x FROM last WHERE win_pr IS NOT NULL)"))
def log_scaled_players(s, d):
    """Win mass scaled to 0..100 by its logarithm."""
    r = summary.scaled(domain.latest_run(s, d).where("win_pr is not null").select("player_id", "win_pr"), "win_pr", log=True)
    return r.select("player_id", F.round("scaled", 6).alias("scaled"), F.col("rank").cast("long").alias("rank"))


_POS = "SELECT player_id, win_pr AS score FROM last WHERE win_pr IS NOT NULL"


@query(sql("r m last", "SELECT x.team_id, tournaments, members, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, round(rating, 9) AS rating, round(centred, 6) AS centred FROM (SELECT team_id, count(DISTINCT tournament_id) AS tournaments, count(DISTINCT user_id) AS members FROM r GROUP BY 1) x LEFT JOIN (SELECT team_id, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(1 - w) AS BIGINT) AS losses FROM (SELECT winner_team_id AS team_id, 1 AS w FROM m UNION ALL SELECT loser_team_id, 0 FROM m) GROUP BY 1) y USING (team_id) LEFT JOIN (SELECT team_id, avg(score) AS rating, exp(avg(ln(score / (SELECT exp(avg(ln(score + 1e-10))) FROM pos) + 1e-10))) AS centred FROM (SELECT DISTINCT team_id, user_id FROM r) JOIN pos ON player_id = user_id GROUP BY 1) z USING (team_id)", pos=_POS))
def team_summary(s, d):
    """Teams with tournaments, members, results, and their members' mean and log-centred mean of win mass."""
    ratings = written(domain.latest_run(s, d).where("win_pr is not null").select("player_id", F.col("win_pr").alias("score")), "ratings")
    r = domain.rosters(s, d)
    t = summary.team_summary(r, domain.played(s, d), ratings).join(summary.team_rating(r, ratings).withColumnRenamed("rating", "centred"), "team_id", "left")
    return t.select("team_id", "tournaments", "members", "wins", "losses", F.round("rating", 9).alias("rating"), F.round("centred", 6).alias("centred"))


@query(sql("r last", "SELECT division, count(*) AS teams, round(avg(rating), 6) AS mean, round(min(rating), 6) AS lowest, round(max(rating), 6) AS highest FROM (SELECT round(rating, 7) AS rating, CASE WHEN k <= 16 THEN 'Division 1' WHEN k <= 48 THEN 'Division 2' ELSE 'Division 3' END AS division FROM (SELECT rating, row_number() OVER (ORDER BY round(rating, 7) DESC, tournament_id, team_id) AS k FROM ent)) GROUP BY 1", mem=analytics._MEMBERS, ent=analytics._ENT))
def division_statistics(s, d):
    e = _round(predict.entropy_rating(analytics._members(s, d)))
    return _round(predict.division_statistics(predict.divisions(e, "rating", ["tournament_id", "team_id"]), "rating"), 6)


@query(sql("r last", "SELECT tournament_id, team_id, seed, CASE WHEN seed <= 4 THEN 'gold' WHEN seed <= 12 THEN 'silver' END AS bracket FROM (SELECT tournament_id, team_id, row_number() OVER (PARTITION BY tournament_id ORDER BY round(rating, 7) DESC, team_id) AS seed FROM ent)", mem=analytics._MEMBERS, ent=analytics._ENT))
def team_brackets(s, d):
    """Every tournament's teams in brackets of four and eight."""
    e = _round(predict.entropy_rating(analytics._members(s, d)))
    b = predict.brackets(e, "tournament_id", "rating", ["team_id"], [("gold", 4), ("silver", 8)])
    return b.select("tournament_id", "team_id", F.col("seed").cast("long").alias("seed"), "bracket")


@query(sql("m r last", "SELECT tournament_id, count(*) AS teams, round(avg((seed = place)::INT), 8) AS exact, round(avg((abs(seed - place) <= 1)::INT), 8) AS within_1, round(avg((abs(seed - place) <= 2)::INT), 8) AS within_2 FROM z GROUP BY 1",
  mem=analytics._MEMBERS, lse=analytics._LSE, wins="SELECT tournament_id, team_id, sum(w) AS wins FROM (SELECT tournament_id, winner_team_id AS team_id, 1 AS w FROM m UNION ALL SELECT tournament_id, loser_team_id, 0 FROM m) GROUP BY ALL",
  z="""SELECT s.tournament_id, seed, place FROM (SELECT tournament_id, team_id, row_number() OVER (PARTITION BY tournament_id ORDER BY round(log_rating, 9) DESC, team_id) AS seed FROM lse) s JOIN (SELECT tournament_id, team_id, row_number() OVER (PARTITION BY tournament_id ORDER BY wins DESC, team_id) AS place FROM wins) p USING (tournament_id, team_id)"""))
def seed_accuracy(s, d):
    """How often seeds by team strength are the places by wins, within one, within two."""
    t = predict.team_log_rating(analytics._members(s, d)).withColumn("log_rating", F.round("log_rating", 9))
    m = domain.played(s, d).where("tournament_id is not null")
    wins = m.select("tournament_id", F.col("winner_team_id").alias("team_id"), F.lit(1).alias("w")).unionByName(m.select("tournament_id", F.col("loser_team_id").alias("team_id"), F.lit(0).alias("w")))
    wins = wins.groupBy("tournament_id", "team_id").agg(F.sum("w").alias("log_rating"))
    places = predict.seeds(wins).select("tournament_id", "team_id", F.col("seed").alias("place"))
    return _round(predict.seed_accuracy(predict.seeds(t), places), 8)


@query(sql("r last", "SELECT tournament_id, team_id, round(sum(exp(score)), 7) AS strength, count(*) AS members FROM mem GROUP BY ALL", mem=analytics._MEMBERS))
def weighted_team_strength(s, d):
    return _round(predict.weighted_strength(analytics._members(s, d)))


@query(evaluated("", "SELECT match_id, round(p * p * (1 + 2 * (1 - p)), 7) AS best_of_3, round(p * p * p * (1 + 3 * (1 - p) + 6 * (1 - p) * (1 - p)), 7) AS best_of_5 FROM e"))
def series_chances(s, d):
    """Chances to win a series of three or five games."""
    p = F.col("p")
    return _round(analytics._pred(s, d).select("match_id", predict.series_probability(p, 3).alias("best_of_3"), predict.series_probability(p, 5).alias("best_of_5")))


@query("SELECT range AS window, 1704067200 + range * 604800 AS first, least(1704067200 + range * 604800 + 1209600, 1735689600) AS last FROM range(53)")
def time_windows(s, d):
    """Windows of two weeks that begin every week of a year."""
    return scalar.time_windows(s, 1704067200, 1735689600, 1209600, 604800)


@query("SELECT CAST(isoyear(x) AS BIGINT) AS year, CAST(weekofyear(x) AS BIGINT) AS week, strftime(x, '%Y-%m-%d') AS monday FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2025-01-02', INTERVAL 7 DAY)) AS x)")
def calendar_weeks(s, d):
    w = scalar.weeks(s, "2023-12-29", "2025-01-02")
    return w.select(F.col("year").cast("long").alias("year"), F.col("week").cast("long").alias("week"), F.col("monday").cast("string").alias("monday"))


_LOG = "SELECT (ln(greatest(coalesce(wr, 0.05), 1e-12)) - ln(greatest(coalesce(lr, 0.05), 1e-12))) AS gap FROM e"
_GAPS = "SELECT w.log_rating - l.log_rating AS gap, m.ts, m.match_id, CASE WHEN total_games IS NULL THEN 'unknown' WHEN total_games <= 3 THEN 'short' ELSE 'long' END AS format FROM m JOIN lse w ON w.tournament_id = m.tournament_id AND w.team_id = winner_team_id JOIN lse l ON l.tournament_id = m.tournament_id AND l.team_id = loser_team_id"


def _gaps(s: SparkSession, d: str) -> DataFrame:
    t = predict.team_log_rating(analytics._members(s, d)).select("tournament_id", "team_id", "log_rating")
    m = domain.played(s, d)
    for side in ("winner", "loser"):
        m = m.join(t.withColumnsRenamed({"team_id": f"{side}_team_id", "log_rating": side}), ["tournament_id", f"{side}_team_id"])
    kind = F.when(F.col("total_games").isNull(), "unknown").when(F.col("total_games") <= 3, "short").otherwise("long")
    return m.select((F.col("winner") - F.col("loser")).alias("gap"), "ts", "match_id", kind.alias("format"))


_NEWTON = "SELECT {g}, 0 AS i, 0.0::DOUBLE AS b FROM (SELECT DISTINCT {g} FROM gp) UNION ALL SELECT {g}, any_value(i) + 1, any_value(b) + greatest(-5, least(5, sum((1 - p) * gap) / (sum(p * (1 - p) * gap * gap) + {eps}))) FROM (SELECT nw.{g}, i, b, gap, 1 / (1 + exp(-b * gap)) AS p FROM nw JOIN gp ON gp.{g} = nw.{g} WHERE i < 25) GROUP BY {g}"


@query(sql("m r last", "SELECT format, rows, round(CASE WHEN rows * 2 >= 20 THEN b ELSE (SELECT b FROM base) END, 5) AS slope FROM (SELECT format, b FROM nw WHERE i = 25) JOIN (SELECT format, count(*) AS rows FROM gp GROUP BY 1) USING (format)",
  mem=analytics._MEMBERS, lse=analytics._LSE, gp=_GAPS, nw=_NEWTON.format(g="format", eps="1e-9"), gq="SELECT 'all' AS one, gap FROM gp",
  bb=_NEWTON.format(g="one", eps="5e-10").replace("nw", "bb").replace("gp", "gq"), base="SELECT b FROM bb WHERE i = 25"))
def format_calibration(s, d):
    """Slopes of the chance to win by the gap in strength, per format."""
    r = predict.calibrate_by(_gaps(s, d), "format")
    return r.select("format", "rows", F.round("slope", 5).alias("slope"))


@query()
def calibration_cv(s, d):
    """Calibration tested on five later parts of time."""
    return predict.calibration_scores(_gaps(s, d), [F.asc("ts"), F.asc("match_id")])


@query()
def adaptive_calibration(s, d):
    """Chances from an online fit per format, as they were before each match; the smaller id is the first side."""
    g = _gaps(s, d).withColumn("turn", F.pmod(F.xxhash64("match_id"), F.lit(2)) == 0)
    g = g.select("match_id", "ts", "format", F.when(F.col("turn"), -F.col("gap")).otherwise(F.col("gap")).alias("gap"), (~F.col("turn")).alias("won"))
    return predict.adaptive(g, "format", ["ts", "match_id"])


@query(sql("pairs ex", "SELECT win2.id AS player_id, round(ln((win2.x + lam * v) / (loss2.x + lam * v)), 5) AS score FROM win2 JOIN loss2 USING (id) JOIN rho USING (id), l", **reference._RHO, **reference.settled("win", "se", "rho"), **reference.settled("loss", "se", "rho", "winner", "loser"), l=reference._LAMBDA,
  zs="SELECT id, (s - avg(s) OVER ()) / (stddev_pop(s) OVER () + 1e-8) AS z FROM (SELECT win.id, ln((win.x + lam * v) / (loss.x + lam * v)) AS s FROM win JOIN loss USING (id) JOIN rho USING (id), l)",
  sur="SELECT match_id, winner, loser, share * -ln(greatest(1 / (1 + exp(avg(zl.z) OVER (PARTITION BY match_id) - avg(zw.z) OVER (PARTITION BY match_id))), 1e-6)) AS share FROM pairs JOIN zs zw ON zw.id = winner JOIN zs zl ON zl.id = loser",
  se2="SELECT loser, winner, sum(share) AS weight_sum FROM sur GROUP BY ALL", **reference.settled("win2", "se2", "rho"), **reference.settled("loss2", "se2", "rho", "winner", "loser")))
def surprisal_log_odds(s, d):
    """Log-odds ratings refined by how surprising results were."""
    cfg = graph.Engine.of(now=NOW, half_life_days=domain.HALF_LIFE_DAYS, surprisal_rounds=2)
    return graph.surprisal(reference._compact(s, d), cfg).select(F.col("id").alias("player_id"), F.round("score", 5).alias("score"))


@query()
def sequential_holdout(s, d):
    """Loss on tournaments held out one after the other, ten of them spaced evenly, from ratings of all before."""
    m, r = (written(f(s, d), "holdout") for f in (domain.played, domain.rosters))
    m = written(reference.with_sides(m, r, domain.appearances(s, d)), "holdout")
    return evaluate.sequential_holdout(m, lambda train: reference.rated_teams(train, r), least=10, splits=10)


@query(sql("mm r", "SELECT user_id AS player_id, max(ts) AS last_active FROM (SELECT r.user_id, mm.ts FROM r JOIN mm ON mm.tournament_id = r.tournament_id AND r.team_id IN (mm.team1_id, mm.team2_id) WHERE mm.ts <= 1735689600 UNION ALL SELECT r.user_id, CAST(floor(start_ms / 1000.0) AS BIGINT) FROM r JOIN st ON st.tournament_id = r.tournament_id WHERE start_ms <= 1735689600000) GROUP BY 1", st=_START))
def last_active_players(s, d):
    """Each player's last activity before 2025, by matches of its teams and starts of its tournaments."""
    at = F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.coalesce("start_time_ms", F.lit(-1)))
    t = table(s, d, "tournaments").where("tournament_id is not null").groupBy("tournament_id").agg(F.max_by("start_time_ms", at).alias("start"))
    t = t.select("tournament_id", F.floor(F.floor(scalar.epoch_seconds(F.col("start").cast("double")) * 1000) / 1000).alias("ts")).where("ts is not null")
    return summary.last_active(domain.matches(s, d), domain.rosters(s, d), t, 1735689600)


@query(sql("c", "SELECT x AS player_id, match_id, list_aggregate(list_transform(list_sort(list_filter(side, lambda y: y != x)), lambda y: y::VARCHAR), 'string_agg', ',') AS mates FROM (SELECT match_id, winners AS side, unnest(winners) AS x FROM c UNION ALL SELECT match_id, losers, unnest(losers) FROM c)").replace("list_aggregate(", "coalesce(list_aggregate(").replace("'string_agg', ',') AS mates", "'string_agg', ','), '') AS mates"))
def match_mates(s, d):
    """Who else was on a player's side of each match."""
    return summary.with_mates(reference._compact(s, d))


_TN = "SELECT team_id, max(team_name) AS name FROM tournament_teams WHERE team_id IS NOT NULL GROUP BY 1"


@query(sql("m t", "SELECT m.match_id, t.name AS tournament, w.name AS winner, l.name AS loser, strftime(make_timestamp(m.ts * 1000000), '%Y-%m-%d') AS played_on, CAST(isodow(make_timestamp(m.ts * 1000000)) AS BIGINT) AS weekday, CAST(weekofyear(make_timestamp(m.ts * 1000000)) AS BIGINT) AS week FROM m LEFT JOIN t ON t.tournament_id = m.tournament_id LEFT JOIN tn w ON w.team_id = winner_team_id LEFT JOIN tn l ON l.team_id = loser_team_id", tn=_TN))
def named_matches(s, d):
    """Matches with the names of tournament and teams, day, weekday and week."""
    names = table(s, d, "tournament_teams").where("team_id is not null").groupBy("team_id").agg(F.max("team_name").alias("name"))
    return summary.named(domain.played(s, d), names, domain.tournaments(s, d))


@query("SELECT f.player_id, f.match_id, f.is_win, f.positive_rank, f.flux, h.tournament, h.match_date, h.opponents FROM (" + reference.SQL["influential_matches"] + ") f JOIN (" + reference.SQL["match_history"] + ") h ON h.player_id = f.player_id AND h.match_id = f.match_id AND h.is_win = f.is_win")
def influential_named(s, d):
    """The matches that moved each player most with tournament, date and opponents."""
    h = reference.match_history(s, d).select("player_id", "match_id", "is_win", "tournament", "match_date", "opponents")
    return reference.influential_matches(s, d).join(h, ["player_id", "match_id", "is_win"])


@query()
def weekly_impacts(s, d):
    """Approximate and exact changes of every rated player's score without each match of its shortlist, stored as a run and
    read back."""
    c = written(reference._compact(s, d), "compact")
    scores = written(graph.log_odds(c, graph.Engine(now=NOW, fixed_lambda=0.025)), "scores")
    out = incremental.scratch(s, "impacts")
    store.add_run(loo.weekly(c, scores, 0.025, k=10), out, {"build": "build", "at": int(NOW * 1000)})
    return loaders.impacts(s, out, build="build", at=int(NOW * 1000)).drop("build", "at")


@query()
def tournament_backtest(s, d):
    """Ten tournaments spaced evenly: how the order by earlier ratings agrees with that by wins."""
    m, r = (written(f(s, d), "backtest") for f in (domain.played, domain.rosters))
    m = written(reference.with_sides(m, r, domain.appearances(s, d)), "backtest")
    return quality.backtest(m, lambda train: reference.rated_teams(train, r), least=10, splits=10)


@query(sql("", "SELECT count(*) AS rows, CAST(sum(match_id) AS BIGINT) AS total FROM q", q="SELECT DISTINCT event_id AS match_id FROM events WHERE event_id IS NOT NULL"))
def high_water_mark(s, d):
    """A table that grows by what lies beyond its largest id, fed twice with everything and before with the older half."""
    where = incremental.scratch(s, "marks")
    e = written(table(s, d, "events").select(F.col("event_id").alias("match_id")).dropna().distinct(), "ids")
    middle = e.agg(F.avg("match_id")).first()[0] or 0
    for part in (e.where(F.col("match_id") <= middle), e, e):
        incremental.append_above(s, where, part)
    got = store.Versioned(s, where).read()
    got = got if got is not None else e
    return got.agg(F.count(F.lit(1)).alias("rows"), F.sum("match_id").alias("total"))


# ---- the production run

_BORROWED = reference.SQL["borrowed_rosters"]


@query(sql("m r a", """SELECT 'compiled_matches' AS name, count(*) AS rows FROM m UNION ALL SELECT 'compiled_players', count(*) FROM (SELECT * FROM br WHERE (tournament_id, team_id) IN (SELECT tournament_id, team_id FROM u))
  UNION ALL SELECT 'ranking_stats', count(DISTINCT user_id) FROM ka WHERE tournament_id IN (SELECT tournament_id FROM m) UNION ALL SELECT 'influence', count(DISTINCT tournament_id) FROM m WHERE tournament_id IN (SELECT tournament_id FROM br WHERE (tournament_id, team_id) IN (SELECT tournament_id, team_id FROM u))""",
  u="SELECT tournament_id, winner_team_id AS team_id FROM m WHERE tournament_id IS NOT NULL UNION SELECT tournament_id, loser_team_id FROM m WHERE tournament_id IS NOT NULL",
  br="SELECT * FROM r UNION SELECT x.tournament_id, x.team_id, r.user_id FROM (SELECT tournament_id, team_id FROM u WHERE (tournament_id, team_id) NOT IN (SELECT tournament_id, team_id FROM r)) x JOIN (SELECT team_id, min(tournament_id) AS f FROM r GROUP BY 1) s ON s.team_id = x.team_id JOIN r ON r.team_id = x.team_id AND r.tournament_id = s.f",
  ka="SELECT DISTINCT a.tournament_id, a.user_id FROM a JOIN m ON m.match_id = a.match_id AND m.tournament_id = a.tournament_id JOIN br ON br.tournament_id = a.tournament_id AND br.user_id = a.user_id"))
def production_manifest(s, d):
    """The production run over all matches: its tables and their rows, from the manifest it wrote."""
    cfg = graph.Engine(now=NOW, half_life_days=domain.HALF_LIFE_DAYS)
    m = batch.update(s, incremental.scratch(s, "production"), domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d), "build", int(NOW * 1000), cfg)
    rows = [(n, x["rows"]) for n, x in m["tables"].items() if n != "rankings"]
    return s.createDataFrame(rows, "name string, rows long")


@query()
def production_rankings(s, d):
    """The rankings of the production run, read back from the table of all runs."""
    out = incremental.scratch(s, "production")
    cfg = graph.Engine(now=NOW, half_life_days=domain.HALF_LIFE_DAYS)
    batch.update(s, out, domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d), "build", int(NOW * 1000), cfg)
    return loaders.impacts(s, f"{out}/rankings", build="build", at=int(NOW * 1000)).drop("build", "at")


@query(sql("t mm", "SELECT tournament_id, coalesce(name, '') AS name, CAST(coalesce(n, 0) AS BIGINT) AS match_count FROM t LEFT JOIN (SELECT tournament_id, count(*) AS n FROM mm GROUP BY 1) USING (tournament_id)"))
def stored_tournaments(s, d):
    """Tournaments after two imports of everything, the first of which knew no counts; both imports happen wholly."""
    db = store.Database(s, incremental.scratch(s, "database"))
    t = domain.tournaments(s, d).select("tournament_id", F.coalesce("name", F.lit("")).alias("name"))
    m = written(domain.matches(s, d), "m")
    first = t.withColumns({"match_count": F.lit(None).cast("long"), "is_ranked": F.lit(None).cast("boolean")})
    store.import_all(db, {"tournaments": first, "matches": m})
    n = m.groupBy("tournament_id").agg(F.count(F.lit(1)).alias("match_count"))
    again = t.join(n, "tournament_id", "left").na.fill(0, ["match_count"]).withColumn("name", F.lit("another"))
    store.import_all(db, {"tournaments": again, "matches": m})
    return db.read("tournaments").select("tournament_id", "name", "match_count")


# ---- the queue's documents: eight events in a row are a match, each of them a map and a player's entry

_EV = "SELECT event_id, user_id, CAST(floor(event_id / 8.0) AS BIGINT) AS match_id, 2 * CAST(floor(event_id / 8.0) AS BIGINT) + event_id % 2 AS group_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS at_s, event_type, coalesce(value, 0) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"
_WON = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN v >= 50 THEN 2 * match_id ELSE 2 * match_id + 1 END"


def queue_documents(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("user_id is not null and ts is not null")
    match = F.floor(F.col("event_id") / 8)
    v = F.coalesce("value", F.lit(0.0))
    e = e.select("event_id", "user_id", match.alias("match_id"), (2 * match + F.col("event_id") % 2).alias("group_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"), "event_type", v.alias("v"))
    won = F.when(F.col("event_id") % 17 != 0, F.when(F.col("v") >= 50, 2 * F.col("match_id")).otherwise(2 * F.col("match_id") + 1))
    # A player's last event of a match is the entry that counts.
    one = e.groupBy("match_id", "user_id").agg(F.max_by(F.struct("group_id", "event_id", "v"), "event_id").alias("u")).select("match_id", "user_id", "u.*")
    diff = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7 - 3) * 1.0)
    memento = F.struct(F.struct((F.floor(F.col("v") / 10) * 10 / 15).alias("ordinal")).alias("skill"), F.struct(F.lit(True).alias("calculated"), diff.alias("spDiff")).alias("skillDifference"))
    member = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("discordName"))
    users = one.groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), memento))).alias("users"),
        *[F.collect_list(F.when(F.col("group_id") % 2 == k, member)).alias(f"m{k}") for k in (0, 1)],
        F.collect_list(F.when(F.col("event_id") % 3 == 0, F.struct(F.col("user_id").alias("userId"), F.when(F.col("event_id") % 2 == 0, "PREFER").alias("preference")))).alias("prefs"),
    )
    maps = e.groupBy("match_id").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), won.alias("winnerGroupId")))).alias("mapList"))
    j = maps.join(users, "match_id")
    m = F.struct(F.col("match_id").alias("id"), (2 * F.col("match_id")).alias("alphaGroupId"), (2 * F.col("match_id") + 1).alias("bravoGroupId"), F.col("at").alias("createdAt"), (F.col("at") + 600).alias("reportedAt"), F.struct("users", F.array("prefs").alias("mapPreferences")).alias("memento"), "mapList")
    side = lambda k, n: F.struct((2 * F.col("match_id") + k).alias("id"), F.col(f"m{k}").alias("members")).alias(n)
    return j.select(F.to_json(F.struct(m.alias("match"), side(0, "groupAlpha"), side(1, "groupBravo"))).alias("doc"))


_ONE = "SELECT match_id, user_id, arg_max(group_id, event_id) AS group_id, arg_max(v, event_id) AS v, max(event_id) AS event_id FROM ev GROUP BY ALL"
_QM = f"SELECT match_id, 2 * match_id AS alpha_team_id, 2 * match_id + 1 AS bravo_team_id, min(at_s) AS created_at, min(at_s) + 600 AS reported_at, CASE WHEN count(w) = 0 THEN 'cancelled' WHEN count(*) FILTER (w = 2 * match_id) >= count(*) FILTER (w = 2 * match_id + 1) THEN 'alpha' ELSE 'bravo' END AS winner FROM (SELECT *, {_WON} AS w FROM ev) GROUP BY match_id"


@query(sql("", "SELECT match_id, alpha_team_id, bravo_team_id, created_at, reported_at, winner, CASE winner WHEN 'cancelled' THEN 'cancelled' WHEN 'alpha' THEN CAST(alpha_team_id AS VARCHAR) ELSE CAST(bravo_team_id AS VARCHAR) END AS winner_id FROM qm", ev=_EV, qm=_QM))
def queue_parsed_matches(s, d):
    """Queue matches read back from their documents."""
    return queue_docs.tables(queue_documents(s, d))["matches"].drop("reported_by_user_id")


@query(sql("", "SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY event_id) - 1 AS map_index, event_id AS id, event_type AS mode, " + _WON + " AS winner_group_id FROM ev", ev=_EV))
def queue_parsed_maps(s, d):
    m = queue_docs.tables(queue_documents(s, d))["maps"]
    return m.select("match_id", F.col("map_index").cast("long").alias("map_index"), "id", "mode", "winner_group_id")


@query(sql("", "SELECT match_id, CAST(0 AS BIGINT) AS map_index, user_id, CASE WHEN event_id % 3 != 0 THEN 'IMPLICIT_INDIFFERENT' WHEN event_id % 2 = 0 THEN 'PREFER' ELSE 'EXPLICIT_INDIFFERENT' END AS preference FROM one", ev=_EV, one=_ONE))
def queue_parsed_preferences(s, d):
    p = queue_docs.tables(queue_documents(s, d))["map_preferences"]
    return p.withColumn("map_index", F.col("map_index").cast("long"))


@query(sql("", "SELECT match_id, group_id, user_id, 'u' || user_id AS discord_name, CASE group_id % 2 WHEN 0 THEN 'alpha' ELSE 'bravo' END AS team FROM one", ev=_EV, one=_ONE))
def queue_parsed_groups(s, d):
    return queue_docs.tables(queue_documents(s, d))["groups"].select("match_id", "group_id", "user_id", "discord_name", "team")


@query(sql("", "SELECT o.match_id, o.user_id, o.group_id, CASE o.group_id % 2 WHEN 0 THEN 'alpha' ELSE 'bravo' END AS team, CASE o.group_id % 2 WHEN 0 THEN bravo_team_id ELSE alpha_team_id END AS enemy_group_id, winner, created_at, CASE o.group_id % 2 WHEN 0 THEN 'alpha' ELSE 'bravo' END = winner AS is_winner, round(floor(v / 10) * 10 + 1000, 6) AS sp, CASE WHEN event_id % 5 != 0 THEN (event_id % 7 - 3) * 1.0 END AS sp_diff FROM one o JOIN qm USING (match_id)", ev=_EV, one=_ONE, qm=_QM))
def queue_merged(s, d):
    """One row per player and queue match: memento, match, group and enemy group together."""
    m = queue_docs.merged(queue_docs.tables(queue_documents(s, d)))
    return m.select("match_id", "user_id", "group_id", "team", "enemy_group_id", "winner", "created_at", "is_winner", F.round("sp", 6).alias("sp"), F.col("skill_difference_sp_diff").alias("sp_diff"))


@query()
def queue_player_rows(s, d):
    """The statistics of every player and queue match."""
    return queue.player_rows(written(queue_docs.merged(queue_docs.tables(queue_documents(s, d))), "merged"))


@query()
def queue_lognormal(s, d):
    """The three-parameter log-normal law of the latest points, and how far they are from it."""
    x = written(queue_docs.merged(queue_docs.tables(queue_documents(s, d))).where("sp is not null").select("user_id", "sp"), "points")
    shape, location, scale = queue.lognormal(x, "sp") or (None, None, None)
    ks = queue.kolmogorov(x, "sp", shape, location, scale) if shape else None
    return s.createDataFrame([(shape, location, scale, ks)], "shape double, location double, scale double, ks double")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
