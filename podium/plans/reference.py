"""Queries of conversion, graph, rating and reporting operators over the competition tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.operators import convert, graph, summary
from podium.runtime import written
from podium.sources import domain
from podium.sources.domain import NOW, RATE, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
R8 = lambda c: F.round(c, 8)


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _weights(s: SparkSession, d: str) -> DataFrame:
    return convert.weighted(domain.played(s, d), NOW, RATE)


def _compact(s: SparkSession, d: str) -> DataFrame:
    return convert.compact(_weights(s, d), domain.rosters(s, d), domain.appearances(s, d))


def with_sides(m: DataFrame, r: DataFrame, a: DataFrame) -> DataFrame:
    """Played matches with winners, losers, weight and share of their compact form, null where a side isn't known.

    A match's sides depend on no other match: ratings of several parts of the matches take them from here.
    """
    c = convert.compact(convert.weighted(m, NOW, RATE), r, a).select("match_id", "winners", "losers", "weight", "share")
    return m.join(c, "match_id", "left")


def rated_teams(train: DataFrame, r: DataFrame) -> DataFrame:
    """(id, rating) of teams from matches `with_sides`: the mean of exp(log-odds) over their rated members."""
    rated = graph.log_odds(train.where("winners is not null and losers is not null"), graph.Engine(now=NOW, fixed_lambda=0.025))
    return r.join(rated.select(F.col("id").alias("user_id"), F.exp("score").alias("x")), "user_id").groupBy(F.col("team_id").alias("id")).agg(F.avg("x").alias("rating"))


@query(sql("mm t", """SELECT m.match_id, m.tournament_id, m.winner_team_id, m.loser_team_id, m.ts * 1000 AS ts_ms FROM mm m JOIN t ON t.tournament_id = m.tournament_id
  WHERE m.ts BETWEEN 1704067200 AND 1735689600 AND t.is_ranked"""))
def load_ranked_matches(s, d):
    """Ranked tournaments' matches of a time window."""
    m = domain.matches(s, d).join(domain.tournaments(s, d).where("is_ranked").select("tournament_id"), "tournament_id")
    return m.where(F.col("ts").between(1704067200, 1735689600)).select("match_id", "tournament_id", "winner_team_id", "loser_team_id", (F.col("ts") * 1000).alias("ts_ms"))


@query(sql("r p", "SELECT r.tournament_id, r.team_id, r.user_id, p.name, p.country FROM r JOIN p ON p.player_id = r.user_id"))
def load_players(s, d):
    p = domain.players(s, d).withColumnRenamed("player_id", "user_id")
    return domain.rosters(s, d).join(p, "user_id").select("tournament_id", "team_id", "user_id", "name", "country")


@query(sql("t mm", """SELECT t.tournament_id, max(mm.ts) * 1000 AS event_ms, count(mm.match_id) AS matches FROM t LEFT JOIN mm ON mm.tournament_id = t.tournament_id GROUP BY t.tournament_id"""))
def tournament_event_times(s, d):
    """The time of each tournament's last match."""
    m = domain.matches(s, d).select("tournament_id", "ts", "match_id")
    g = domain.tournaments(s, d).select("tournament_id").join(m, "tournament_id", "left").groupBy("tournament_id")
    return g.agg((F.max("ts") * 1000).alias("event_ms"), F.count("match_id").alias("matches"))


@query("SELECT x.id AS missing_id FROM range((SELECT min(tournament_id) FROM tournaments), (SELECT max(tournament_id) FROM tournaments) + 1) x(id) WHERE x.id NOT IN (SELECT tournament_id FROM tournaments WHERE tournament_id IS NOT NULL)")
def missing_tournament_ids(s, d):
    t = domain.tournaments(s, d).select(F.col("tournament_id").alias("id"))
    low, high = t.agg(F.min("id"), F.max("id")).first()
    return s.range(low or 0, (high if high is not None else -1) + 1).join(t, "id", "left_anti").withColumnRenamed("id", "missing_id")


@query(sql("t r", "SELECT t.tournament_id, t.name FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tournament_id = t.tournament_id)"))
def tournaments_without_players(s, d):
    return domain.tournaments(s, d).join(domain.rosters(s, d), "tournament_id", "left_anti").select("tournament_id", "name")


@query(sql("w", "SELECT match_id, winner_team_id, loser_team_id, ts, round(weight, 8) AS weight FROM w"))
def weighted_matches(s, d):
    return _weights(s, d).select("match_id", "winner_team_id", "loser_team_id", "ts", R8("weight").alias("weight"))


@query(sql("c", "SELECT match_id, tournament_id, list_aggregate(winners, 'string_agg', ',') AS winners, list_aggregate(losers, 'string_agg', ',') AS losers, round(weight, 8) AS weight, ts, winner_count, loser_count, round(share, 8) AS share FROM c"))
def compact_matches(s, d):
    """Matches with the players who played, else the rosters."""
    c = _compact(s, d)
    text = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    return c.select("match_id", "tournament_id", text("winners"), text("losers"), R8("weight").alias("weight"), "ts", F.col("winner_count").cast("long").alias("winner_count"), F.col("loser_count").cast("long").alias("loser_count"), R8("share").alias("share"))


@query(sql("w r", """SELECT l.user_id AS loser, v.user_id AS winner, round(sum(weight), 7) AS weight_sum FROM w JOIN r l ON l.tournament_id = w.tournament_id AND l.team_id = loser_team_id
  JOIN r v ON v.tournament_id = w.tournament_id AND v.team_id = winner_team_id GROUP BY ALL"""))
def player_edges(s, d):
    return convert.player_edges(_weights(s, d), domain.rosters(s, d)).select("loser", "winner", F.round("weight_sum", 7).alias("weight_sum"))


@query(sql("te", "SELECT loser, winner, round(weight_sum, 8) AS weight_sum FROM te"))
def team_edges(s, d):
    return convert.team_edges(_weights(s, d)).withColumn("weight_sum", R8("weight_sum"))


_DENOM = "SELECT l.id, loss, coalesce(win, 0.0) AS win FROM (SELECT loser AS id, sum(weight_sum) AS loss FROM te GROUP BY 1) l LEFT JOIN (SELECT winner AS id, sum(weight_sum) AS win FROM te GROUP BY 1) x ON x.id = l.id"


@query(sql("te", """SELECT id, round(loss, 7) AS loss_weights, round(win, 7) AS win_weights, round(loss, 7) AS d_none, round(loss + least(0.02 * win, loss), 7) AS d_wins_proportional, round(loss + 1e-6, 7) AS d_constant,
  round(loss + 0.1 / (1 + (loss + win) / 100.0) * win, 7) AS d_adaptive, round(loss + 1e-6 + 0.02 * win, 7) AS d_hybrid FROM q""", q=_DENOM))
def smoothing_denominators(s, d):
    """The five smoothings of team edges."""
    x = graph.denominators(convert.team_edges(_weights(s, d)), "none")
    modes = ["none", "wins_proportional", "constant", "adaptive", "hybrid"]
    r7 = lambda c: F.round(c, 7)
    return x.select("id", r7("loss_weights").alias("loss_weights"), r7("win_weights").alias("win_weights"), *[r7(graph.smoothed(m, F.col("loss_weights"), F.col("win_weights"))).alias(f"d_{m}") for m in modes])


_NODES = "SELECT DISTINCT id FROM (SELECT loser AS id FROM te UNION ALL SELECT winner FROM te)"


@query(sql("te", """SELECT n.id, round(raw / sum(raw) OVER (), 10) AS volume_inverse, round(1.0 / count(*) OVER (), 10) AS uniform FROM (SELECT n.id, 1 / sqrt(coalesce(deg, 1)) AS raw FROM n LEFT JOIN (SELECT loser AS id, count(*) AS deg FROM te GROUP BY 1) g ON g.id = n.id) n""", n=_NODES))
def teleport_vectors(s, d):
    e = written(convert.team_edges(_weights(s, d)), "edges")
    v, u = graph.teleport(e, "volume_inverse"), graph.teleport(e, "uniform").withColumnRenamed("v", "u")
    return v.join(u, "id").select("id", F.round("v", 10).alias("volume_inverse"), F.round("u", 10).alias("uniform"))


def settled(name: str, edges: str, v: str, src: str = "loser", dst: str = "winner", tol: float = 1e-8, steps: int = 200, alpha: float = 0.85) -> dict[str, str]:
    """PageRank as SQL, from `src` to `dst` of the edges' table with the teleport table (id, v): every step follows from the
    one before until the scores move by less than `tol` in all. The last step is the table `name` (id, x)."""
    return {
        f"{name}_p": f"SELECT e.{src} AS src, e.{dst} AS dst, e.weight_sum / o.s AS p FROM {edges} e JOIN (SELECT {src} AS id, sum(weight_sum) AS s FROM {edges} GROUP BY 1) o ON o.id = e.{src}",
        f"{name}_z": f"SELECT id FROM {v} WHERE id NOT IN (SELECT src FROM {name}_p)",
        f"{name}_r": f"""SELECT 0 AS i, id, v / sum(v) OVER () AS x, NULL::DOUBLE AS was FROM {v} UNION ALL SELECT i + 1, id, x / sum(x) OVER (), was FROM (
          SELECT r.i, r.id, r.x AS was, {alpha} * coalesce(g.x, 0) + (1 - {alpha} + {alpha} * (SELECT coalesce(sum(x), 0) FROM {name}_r WHERE id IN (SELECT id FROM {name}_z))) * t.v AS x
          FROM {name}_r r JOIN {v} t ON t.id = r.id LEFT JOIN (SELECT p.dst AS id, sum(q.x * p.p) AS x FROM {name}_r q JOIN {name}_p p ON p.src = q.id GROUP BY 1) g ON g.id = r.id
          WHERE r.i < {steps} AND (SELECT sum(abs(x - was)) IS NULL OR sum(abs(x - was)) >= {tol} FROM {name}_r))""",
        name: f"SELECT id, x FROM {name}_r WHERE i = (SELECT max(i) FROM {name}_r)",
    }


_TELEPORT = {"n": _NODES, "v": "SELECT id, raw / sum(raw) OVER () AS v FROM (SELECT n.id, 1 / sqrt(coalesce(deg, 1)) AS raw FROM n LEFT JOIN (SELECT loser AS id, count(*) AS deg FROM te GROUP BY 1) g ON g.id = n.id)"}


@query(sql("te", "SELECT id AS team_id, round(x, 9) AS score, row_number() OVER (ORDER BY round(x, 9) DESC, id) AS rank FROM pr", **_TELEPORT, **settled("pr", "te", "v")))
def team_pagerank(s, d):
    """PageRank of teams from losers to winners, run until it settles."""
    e = written(convert.team_edges(_weights(s, d)), "edges")
    r = graph.pagerank(e, "weight_sum", graph.teleport(e))
    r = r.select(F.col("id").alias("team_id"), F.round("score", 9).alias("score"))
    return summary.numbered(r, [F.desc("score"), F.asc("team_id")], "rank")


@query(sql("ex", "SELECT id, round(exposure, 7) AS exposure, round(e_share, 7) AS e_share, last_ts FROM ex"))
def exposure_and_activity(s, d):
    c = written(_compact(s, d), "compact")
    e = convert.exposure(c).join(convert.last_activity(c), "id")
    return e.select("id", F.round("exposure", 7).alias("exposure"), F.round("e_share", 7).alias("e_share"), "last_ts")


@query(sql("pairs", "SELECT loser, winner, round(sum(share), 7) AS weight_sum FROM pairs GROUP BY ALL"))
def share_edges(s, d):
    return convert.share_edges(_compact(s, d)).withColumn("weight_sum", F.round("weight_sum", 7))


@query(sql("m r a", """SELECT user_id, count(*) AS tournament_count, max(last) * 1000 AS last_active_ms FROM (SELECT DISTINCT tournament_id, user_id FROM a) q JOIN (SELECT tournament_id, max(ts) AS last FROM m GROUP BY 1) x USING (tournament_id) GROUP BY 1"""))
def player_stats(s, d):
    return convert.player_stats(domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d))


@query(sql("m ai", """SELECT m.match_id FROM m WHERE (SELECT count(DISTINCT user_id) FROM ai WHERE ai.match_id = m.match_id AND ai.tournament_id = m.tournament_id AND team_id = winner_team_id) = 4
  AND (SELECT count(DISTINCT user_id) FROM ai WHERE ai.match_id = m.match_id AND ai.tournament_id = m.tournament_id AND team_id = loser_team_id) = 4"""))
def strict_4v4(s, d):
    return convert.strict_4v4(domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d)).select("match_id")


_RANKED = """SELECT t.tournament_id, coalesce(teams, 0) AS teams, coalesce(players, 0) AS players, coalesce(n, 0) AS matches FROM t LEFT JOIN (SELECT tournament_id, count(DISTINCT team_id) AS teams, count(DISTINCT user_id) AS players FROM r GROUP BY 1) q USING (tournament_id)
  LEFT JOIN (SELECT tournament_id, count(*) AS n FROM m GROUP BY 1) g USING (tournament_id) WHERE coalesce(teams, 0) >= 4 AND coalesce(players, 0) >= 16 AND coalesce(n, 0) >= 10 AND NOT regexp_matches(coalesce(t.name, ''), '(?i)test|debug|demo|practice')"""


@query(sql("t m r", _RANKED))
def ranked_tournaments(s, d):
    return convert.ranked_tournaments(domain.tournaments(s, d), domain.played(s, d), domain.rosters(s, d))


_RATIO = """SELECT tournament_id, team_id, count(x.player_id) * 1.0 / count(*) AS ratio, count(*) - count(x.player_id) AS unrated FROM r LEFT JOIN (SELECT player_id FROM last WHERE score IS NOT NULL) x ON x.player_id = r.user_id GROUP BY ALL"""


@query(sql("m r last", """SELECT match_id, round(coalesce(w.ratio, 0), 8) AS winner_ratio, round(coalesce(l.ratio, 0), 8) AS loser_ratio, coalesce(w.unrated, 0) AS winner_unrated, coalesce(l.unrated, 0) AS loser_unrated FROM m
  LEFT JOIN q w ON w.tournament_id = m.tournament_id AND w.team_id = winner_team_id LEFT JOIN q l ON l.tournament_id = m.tournament_id AND l.team_id = loser_team_id
  WHERE coalesce(w.ratio, 0) >= 0.75 AND coalesce(l.ratio, 0) >= 0.75""", q=_RATIO))
def rated_ratio_filter(s, d):
    """Matches with at least three quarters of both rosters rated."""
    rated = domain.latest_run(s, d).where("score is not null").select(F.col("player_id").alias("id"))
    x = convert.rated_ratio(domain.played(s, d), domain.rosters(s, d), rated).where("winner_ratio >= 0.75 and loser_ratio >= 0.75")
    return x.select("match_id", R8("winner_ratio").alias("winner_ratio"), R8("loser_ratio").alias("loser_ratio"), "winner_unrated", "loser_unrated")


@query(sql("m r", """SELECT DISTINCT * FROM (SELECT * FROM r UNION ALL SELECT x.tournament_id, x.team_id, r.user_id FROM (SELECT DISTINCT tournament_id, team_id FROM u WHERE (tournament_id, team_id) NOT IN (SELECT tournament_id, team_id FROM r)) x
  JOIN (SELECT team_id, min(tournament_id) AS f FROM r GROUP BY 1) s ON s.team_id = x.team_id JOIN r ON r.team_id = x.team_id AND r.tournament_id = s.f)""",
  u="SELECT tournament_id, winner_team_id AS team_id FROM m WHERE tournament_id IS NOT NULL UNION ALL SELECT tournament_id, loser_team_id FROM m WHERE tournament_id IS NOT NULL"))
def borrowed_rosters(s, d):
    return convert.borrowed_rosters(domain.played(s, d), domain.rosters(s, d))


@query(sql("a r", """SELECT tournament_id, user_id, team_id FROM (SELECT tournament_id, user_id, team_id, row_number() OVER (PARTITION BY tournament_id, user_id ORDER BY k DESC, team_id) AS n FROM (SELECT tournament_id, user_id, team_id, count(*) AS k FROM a
  WHERE team_id IS NOT NULL AND (tournament_id, user_id) NOT IN (SELECT tournament_id, user_id FROM r) GROUP BY ALL)) WHERE n = 1"""))
def promoted_appearances(s, d):
    return convert.promoted(domain.appearances(s, d), domain.rosters(s, d))


_PART = "SELECT DISTINCT r.tournament_id, r.user_id FROM r JOIN (SELECT tournament_id, winner_team_id AS team_id FROM m UNION SELECT tournament_id, loser_team_id FROM m) u ON u.tournament_id = r.tournament_id AND u.team_id = r.team_id"
_SCORED = "SELECT q.tournament_id, coalesce(l.win_pr, (SELECT quantile_cont(win_pr, 0.05) FROM last WHERE win_pr IS NOT NULL)) AS x FROM q LEFT JOIN last l ON l.player_id = q.user_id AND l.win_pr IS NOT NULL"
_METHODS = {"arithmetic": "avg(x)", "sum": "sum(x)", "median": "median(x)", "geometric": "exp(avg(ln(x + 1e-10)))", "top_20_sum": "list_sum(list_reverse_sort(list(x))[1:20])", "top_10_sum": "list_sum(list_reverse_sort(list(x))[1:10])", "top_20_mean": "list_avg(list_reverse_sort(list(x))[1:20])", "sqrt_top_20_sum": "sqrt(list_sum(list_reverse_sort(list(x))[1:20]))"}


@query(sql("m r last", "SELECT tournament_id, " + ", ".join(f"round({k} / avg({k}) OVER (), 7) AS {k}" for k in _METHODS) + " FROM (SELECT tournament_id, " + ", ".join(f"{e} AS {k}" for k, e in _METHODS.items()) + " FROM z GROUP BY 1)", q=_PART, z=_SCORED))
def tournament_influence(s, d):
    """Tournaments' strength from their participants' win mass, by eight methods."""
    who = written(graph.participants(domain.played(s, d), domain.rosters(s, d)), "who")
    scores = written(domain.latest_run(s, d).where("win_pr is not null").select(F.col("player_id").alias("id"), F.col("win_pr").alias("score")), "scores")
    return graph.influences(scores, who, tuple(_METHODS)).select("tournament_id", *[F.round(m, 7).alias(m) for m in _METHODS])


_MEAN = "SELECT tournament_id, x / avg(x) OVER () AS x FROM (SELECT tournament_id, avg(x) AS x FROM z GROUP BY 1)"


@query(sql("m r last", """SELECT tournament_id, round(0.5 + 1.5 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 7) AS minmax,
  round(1 + 0.5 * greatest(-2, least(2, (x - avg(x) OVER ()) / stddev_pop(x) OVER ())), 7) AS zscore, round(exp(min(ln(x + 1e-10)) OVER () + (ln(x + 1e-10) - min(ln(x + 1e-10)) OVER ()) * ln(2) / (max(ln(x + 1e-10)) OVER () - min(ln(x + 1e-10)) OVER ())), 7) AS log FROM y""", q=_PART, z=_SCORED, y=_MEAN))
def normalized_influence(s, d):
    who = graph.participants(domain.played(s, d), domain.rosters(s, d))
    scores = domain.latest_run(s, d).where("win_pr is not null").select(F.col("player_id").alias("id"), F.col("win_pr").alias("score"))
    x = written(graph.influence(scores, who, "arithmetic"), "infl")
    out = None
    for m in ("minmax", "zscore", "log"):
        y = graph.rescaled(x, m).select("tournament_id", F.round("strength", 7).alias(m))
        out = y if out is None else out.join(y, "tournament_id")
    return out


@query(sql("te", "SELECT winner AS id, round(sum(x * weight_sum * exp(-0.005 * weight_sum)), 9) AS strength FROM te JOIN pr ON pr.id = te.loser GROUP BY 1", **_TELEPORT, **settled("pr", "te", "v")))
def retrospective_strength(s, d):
    """Teams' strength from the PageRank of those they beat."""
    e = written(convert.team_edges(_weights(s, d)), "edges")
    scores = graph.pagerank(e, "weight_sum", graph.teleport(e))
    return graph.retrospective(e, scores).withColumn("strength", F.round("strength", 9))


TICKS = 5


def _tick_tock_sql() -> str:
    more = {
        "base": "SELECT w.tournament_id, l.user_id AS loser, v.user_id AS winner, sum(weight) AS weight_sum FROM w JOIN r l ON l.tournament_id = w.tournament_id AND l.team_id = loser_team_id JOIN r v ON v.tournament_id = w.tournament_id AND v.team_id = winner_team_id GROUP BY ALL",
        "v": "SELECT id, raw / sum(raw) OVER () AS v FROM (SELECT n.id, 1 / sqrt(coalesce(deg, 1)) AS raw FROM (SELECT loser AS id FROM base UNION SELECT winner FROM base) n LEFT JOIN (SELECT loser AS id, count(DISTINCT winner) AS deg FROM base GROUP BY 1) g ON g.id = n.id)",
        "part": _PART,
        "infl0": "SELECT DISTINCT tournament_id, 1.0::DOUBLE AS strength FROM m WHERE tournament_id IS NOT NULL",
    }
    for i in range(1, TICKS + 1):
        more[f"ed{i}"] = f"SELECT loser, winner, sum(weight_sum * coalesce(strength, 1)) AS weight_sum FROM base LEFT JOIN infl{i - 1} USING (tournament_id) GROUP BY ALL"
        more |= settled(f"pr{i}", f"ed{i}", "v")
        more[f"infl{i}"] = f"SELECT tournament_id, x / avg(x) OVER () AS strength FROM (SELECT tournament_id, avg(coalesce(x, (SELECT quantile_cont(x, 0.05) FROM pr{i}))) AS x FROM part LEFT JOIN pr{i} ON id = user_id GROUP BY 1)"
        more[f"ch{i}"] = f"SELECT {i} AS i, avg(abs(coalesce(n.strength, 1) - coalesce(o.strength, 1))) AS c FROM infl{i} n FULL JOIN infl{i - 1} o USING (tournament_id)"
    more["stop"] = f"SELECT coalesce(min(i) FILTER (c < 1e-4), {TICKS}) AS at FROM (" + " UNION ALL ".join(f"SELECT * FROM ch{i}" for i in range(1, TICKS + 1)) + ")"
    more["stop"] = more["stop"].replace(" AS at ", " AS tick ")
    return sql("w r", " UNION ALL ".join(f"SELECT id AS player_id, round(x, 9) AS score FROM pr{i} WHERE (SELECT tick FROM stop) = {i}" for i in range(1, TICKS + 1)), **more)


@query(_tick_tock_sql())
def tick_tock_ratings(s, d):
    """Players' ratings with tournaments' influence estimated alongside."""
    cfg = graph.Engine(now=NOW, half_life_days=domain.HALF_LIFE_DAYS, max_ticks=TICKS)
    r = graph.tick_tock(written(domain.played(s, d), "m"), written(domain.rosters(s, d), "r"), cfg)[0]
    return r.select(F.col("id").alias("player_id"), F.round("score", 9).alias("score"))


_RHO = {"rho": "SELECT id, exposure, (e_share + 1e-12) / sum(e_share + 1e-12) OVER () AS v FROM ex", "se": "SELECT loser, winner, sum(share) AS weight_sum FROM pairs GROUP BY ALL"}
_LAMBDA = "SELECT 0.025 * (SELECT quantile_cont(x, 0.5) FROM win) / (SELECT quantile_cont(v, 0.5) FROM rho) AS lam"


@query(sql("pairs ex", "SELECT win.id AS player_id, round(ln((win.x + lam * v) / (loss.x + lam * v)), 5) AS score, round(win.x, 9) AS win_pr, round(loss.x, 9) AS loss_pr, round(exposure, 7) AS exposure FROM win JOIN loss USING (id) JOIN rho USING (id), l",
  **_RHO, **settled("win", "se", "rho"), **settled("loss", "se", "rho", "winner", "loser"), l=_LAMBDA))
def exposure_log_odds(s, d):
    """Players' log-odds ratings."""
    cfg = graph.Engine(now=NOW, half_life_days=domain.HALF_LIFE_DAYS)
    r = graph.log_odds(_compact(s, d), cfg)
    return r.select(F.col("id").alias("player_id"), F.round("score", 5).alias("score"), F.round("win_pr", 9).alias("win_pr"), F.round("loss_pr", 9).alias("loss_pr"), F.round("exposure", 7).alias("exposure"))


@query()
def tick_tock_log_odds(s, d):
    cfg = graph.Engine(now=NOW, half_life_days=domain.HALF_LIFE_DAYS)
    return graph.tick_tock_log_odds(written(domain.played(s, d), "m"), written(domain.rosters(s, d), "r"), written(domain.appearances(s, d), "a"), cfg)[0].withColumnRenamed("id", "player_id")


@query(sql("pairs last", """SELECT match_id, id, is_win, round(sum(f), 9) AS flux FROM (SELECT match_id, winner AS id, true AS is_win, 0.85 * s.win_pr * share / o.t AS f FROM pairs p JOIN (SELECT loser, sum(share) AS t FROM pairs GROUP BY 1) o USING (loser) JOIN last s ON s.player_id = p.loser AND s.win_pr IS NOT NULL
  UNION ALL SELECT match_id, loser, false, 0.85 * s.loss_pr * share / i.t FROM pairs p JOIN (SELECT winner, sum(share) AS t FROM pairs GROUP BY 1) i USING (winner) JOIN last s ON s.player_id = p.winner AND s.win_pr IS NOT NULL) WHERE f IS NOT NULL GROUP BY ALL"""))
def match_flux(s, d):
    """What each match contributes to its players' win and loss mass."""
    scores = domain.latest_run(s, d).where("win_pr is not null").select(F.col("player_id").alias("id"), "win_pr", "loss_pr")
    return graph.loo_flux(written(_compact(s, d), "compact"), scores).where("flux is not null").withColumn("flux", F.round("flux", 9))


# ---- reports


_GRADED = "CASE WHEN score IS NULL THEN NULL " + " ".join(f"WHEN score <= {b} THEN '{g}'" for b, g in zip(summary.SCORE_BREAKS, summary.SCORE_LABELS, strict=False)) + f" ELSE '{summary.SCORE_LABELS[-1]}' END"
_STATS = "SELECT user_id, count(*) AS tournament_count, max(last) * 1000 AS last_active_ms FROM (SELECT DISTINCT tournament_id, user_id FROM a) q JOIN (SELECT tournament_id, max(ts) AS last FROM m GROUP BY 1) x USING (tournament_id) GROUP BY 1"


@query(sql("m a last p", f"""SELECT row_number() OVER (ORDER BY score DESC, l.player_id) AS rank, l.player_id, p.name, round(score, 8) AS score, tournament_count, round((score + 0.0) * 25, 6) AS display_score, {_GRADED} AS grade,
  round(win_pr / greatest(loss_pr, 1e-10), 6) AS win_loss_ratio, round((win_pr - loss_pr) * 1e6, 4) AS win_loss_diff
  FROM last l JOIN q ON q.user_id = l.player_id LEFT JOIN p ON p.player_id = l.player_id WHERE score IS NOT NULL AND tournament_count >= 5 AND last_active_ms >= {int((NOW - 180 * 86400) * 1000)}""", q=_STATS))
def post_processed_rankings(s, d):
    """The latest run's eligible players with rank, grade and ratios."""
    stats = convert.player_stats(domain.played(s, d), domain.rosters(s, d), domain.appearances(s, d)).withColumnRenamed("user_id", "player_id")
    r = summary.post_processed(domain.latest_run(s, d), stats, NOW, min_tournaments=5, inactive_days=180)
    r = r.join(domain.players(s, d).select("player_id", "name"), "player_id", "left")
    return r.select(F.col("rank").cast("long").alias("rank"), "player_id", "name", R8("score").alias("score"), "tournament_count", F.round("display_score", 6).alias("display_score"), "grade", F.round("win_loss_ratio", 6).alias("win_loss_ratio"), F.round(F.col("win_loss_diff") * 1e6, 4).alias("win_loss_diff"))


@query(sql("last", "SELECT system, grade, round(100.0 * k / sum(k) OVER (PARTITION BY system), 6) AS percent FROM (SELECT system, grade, count(*) AS k FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS system, " + f"CASE {' '.join(f'WHEN {x} <= {b} THEN {chr(39)}{g}{chr(39)}' for b, g in zip(bs, ls, strict=False))} ELSE '{ls[-1]}' END AS grade FROM z" for n, x, bs, ls in summary.SYSTEMS_SQL) + ") GROUP BY ALL)",
  z="SELECT score, 1500 + 400 * score AS elo, row_number() OVER (ORDER BY score DESC, player_id) * 1.0 / count(*) OVER () AS pct FROM last WHERE score IS NOT NULL"))
def grade_distributions(s, d):
    """Shares of grades under each grading system."""
    return summary.grade_distribution(domain.latest_run(s, d).where("score is not null"))


_TWO = "SELECT player_id, score, rank() OVER (PARTITION BY calculated_at_ms ORDER BY score DESC) AS k, dense_rank() OVER (ORDER BY calculated_at_ms DESC) AS run FROM runs WHERE score IS NOT NULL"


@query(sql("runs", "SELECT n.player_id, o.k AS old_rank, n.k AS new_rank, o.k - n.k AS rank_change, round(n.score - o.score, 8) AS score_change FROM q n JOIN q o ON o.player_id = n.player_id AND o.run = 2 WHERE n.run = 1", q=_TWO))
def compare_runs(s, d):
    """Players in the latest two runs with their change of rank."""
    r = written(domain.runs(s, d).where("score is not null"), "runs")
    at = sorted((x[0] for x in r.select("calculated_at_ms").distinct().collect()), reverse=True)[:2]
    new, old = (r.where(F.col("calculated_at_ms") == a) for a in (at + [0, 0])[:2])
    c = summary.compared(old, new)
    return c.select("player_id", F.col("old_rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"), (F.col("old_rank") - F.col("new_rank")).cast("long").alias("rank_change"), R8(F.col("new_score") - F.col("old_score")).alias("score_change"))


@query(sql("m", """SELECT least(winner_team_id, loser_team_id) AS team_a, greatest(winner_team_id, loser_team_id) AS team_b, count(*) AS matches, count(*) FILTER (winner_team_id < loser_team_id) AS wins_a, count(*) FILTER (winner_team_id > loser_team_id) AS wins_b, round(count(*) FILTER (winner_team_id < loser_team_id) * 1.0 / count(*), 8) AS rate_a, max(ts) AS last_ts FROM m GROUP BY ALL"""))
def head_to_head(s, d):
    return summary.head_to_head(domain.played(s, d)).withColumn("rate_a", R8("rate_a"))


@query(sql("pairs p t", """SELECT x.id AS player_id, x.match_id, x.is_win, x.ts, strftime(make_timestamp(x.ts * 1000000), '%Y-%m-%d') AS match_date, t.name AS tournament, opponents FROM (
  SELECT winner AS id, match_id, true AS is_win, ts, tournament_id, string_agg(DISTINCT loser::VARCHAR, ',' ORDER BY loser::VARCHAR) AS opponents FROM pairs GROUP BY ALL UNION ALL SELECT loser, match_id, false, ts, tournament_id, string_agg(DISTINCT winner::VARCHAR, ',' ORDER BY winner::VARCHAR) FROM pairs GROUP BY ALL) x LEFT JOIN t ON t.tournament_id = x.tournament_id"""))
def match_history(s, d):
    """Every player's wins and losses with date, tournament and opponents."""
    return summary.history(_compact(s, d), domain.tournaments(s, d))


@query(sql("pairs", f"""SELECT id AS player_id, tournaments, matches, opponents, round(connectivity, 8) AS connectivity, round(score, 8) AS confidence, CASE WHEN tournaments >= 20 OR (tournaments >= 15 AND opponents >= 200) OR (tournaments >= 10 AND connectivity >= 5) THEN 'high'
  WHEN tournaments >= 10 OR (tournaments >= 5 AND opponents >= 100) OR (tournaments >= 5 AND connectivity >= 2) THEN 'medium' WHEN tournaments >= 5 OR (tournaments >= 3 AND opponents >= 50) THEN 'low' ELSE 'provisional' END AS tier,
  CAST(floor(matches * least(opponents * 1.0 / matches, 1)) AS BIGINT) AS effective_comparisons FROM (SELECT *, 0.4 * least(tournaments / 20.0, 1) + 0.4 * least(opponents / 200.0, 1) + 0.2 * least(connectivity / 5.0, 1) AS score FROM (
  SELECT id, count(DISTINCT tournament_id) AS tournaments, count(DISTINCT match_id) AS matches, count(DISTINCT opp) AS opponents, 100.0 * count(DISTINCT opp) / (SELECT count(*) FROM ids) AS connectivity FROM e GROUP BY id))""",
  e="SELECT winner AS id, loser AS opp, match_id, tournament_id FROM pairs UNION ALL SELECT loser, winner, match_id, tournament_id FROM pairs", ids="SELECT DISTINCT id FROM e"))
def player_confidence(s, d):
    return summary.confidence(written(_compact(s, d), "compact")).select("player_id", "tournaments", "matches", "opponents", R8("connectivity").alias("connectivity"), R8("confidence").alias("confidence"), "tier", "effective_comparisons")


@query(sql("r last", """SELECT tournament_id, team_id, count(score) AS rated, round(exp(avg(ln(exp(score) + 1e-10))), 7) AS geometric, round(avg(score), 7) AS mean, round(max(score), 7) AS best, round(median(score), 7) AS median FROM r JOIN last l ON l.player_id = r.user_id AND l.score IS NOT NULL GROUP BY ALL"""))
def team_ratings(s, d):
    """Teams' ratings from their members'."""
    return summary.team_ratings(domain.rosters(s, d), domain.latest_run(s, d))


@query(sql("last p", """SELECT l.player_id, p.name, p.country, round(100 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS scaled, rank() OVER (ORDER BY score DESC) AS rank FROM last l LEFT JOIN p ON p.player_id = l.player_id WHERE score IS NOT NULL"""))
def player_summary(s, d):
    r = summary.scaled(domain.latest_run(s, d).where("score is not null"), "score")
    r = r.join(domain.players(s, d), "player_id", "left")
    return r.select("player_id", "name", "country", F.round("scaled", 6).alias("scaled"), F.col("rank").cast("long").alias("rank"))


@query(sql("m t r", """SELECT t.tournament_id, t.name, coalesce(n, 0) AS matches, teams, players, first_ts, last_ts FROM t LEFT JOIN (SELECT tournament_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY 1) q USING (tournament_id) LEFT JOIN (SELECT tournament_id, count(DISTINCT team_id) AS teams, count(DISTINCT user_id) AS players FROM r GROUP BY 1) x USING (tournament_id)"""))
def tournament_summary(s, d):
    m = domain.played(s, d).groupBy("tournament_id").agg(F.count(F.lit(1)).alias("matches"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    r = domain.rosters(s, d).groupBy("tournament_id").agg(F.countDistinct("team_id").alias("teams"), F.countDistinct("user_id").alias("players"))
    t = domain.tournaments(s, d).select("tournament_id", "name").join(m, "tournament_id", "left").join(r, "tournament_id", "left").na.fill(0, ["matches"])
    return t.select("tournament_id", "name", "matches", "teams", "players", "first_ts", "last_ts")


@query(sql("pairs last", """SELECT player_id, match_id, is_win, positive_rank, round(flux, 9) AS flux FROM (SELECT *, row_number() OVER (PARTITION BY player_id, is_win ORDER BY round(flux, 9) DESC, match_id) AS positive_rank FROM (SELECT match_id, id AS player_id, is_win, sum(f) AS flux FROM (SELECT match_id, winner AS id, true AS is_win, 0.85 * s.win_pr * share / o.t AS f FROM pairs p JOIN (SELECT loser, sum(share) AS t FROM pairs GROUP BY 1) o USING (loser) JOIN last s ON s.player_id = p.loser AND s.win_pr IS NOT NULL
  UNION ALL SELECT match_id, loser, false, 0.85 * s.loss_pr * share / i.t FROM pairs p JOIN (SELECT winner, sum(share) AS t FROM pairs GROUP BY 1) i USING (winner) JOIN last s ON s.player_id = p.winner AND s.win_pr IS NOT NULL) WHERE f IS NOT NULL GROUP BY ALL)) WHERE positive_rank <= 3"""))
def influential_matches(s, d):
    """The three matches that moved each player most, up and down."""
    scores = domain.latest_run(s, d).where("win_pr is not null").select(F.col("player_id").alias("id"), "win_pr", "loss_pr")
    f = graph.loo_flux(written(_compact(s, d), "compact"), scores).where("flux is not null").withColumn("flux", F.round("flux", 9))
    w = Window.partitionBy("id", "is_win").orderBy(F.desc("flux"), "match_id")
    f = f.withColumn("positive_rank", F.row_number().over(w)).where("positive_rank <= 3")
    return f.select(F.col("id").alias("player_id"), "match_id", "is_win", F.col("positive_rank").cast("long").alias("positive_rank"), "flux")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)

