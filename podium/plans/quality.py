"""Queries of measures of orders, predictions and trust, each with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import confidence, convert, evaluate, graph, predict, quality, summary
from podium.plans import analytics, reference
from podium.plans.analytics import evaluated
from podium.runtime import table, written
from podium.sources import domain
from podium.sources.domain import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


_round = analytics._round


# ---- orders

_WINS = "SELECT tournament_id, team_id, sum(w) AS wins FROM (SELECT tournament_id, winner_team_id AS team_id, 1 AS w FROM m UNION ALL SELECT tournament_id, loser_team_id, 0 FROM m) GROUP BY ALL"
_Z = """SELECT tournament_id, team_id, row_number() OVER (PARTITION BY tournament_id ORDER BY log_rating DESC, team_id) - 1 AS seed, row_number() OVER (PARTITION BY tournament_id ORDER BY wins DESC, team_id) - 1 AS place,
  count(*) OVER (PARTITION BY tournament_id) AS n FROM (SELECT tournament_id, team_id, round(log_rating, 9) AS log_rating FROM lse) JOIN wins USING (tournament_id, team_id)"""


def _agreement(z: str, g: str) -> str:
    sums = "sum(w) AS w, sum(w * seed) AS wx, sum(w * place) AS wy, sum(w * seed * seed) AS wxx, sum(w * place * place) AS wyy, sum(w * seed * place) AS wxy"
    ndcg = lambda k: f"round(sum((n - place) / log2(seed + 2)) FILTER (seed < {k}) / sum((n - place) / log2(place + 2)) FILTER (place < {k}), 7)"
    return f"""SELECT {g}, items, ndcg_4, ndcg_8, ndcg, spearman, mae, mae_4, mae_8, coalesce(d, 0) AS discordant, round(coalesce(coalesce(d, 0) / nullif(items * (items - 1) / 2.0, 0), 0), 7) AS kendall_distance, round(1 - coalesce(coalesce(d, 0) / nullif(items * (items - 1) / 2.0, 0), 0), 7) AS agreement,
      round(CASE WHEN wxx / w - wx * wx / (w * w) > 1e-15 AND wyy / w - wy * wy / (w * w) > 1e-15 THEN (wxy / w - wx * wy / (w * w)) / sqrt((wxx / w - wx * wx / (w * w)) * (wyy / w - wy * wy / (w * w))) ELSE 0 END, 7) AS weighted_spearman
      FROM (SELECT {g}, count(*) AS items, {ndcg(4)} AS ndcg_4, {ndcg(8)} AS ndcg_8, {ndcg(10**9)} AS ndcg, round(corr(seed, place), 7) AS spearman, round(avg(abs(seed - place)), 7) AS mae, round(avg(abs(seed - place)) FILTER (seed < 4), 7) AS mae_4, round(avg(abs(seed - place)) FILTER (seed < 8), 7) AS mae_8, {sums}
        FROM (SELECT *, 1.0 / (1 + seed) AS w FROM {z}) GROUP BY 1) LEFT JOIN (SELECT a.{g}, count(*) AS d FROM {z} a JOIN {z} b ON b.{g} = a.{g} AND a.seed < b.seed AND a.place > b.place GROUP BY 1) USING ({g})"""


@query(sql("m r last", _agreement("z", "tournament_id"), mem=analytics._MEMBERS, lse=analytics._LSE, wins=_WINS, z=_Z))
def seed_quality(s, d):
    """Seeds by team strength against places by wins, per tournament: NDCG, correlations, seed errors, discordant pairs."""
    t = predict.team_log_rating(analytics._members(s, d)).select("tournament_id", "team_id", F.round("log_rating", 9).alias("rating"))
    m = domain.played(s, d).where("tournament_id is not null")
    wins = m.select("tournament_id", F.col("winner_team_id").alias("team_id"), F.lit(1).alias("w")).unionByName(m.select("tournament_id", F.col("loser_team_id").alias("team_id"), F.lit(0).alias("w")))
    wins = wins.groupBy("tournament_id", "team_id").agg(F.sum("w").alias("wins"))
    orders = quality.placed(t.join(wins, ["tournament_id", "team_id"]), ["tournament_id"], "team_id", -F.col("rating"), -F.col("wins"))
    return _round(quality.order_agreement(orders, ["tournament_id"]))


_TWO = """SELECT 'runs' AS what, n.player_id, row_number() OVER (ORDER BY o.score DESC, n.player_id) - 1 AS seed, row_number() OVER (ORDER BY n.score DESC, n.player_id) - 1 AS place, count(*) OVER () AS n FROM q n JOIN q o ON o.player_id = n.player_id AND o.run = 2 WHERE n.run = 1"""
_Q2 = "SELECT player_id, score, dense_rank() OVER (ORDER BY calculated_at_ms DESC) AS run FROM runs WHERE score IS NOT NULL"


def _run_orders(s: SparkSession, d: str) -> DataFrame:
    """Players in both of the latest two runs: `seed` by the older one's scores, `place` by the newer one's."""
    r = written(domain.runs(s, d).where("score is not null"), "runs")
    at = sorted((x[0] for x in r.select("calculated_at_ms").distinct().collect()), reverse=True)[:2]
    new, old = (r.where(F.col("calculated_at_ms") == a).select("player_id", F.col("score").alias(n)) for a, n in zip((at + [0, 0])[:2], "xy", strict=True))
    return quality.placed(new.join(old, "player_id").withColumn("what", F.lit("runs")), ["what"], "player_id", -F.col("y"), -F.col("x"))


@query(sql("runs", _agreement("z", "what"), q=_Q2, z=_TWO))
def run_agreement(s, d):
    """The orders of the latest two runs as a whole."""
    return _round(quality.order_agreement(_run_orders(s, d), ["what"]))


def _ranks(s: SparkSession, d: str) -> DataFrame:
    return _run_orders(s, d).select((F.col("place") + 1).alias("t"), (F.col("seed") + 1).alias("p"))


_WAYS = {"exponential": "exp(-0.1 * place)", "logarithmic": "1 / ln(place + 2.0)", "hyperbolic": "1.0 / (place + 1)"}
_WC = "SELECT '{k}' AS weighting, sum({w}) AS w, sum({w} * {w}) AS ww, sum({w} * (seed - place) * (seed - place)) AS d FROM z"


@query(sql("runs", "SELECT weighting, round(least(greatest(1 - 6 * d / w / (w * w / ww * (w * w / ww * (w * w / ww) - 1)), -1), 1), 7) AS correlation FROM (" + " UNION ALL ".join(_WC.format(k=k, w=w) for k, w in _WAYS.items()) + ")", q=_Q2, z=_TWO))
def run_weighted_correlations(s, d):
    """Correlation of the latest two runs' ranks with more weight at the top, by three weightings."""
    return _round(quality.weighted_correlations(_ranks(s, d), "t", "p"))


_KS = (10, 20, 50, 100)


@query(sql("runs", " UNION ALL ".join(f"SELECT {k} AS k, round(coalesce(sum(1.0 / (place + 1)) FILTER (place < {k} AND seed < {k}), 0) / sum(1.0 / (place + 1)) FILTER (place < {k}), 7) AS accuracy, round(count(*) FILTER (place < {k} AND seed < {k}) * 1.0 / count(*) FILTER (place < {k} OR seed < {k}), 7) AS jaccard FROM z HAVING count(*) >= {k}" for k in _KS), q=_Q2, z=_TWO))
def run_top_k(s, d):
    """How much of the newer run's first k the older one had."""
    return _round(quality.top_k_accuracy(_ranks(s, d), "t", "p", _KS))


_PCT = (10, 25, 50, 75, 90, 95, 99)


@query(sql("runs", "SELECT round(avg(d), 7) AS mean_abs_diff, max(d) AS max_abs_diff, round(avg(d) FILTER (place < 10), 7) AS top_10_mean_diff, max(d) FILTER (place < 10) AS top_10_max_diff, round(avg(d) FILTER (place < 50), 7) AS top_50_mean_diff, quantile_cont(d, 0.5) AS median_abs_diff, " + ", ".join(f"round(quantile_cont(d, {p / 100}), 7) AS p{p}_abs_diff" for p in _PCT) + " FROM (SELECT place, abs(seed - place)::DOUBLE AS d FROM z)", q=_Q2, z=_TWO))
def run_rank_differences(s, d):
    """How far players' ranks moved between the latest two runs."""
    return _round(quality.rank_differences(_ranks(s, d), "t", "p", _PCT))


# ---- predictions


@query(evaluated("", "SELECT tournament_id, count(*) AS matches, count(*) FILTER (p >= 0.65) AS confident, round(avg((p > 0.5)::INT) FILTER (p >= 0.65), 7) AS accuracy, round(avg((p < 0.5)::INT) / avg(1 - p), 7) AS upset_ratio, round(avg(abs(p - 0.5)), 7) AS separation FROM e GROUP BY 1"))
def confident_accuracy(s, d):
    """Accuracy of predictions of at least 65 %, upsets over expected ones and separation, per tournament."""
    return _round(quality.high_confidence_accuracy(analytics._pred(s, d), ["tournament_id"]))


@query(evaluated("", "SELECT round(avg((coalesce(wr, 0) > coalesce(lr, 0))::INT), 7) AS concordance, count(*) AS matches FROM e"))
def strict_concordance(s, d):
    return _round(quality.strict_concordance(analytics._pred(s, d)))


_IDS = "SELECT id, rating, row_number() OVER (ORDER BY id) - 1 AS at FROM tr"
_MULT = "SELECT x.range AS k FROM range(1, 11) x"
_DEALT = "SELECT k, o.id, b.rating FROM (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY (id % 4294967296 + 4294967296) % 4294967296 * (1103515245 + 15308642 * k) % 4294967296, id) - 1 AS at FROM mult, ids) o JOIN ids b ON b.at = o.at"
_P = "1 / (1 + exp(-(ln(greatest(coalesce(w.rating, 0.05), 1e-12)) - ln(greatest(coalesce(l.rating, 0.05), 1e-12)))))"


@query(evaluated("", f"""SELECT round(a.loss, 7) AS loss, round(b.loss, 7) AS shuffled_loss, round(1 - a.loss / b.loss, 7) AS skill FROM (SELECT avg({analytics._LOSS}) AS loss FROM e) a,
  (SELECT avg(loss) AS loss FROM (SELECT k, avg({analytics._LOSS}) AS loss FROM (SELECT mult.k, {_P} AS p FROM mult, m LEFT JOIN dealt w ON w.id = winner_team_id AND w.k = mult.k LEFT JOIN dealt l ON l.id = loser_team_id AND l.k = mult.k) GROUP BY k)) b""", ids=_IDS, mult=_MULT, dealt=_DEALT))
def skill_score(s, d):
    """One minus the predictions' loss over that of ratings dealt out anew, over ten permutations."""
    return _round(quality.skill(domain.played(s, d), analytics._ratings(s, d)))


_BOTH = "SELECT wr > lr AS a, w.log_rating > l.log_rating AS b FROM e JOIN lse w ON w.tournament_id = e.tournament_id AND w.team_id = winner_team_id JOIN lse l ON l.tournament_id = e.tournament_id AND l.team_id = loser_team_id"


def _both_models(s: SparkSession, d: str) -> DataFrame:
    """Matches with the winner's lead by the mean of exp(score) (`a`) and by log-sum-exp (`b`)."""
    t = predict.team_log_rating(analytics._members(s, d)).select("tournament_id", "team_id", F.round("log_rating", 9).alias("log_rating"))
    m = analytics._pred(s, d)
    for side in ("winner", "loser"):
        m = m.join(t.withColumnsRenamed({"team_id": f"{side}_team_id", "log_rating": side}), ["tournament_id", f"{side}_team_id"])
    return m.select("tournament_id", (F.col("winner_rating") > F.col("loser_rating")).alias("a"), (F.col("winner") > F.col("loser")).alias("b"))


@query(evaluated("", "SELECT x AS only_first, y AS only_second, round(CASE WHEN x + y > 1 THEN (abs(x - y) - 1) * (abs(x - y) - 1) / (x + y)::DOUBLE ELSE 0 END, 7) AS statistic FROM (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM two)",
  mem=analytics._MEMBERS, lse="SELECT tournament_id, team_id, round(log_rating, 9) AS log_rating FROM (" + analytics._LSE + ")", two=_BOTH))
def mcnemar_models(s, d):
    """McNemar's test of two ways to rate a team."""
    return _round(quality.mcnemar(_both_models(s, d), "a", "b")).drop("p_value")


@query(evaluated("", "SELECT n, round(mean, 7) AS mean_difference, round(mean / (sd / sqrt(n)), 5) AS t FROM (SELECT count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS sd FROM (SELECT avg(a::INT) AS a, avg(b::INT) AS b FROM (SELECT e.tournament_id, wr > lr AS a, w.log_rating > l.log_rating AS b FROM e JOIN lse w ON w.tournament_id = e.tournament_id AND w.team_id = winner_team_id JOIN lse l ON l.tournament_id = e.tournament_id AND l.team_id = loser_team_id) GROUP BY tournament_id))",
  mem=analytics._MEMBERS, lse="SELECT tournament_id, team_id, round(log_rating, 9) AS log_rating FROM (" + analytics._LSE + ")"))
def compared_models(s, d):
    """Student's t of the two models' accuracies over the same tournaments."""
    per = _both_models(s, d).groupBy("tournament_id").agg(F.avg(F.col("a").cast("int")).alias("a"), F.avg(F.col("b").cast("int")).alias("b"))
    t = quality.paired_test(written(per, "accuracies"), "a", "b").drop("p_value")
    return t.select("n", F.round("mean_difference", 7).alias("mean_difference"), F.round("t", 5).alias("t"))


@query(evaluated("", "SELECT n, round(coverage, 7) AS coverage, 0.95 AS expected, round(abs(coverage - 0.95), 7) AS error, round(sqrt(coverage * (1 - coverage) / n), 7) AS se, round(mean_width, 7) AS mean_width, round(sd_width, 7) AS sd_width FROM (SELECT count(*) AS n, avg((1 BETWEEN lo AND hi)::INT) AS coverage, avg(hi - lo) AS mean_width, stddev_pop(hi - lo) AS sd_width FROM (SELECT greatest(p - 0.4, 0) AS lo, least(p + 0.4, 1) AS hi FROM e))"))
def interval_coverage(s, d):
    """How often intervals of 0.4 around the chances hold the outcome."""
    x = analytics._pred(s, d).select(F.greatest(F.col("p") - 0.4, F.lit(0.0)).alias("lo"), F.least(F.col("p") + 0.4, F.lit(1.0)).alias("hi"), F.lit(1.0).alias("y"))
    return _round(quality.interval_coverage(x, "lo", "hi", "y"))


_PER = "SELECT tournament_id, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0 END) AS accuracy, avg((1 - p) * (1 - p)) AS brier FROM e GROUP BY 1"


@query(evaluated("", " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS sd, round(min({c}), 7) AS min, round(max({c}), 7) AS max, round(quantile_cont({c}, 0.25), 7) AS q1, round(quantile_cont({c}, 0.5), 7) AS median, round(quantile_cont({c}, 0.75), 7) AS q3, round((SELECT avg({c}) FROM per WHERE {c} BETWEEN (SELECT quantile_cont({c}, 0.1) FROM per) AND (SELECT quantile_cont({c}, 0.9) FROM per)), 7) AS trimmed_mean FROM per" for c in ("accuracy", "brier")), per=_PER))
def metric_summary(s, d):
    """Mean, spread, quartiles and trimmed mean of the tournaments' accuracy and Brier score."""
    x = written(evaluate.weighted_losses(analytics._pred(s, d), ["tournament_id"]).select("accuracy", "brier"), "metrics")
    cols = ["accuracy", "brier"]
    return _round(quality.described(x, cols).join(quality.quartiles(x, cols), "metric"))


@query(evaluated("", "SELECT bin, n, round(mean_value, 7) AS mean_value, round(mean_outcome, 7) AS mean_outcome, round(mean_outcome, 9) >= round(lag(mean_outcome) OVER (ORDER BY bin), 9) AS rises FROM (SELECT CAST(floor((k - 1) * 10 / n) AS BIGINT) AS bin, count(*) AS n, avg(v) AS mean_value, avg(y) AS mean_outcome FROM (SELECT v, y, row_number() OVER (ORDER BY v, y) AS k, (count(*) OVER ())::DOUBLE AS n FROM (SELECT round(p, 9) AS v, won::DOUBLE AS y FROM bw)) GROUP BY 1)", bw=analytics._WAYS))
def rating_monotonicity(s, d):
    """Whether more of what was given more of a chance came true, over ten equal bins."""
    x = evaluate.both_ways(analytics._pred(s, d)).select(F.round("p", 9).alias("p"), "won")
    return _round(quality.monotonicity(x, "p", "won"))


_VOTED = "SELECT v.y, last.score AS x FROM (SELECT player_id, max(top_class::INT) AS y FROM player_votes WHERE top_class IS NOT NULL GROUP BY 1) v JOIN last ON last.player_id = v.player_id AND last.score IS NOT NULL"


@query(sql("last", """SELECT round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 7) AS cohens_d, CASE WHEN n0 > 0 AND n1 > 0 THEN round(overlap, 7) END AS overlap, CASE WHEN n0 > 0 AND n1 > 0 THEN round(best, 7) END AS top_decile FROM (SELECT count(*) FILTER (y = 1) AS n0, count(*) FILTER (y = 0) AS n1, avg(x) FILTER (y = 1) AS m0, avg(x) FILTER (y = 0) AS m1, var_samp(x) FILTER (y = 1) AS v0, var_samp(x) FILTER (y = 0) AS v1 FROM vo) s,
  (SELECT sum(least(a / n0, b / n1)) AS overlap FROM (SELECT least(floor((x - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) FILTER (y = 1)::DOUBLE AS a, count(*) FILTER (y = 0)::DOUBLE AS b FROM vo, (SELECT min(x) AS lo, max(x) AS hi FROM vo) GROUP BY 1), (SELECT count(*) FILTER (y = 1) AS n0, count(*) FILTER (y = 0) AS n1 FROM vo)),
  (SELECT avg(y) AS best FROM vo WHERE x >= (SELECT quantile_cont(x, 0.9) FROM vo))""", vo=_VOTED))
def votes_effect(s, d):
    """How far the scores of voted top players are from the others'."""
    v = table(s, d, "player_votes").where("top_class is not null").groupBy("player_id").agg(F.max(F.col("top_class").cast("int")).alias("y"))
    return _round(quality.effect_size(v.join(domain.latest_run(s, d).where("score is not null"), "player_id"), "score", "y"))


@query(sql("last", """SELECT round(x, 7) AS x, round(y, 7) AS density, coalesce(y > lag(y) OVER (ORDER BY i), true) AND coalesce(y > lead(y) OVER (ORDER BY i), true) AS peak FROM (SELECT g.i, any_value(lo + step * g.i) AS x, sum(c * exp(-0.5 * ((g.i - b.i) * step / w) * ((g.i - b.i) * step / w)) / (w * sqrt(2 * pi()))) / any_value(n) AS y FROM range(200) g(i), st,
  (SELECT CAST(round((score - lo) / step) AS BIGINT) AS i, count(*) AS c FROM last, st WHERE score IS NOT NULL GROUP BY 1) b GROUP BY g.i)""", st="SELECT count(*) AS n, min(score) AS lo, (max(score) - min(score)) / 199 AS step, 1.06 * stddev_samp(score) * pow(count(*), -0.2) AS w FROM last WHERE score IS NOT NULL"))
def score_density(s, d):
    """Kernel density of the latest scores with its peaks."""
    return _round(quality.density(domain.latest_run(s, d), "score"))


# ---- trust

_CONF = """SELECT *, 100.0 * opponents / n AS connectivity FROM (SELECT id, count(DISTINCT tournament_id) AS tournaments, count(DISTINCT match_id) AS matches, count(DISTINCT opp) AS opponents FROM e GROUP BY id), (SELECT count(DISTINCT id) AS n FROM e)"""
_E = "SELECT winner AS id, loser AS opp, true AS won, match_id, tournament_id FROM pairs UNION ALL SELECT loser, winner, false, match_id, tournament_id FROM pairs"
_RK = "SELECT player_id, row_number() OVER (ORDER BY score DESC, player_id) AS rank, count(*) OVER () AS n FROM last WHERE score IS NOT NULL"


def _standing(s: SparkSession, d: str) -> DataFrame:
    return summary.numbered(domain.latest_run(s, d).where("score is not null").select("player_id", "score"), [F.desc("score"), F.asc("player_id")], "rank").select("player_id", "rank")


@query(sql("pairs last", """SELECT c.id AS player_id, round(least(matches * least(opponents * 1.0 / matches, 1), log2(c.n)), 6) AS information_bits, CAST(coalesce(floor(rank * u), floor(c.n * u / 2)) AS BIGINT) AS rank_uncertainty, round(u * 50, 6) AS percentile_uncertainty FROM (SELECT *, least(CASE WHEN matches < 10 THEN 0.30 WHEN matches < 50 THEN 0.14 WHEN matches < 200 THEN 0.07 ELSE 0.05 END * (2 - least(connectivity / 5.0, 1)) + 1 - pow(0.85, ln(n) / ln(greatest(opponents, 2))), 1) AS u FROM cf) c LEFT JOIN rk ON rk.player_id = c.id""",
  e=_E, cf=_CONF, rk=_RK))
def rank_uncertainty(s, d):
    """How unsure each player's place is, and how many bits its matches give."""
    c = summary.confidence(written(reference._compact(s, d), "compact"))
    return _round(confidence.with_uncertainty(c, _standing(s, d)).select("player_id", "information_bits", "rank_uncertainty", "percentile_uncertainty"), 6)


_MET = "SELECT id, opp, count(*) FILTER (won) AS b, count(*) FILTER (NOT won) AS l, any_value(1 - (rank - 1) / rk.n::DOUBLE) AS pct, coalesce(any_value(rank <= floor(rk.n * 0.1)), false)::INT AS t FROM e LEFT JOIN rk ON rk.player_id = opp GROUP BY id, opp"
_ASYM = """SELECT *, CASE WHEN winner THEN least(base * 3, 1) ELSE base END AS overall FROM (SELECT *, least(abs(up - 0.5) + abs(0.5 - down), 1) AS base, tournaments <= 3 AND top_b >= 3 AND oq > 0.5 AS winner FROM (
  SELECT *, CASE WHEN nb > 0 THEN 0.5 * sqrt(oq) + 0.2 * least(nb / 20.0, 1) + 0.3 * least(top_b / 3.0, 1) ELSE 0 END AS up, CASE WHEN nl = 0 THEN 0.5 WHEN by_top = nl THEN 0.2 ELSE 0.7 * (1 - iq) + 0.3 * least(nl / 10.0, 1) END AS down FROM (
  SELECT id, count(*) AS uo, sum(t) AS faced, sum(b * t) AS top_b, sum(l * t) AS by_top, sum(b) AS nb, sum(l) AS nl, coalesce(sum(b * pct) / nullif(sum(b) FILTER (pct IS NOT NULL), 0), 0) AS oq, coalesce(sum(l * pct) / nullif(sum(l) FILTER (pct IS NOT NULL), 0), 0) AS iq, count(*) FILTER (b > 0) AS oe, count(*) FILTER (l > 0) AS ie FROM met GROUP BY id)
  JOIN (SELECT id, count(DISTINCT tournament_id) AS tournaments, count(DISTINCT match_id) AS matches FROM e GROUP BY id) USING (id)))"""
_TIER = "CASE WHEN winner OR round(overall, 9) >= 0.8 THEN 'high' WHEN round(overall, 9) >= 0.6 THEN 'medium' WHEN round(overall, 9) >= 0.4 THEN 'low' ELSE 'provisional' END"


def _asymmetric(s: SparkSession, d: str) -> DataFrame:
    return confidence.asymmetric(written(reference._compact(s, d), "compact"), _standing(s, d))


@query(sql("pairs last", f"SELECT id AS player_id, tournaments, matches, uo AS unique_opponents, CAST(faced AS BIGINT) AS top_opponents_faced, CAST(top_b AS BIGINT) AS top_players_beaten, CAST(by_top AS BIGINT) AS beaten_by_top, round(oq, 9) AS outgoing_quality, round(iq, 9) AS incoming_quality, oe AS outgoing_edges, ie AS incoming_edges, round(up, 9) AS upward_mobility, round(down, 9) AS downward_pressure, winner AS tournament_winner, round(overall, 9) AS overall_confidence, {_TIER} AS tier, CASE WHEN {_TIER} != 'provisional' THEN {_TIER} WHEN uo < 10 THEN 'unrankable' ELSE 'low' END AS rankability FROM asym", e=_E, rk=_RK, met=_MET, asym=_ASYM))
def asymmetric_confidence(s, d):
    """Confidence from the quality of those a player beat and lost to."""
    return _round(_asymmetric(s, d), 9)


@query(sql("pairs last", "SELECT id AS player_id, category FROM (SELECT id, CASE WHEN winner THEN 'tournament_winners' WHEN up > 0.8 AND matches < 20 THEN 'giant_killers' WHEN up > 0.4 AND up < 0.7 AND matches > 50 AND faced > 10 THEN 'gatekeepers' WHEN (faced = 0 OR faced < 3 AND matches > 20) AND matches > 30 THEN 'isolated_active' WHEN matches < 10 AND oq > 0.7 THEN 'provisional_strong' END AS category FROM asym) WHERE category IS NOT NULL", e=_E, rk=_RK, met=_MET, asym=_ASYM))
def special_players(s, d):
    """Players of five special categories."""
    return confidence.special_cases(_asymmetric(s, d))


_TRUST = "SELECT z.player_id, seed + 1 AS p, place + 1 AS t, cf.tournaments, cf.opponents, cf.connectivity FROM z JOIN cf ON cf.id = z.player_id"
_WCOR = "CASE WHEN count(*) > 1 AND sum(w * t * t) / sum(w) - pow(sum(w * t) / sum(w), 2) > 1e-12 AND sum(w * p * p) / sum(w) - pow(sum(w * p) / sum(w), 2) > 1e-12 THEN round((sum(w * t * p) / sum(w) - sum(w * t) * sum(w * p) / (sum(w) * sum(w))) / sqrt((sum(w * t * t) / sum(w) - pow(sum(w * t) / sum(w), 2)) * (sum(w * p * p) / sum(w) - pow(sum(w * p) / sum(w), 2))), 6) END"
_TIERED = "CASE WHEN tournaments >= 20 OR (tournaments >= 15 AND opponents >= 200) OR (tournaments >= 10 AND connectivity >= 5) THEN 'high' WHEN tournaments >= 10 OR (tournaments >= 5 AND opponents >= 100) OR (tournaments >= 5 AND connectivity >= 2) THEN 'medium' WHEN tournaments >= 5 OR (tournaments >= 3 AND opponents >= 50) THEN 'low' ELSE 'provisional' END"


def _trusted(s: SparkSession, d: str) -> DataFrame:
    c = summary.confidence(written(reference._compact(s, d), "compact"))
    return _run_orders(s, d).select("player_id", (F.col("place") + 1).alias("t"), (F.col("seed") + 1).alias("p")).join(c, "player_id")


@query(sql("pairs runs", f"SELECT {_WCOR} AS correlation, count(*) AS n FROM (SELECT *, sqrt(tournaments) AS w FROM tr2)", e=_E, cf=_CONF, q=_Q2, z=_TWO, tr2=_TRUST))
def activity_weighted_correlation(s, d):
    """Correlation of the latest two runs, players weighted by the root of their tournaments."""
    return _round(quality.weighted_spearman(_trusted(s, d), "t", "p", F.sqrt("tournaments")), 6)


@query(sql("pairs runs", f"SELECT tier, {_WCOR} AS correlation, count(*) AS n FROM (SELECT *, 1.0 AS w, {_TIERED} AS tier FROM tr2) GROUP BY 1", e=_E, cf=_CONF, q=_Q2, z=_TWO, tr2=_TRUST))
def tier_correlation(s, d):
    """Correlation of the latest two runs within each tier of confidence."""
    return _round(quality.weighted_spearman(_trusted(s, d), "t", "p", F.lit(1.0), ["tier"]), 6)


@query(sql("te", "SELECT id, min(id) OVER (PARTITION BY root) AS component FROM (SELECT id, min(r) AS root FROM reach GROUP BY id)", n=reference._NODES, bth="SELECT loser AS x, winner AS y FROM te UNION SELECT winner, loser FROM te", reach="SELECT id, id AS r FROM n UNION SELECT bth.x, reach.r FROM reach JOIN bth ON bth.y = reach.id WHERE reach.r < bth.x"))
def team_components(s, d):
    """The connected component of each team, named by its smallest id."""
    return graph.components(_edges(s, d))


# ---- robustness


def _edges(s: SparkSession, d: str) -> DataFrame:
    return written(convert.team_edges(reference._weights(s, d)), "edges")


_VOLUME = "SELECT id, raw / sum(raw) OVER () AS v FROM (SELECT n.id, 1 / sqrt(coalesce(deg, 1)) AS raw FROM (SELECT loser AS id FROM {e} UNION SELECT winner FROM {e}) n LEFT JOIN (SELECT loser AS id, count(*) AS deg FROM {e} GROUP BY 1) g ON g.id = n.id)"
# Ids may be negative: the remainder is brought above 0, as in the operator.
_NUMBER = "((({a}) % 1048576 + 1048576) % 1048576 * 1103515245 + (({b}) % 1048576 + 1048576) % 1048576 * 12820163 + {k}) % 1000003"


def _correlated(variants: dict[str, str], **more: str) -> str:
    """SQL of the rank correlation of each variant's table (id, x) with the table `base`."""
    one = "SELECT '{n}' AS variant, round(corr(a, b), 5) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM (SELECT round(o.x, 12) AS x, round(p.x, 12) AS y FROM base o JOIN {t} p ON p.id = o.id))"
    return sql("te", " UNION ALL ".join(one.format(n=n, t=t) for n, t in variants.items()), v=_VOLUME.format(e="te"), **reference.settled("base", "te", "v"), **more)


def _sensitivity_sql() -> str:
    more = {"u": "SELECT id, 1.0 / count(*) OVER () AS v FROM v"} | reference.settled("pu", "te", "u")
    for i, a in enumerate((0.5, 0.7, 0.9, 0.95)):
        more |= reference.settled(f"pa{i}", "te", "v", alpha=a)
    return _correlated({f"alpha_{a}": f"pa{i}" for i, a in enumerate((0.5, 0.7, 0.9, 0.95))} | {"uniform": "pu"}, **more)


def _changed_sql(edges: str, seeds: tuple[int, ...]) -> str:
    more = {}
    for k in seeds:
        more |= {f"ed{k}": edges.replace("SEED", str(7654321 * k)), f"vd{k}": _VOLUME.format(e=f"ed{k}")} | reference.settled(f"pd{k}", f"ed{k}", f"vd{k}")
    return _correlated({f"seed_{k}": f"pd{k}" for k in seeds}, **more)


@query(_sensitivity_sql())
def teleport_sensitivity(s, d):
    """Rank correlation of team PageRank under other damping and teleport with the usual one."""
    e = _edges(s, d)
    v = written(graph.teleport(e), "teleport")
    rate = lambda cfg=graph.PageRank(), t=v, w=e: graph.pagerank(w, "weight_sum", t, cfg)
    variants = {f"alpha_{a}": (lambda a=a: rate(graph.PageRank(alpha=a))) for a in (0.5, 0.7, 0.9, 0.95)} | {"uniform": lambda: rate(t=graph.teleport(e, "uniform"))}
    return _round(quality.sensitivity(rate(), variants), 5)


def _changed(s: SparkSession, d: str, change: Callable[[DataFrame, int], DataFrame], seeds: tuple[int, ...]) -> DataFrame:
    e = _edges(s, d)
    base = graph.pagerank(e, "weight_sum", graph.teleport(e))

    def rated(seed: int) -> DataFrame:
        f = written(change(e, seed), "changed")
        return graph.pagerank(f, "weight_sum", graph.teleport(f))

    return _round(quality.sensitivity(base, {f"seed_{k}": (lambda k=k: rated(k)) for k in seeds}), 5)


_TURN = "SELECT CASE WHEN t THEN winner ELSE loser END AS loser, CASE WHEN t THEN loser ELSE winner END AS winner, sum(weight_sum) AS weight_sum FROM (SELECT *, " + _NUMBER.format(a="least(loser, winner)", b="greatest(loser, winner) + (loser < winner)::BIGINT * 99991", k="SEED") + " % 2 = 0 AS t FROM te) GROUP BY ALL"


@query(_changed_sql(_TURN, (1, 2, 3)))
def null_shuffle_correlation(s, d):
    """Rank correlation of team PageRank with that of results turned round at random: what chance alone keeps."""
    return _changed(s, d, quality.null_shuffle, (1, 2, 3))


@query(_changed_sql("SELECT * FROM te WHERE " + _NUMBER.format(a="loser", b="winner", k="SEED") + " >= 0.1 * 1000003", (1, 2, 3, 4, 5)))
def edge_dropout_robustness(s, d):
    """Rank correlation of team PageRank with that of graphs that lack a tenth of the edges."""
    return _changed(s, d, lambda e, k: evaluate.edge_dropout(e, 0.1, k), (1, 2, 3, 4, 5))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
