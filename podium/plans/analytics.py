"""Queries of evaluation, prediction and queue operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import evaluate, predict, queue
from podium.plans import reference
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


def _round(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


# Teams' ratings for the evaluations: the mean of exp(score) of their rated members.
_TR = "SELECT team_id AS id, avg(exp(score)) AS rating FROM r JOIN last ON last.player_id = r.user_id AND score IS NOT NULL GROUP BY 1"
_PRED = """SELECT m.match_id, m.tournament_id, m.ts, winner_team_id, loser_team_id, w.rating AS wr, l.rating AS lr, 1 / (1 + exp(-(ln(greatest(coalesce(w.rating, 0.05), 1e-12)) - ln(greatest(coalesce(l.rating, 0.05), 1e-12))))) AS p
  FROM m LEFT JOIN tr w ON w.id = winner_team_id LEFT JOIN tr l ON l.id = loser_team_id"""


def _ratings(s: SparkSession, d: str) -> DataFrame:
    r = domain.rosters(s, d).join(domain.latest_run(s, d).where("score is not null").select(F.col("player_id").alias("user_id"), "score"), "user_id")
    return written(r.groupBy(F.col("team_id").alias("id")).agg(F.avg(F.exp("score")).alias("rating")), "ratings")


def _pred(s: SparkSession, d: str) -> DataFrame:
    return evaluate.predicted(domain.played(s, d), _ratings(s, d))


def evaluated(names: str, body: str, **more: str) -> str:
    return sql(f"m r last {names}", body, tr=_TR, e=_PRED, **more)


_LOSS = "-ln(least(greatest(p, 1e-15), 1 - 1e-15))"
_FAR = "abs(p - 0.5) * 2"
_W = {"none": "1.0", "entropy": _FAR, "entropy_sqrt": f"sqrt({_FAR})", "entropy_squared": f"({_FAR}) * ({_FAR})", "var_inv": "1 / (p * (1 - p))", "entropy_exp": f"pow(2.0, {_FAR})", "threshold": "CASE WHEN abs(p - 0.5) > 0.1 THEN 1.0 ELSE 0.1 END"}


@query(evaluated("", "SELECT tournament_id, count(*) AS matches, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0 END), 7) AS accuracy, round(avg((1 - p) * (1 - p)), 7) AS brier, round(avg(p), 7) AS mean_p, " + ", ".join(f"round(sum({w} * {_LOSS}) / nullif(sum({w}), 0), 7) AS loss_{k}" for k, w in _W.items()) + " FROM e GROUP BY 1"))
def tournament_losses(s, d):
    """Losses of predictions per tournament under seven weightings."""
    x = _pred(s, d)
    g = evaluate.weighted_losses(x, ["tournament_id"])
    return _round(g)


@query(evaluated("", f"SELECT CAST(least(floor((greatest(p, 1 - p) - 0.5) * 10), 4) AS BIGINT) AS bucket, count(*) AS matches, round(avg({_LOSS}), 7) AS mean_loss FROM e GROUP BY 1"))
def loss_buckets(s, d):
    return _round(evaluate.buckets(_pred(s, d)))


_WAYS = "SELECT CASE WHEN winner_team_id < loser_team_id THEN p ELSE 1 - p END AS p, CASE WHEN winner_team_id < loser_team_id THEN 1 ELSE 0 END AS won FROM e"
_REL = "SELECT b.range AS bucket, coalesce(matches, 0) AS matches, expected, observed, abs(expected - observed) AS gap FROM range(10) b LEFT JOIN (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS k, count(*) AS matches, avg(p) AS expected, avg(won) AS observed FROM bw GROUP BY 1) g ON g.k = b.range"


@query(evaluated("", "SELECT bucket, matches, round(expected, 7) AS expected, round(observed, 7) AS observed, round(gap, 7) AS gap FROM rel", bw=_WAYS, rel=_REL))
def reliability_diagram(s, d):
    return _round(evaluate.reliability(evaluate.both_ways(_pred(s, d))))


@query(evaluated("", "SELECT round(sum(gap * matches) / sum(matches), 7) AS ece FROM rel", bw=_WAYS, rel=_REL))
def calibration_error(s, d):
    return _round(evaluate.ece(evaluate.reliability(evaluate.both_ways(_pred(s, d)))))


@query(evaluated("", "SELECT tournament_id, count(*) AS matches, round(avg(CASE WHEN wr > lr THEN 1.0 WHEN wr = lr THEN 0.5 ELSE 0 END), 7) AS concordance FROM e WHERE wr IS NOT NULL AND lr IS NOT NULL GROUP BY 1"))
def concordance(s, d):
    return _round(evaluate.concordance(_pred(s, d), ["tournament_id"]))


@query(evaluated("", "SELECT favourite, matches, upsets, round(expected, 6) AS expected, round(upsets / expected, 6) AS ratio FROM (SELECT CASE WHEN greatest(p, 1 - p) <= 0.6 THEN '50-60' WHEN greatest(p, 1 - p) <= 0.7 THEN '60-70' WHEN greatest(p, 1 - p) <= 0.8 THEN '70-80' WHEN greatest(p, 1 - p) <= 0.9 THEN '80-90' ELSE '90-100' END AS favourite, count(*) AS matches, count(*) FILTER (p < 0.5) AS upsets, sum(1 - greatest(p, 1 - p)) AS expected FROM e GROUP BY 1)"))
def upset_rates(s, d):
    return _round(evaluate.upsets(_pred(s, d)), 6)


_GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


@query(evaluated("", " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, round(avg(-ln(least(greatest(1 / (1 + exp(-{a} * ln(p / (1 - p)))), 1e-15), 1 - 1e-15))), 7) AS loss FROM e" for a in _GRID)))
def alpha_grid(s, d):
    """Loss of each exponent in one pass."""
    return _round(evaluate.alpha_losses(domain.played(s, d), _ratings(s, d), _GRID))


_GRID9 = "SELECT {i} AS i, lo + k * (hi - lo) / 8 AS a, lo, hi FROM {b}, range(9) x(k)"
_AT = "SELECT a, avg(-ln(least(greatest(1 / (1 + exp(-a * gap)), 1e-15), 1 - 1e-15))) AS loss, any_value(lo) AS lo, any_value(hi) AS hi FROM lg, ({g}) GROUP BY a"
_CLOSER = "SELECT greatest(lo, a - (hi - lo) / 8) AS lo, least(hi, a + (hi - lo) / 8) AS hi FROM {l} ORDER BY loss, a LIMIT 1"


def _alpha_sql() -> str:
    more = {"lg": "SELECT ln(greatest(coalesce(wr, 0.05), 1e-12)) - ln(greatest(coalesce(lr, 0.05), 1e-12)) AS gap FROM e", "b0": "SELECT 0.05::DOUBLE AS lo, 5.0::DOUBLE AS hi"}
    for i in range(1, 5):
        more[f"l{i}"] = _AT.format(g=_GRID9.format(i=i, b=f"b{i - 1}"))
        more[f"b{i}"] = _CLOSER.format(l=f"l{i}")
    return evaluated("", "SELECT round((lo + hi) / 2, 6) AS alpha FROM b4", **more)


@query(_alpha_sql())
def alpha_fit(s, d):
    """The exponent of least loss, by grids that close in around the best point."""
    a = evaluate.fitted_alpha(written(domain.played(s, d), "m"), _ratings(s, d))
    return s.createDataFrame([(a,)], "alpha double").withColumn("alpha", F.round("alpha", 6))


@query(sql("runs", """SELECT round(corr(a, b), 7) AS spearman, count(*) AS n FROM (SELECT (rank() OVER (ORDER BY x DESC)) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, (rank() OVER (ORDER BY y DESC)) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM (
  SELECT n.score AS x, o.score AS y FROM q n JOIN q o ON o.player_id = n.player_id AND o.run = 2 WHERE n.run = 1))""", q="SELECT player_id, score, dense_rank() OVER (ORDER BY calculated_at_ms DESC) AS run FROM runs WHERE score IS NOT NULL"))
def run_correlation(s, d):
    """Spearman's correlation of the latest two runs."""
    r = written(domain.runs(s, d).where("score is not null"), "runs")
    at = sorted((x[0] for x in r.select("calculated_at_ms").distinct().collect()), reverse=True)[:2]
    new, old = (r.where(F.col("calculated_at_ms") == a).select("player_id", F.col("score").alias(n)) for a, n in zip((at + [0, 0])[:2], "xy", strict=True))
    return _round(evaluate.spearman(written(new.join(old, "player_id"), "both"), "x", "y"))


@query(sql("last", """SELECT round((sum(CASE WHEN y = 1 THEN a END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 7) AS auc, count(*) AS n FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a FROM (
  SELECT v.y, last.score FROM (SELECT player_id, max(top_class::INT) AS y FROM player_votes WHERE top_class IS NOT NULL GROUP BY 1) v JOIN last ON last.player_id = v.player_id AND last.score IS NOT NULL))"""))
def votes_auc(s, d):
    """How well the latest scores tell voted top players from the others."""
    v = table(s, d, "player_votes").where("top_class is not null").groupBy("player_id").agg(F.max(F.col("top_class").cast("int")).alias("y"))
    return _round(evaluate.auc(written(v.join(domain.latest_run(s, d).where("score is not null"), "player_id"), "votes"), "score", "y"))


@query(sql("last", "SELECT round(sum((2 * k - n - 1) * exposure) / (max(n) * sum(exposure)), 7) AS gini, count(*) AS n FROM (SELECT exposure, row_number() OVER (ORDER BY exposure) AS k, count(*) OVER () AS n FROM last WHERE exposure IS NOT NULL)"))
def exposure_gini(s, d):
    return _round(evaluate.gini(domain.latest_run(s, d).select("exposure"), "exposure"))


@query()
def temporal_cross_validation(s, d):
    """Loss and accuracy per temporal fold: players rated on what came before, teams by their rated members."""
    out = None
    m, r = (written(f(s, d), "cv") for f in (domain.played, domain.rosters))
    m = written(reference.with_sides(m, r, domain.appearances(s, d)), "cv")
    for i, (train, test) in enumerate(evaluate.folds(m, 5)):
        teams = written(reference.rated_teams(train, r), "teams")
        x = evaluate.weighted_losses(evaluate.predicted(test, teams, prior=1.0), []).withColumn("fold", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out


@query()
def accuracy_interval(s, d):
    """Accuracy of predictions with a bootstrap interval."""
    p = _pred(s, d).select("match_id", (F.col("p") > 0.5).cast("double").alias("hit"))
    return evaluate.bootstrap(p, "hit", 500)


# ---- prediction

_MEMBERS = "SELECT r.tournament_id, r.team_id, r.user_id, score FROM r JOIN last ON last.player_id = r.user_id AND score IS NOT NULL"
_LSE = "SELECT tournament_id, team_id, max(score) + ln(sum(exp(score - hi))) AS log_rating, count(*) AS members FROM (SELECT *, max(score) OVER (PARTITION BY tournament_id, team_id) AS hi FROM mem) GROUP BY ALL"


def _members(s: SparkSession, d: str) -> DataFrame:
    return domain.rosters(s, d).join(domain.latest_run(s, d).where("score is not null").select(F.col("player_id").alias("user_id"), "score"), "user_id")


@query(sql("r last", "SELECT tournament_id, team_id, round(log_rating, 7) AS log_rating, members FROM lse", mem=_MEMBERS, lse=_LSE))
def team_strength(s, d):
    return _round(predict.team_log_rating(_members(s, d)))


@query(sql("r last", """SELECT tournament_id, team_id, log_rating, row_number() OVER w AS seed, round(1 - exp(-least(coalesce(lag(log_rating) OVER w - log_rating, 1e308), coalesce(log_rating - lead(log_rating) OVER w, 1e308))), 7) AS confidence
  FROM lse WINDOW w AS (PARTITION BY tournament_id ORDER BY log_rating DESC, team_id)""", mem=_MEMBERS, lse="SELECT tournament_id, team_id, round(log_rating, 9) AS log_rating FROM (" + _LSE + ")"))
def tournament_seeds(s, d):
    t = predict.team_log_rating(_members(s, d)).withColumn("log_rating", F.round("log_rating", 9))
    return predict.seeds(t).withColumn("confidence", F.round("confidence", 7))


_ENT = """SELECT tournament_id, team_id, o, o + ln(1 + CASE WHEN n > 1 THEN least(greatest(h / ln(n), 0), 1) ELSE 0 END * (exp(ln(e + (4 - n) * exp(-10.0)) - o) - 1)) AS rating FROM (SELECT tournament_id, team_id, n, o, e, -list_sum(list_transform(x, lambda v: exp(v) / e * ln(exp(v) / e + 1e-10))) AS h FROM (
  SELECT tournament_id, team_id, list(score) AS x, count(*) AS n, (sum(score) + (4 - count(*)) * -10.0) / 4 AS o, sum(exp(score)) AS e FROM (SELECT *, row_number() OVER (PARTITION BY tournament_id, team_id ORDER BY score DESC, user_id) AS k FROM mem) WHERE k <= 4 GROUP BY ALL))"""


@query(sql("r last", "SELECT tournament_id, team_id, round(o, 7) AS baseline, round(rating, 7) AS rating FROM ent", mem=_MEMBERS, ent=_ENT))
def entropy_ratings(s, d):
    return _round(predict.entropy_rating(_members(s, d)))


@query(sql("r last", "SELECT tournament_id, team_id, k AS place, CASE WHEN k <= 16 THEN 'Division 1' WHEN k <= 48 THEN 'Division 2' ELSE 'Division 3' END AS division FROM (SELECT tournament_id, team_id, row_number() OVER (ORDER BY round(rating, 7) DESC, tournament_id, team_id) AS k FROM ent)", mem=_MEMBERS, ent=_ENT))
def team_divisions(s, d):
    e = _round(predict.entropy_rating(_members(s, d)))
    return predict.divisions(e, "rating", ["tournament_id", "team_id"]).select("tournament_id", "team_id", F.col("place").cast("long").alias("place"), "division")


@query(sql("m r last", "SELECT round(b, 5) AS slope, 0.0::DOUBLE AS intercept FROM nw WHERE i = 25", mem=_MEMBERS, lse=_LSE, gp="SELECT w.log_rating - l.log_rating AS gap FROM m JOIN lse w ON w.tournament_id = m.tournament_id AND w.team_id = winner_team_id JOIN lse l ON l.tournament_id = m.tournament_id AND l.team_id = loser_team_id",
  nw="SELECT 0 AS i, 0.0::DOUBLE AS b UNION ALL SELECT any_value(i) + 1, any_value(b) + greatest(-5, least(5, sum((1 - p) * gap) / (sum(p * (1 - p) * gap * gap) + 5e-10))) FROM (SELECT i, b, gap, 1 / (1 + exp(-b * gap)) AS p FROM nw , gp WHERE i < 25) HAVING count(*) > 0"))
def match_calibration(s, d):
    """Slope and intercept that turn gaps of team strength into chances."""
    t = predict.team_log_rating(_members(s, d)).select("tournament_id", "team_id", "log_rating")
    m = domain.played(s, d)
    for side in ("winner", "loser"):
        m = m.join(t.withColumnsRenamed({"team_id": f"{side}_team_id", "log_rating": side}), ["tournament_id", f"{side}_team_id"])
    a, b = predict.calibrate(written(m.select((F.col("winner") - F.col("loser")).alias("gap")), "gaps"))
    return s.createDataFrame([(round(a, 5), round(b, 7) + 0.0)], "slope double, intercept double")


@query()
def monte_carlo_places(s, d):
    return predict.monte_carlo(predict.team_log_rating(_members(s, d)), runs=10_000)


@query(sql("r last", "SELECT tournament_id, team_id, true AS near FROM mem GROUP BY ALL", mem=_MEMBERS))
def monte_carlo_check(s, d):
    """Whether simulated chances to come first are within 2 % of the softmax of the ratings, which they approach."""
    t = written(predict.team_log_rating(_members(s, d)), "teams")
    j = predict.monte_carlo(t, runs=10_000).join(predict.first_chances(t).withColumnRenamed("p_first", "p"), ["tournament_id", "team_id"])
    return j.select("tournament_id", "team_id", (F.abs(F.col("p_first") - F.col("p")) < 0.02).alias("near"))


_H = "((-p * ln(p + 1e-10) - (1 - p) * ln(1 - p + 1e-10)) / ln(2))"
_WU = {"none": "1.0", "entropy": _H, "entropy_sqrt": f"sqrt({_H})", "entropy_squared": f"({_H} * {_H})", "var_inv": "(1 / (p * (1 - p) + 1e-10))", "entropy_exp": f"pow(2.0, {_H})", "threshold": "(abs(p - 0.5) >= 0.1)::INT"}


@query(evaluated("", "SELECT tournament_id, count(*) AS matches, " + ", ".join(f"round(sum({w} * {_LOSS}) / nullif(sum({w}), 0), 6) AS loss_{k}" for k, w in _WU.items()) + " FROM e GROUP BY 1"))
def uncertainty_losses(s, d):
    """Losses per tournament under the entropy-based weights."""
    return _round(evaluate.uncertainty_losses(_pred(s, d), ["tournament_id"]), 6)


# ---- queue, over the events table: purchases are wins, errors cancelled matches

_Q = "SELECT event_id AS match_id, user_id, ts, epoch_us(ts) AS created_us, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS created_s, coalesce(value, 0) >= 50 AS is_winner, CASE WHEN event_id % 17 = 0 THEN 'cancelled' WHEN coalesce(value, 0) >= 50 THEN 'alpha' ELSE 'bravo' END AS winner, floor(coalesce(value, 0) / 10.0) * 10 + 1000 AS sp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 7 - 3) * 1.0 END AS sp_diff FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"


def _queue(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("user_id is not null and ts is not null")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    v = F.coalesce("value", F.lit(0.0))
    return e.select(
        F.col("event_id").alias("match_id"), "user_id", us.alias("created_us"), F.floor(us / 1e6).cast("long").alias("created_s"), (v >= 50).alias("is_winner"),
        F.when(F.col("event_id") % 17 == 0, "cancelled").when(v >= 50, "alpha").otherwise("bravo").alias("winner"), (F.floor(v / 10.0) * 10.0 + 1000).alias("sp"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 7 - 3) * 1.0).alias("sp_diff"),
    )


@query(sql("", "SELECT season, count(*) AS matches, min(created_s) AS first_s, max(created_s) AS last_s FROM (SELECT *, sum(CASE WHEN gap > 172800 THEN 1 ELSE 0 END) OVER (ORDER BY created_s, match_id) AS season FROM (SELECT *, created_s - lag(created_s) OVER (ORDER BY created_s, match_id) AS gap FROM q)) GROUP BY 1", q=_Q).replace("SELECT season,", "SELECT CAST(season AS BIGINT) AS season,"))
def queue_seasons(s, d):
    """Seasons by gaps of more than two days, over all events."""
    return queue.season_metadata(queue.seasons(_queue(s, d)))


_ROLL = ", ".join(f"count(is_winner) OVER w{n} AS count_{n}, CAST(sum(is_winner::INT) OVER w{n} AS BIGINT) AS won_{n}, CAST(sum(is_winner::INT) OVER w{n} - is_winner::INT AS BIGINT) AS won_prior_{n}" for n in ("7d", "24h"))


@query(sql("", f"SELECT match_id, user_id, {_ROLL} FROM q WINDOW w7d AS (PARTITION BY user_id ORDER BY created_us RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW), w24h AS (PARTITION BY user_id ORDER BY created_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)", q=_Q))
def queue_rolling(s, d):
    return queue.rolling(_queue(s, d), {"7d": 7 * 86400, "24h": 86400}).select("match_id", "user_id", *[f"{a}_{n}" for n in ("7d", "24h") for a in ("count", "won", "won_prior")])


@query(sql("", "SELECT match_id, user_id, round(CASE WHEN count(sp) OVER w = 7 THEN stddev_samp(sp) OVER w END, 6) AS sp_std_7 FROM q WINDOW w AS (PARTITION BY user_id ORDER BY created_us, match_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", q=_Q))
def queue_rolling_std(s, d):
    return _round(queue.rolling_std(_queue(s, d), "sp").select("match_id", "user_id", "sp_std_7"), 6)


@query(sql("", "SELECT match_id, user_id, CAST(CASE WHEN winner = 'cancelled' THEN 0 ELSE coalesce(sum(CASE WHEN winner != 'cancelled' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_us, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS cum_matches FROM q", q=_Q))
def queue_cumulative(s, d):
    return queue.cumulative(_queue(s, d)).select("match_id", "user_id", "cum_matches")


@query(sql("", "SELECT match_id, user_id, round(sp + sum(coalesce(sp_diff, 0)) OVER (PARTITION BY user_id, seg ORDER BY created_us, match_id), 6) AS after_sp FROM (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY created_us, match_id) AS seg FROM (SELECT *, coalesce((sp != lag(sp) OVER (PARTITION BY user_id ORDER BY created_us, match_id))::INT, 0) AS changed FROM q))", q=_Q))
def queue_corrected_points(s, d):
    return _round(queue.corrected(_queue(s, d)).select("match_id", "user_id", "after_sp"), 6)


@query(sql("", "SELECT user_id, match_id, created_us, winner, sp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_us DESC, match_id DESC) AS n FROM q WHERE winner != 'cancelled') WHERE n = 1", q=_Q))
def queue_latest(s, d):
    return queue.latest(_queue(s, d)).select("user_id", "match_id", "created_us", "winner", "sp")


@query()
def queue_slots(s, d):
    """Chart slots of overlapping matches, which last as many minutes as their value."""
    m = queue.seasons(_queue(s, d)).select("match_id", "season", "created_s", (F.col("created_s") + 60 * (1 + F.col("match_id") % 50)).alias("reported_s"))
    return queue.slots(m)


@query(sql("", """SELECT x.match_id, x.user_id, round(lz - (own.s - lz) / 3, 6) AS teammate_diff, round(lz - en.s / 4, 6) AS enemy_diff FROM g x LEFT JOIN gs own ON own.match_id = x.match_id AND own.group_id = x.group_id LEFT JOIN gs en ON en.match_id = x.match_id AND en.group_id = x.enemy_group_id""", q=_Q,
  g="SELECT CAST(floor(match_id / 8.0) AS BIGINT) AS match_id, match_id AS row_id, user_id, match_id % 2 AS group_id, 1 - match_id % 2 AS enemy_group_id, (ln(sp) - avg(ln(sp)) OVER ()) / stddev_pop(ln(sp)) OVER () AS lz FROM q", gs="SELECT match_id, group_id, sum(lz) AS s FROM g GROUP BY ALL"))
def queue_group_differences(s, d):
    """Players' points against their mates' and enemies', for groups of eight consecutive events."""
    q = queue.logz(_queue(s, d), "sp").select(F.floor(F.col("match_id") / 8).alias("match_id"), "user_id", (F.col("match_id") % 2).alias("group_id"), (1 - F.col("match_id") % 2).alias("enemy_group_id"), F.col("sp_logz").alias("lz"))
    return _round(queue.against_group(q, "lz").select("match_id", "user_id", "teammate_diff", "enemy_diff"), 6)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)

