"""The competition tables cleaned to what the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.runtime import table

#: The instant that ages count back from: 2025-07-01 00:00 UTC.
NOW = 1751328000.0
HALF_LIFE_DAYS = 180.0
RATE = scalar.half_life_rate(HALF_LIFE_DAYS)


def matches(spark: SparkSession, d: str) -> DataFrame:
    """One row per match, the latest arrived (ties: larger ids), with `ts` in whole seconds from its end or creation."""
    ts = F.floor(F.coalesce(scalar.epoch_seconds(F.col("last_game_finished_at")), scalar.epoch_seconds(F.col("match_created_at")))).cast("long")
    fields = ["winner_team_id", "loser_team_id", "tournament_id", "stage_id", "total_games", "ts", "is_bye", "team1_id", "team2_id", "team1_score", "team2_score"]
    by = [F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))).alias("at"), *[F.coalesce(F.col(c), F.lit(-1)).alias(f"k{c}") for c in fields[:6]]]
    m = table(spark, d, "matches").withColumn("ts", ts).where("match_id is not null")
    g = m.groupBy("match_id").agg(F.max_by(F.struct(*fields), F.struct(*by)).alias("m"))
    return g.select("match_id", "m.*")


def played(spark: SparkSession, d: str) -> DataFrame:
    """Matches with two teams, no bye and a time."""
    return matches(spark, d).where("winner_team_id is not null and loser_team_id is not null and coalesce(is_bye, false) = false and ts is not null")


def rosters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster_entries").select("tournament_id", "team_id", F.col("player_id").alias("user_id")).dropna().distinct()


def appearances(spark: SparkSession, d: str) -> DataFrame:
    """One row per (tournament, match, user), with the largest team that any of its rows names."""
    a = table(spark, d, "player_appearances").select("tournament_id", "match_id", F.col("player_id").alias("user_id"), "team_id")
    return a.dropna(subset=["tournament_id", "match_id", "user_id"]).groupBy("tournament_id", "match_id", "user_id").agg(F.max("team_id").alias("team_id"))


def tournaments(spark: SparkSession, d: str) -> DataFrame:
    """One row per tournament: name, organiser and flags of its latest import."""
    at = F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.coalesce("name", F.lit("")), F.coalesce("org_slug", F.lit("")))
    g = table(spark, d, "tournaments").where("tournament_id is not null").groupBy("tournament_id")
    return g.agg(F.max_by(F.struct("name", "org_slug", "is_ranked", "is_finalized", "settings_timezone"), at).alias("t")).select("tournament_id", "t.*")


def players(spark: SparkSession, d: str) -> DataFrame:
    """One row per player, with the largest name and country that any of its rows gives."""
    p = table(spark, d, "players").where("player_id is not null").groupBy("player_id")
    return p.agg(F.max(scalar.squeezed(F.col("display_name"))).alias("name"), F.max(scalar.country(F.col("country"))).alias("country"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per player and run: the largest finite score (null if there is none) and the exposure."""
    r = table(spark, d, "rankings").where("player_id is not null and calculated_at_ms is not null")
    num = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    return r.groupBy("player_id", "calculated_at_ms").agg(F.max(num("score")).alias("score"), F.max(num("exposure")).alias("exposure"), F.max(num("win_pr")).alias("win_pr"), F.max(num("loss_pr")).alias("loss_pr"))


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    last = table(spark, d, "rankings").agg(F.max("calculated_at_ms")).first()[0]
    return r.where(F.col("calculated_at_ms") == F.lit(last).cast("long"))


def _epoch_sql(x: str) -> str:
    cases = " ".join(f"WHEN {x} >= {scalar.FIRST_S * u}.0 AND {x} < {scalar.LAST_S * u}.0 THEN {x} / {u}.0" for u in (1, 1000, 10**6, 10**9))
    return f"CASE WHEN isnan({x}) THEN NULL {cases} END"


#: Common table expressions with the same content; `{NOW}` and the rest are filled in.
CTES = {
    "mm": f"""SELECT * EXCLUDE (rn) FROM (SELECT match_id, winner_team_id, loser_team_id, tournament_id, stage_id, total_games, ts, is_bye, team1_id, team2_id, team1_score, team2_score,
      row_number() OVER (PARTITION BY match_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(winner_team_id,-1) DESC, coalesce(loser_team_id,-1) DESC,
        coalesce(tournament_id,-1) DESC, coalesce(stage_id,-1) DESC, coalesce(total_games,-1) DESC, coalesce(ts,-1) DESC) AS rn
      FROM (SELECT *, CAST(floor(coalesce({_epoch_sql("last_game_finished_at")}, {_epoch_sql("match_created_at")})) AS BIGINT) AS ts FROM matches WHERE match_id IS NOT NULL)) WHERE rn = 1""",
    "m": "SELECT * FROM mm WHERE winner_team_id IS NOT NULL AND loser_team_id IS NOT NULL AND coalesce(is_bye, false) = false AND ts IS NOT NULL",
    "r": "SELECT DISTINCT tournament_id, team_id, player_id AS user_id FROM roster_entries WHERE tournament_id IS NOT NULL AND team_id IS NOT NULL AND player_id IS NOT NULL",
    "a": "SELECT tournament_id, match_id, player_id AS user_id, max(team_id) AS team_id FROM player_appearances WHERE tournament_id IS NOT NULL AND match_id IS NOT NULL AND player_id IS NOT NULL GROUP BY ALL",
    "ai": "SELECT DISTINCT a.tournament_id, a.match_id, a.user_id, coalesce(a.team_id, r.team_id) AS team_id FROM a LEFT JOIN r ON r.tournament_id = a.tournament_id AND r.user_id = a.user_id WHERE coalesce(a.team_id, r.team_id) IS NOT NULL",
    "t": """SELECT * EXCLUDE (rn) FROM (SELECT tournament_id, name, org_slug, is_ranked, is_finalized, settings_timezone, row_number() OVER (PARTITION BY tournament_id ORDER BY
      coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(name,'') DESC, coalesce(org_slug,'') DESC) AS rn FROM tournaments WHERE tournament_id IS NOT NULL) WHERE rn = 1""",
    "p": r"SELECT player_id, max(trim(regexp_replace(display_name, '\s+', ' ', 'g'))) AS name, max(nullif(upper(substr(trim(country), 1, 2)), '')) AS country FROM players WHERE player_id IS NOT NULL GROUP BY player_id",
    "runs": "SELECT player_id, calculated_at_ms, max(CASE WHEN NOT isnan(score) THEN score END) AS score, max(CASE WHEN NOT isnan(exposure) THEN exposure END) AS exposure, max(CASE WHEN NOT isnan(win_pr) THEN win_pr END) AS win_pr, max(CASE WHEN NOT isnan(loss_pr) THEN loss_pr END) AS loss_pr FROM rankings WHERE player_id IS NOT NULL AND calculated_at_ms IS NOT NULL GROUP BY ALL",
    "last": "SELECT * FROM runs WHERE calculated_at_ms = (SELECT max(calculated_at_ms) FROM rankings)",
    "w": f"SELECT m.*, exp(-({NOW} - ts) / 86400.0 * {RATE!r}) AS weight FROM m",
    "rl": "SELECT tournament_id, team_id, list_sort(list(user_id)) AS roster FROM r GROUP BY ALL",
    "pl": "SELECT tournament_id, match_id, team_id, list_sort(list(DISTINCT user_id)) AS played FROM ai GROUP BY ALL",
    "c": """SELECT match_id, tournament_id, winners, losers, weight, ts, len(winners) AS winner_count, len(losers) AS loser_count, weight / (len(winners) * len(losers)) AS share FROM (
      SELECT w.match_id, w.tournament_id, weight, ts, coalesce(pw.played, rw.roster) AS winners, coalesce(pl2.played, rl2.roster) AS losers FROM w
      LEFT JOIN rl rw ON rw.tournament_id = w.tournament_id AND rw.team_id = winner_team_id LEFT JOIN rl rl2 ON rl2.tournament_id = w.tournament_id AND rl2.team_id = loser_team_id
      LEFT JOIN pl pw ON pw.tournament_id = w.tournament_id AND pw.match_id = w.match_id AND pw.team_id = winner_team_id
      LEFT JOIN pl pl2 ON pl2.tournament_id = w.tournament_id AND pl2.match_id = w.match_id AND pl2.team_id = loser_team_id) WHERE winners IS NOT NULL AND losers IS NOT NULL""",
    "cw": "SELECT match_id, tournament_id, ts, weight, share, losers, unnest(winners) AS winner FROM c",
    "pairs": "SELECT match_id, tournament_id, ts, weight, share, winner, unnest(losers) AS loser FROM cw",
    "ex": "SELECT id, sum(weight) AS exposure, sum(share) AS e_share, max(ts) AS last_ts FROM (SELECT unnest(list_concat(winners, losers)) AS id, weight, share, ts FROM c) GROUP BY id",
    "te": "SELECT loser_team_id AS loser, winner_team_id AS winner, sum(weight) AS weight_sum FROM w GROUP BY ALL",
}
_NEEDS = {"m": ["mm"], "ai": ["a", "r"], "last": ["runs"], "w": ["m"], "rl": ["r"], "pl": ["ai"], "c": ["w", "rl", "pl"], "cw": ["c"], "pairs": ["cw"], "ex": ["c"], "te": ["w"]}


def sql(names: str, body: str, **more: str) -> str:
    """`body` after the named expressions and all they need; `more` are further ones, in order."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    # A recursive expression can't be materialised; it names itself.
    kind = lambda n, s: "" if f" {n} " in s else " MATERIALIZED"
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS{kind(n, s)} ({s})" for n, s in more.items()]
    return ("WITH " + ("RECURSIVE " if any(not kind(n, s) for n, s in more.items()) else "") + ",\n".join(parts) + "\n" if parts else "") + body
