"""Queries of ingestion, stores, streams, exact attribution and synthetic data, each with its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import convert, graph, loo, synth
from podium.plans import analytics
from podium.runtime import table, written
from podium.sources import domain, ingest, store
from podium.sources.domain import NOW, RATE, sql
from podium.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Matches per document, so that no document holds a whole large tournament.
DOC_MATCHES = 500


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def documents(s: SparkSession, d: str) -> DataFrame:
    """(doc): tournaments with their stages, teams and matches as nested texts, several of one tournament if it is large."""
    m = domain.matches(s, d).where("tournament_id is not null")
    opp = lambda i: F.struct(F.col(f"team{i}_id").alias("id"), F.col(f"team{i}_score").alias("score"), F.when(F.col("winner_team_id") == F.col(f"team{i}_id"), "win").when(F.col("loser_team_id") == F.col(f"team{i}_id"), "loss").alias("result"))
    n = written(m.groupBy("tournament_id").agg(F.ceil(F.count(F.lit(1)) / DOC_MATCHES).alias("parts")), "parts")
    part = lambda df, key: df.join(n, "tournament_id", "left").withColumn("part", F.pmod(F.xxhash64(key), F.coalesce("parts", F.lit(1)))).drop("parts")
    match = F.struct(F.col("match_id").alias("id"), "stage_id", F.col("ts").cast("double").alias("lastGameFinishedAt"), opp(1).alias("opponent1"), opp(2).alias("opponent2"))
    pieces = part(m, "match_id").select("tournament_id", "part", match.alias("match"))
    st = table(s, d, "stages").where("stage_id is not null and tournament_id is not null").groupBy("stage_id").agg(F.max("tournament_id").alias("tournament_id"), F.max("stage_name").alias("name"), F.max("stage_number").alias("number"), F.max("stage_type").alias("type"))
    pieces = pieces.unionByName(part(st, "stage_id").select("tournament_id", "part", F.struct(F.col("stage_id").alias("id"), "name", "number", "type").alias("stage")), allowMissingColumns=True)
    r = table(s, d, "roster_entries").dropna(subset=["tournament_id", "team_id", "player_id"]).groupBy("tournament_id", "team_id", "player_id").agg(F.max(F.coalesce("is_owner", F.lit(False))).alias("isOwner"))
    r = r.groupBy("tournament_id", "team_id").agg(F.collect_list(F.struct(F.col("player_id").alias("userId"), "isOwner")).alias("members"))
    flag = lambda c, name: F.max(c).alias(name)
    tt = table(s, d, "tournament_teams").dropna(subset=["tournament_id", "team_id"]).groupBy("tournament_id", "team_id")
    tt = tt.agg(F.max("team_name").alias("name"), F.max("seed").alias("seed"), flag("prefers_not_to_host", "prefersNotToHost"), flag("no_screen", "noScreen"), flag("dropped_out", "droppedOut"), F.max("created_at_ms").alias("createdAt"))
    tt = part(tt.join(r, ["tournament_id", "team_id"], "full"), "team_id")
    team = F.struct(F.col("team_id").alias("id"), "name", "seed", "prefersNotToHost", "noScreen", "droppedOut", "createdAt", "members")
    pieces = pieces.unionByName(tt.select("tournament_id", "part", team.alias("team")), allowMissingColumns=True)
    t = domain.tournaments(s, d)
    pieces = pieces.unionByName(t.select("tournament_id", F.lit(0).cast("long").alias("part")), allowMissingColumns=True)
    g = pieces.groupBy("tournament_id", "part").agg(F.collect_list("match").alias("match"), F.collect_list("stage").alias("stage"), F.collect_list("team").alias("teams")).join(t, "tournament_id", "left")
    group = F.transform("stage", lambda x: F.struct(x["id"].alias("id"), x["id"].alias("stage_id"), F.lit(1).alias("number")))
    two = lambda k: F.transform("stage", lambda x: F.struct((x["id"] * 2 + k).alias("id"), x["id"].alias("stage_id"), x["id"].alias("group_id"), F.lit(k + 1).alias("number"), F.struct(F.lit(3 + 2 * k).alias("count"), F.lit("BEST_OF").alias("type")).alias("maps")))
    data = F.struct("match", "stage", group.alias("group"), F.concat(two(0), two(1)).alias("round"))
    org, settings = F.struct(F.col("org_slug").alias("slug")), F.struct(F.col("is_ranked").alias("isRanked"), F.col("settings_timezone").alias("timezone"))
    ctx = F.struct(F.col("tournament_id").alias("id"), "name", F.col("is_finalized").alias("isFinalized"), org.alias("organization"), settings.alias("settings"), "teams")
    return g.select(F.to_json(F.struct(F.struct(data.alias("data"), ctx.alias("ctx")).alias("tournament"))).alias("doc"))


def _stored_documents(s: SparkSession, d: str) -> DataFrame:
    """The documents as they come back from files, with a file that is cut off beside them."""
    where = incremental.scratch(s, "documents")
    ingest.write_documents(documents(s, d), where)
    store.Folder(s, where).write_text("tournament_broken.json", '{"tournament": {"data": {"match": [{"id": 1')
    return ingest.read_documents(s, where)


@query(sql("mm", "SELECT tournament_id, match_id, team1_id, team2_id, CASE WHEN winner_team_id IN (team1_id, team2_id) THEN winner_team_id END AS winner_team_id, team1_id IS NULL OR team2_id IS NULL AS is_bye FROM mm WHERE tournament_id IS NOT NULL"))
def ingested_matches(s, d):
    """Matches read back from files of nested documents."""
    m = ingest.tables(_stored_documents(s, d))["matches"]
    return m.select("tournament_id", "match_id", "team1_id", "team2_id", "winner_team_id", "is_bye")


_ST = "SELECT stage_id, max(tournament_id) AS tournament_id, max(stage_name) AS stage_name, max(stage_number) AS stage_number, max(stage_type) AS stage_type FROM stages WHERE stage_id IS NOT NULL AND tournament_id IS NOT NULL GROUP BY 1"
_TT = """SELECT coalesce(x.tournament_id, r.tournament_id) AS tournament_id, coalesce(x.team_id, r.team_id) AS team_id, team_name, seed, coalesce(host, false) AS prefers_not_to_host, coalesce(screen, false) AS no_screen, coalesce(dropped, false) AS dropped_out, created_at FROM
  (SELECT tournament_id, team_id, max(team_name) AS team_name, max(seed) AS seed, bool_or(prefers_not_to_host) AS host, bool_or(no_screen) AS screen, bool_or(dropped_out) AS dropped, max(created_at_ms) AS created_at FROM tournament_teams WHERE tournament_id IS NOT NULL AND team_id IS NOT NULL GROUP BY ALL) x
  FULL JOIN (SELECT DISTINCT tournament_id, team_id FROM r) r ON r.tournament_id = x.tournament_id AND r.team_id = x.team_id"""
_IDS = "SELECT tournament_id FROM t UNION SELECT tournament_id FROM mm WHERE tournament_id IS NOT NULL UNION SELECT tournament_id FROM st UNION SELECT tournament_id FROM tt"
_COUNTED = "SELECT tournament_id, count(*) AS n FROM {} GROUP BY 1"


@query(sql("t mm r", f"""SELECT i.tournament_id, name, coalesce(is_finalized, false) AS is_finalized, org_slug, is_ranked, settings_timezone, coalesce(a.n, 0) AS team_count, coalesce(b.n, 0) AS match_count, coalesce(c.n, 0) AS stage_count FROM ids i LEFT JOIN t USING (tournament_id)
  LEFT JOIN ({_COUNTED.format("tt")}) a USING (tournament_id) LEFT JOIN ({_COUNTED.format("mm")}) b USING (tournament_id) LEFT JOIN ({_COUNTED.format("st")}) c USING (tournament_id)""", st=_ST, tt=_TT, ids=_IDS))
def ingested_tournaments(s, d):
    t = ingest.tables(_stored_documents(s, d))["tournaments"]
    return t.select("tournament_id", "name", "is_finalized", "org_slug", "is_ranked", "settings_timezone", "team_count", "match_count", "stage_count")


@query(sql("", "SELECT tournament_id, stage_id, stage_name, stage_number, stage_type FROM st", st=_ST))
def ingested_stages(s, d):
    return ingest.tables(_stored_documents(s, d))["stages"].drop("settings")


@query(sql("", "SELECT tournament_id, stage_id, stage_id AS group_id, 1 AS group_number FROM st", st=_ST))
def ingested_groups(s, d):
    return ingest.tables(_stored_documents(s, d))["groups"]


@query(sql("", "SELECT tournament_id, stage_id, stage_id AS group_id, stage_id * 2 + k AS round_id, CAST(k + 1 AS INTEGER) AS round_number, CAST(3 + 2 * k AS INTEGER) AS maps_count, 'BEST_OF' AS maps_type FROM st, range(2) x(k)", st=_ST))
def ingested_rounds(s, d):
    return ingest.tables(_stored_documents(s, d))["rounds"]


@query(sql("r", "SELECT * FROM tt", tt=_TT))
def ingested_teams(s, d):
    return ingest.tables(_stored_documents(s, d))["teams"]


@query(sql("", "SELECT tournament_id, team_id, player_id AS user_id, bool_or(coalesce(is_owner, false)) AS is_owner FROM roster_entries WHERE tournament_id IS NOT NULL AND team_id IS NOT NULL AND player_id IS NOT NULL GROUP BY ALL"))
def ingested_players(s, d):
    return ingest.tables(_stored_documents(s, d))["players"].select("tournament_id", "team_id", "user_id", "is_owner")


@query("SELECT CAST(1 AS BIGINT) AS corrupt, true AS some_read")
def ingested_corrupt(s, d):
    """Unreadable documents are counted, not lost silently: there is the one that was cut off."""
    x = ingest.readable(_stored_documents(s, d))
    return x.agg(F.count_if(~F.col("ok")).alias("corrupt"), (F.count_if("ok") > 0).alias("some_read"))


@query(sql("a", "SELECT tournament_id, match_id, user_id, team_id FROM a"))
def ingested_appearances(s, d):
    """Appearances read back from payloads listed by match, wrapped twice."""
    a = domain.appearances(s, d)
    team = a.groupBy("tournament_id", "match_id", "team_id").agg(F.collect_list(F.struct(F.col("user_id").alias("userId"))).alias("players"))
    match = team.groupBy("tournament_id", "match_id").agg(F.collect_list(F.struct(F.col("team_id").alias("teamId"), "players")).alias("teams"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("match_id").alias("matchId"), "teams")).alias("matches")).alias("data")))
    return ingest.appearances(match.select("tournament_id", doc.alias("payload")), "tournament_id", "payload").select("tournament_id", "match_id", "user_id", "team_id")


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two imports that together hold every player: those on a roster, then those who played or are on none, with names in capitals."""
    on = domain.rosters(s, d).select(F.col("user_id").alias("player_id")).distinct()
    played = domain.appearances(s, d).select(F.col("user_id").alias("player_id")).distinct()
    p = domain.players(s, d).join(on.withColumn("on", F.lit(True)), "player_id", "left").join(played.withColumn("played", F.lit(True)), "player_id", "left")
    p = written(p, "p")
    new = p.where("played or on is null").select("player_id", F.upper("name").alias("name"), "country")
    return p.where("on").select("player_id", "name", "country"), new


_ON = "SELECT DISTINCT user_id AS player_id FROM r"
_NEW = "SELECT player_id, upper(name) AS name, country FROM p WHERE player_id IN (SELECT user_id FROM a) OR player_id NOT IN (SELECT player_id FROM onroster)"
_OLD = "SELECT player_id, name, country FROM p WHERE player_id IN (SELECT player_id FROM onroster)"


@query(sql("p r a", "SELECT coalesce(n.player_id, o.player_id) AS player_id, CASE WHEN n.player_id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.player_id IS NULL THEN n.country ELSE o.country END AS country FROM o FULL JOIN n ON n.player_id = o.player_id", onroster=_ON, o=_OLD, n=_NEW))
def upsert_players(s, d):
    """An upsert that may only change the name, to null as well."""
    old, new = _batches(s, d)
    t = store.Versioned(s, incremental.scratch(s, "upsert"))
    t.upsert(old, ["player_id"])
    t.upsert(new, ["player_id"], ["name"])
    return t.read()


@query(sql("p r a", "SELECT player_id, name, country FROM o UNION ALL SELECT player_id, name, country FROM n WHERE player_id NOT IN (SELECT player_id FROM o)", onroster=_ON, o=_OLD, n=_NEW))
def insert_absent_players(s, d):
    """Insert if absent."""
    old, new = _batches(s, d)
    t = store.Versioned(s, incremental.scratch(s, "absent"))
    t.insert_absent(old, ["player_id"])
    t.insert_absent(new, ["player_id"])
    return t.read()


@query(sql("", "SELECT user_id, count(*) AS matches, CAST(sum(is_winner::INT) AS BIGINT) AS wins, max(created_us) AS last_us, arg_max(match_id, (created_us, match_id)) AS last_match FROM q GROUP BY 1", q=analytics._Q))
def streamed_latest(s, d):
    """Per-user figures kept by a stream over the events, as far as they go."""
    where = incremental.scratch(s, "latest")
    stream = incremental.read(s, d, "events.parquet")

    def prepare(b: DataFrame) -> DataFrame:
        b = b.where("user_id is not null and ts is not null")
        return b.select(F.col("event_id").alias("match_id"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"), (F.coalesce("value", F.lit(0.0)) >= 50).alias("is_winner"))

    incremental.keep_latest(stream, prepare, f"{where}/table", f"{where}/checkpoint")
    got = store.Versioned(s, f"{where}/table").read()
    empty = s.createDataFrame([], "user_id long, matches long, wins long, last_us long, last_match long")
    return got.drop("batch") if got is not None else empty


@query(sql("", "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS matches, CAST(sum((coalesce(value, 0) >= 50)::INT) AS BIGINT) AS wins FROM events WHERE ts IS NOT NULL GROUP BY 1"))
def hourly_events(s, d):
    """The hourly windows of the stream's plan, run over all rows at once."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("is_winner", F.coalesce("value", F.lit(0.0)) >= 50)
    return incremental.hourly(e, "ts").select(F.unix_micros("hour").alias("hour_us"), "matches", "wins")


@query()
def exact_match_impact(s, d):
    """The exact effect on every player's score of the ten matches that moved it most, either way."""
    c = written(convert.compact(convert.weighted(domain.played(s, d), NOW, RATE), domain.rosters(s, d), domain.appearances(s, d)), "compact")
    scores = written(graph.log_odds(c, graph.Engine(now=NOW, fixed_lambda=0.025)), "scores")
    return loo.exact(c, loo.shortlist(loo.approximated(graph.loo_flux(c, scores)), 10), 0.025).withColumnRenamed("id", "player_id")


@query(sql("mm r t", """SELECT 'match_without_tournament' AS "check", count(*) AS violations FROM mm WHERE tournament_id IS NULL OR tournament_id NOT IN (SELECT tournament_id FROM t)
  UNION ALL SELECT 'roster_without_tournament', count(*) FROM r WHERE tournament_id NOT IN (SELECT tournament_id FROM t)
  UNION ALL SELECT 'team_without_roster', count(*) FROM (SELECT tournament_id, team1_id AS team_id FROM mm WHERE team1_id IS NOT NULL AND tournament_id IS NOT NULL UNION SELECT tournament_id, team2_id FROM mm WHERE team2_id IS NOT NULL AND tournament_id IS NOT NULL) x WHERE (tournament_id, team_id) NOT IN (SELECT tournament_id, team_id FROM r)
  UNION ALL SELECT 'team_against_itself', count(*) FROM mm WHERE team1_id = team2_id
  UNION ALL SELECT 'winner_not_in_match', count(*) FROM mm WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL AND winner_team_id IS NOT NULL AND winner_team_id NOT IN (team1_id, team2_id)
  UNION ALL SELECT 'winner_with_fewer_games', count(*) FROM mm WHERE team1_id IS NOT NULL AND team2_id IS NOT NULL AND ((winner_team_id = team1_id AND team1_score < team2_score) OR (winner_team_id = team2_id AND team2_score < team1_score))
  UNION ALL SELECT 'player_on_two_rosters', count(*) FROM (SELECT tournament_id, user_id FROM r GROUP BY ALL HAVING count(DISTINCT team_id) > 1)"""))
def table_violations(s, d):
    """Consistency checks of the competition tables."""
    return synth.violations(domain.matches(s, d), domain.rosters(s, d), domain.tournaments(s, d))


@query()
def synthetic_league(s, d):
    """A round robin of synthetic teams with simulated series."""
    p = synth.players(s, 256)
    t = written(synth.teams(p), "teams")
    strength = t.groupBy("team_id").agg(F.avg("skill").alias("strength"))
    pairs = synth.round_robin(sorted(r[0] for r in strength.select("team_id").collect()))
    frame = s.createDataFrame([(i, r, a, b) for i, (r, a, b) in enumerate(pairs)], "match_id long, round int, a long, b long")
    return synth.results(frame.drop("round"), strength)


@query()
def synthetic_circuit(s, d):
    """Synthetic events as large as the real ones, each in round robin, through documents into the tables of ingestion; their
    figures beside the real ones'."""
    t = domain.tournaments(s, d).count()
    real = synth.patterns(domain.matches(s, d), domain.rosters(s, d)).first()
    players = synth.pool(s, domain.players(s, d).count())
    r = written(synth.circuit(s, players, max(1, t), 8), "circuit")
    teams = written(r.groupBy("tournament_id", "team_id").agg(F.avg("skill").alias("strength")), "teams")
    a, b = teams.withColumnsRenamed({"team_id": "a", "strength": "sa"}), teams.withColumnsRenamed({"team_id": "b", "strength": "sb"})
    # Eight teams an event at most: every two of them meet, which is what a round robin is.
    m = a.join(b, "tournament_id").where("a < b").withColumn("match_id", F.xxhash64("a", "b"))
    won = synth.uniform(F.col("match_id"), F.lit("won")) < 1 / (1 + F.exp(F.col("sb") - F.col("sa")))
    m = synth.with_scores(m.select("tournament_id", "match_id", "a", "b", F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), (F.col("sa") - F.col("sb")).alias("gap")))
    got = ingest.tables(synth.documents(r, m))
    mine = synth.patterns(got["matches"], got["players"])
    return mine.withColumn("source", F.lit("synthetic")).unionByName(s.createDataFrame([real], mine.schema).withColumn("source", F.lit("real")))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
