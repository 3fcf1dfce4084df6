"""Queries pN_ of the problems 2, 5, 7, 8 and 9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import mix, pack, pairwise, reading, top_n
from podium.runtime import beside, broadcast_if_small, table, written

#: p2's top class: least decided matches, and odds of four of a kind against four of median strength.
LEAST_DECIDED, TOP_ODDS = 40, 20
CAPACITY = 8192
TOP = 5


def _rating(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.rating(table(spark, d, "player_appearances"), table(spark, d, "matches"), table(spark, d, "roster_entries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Players of the top class with at least 40 decided matches."""
    return _rating(spark, d).where((F.col("matches") >= LEAST_DECIDED) & (F.col("odds") > TOP_ODDS)).select("player_id")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All rated players in one order with their strength."""
    r = pairwise.ranking(_rating(spark, d))
    return r.select("player_id", "matches", "place", *[F.round(c, 6).alias(c) for c in ("offence", "defence", "strength", "odds")])


def p2_strengths(spark: SparkSession, d: str) -> DataFrame:
    """The logarithms of all rated players' strengths and odds."""
    r = _rating(spark, d).where("strength is not null")
    return r.select("player_id", "matches", F.round(F.log("strength"), 6).alias("log_strength"), F.round(F.log("odds"), 6).alias("log_odds"))


def _best(spark: SparkSession, d: str) -> DataFrame:
    t = written(table(spark, d, "tournaments").select("tournament_id").dropna().distinct(), "tournaments")
    a = table(spark, d, "player_appearances").select("tournament_id", "player_id").dropna()
    r = table(spark, d, "rankings").select("player_id", "score", "calculated_at_ms")
    latest = r.agg(F.max("calculated_at_ms")).first()[0]
    run = r.where(F.col("calculated_at_ms") == F.lit(latest).cast("long"))
    return top_n.top_n(a.join(broadcast_if_small(t), "tournament_id", "left_semi"), run, "tournament_id", "player_id", "score", TOP)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The 5 best-scored players of each tournament."""
    return _best(spark, d).select("tournament_id", "player_id")


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    """The same with score and position."""
    return _best(spark, d)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their size in tokens of a byte-level tokenizer: the bytes of the UTF-8 text, 0 for null."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document or piece of one."""
    return pack.pack(_tokens(spark, d), "doc_id", "tokens", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, how many there must be, and how full they are."""
    c = p7_packing(spark, d).where("container is not null").agg(F.max("container").alias("last"), F.sum("size").alias("tokens"))
    n, t = F.coalesce(F.col("last") + 1, F.lit(0)), F.coalesce("tokens", F.lit(0))
    return c.select(n.alias("containers"), F.ceil(t / CAPACITY).alias("at_least"), t.alias("tokens"), F.try_divide(t.cast("double"), n * CAPACITY).alias("fill"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing keeps its promises: every document whole and in order of pieces, no container over its capacity,
    only documents beyond it in several pieces, and at most 5 % (and one) more containers than must be."""
    docs, got = _tokens(spark, d), written(p7_packing(spark, d), "packing")
    per = got.groupBy("doc_id").agg(F.sum("size").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    j = docs.join(per, "doc_id", "full")
    least = F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1))
    whole = (F.col("packed") == F.col("tokens")) & (F.col("pieces") == least) & (F.col("last") == F.col("pieces") - 1)
    a = j.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole"))
    room = got.where("container is not null").groupBy("container").agg(F.sum("size").alias("n"))
    b = room.agg(F.count(F.lit(1)).alias("containers"), F.count_if(F.col("n") > CAPACITY).alias("over_capacity"))
    must = F.ceil(F.col("tokens") / CAPACITY)
    return beside(a, b).select("documents", "tokens", "pieces", "not_whole", "over_capacity", must.alias("at_least"), (F.col("containers") <= must * 1.05 + 1).alias("near_least"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the packing split."""
    return p7_packing(spark, d).where("piece = 1 and container is not null").select("doc_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _tokens(spark, d).select(F.col("doc_id").alias("item"), mix.source_key(F.col("source")).alias("key"), F.col("tokens").alias("size"))
    return mix.mixed(docs, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of a listed source is drawn."""
    got, q = _mixed(spark, d)
    names = q.select("key", "source")
    return got.join(broadcast_if_small(names), "key").select(F.col("item").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mix.shares(*_mixed(spark, d))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Each listed source's target, what it has and wants, whether it is short, and whether its draw keeps to that: within
    one record of what it wants, or all of its permitted copies if it is short."""
    docs = _tokens(spark, d).select(F.col("doc_id").alias("item"), mix.source_key(F.col("source")).alias("key"), F.col("tokens").alias("size"))
    largest = docs.groupBy("key").agg(F.max("size").alias("largest"))
    drawn, q = mix.mixed(docs, table(spark, d, "mix_targets"))
    s = mix.shares(drawn, q).withColumn("key", mix.source_key(F.col("source"))).join(largest, "key", "left")
    near = F.abs(F.col("drawn_tokens") - F.col("wanted")) <= F.coalesce("largest", F.lit(0))
    kept = F.when(F.col("short"), F.col("drawn_tokens") == F.col("max_repeats") * F.col("tokens")).otherwise(near) & (F.col("most_repeats") <= F.col("max_repeats"))
    return s.select("source", F.round("target", 9).alias("target"), "records", "tokens", F.round("wanted", 3).alias("wanted"), F.col("max_repeats").cast("long").alias("max_repeats"), "short", kept.alias("kept"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources that can't reach their share."""
    return p8_shares(spark, d).where("short").select("source")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return reading.levels(docs, reading.fit(docs, table(spark, d, "level_labels").select("doc_id", "reading_level")))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading levels of each document's description and of its prose."""
    return _levels(spark, d)


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language, source and level of their prose."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("lang")).alias("lang"), mix.source_key(F.col("source")).alias("source_key"))
    l = written(_levels(spark, d).select("doc_id", "prose_level"), "levels")
    return docs.join(l, "doc_id").groupBy("lang", "source_key", "prose_level").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose description is of level 4 or 5."""
    return _levels(spark, d).where("description_p4 > 0.5").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = [p2_found, p2_ranking, p2_strengths, p5_found, p5_top, p7_found, p7_packing, p7_fill, p7_check, p8_found, p8_mix, p8_shares, p8_check, p9_found, p9_levels, p9_profile]
    return {f.__name__: f for f in q}


_TOP = """SELECT tournament_id, player_id, score, row_number() OVER (PARTITION BY tournament_id ORDER BY score DESC, player_id) AS position
  FROM (SELECT DISTINCT tournament_id, player_id FROM player_appearances WHERE tournament_id IN (SELECT tournament_id FROM tournaments)) a
  JOIN (SELECT player_id, max(score) AS score FROM rankings WHERE calculated_at_ms = (SELECT max(calculated_at_ms) FROM rankings) AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1) r USING (player_id)"""
_KEY = "nullif(regexp_replace(lower(source), '[^\\p{L}\\p{N}]+', '', 'g'), '')"


# Who won and lost each decided match, a match's factor, and the alternating rescaling until it settles, as SQL.
_SIDES = """dec AS MATERIALIZED (SELECT match_id, arg_max(winner_team_id, k) AS winner, arg_max(loser_team_id, k) AS loser FROM (SELECT *, (coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), winner_team_id, loser_team_id) AS k FROM matches WHERE is_bye IS NOT TRUE AND winner_team_id IS NOT NULL AND loser_team_id IS NOT NULL AND match_id IS NOT NULL) GROUP BY 1),
  ap AS MATERIALIZED (SELECT a.tournament_id, a.match_id, a.player_id, winner, loser, CASE WHEN team_id = winner THEN true WHEN team_id = loser THEN false END AS own FROM player_appearances a JOIN dec ON dec.match_id = a.match_id WHERE a.player_id IS NOT NULL),
  ro AS MATERIALIZED (SELECT DISTINCT tournament_id, player_id, team_id FROM roster_entries WHERE tournament_id IS NOT NULL AND player_id IS NOT NULL AND team_id IS NOT NULL),
  gu AS MATERIALIZED (SELECT ap.match_id, ap.player_id, CASE WHEN own IS NULL THEN CASE WHEN w.team_id IS NOT NULL AND l.team_id IS NULL THEN true WHEN l.team_id IS NOT NULL AND w.team_id IS NULL THEN false END END AS guess, own FROM ap LEFT JOIN ro w ON w.tournament_id = ap.tournament_id AND w.player_id = ap.player_id AND w.team_id = winner LEFT JOIN ro l ON l.tournament_id = ap.tournament_id AND l.player_id = ap.player_id AND l.team_id = loser),
  si AS MATERIALIZED (SELECT match_id, player_id, CASE WHEN count(own) > 0 THEN CASE WHEN bool_and(own) = bool_or(own) THEN bool_or(own) END ELSE CASE WHEN bool_and(guess) = bool_or(guess) THEN bool_or(guess) END END AS won FROM gu GROUP BY ALL),
  fa AS MATERIALIZED (SELECT match_id, 1.0 / (count(*) FILTER (won) * count(*) FILTER (NOT won)) AS w FROM si WHERE won IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (won) > 0 AND count(*) FILTER (NOT won) > 0),
  ra AS MATERIALIZED (SELECT match_id, player_id, won, w FROM si JOIN fa USING (match_id) WHERE won IS NOT NULL)"""


def _half(state: str, vector: str, gives: str) -> str:
    """The vector of the giving side, of geometric mean 1, from the other side's."""
    other = f"SELECT r.match_id, sum(1 / q.{vector}) AS s FROM ra r JOIN {state} q ON q.id = r.player_id WHERE r.won != {gives} GROUP BY 1"
    got = f"SELECT r.player_id AS id, sum(r.w * t.s) AS s FROM ra r JOIN ({other}) t ON t.match_id = r.match_id WHERE r.won = {gives} GROUP BY 1"
    return f"SELECT id, raw / exp(avg(ln(raw)) OVER ()) AS v FROM (SELECT x.id, {pairwise.SMOOTH} + coalesce(g.s, 0) AS raw FROM {state} x LEFT JOIN ({got}) g ON g.id = x.id)"


def _rating_sql(body: str) -> str:
    step = f"""WITH no AS MATERIALIZED ({_half("st", "d", "true")}), nd AS MATERIALIZED ({_half("(SELECT id, v AS o FROM no)", "o", "false")})
      SELECT st.i + 1, st.id, no.v, nd.v, max(abs(ln(no.v / st.o))) OVER () FROM st JOIN no ON no.id = st.id JOIN nd ON nd.id = st.id WHERE st.i < {pairwise.ROUNDS} AND (st.change IS NULL OR st.change >= {pairwise.TOLERANCE})"""
    return f"""WITH RECURSIVE {_SIDES}, st AS (SELECT 0 AS i, player_id AS id, 1.0::DOUBLE AS o, 1.0::DOUBLE AS d, NULL::DOUBLE AS change FROM (SELECT DISTINCT player_id FROM ra) UNION ALL ({step})),
      str AS MATERIALIZED (SELECT id AS player_id, o, d, o / d AS strength, o / d / (SELECT quantile_cont(o / d, 0.5) FROM st WHERE i = (SELECT max(i) FROM st)) AS odds FROM st WHERE i = (SELECT max(i) FROM st)), pl AS MATERIALIZED (SELECT player_id, count(*) AS matches FROM si GROUP BY 1) {body}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _rating_sql(f"SELECT player_id FROM str JOIN pl USING (player_id) WHERE matches >= {LEAST_DECIDED} AND odds > {TOP_ODDS}"),
        "p2_ranking": _rating_sql("SELECT player_id, matches, row_number() OVER (ORDER BY round(strength, 9) DESC, player_id) AS place, round(o, 6) AS offence, round(d, 6) AS defence, round(strength, 6) AS strength, round(odds, 6) AS odds FROM str JOIN pl USING (player_id)"),
        "p2_strengths": _rating_sql("SELECT player_id, matches, round(ln(strength), 6) AS log_strength, round(ln(odds), 6) AS log_odds FROM str JOIN pl USING (player_id)"),
        "p5_found": f"SELECT tournament_id, player_id FROM ({_TOP}) WHERE position <= {TOP}",
        "p5_top": f"SELECT tournament_id, player_id, score, CAST(position AS INTEGER) AS position FROM ({_TOP}) WHERE position <= {TOP}",
        "p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {CAPACITY}",
        "p7_check": f"""SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(ceil(n / {CAPACITY}.0), 1)) AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS over_capacity, CAST(ceil(sum(n) / {CAPACITY}.0) AS BIGINT) AS at_least, true AS near_least
          FROM (SELECT coalesce(strlen(text), 0) AS n FROM documents)""",
        "p8_check": f"""SELECT source, round(share, 9) AS target, records, tokens, round(share * total, 3) AS wanted, CAST(max_repeats AS BIGINT) AS max_repeats, max_repeats * tokens < share * total AS short, true AS kept FROM (
          SELECT t.source, t.max_repeats, t.target_share / sum(t.target_share) OVER () AS share, coalesce(d.records, 0) AS records, CAST(coalesce(d.tokens, 0) AS BIGINT) AS tokens, sum(coalesce(d.tokens, 0)) OVER () AS total FROM
          (SELECT *, {_KEY} AS k FROM mix_targets) t LEFT JOIN (SELECT {_KEY} AS k, count(*) AS records, sum(coalesce(strlen(text), 0)) AS tokens FROM documents GROUP BY 1) d ON d.k = t.k)""",
        "p8_found": f"""SELECT source FROM (SELECT t.source, t.max_repeats, t.target_share / sum(t.target_share) OVER () AS share, coalesce(d.tokens, 0) AS tokens, sum(coalesce(d.tokens, 0)) OVER () AS total FROM
          (SELECT *, {_KEY} AS k FROM mix_targets) t LEFT JOIN (SELECT {_KEY} AS k, sum(coalesce(strlen(text), 0)) AS tokens FROM documents GROUP BY 1) d ON d.k = t.k) WHERE max_repeats * tokens < share * total""",
    }
