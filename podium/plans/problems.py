"""Queries pN_ of the general data-processing problems (1, 3, 4, 6) over the competition tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions import instants
from podium.operators import feature_table, nested, orphan_refs
from podium.runtime import broadcast_if_small, table, written

#: p1_found's numbers: least matches, and the instant (2025-01-02 00:00 UTC) before which the latest one ended.
LEAST_MATCHES, ENDED_BEFORE_MS = 4, 1735776000000
USUAL_CREATED_AT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6})?Z$"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return feature_table.organiser_vectors(table(spark, d, "player_appearances"), table(spark, d, "matches"), table(spark, d, "tournaments"))


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per player: matches, games and days since the last end (before the latest of all) for each organiser."""
    vectors, types = _vectors(spark, d)
    vectors = written(vectors, "vectors")
    as_of = feature_table.cells(vectors).agg(F.max("latest_ms")).first()[0] or 0
    names = [(r["type_idx"], r["org_slug"]) for r in types.orderBy("type_idx").collect()]
    return feature_table.expand(vectors, names, as_of).withColumnRenamed("entity", "player_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Players and organisers with at least 4 matches, the latest of which ended before 2025-01-02."""
    vectors, types = _vectors(spark, d)
    hit = feature_table.cells(vectors).where((F.col("n") >= LEAST_MATCHES) & (F.col("latest_ms") < ENDED_BEFORE_MS))
    return hit.join(broadcast_if_small(types), "type_idx").select(F.col("entity").alias("player_id"), "org_slug")


def _references(spark: SparkSession, d: str) -> list[orphan_refs.Reference]:
    t = {n: table(spark, d, n) for n in ("matches", "player_appearances", "tournaments", "tournament_teams")}
    return [
        orphan_refs.Reference("matches.winner_team_id", t["matches"], "match_id", "winner_team_id", t["tournament_teams"], "team_id", "team"),
        orphan_refs.Reference("player_appearances.tournament_id", t["player_appearances"], "appearance_id", "tournament_id", t["tournaments"], "tournament_id", "tournament"),
        orphan_refs.Reference("player_appearances.match_id", t["player_appearances"], "appearance_id", "match_id", t["matches"], "match_id", "match"),
    ]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record whose reference is deleted, missing or late."""
    return orphan_refs.find(_references(spark, d), table(spark, d, "removed_records")).select("reference", "record_id", "kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted by reference, month of arrival and kind."""
    return orphan_refs.per_period(orphan_refs.find(_references(spark, d), table(spark, d, "removed_records")))


META = ("bracketProgression", "sources", "placements")
SETTINGS = ("groups", "rounds", "maps")
_META_PATHS = tuple("$." + ".".join(META[: i + 1]) for i in range(3))
_SETTINGS_PATHS = tuple("$." + ".".join(SETTINGS[: i + 1]) for i in range(3))


def _meta_nodes(spark: SparkSession, d: str, paths: tuple[str, ...] | None) -> DataFrame:
    return nested.shred(table(spark, d, "tournaments"), "tournament_id", "meta", META[0], META, paths)


def _settings_nodes(spark: SparkSession, d: str, paths: tuple[str, ...] | None) -> DataFrame:
    return nested.shred(table(spark, d, "stages"), "stage_id", "settings", SETTINGS[0], SETTINGS, paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Placements of tournaments' metas and maps of stages' settings with their positions."""
    keys = ["record_id", F.col("pos_1").alias("pos1"), F.col("pos_2").alias("pos2"), F.col("pos").alias("pos3")]
    placements = nested.linked(_meta_nodes(spark, d, _META_PATHS), _META_PATHS)
    a = placements.select(F.lit("tournaments.meta").alias("origin"), *keys, F.col("value").alias("leaf"))
    mode_path = _SETTINGS_PATHS[2] + ".mode"
    nodes = written(_settings_nodes(spark, d, (*_SETTINGS_PATHS, mode_path)), "nodes")
    maps = nested.linked(nodes, _SETTINGS_PATHS)
    modes = nested.linked(nodes, (_SETTINGS_PATHS[2], mode_path)).select("record_id", "doc", F.col("pre_1").alias("pre"), F.col("value").alias("mode"))
    maps = maps.join(modes, ["record_id", "doc", "pre"], "left")
    b = maps.select(F.lit("stages.settings").alias("origin"), *keys, F.coalesce("mode", "value").alias("leaf"))
    return a.unionByName(b).distinct()


def _node_query(nodes: Callable[[SparkSession, str, tuple[str, ...] | None], DataFrame], paths: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.linked(nodes(spark, d, paths), paths)

    run.__doc__ = f"The table of {paths[-1]} nodes, each with its own interval and the number (pre) and position of its ancestors."
    return run


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every type (path) of both sources' texts, with its interval, position, value and its parent's number."""
    parts = ((_meta_nodes, "tournaments.meta"), (_settings_nodes, "stages.settings"))
    a, b = (nested.parented(nodes(spark, d, None)).withColumn("origin", F.lit(name)) for nodes, name in parts)
    return a.unionByName(b)


def _zoned_matches(spark: SparkSession, d: str) -> DataFrame:
    return feature_table.match_instants(table(spark, d, "matches"), table(spark, d, "tournaments"))


def _tournament_starts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tournaments").select("tournament_id", "start_time_ms", "settings_timezone")
    return instants.resolve(t, "start_time_ms", "settings_timezone")


def _player_creations(spark: SparkSession, d: str) -> DataFrame:
    return instants.resolve(table(spark, d, "players").select("player_id", "created_at"), "created_at")


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three fields with its instant, layout, posterior and status (resolved, ambiguous, none)."""
    cols = ["utc_ms", "layout", F.round("posterior", 6).alias("posterior"), "status"]
    parts = [
        (_tournament_starts(spark, d), "tournaments.start_time_ms", "tournament_id"),
        (_zoned_matches(spark, d), "matches.last_game_finished_at", "match_id"),
        (_player_creations(spark, d), "players.created_at", "player_id"),
    ]
    out = [df.select(F.lit(f).alias("field"), F.col(k).alias("record_id"), F.col(f.split(".")[1]).cast("string").alias("written_as"), *cols) for df, f, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants of the values that aren't in their field's usual form."""
    starts = _tournament_starts(spark, d).where("layout != 'epoch_ms'")
    ends = _zoned_matches(spark, d).where("layout != 'epoch_s'")
    made = _player_creations(spark, d).where(~F.col("created_at").rlike(USUAL_CREATED_AT))
    out = None
    for df, f, k in ((starts, "tournaments.start_time_ms", "tournament_id"), (ends, "matches.last_game_finished_at", "match_id"), (made, "players.created_at", "player_id")):
        part = df.where("utc_ms is not null").select(F.lit(f).alias("field"), F.col(k).alias("record_id"), "utc_ms")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    node = lambda n, p, k: _node_query(n, p[:k])
    return {
        "p1_found": p1_found,
        "p1_features": p1_features,
        "p1_cells": p1_cells,
        "p1_merged": p1_merged,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
        "p4_brackets": node(_meta_nodes, _META_PATHS, 1),
        "p4_sources": node(_meta_nodes, _META_PATHS, 2),
        "p4_placements": node(_meta_nodes, _META_PATHS, 3),
        "p4_groups": node(_settings_nodes, _SETTINGS_PATHS, 1),
        "p4_rounds": node(_settings_nodes, _SETTINGS_PATHS, 2),
        "p4_maps": node(_settings_nodes, _SETTINGS_PATHS, 3),
        "p4_nodes": p4_nodes,
        "p6_found": p6_found,
        "p6_instants": p6_instants,
        "p6_numbers": p6_numbers,
    }


_REFS = (
    ("matches.winner_team_id", "matches", "match_id", "winner_team_id", "tournament_teams", "team_id", "team"),
    ("player_appearances.tournament_id", "player_appearances", "appearance_id", "tournament_id", "tournaments", "tournament_id", "tournament"),
    ("player_appearances.match_id", "player_appearances", "appearance_id", "match_id", "matches", "match_id", "match"),
)
_MISSES = " UNION ALL ".join(
    f"""SELECT '{name}' AS reference, rec AS record_id, CASE WHEN f.k IS NOT NULL THEN 'late' WHEN g.internal_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind, seen
  FROM (SELECT {rec} AS rec, {col} AS k, min(ingested_at) AS seen FROM {child} WHERE {col} IS NOT NULL GROUP BY ALL) x LEFT JOIN (SELECT {key} AS k, min(ingested_at) AS first FROM {parent} GROUP BY 1) f ON f.k = x.k
  LEFT JOIN (SELECT DISTINCT internal_id FROM removed_records WHERE entity_type = '{e}') g ON g.internal_id = x.k WHERE f.k IS NULL OR x.seen < f.first"""
    for name, child, rec, col, parent, key, e in _REFS
)


# The ends of matches as instants, in SQL: a count in seconds, milliseconds or microseconds, days from 1899-12-30, or a local
# time in 12 or 14 digits in the tournament's zone. Of a time that occurs twice the first counts: the engine takes the later
# one, so an hour earlier is tried; one that doesn't occur is moved on by the gap.
_ZONED = "SELECT tournament_id, arg_max(coalesce(settings_timezone, 'UTC'), (coalesce(ingested_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), settings_timezone IS NOT NULL, coalesce(settings_timezone, ''))) AS zone FROM tournaments WHERE tournament_id IS NOT NULL GROUP BY 1"


def _instants_sql(rows: str) -> str:
    """`ms` for every row of (..., w, f, zone): the whole and the broken part of a number, and the zone of local times."""
    at = "timezone(zone, l)"
    return f"""SELECT *, CASE WHEN raw_ms >= 1609459200000 AND raw_ms < 1767225600000 THEN CAST(raw_ms AS BIGINT) END AS ms FROM (SELECT *, CASE layout WHEN 'epoch_s' THEN w * 1000 + floor(f * 1000 + 0.5) WHEN 'epoch_ms' THEN w + floor(f + 0.5) WHEN 'epoch_us' THEN (w + 500) // 1000 WHEN 'epoch_ns' THEN (w + 500000) // 1000000
      WHEN 'serial_days' THEN floor((w + f - 25569) * 86400000 + 0.5) WHEN 'digits' THEN epoch_ms(CASE WHEN timezone(zone, {at} - INTERVAL 1 HOUR) = l THEN {at} - INTERVAL 1 HOUR ELSE {at} END) END AS raw_ms FROM (
      SELECT *, CASE WHEN layout = 'digits' THEN coalesce(CASE WHEN len(d) = 14 THEN try_strptime(d, '%Y%m%d%H%M%S') END, CASE WHEN len(d) = 12 THEN try_strptime(d, '%Y%m%d%H%M') END) END AS l FROM (
      SELECT *, CAST(w AS VARCHAR) AS d, CASE WHEN f = 0 AND len(CAST(w AS VARCHAR)) IN (12, 14) AND substr(CAST(w AS VARCHAR), 1, 2) IN ('19', '20') THEN 'digits' ELSE map {{5: 'serial_days', 10: 'epoch_s', 13: 'epoch_ms', 16: 'epoch_us', 19: 'epoch_ns'}}[len(CAST(w AS VARCHAR))] END AS layout FROM ({rows}) WHERE w > 0)))"""


_ENDS = _instants_sql("SELECT m.match_id, m.tournament_id, CAST(floor(v) AS HUGEINT) AS w, v - floor(v) AS f, coalesce(z.zone, 'UTC') AS zone FROM (SELECT *, last_game_finished_at AS v FROM matches WHERE NOT isnan(last_game_finished_at) AND last_game_finished_at BETWEEN 1 AND 9e18) m LEFT JOIN zoned z ON z.tournament_id = m.tournament_id")
_STARTS = _instants_sql("SELECT tournament_id, CAST(start_time_ms AS HUGEINT) AS w, 0.0::DOUBLE AS f, coalesce(settings_timezone, 'UTC') AS zone FROM tournaments WHERE start_time_ms IS NOT NULL")
# Players' times of creation, which are texts: what gives the zone is taken off, then the fraction, then the rest is read.
_NAMED = {n: m for n, m in instants.ABBREVIATIONS.items()}
_SHAPES = {
    "first": r"([A-Z]\w+/[\w/+-]+) (\S+ \S+)", "last": r"(.*?)(?:\[(\w+/[\w/]+)\]| (\w+/[\w/]+))", "short": r"(.*(?:\d| [AP]M)) ?([A-Za-z]{3,4}|[Zz])", "offset": r"(.*:\d\d(?:[.,]\d+)?(?: [AP]M)?) ?([+-])(\d\d):?(\d\d)?",
}
_TIMES = "'%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y%m%dT%H%M%S', '%Y/%m/%d %H:%M:%S', '%d.%m.%Y %H:%M', '%d %b %Y %H:%M:%S', '%d/%b/%Y:%H:%M:%S', '%b %d, %Y %I:%M:%S %p'"


def _texts_sql() -> str:
    x = {k: (f"regexp_full_match(s, '{p}')", lambda i, p=p: f"regexp_extract(s, '^{p}$', {i})") for k, p in _SHAPES.items()}
    names = "map {" + ", ".join(f"'{n}': {m}" for n, m in _NAMED.items()) + "}"
    short = x["short"][1](2)
    at = "timezone(zone, l)"
    return rf"""SELECT player_id, CASE WHEN raw >= 1609459200000 AND raw < 1767225600000 THEN raw END AS ms FROM (SELECT player_id, ms + CASE WHEN zone IS NULL THEN epoch_ms(l) - east * 60000 ELSE epoch_ms(CASE WHEN timezone(zone, {at} - INTERVAL 1 HOUR) = l THEN {at} - INTERVAL 1 HOUR ELSE {at} END) END AS raw FROM (
      SELECT *, coalesce(try_strptime(r, [{_TIMES}]), try_strptime(r, ['%Y-%m-%d', '%d.%m.%Y', '%Y%m%d']) + INTERVAL '23:59:59.999') AS l FROM (SELECT player_id, nullif(zone, '') AS zone, coalesce(east, 0) AS east, coalesce((rpad(substr(nullif(regexp_extract(rest, '^(.*:\d\d)[.,](\d+)$', 2), ''), 1, 9), 9, '0')::BIGINT + 500000) // 1000000, 0) AS ms,
        regexp_replace(regexp_replace(regexp_replace(rest, '^(.*:\d\d)[.,]\d+$', '\1'), '^(\d{{4}}-\d\d-\d\d)t', '\1T'), '^[A-Z][a-z]{{2}}, (\d\d [A-Z])', '\1') AS r FROM (
        SELECT player_id, CASE WHEN {x["first"][0]} THEN {x["first"][1](1)} WHEN {x["last"][0]} THEN {x["last"][1](2)} || {x["last"][1](3)} END AS zone,
          CASE WHEN {x["first"][0]} OR {x["last"][0]} THEN 0 WHEN {x["short"][0]} AND {names}[upper({short})] IS NOT NULL THEN {names}[upper({short})] WHEN {x["offset"][0]} THEN (CASE {x["offset"][1](2)} WHEN '-' THEN -1 ELSE 1 END) * ({x["offset"][1](3)}::INT * 60 + coalesce(nullif({x["offset"][1](4)}, '')::INT, 0)) END AS east,
          CASE WHEN {x["first"][0]} THEN {x["first"][1](2)} WHEN {x["last"][0]} THEN {x["last"][1](1)} WHEN {x["short"][0]} AND {names}[upper({short})] IS NOT NULL THEN {x["short"][1](1)} WHEN {x["offset"][0]} THEN {x["offset"][1](1)} ELSE s END AS rest
        FROM (SELECT player_id, regexp_replace(replace(created_at, chr(160), ' '), '^\s+|\s+$', '', 'g') AS s FROM players WHERE created_at IS NOT NULL AND NOT regexp_matches(created_at, '{USUAL_CREATED_AT}')) WHERE NOT regexp_full_match(s, '\d{{9,}}(\.\d+)?')))))"""


_COUNTED = _instants_sql(r"SELECT player_id, CAST(regexp_extract(s, '^\d+') AS HUGEINT) AS w, coalesce(('0' || nullif(regexp_extract(s, '\.\d+$'), ''))::DOUBLE, 0.0) AS f, 'UTC' AS zone FROM (SELECT player_id, regexp_replace(created_at, '^\s+|\s+$', '', 'g') AS s FROM players) WHERE regexp_full_match(s, '\d{9,19}(\.\d+)?')")
_P1 = """SELECT player_id, org_slug, count(*) AS n, CAST(sum(coalesce(games, 0)) AS DOUBLE) AS total, max(ms) AS latest FROM (SELECT DISTINCT a.player_id, a.match_id, t.org_slug FROM player_appearances a JOIN tournaments t ON t.tournament_id = a.tournament_id AND t.org_slug IS NOT NULL WHERE a.player_id IS NOT NULL AND a.match_id IS NOT NULL)
  JOIN (SELECT match_id, max(ms) AS ms, max(games) AS games FROM (SELECT match_id, ms, NULL AS games FROM ends WHERE ms IS NOT NULL UNION ALL SELECT match_id, NULL, total_games FROM matches) GROUP BY 1 HAVING max(ms) IS NOT NULL) USING (match_id) GROUP BY ALL"""


def _unfolded(x: str) -> str:
    """JSON text within a JSON string, read."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND substr(ltrim(json_extract_string({x}, '$')), 1, 1) IN ('{{', '[', '\"') THEN (json_extract_string({x}, '$'))::JSON ELSE {x} END"


def _nested_sql(tab: str, key: str, col: str, names: tuple[str, str, str]) -> str:
    """(rec, pos1, pos2, pos3, x) of the third level of objects within arrays; texts are JSON, or Python literals without
    apostrophes in their strings, and may be quoted or wrapped."""
    snake = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k)
    get = lambda j, k: _unfolded(f"coalesce(json_extract({j}, '$.{k}'), json_extract({j}, '$.{snake(k)}'))")
    text = f"regexp_replace({col}, '^[\\s﻿]+|[\\s﻿]+$', '', 'g')"
    plain = "CASE WHEN json_valid(t) THEN t WHEN t[1:2] = '{''' THEN regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(t, '''([\\[{])', '\\1', 'g'), '([\\]}])''', '\\1', 'g'), '''', '\"'), '\\bNone\\b', 'null', 'g'), '\\bTrue\\b', 'true', 'g'), '\\bFalse\\b', 'false', 'g') END"
    rows = f"SELECT rec, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM (SELECT rec, {plain} AS p FROM (SELECT DISTINCT {key} AS rec, {text} AS t FROM {tab} WHERE {col} IS NOT NULL AND {key} IS NOT NULL))"
    rows = f"SELECT rec, {_unfolded('j')} AS j FROM (SELECT rec, {_unfolded('j')} AS j FROM ({rows}) WHERE j IS NOT NULL)"
    out = f"SELECT rec, CASE WHEN json_extract(j, '$.{names[0]}') IS NULL AND json_extract(j, '$.{snake(names[0])}') IS NULL THEN coalesce(json_extract(j, '$.data'), json_extract(j, '$.payload'), json_extract(j, '$.result')) ELSE j END AS x FROM ({rows})"
    for i, k in enumerate(names, 1):
        keep = "".join(f"pos{n}, " for n in range(1, i))
        els = "CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN [] WHEN json_type(v) = 'ARRAY' THEN from_json(v, '[\"JSON\"]') ELSE [v] END"
        rows = f"SELECT rec, {keep}unnest(els) AS x, unnest(range(len(els))) AS pos{i} FROM (SELECT rec, {keep}{els} AS els FROM (SELECT rec, {keep}{get('x', k)} AS v FROM ({out})))"
        out = f"SELECT rec, {keep}pos{i}, {_unfolded('x')} AS x FROM ({rows}) WHERE x IS NOT NULL AND json_type(x) != 'NULL'"
    return out


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sparse vectors' cells: a row per player and organiser with matches, games and the latest end."""
    vectors, types = _vectors(spark, d)
    c = feature_table.cells(vectors).join(broadcast_if_small(types), "type_idx")
    return c.select(F.col("entity").alias("player_id"), "org_slug", "n", "total", F.col("latest_ms").alias("latest"))


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same cells from the vectors of two halves of the appearances, kept apart by match and merged."""
    a = table(spark, d, "player_appearances")
    first = F.pmod(F.xxhash64("match_id"), F.lit(2)) == 0
    halves = [feature_table.organiser_vectors(a.where(w), table(spark, d, "matches"), table(spark, d, "tournaments")) for w in (first, ~first)]
    both = feature_table.merge(written(halves[0][0], "half"), written(halves[1][0], "half"))
    c = feature_table.cells(both).join(broadcast_if_small(halves[0][1]), "type_idx")
    return c.select(F.col("entity").alias("player_id"), "org_slug", "n", "total", F.col("latest_ms").alias("latest"))


def p6_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The instants of p6_found's two numeric fields."""
    ends = _zoned_matches(spark, d).where("layout != 'epoch_s'").select(F.lit("matches.last_game_finished_at").alias("field"), F.col("match_id").alias("record_id"), "utc_ms")
    starts = _tournament_starts(spark, d).where("layout != 'epoch_ms'").select(F.lit("tournaments.start_time_ms").alias("field"), F.col("tournament_id").alias("record_id"), "utc_ms")
    return ends.unionByName(starts).where("utc_ms is not null").distinct()


def oracle_sql() -> dict[str, str]:
    ends = f"WITH zoned AS MATERIALIZED ({_ZONED}), ends AS MATERIALIZED ({_ENDS}), cells AS MATERIALIZED ({_P1}) "
    return {
        "p1_found": ends + f"SELECT player_id, org_slug FROM cells WHERE n >= {LEAST_MATCHES} AND latest < {ENDED_BEFORE_MS}",
        "p1_cells": ends + "SELECT * FROM cells",
        "p1_merged": ends + "SELECT * FROM cells",
        "p4_found": f"SELECT DISTINCT 'tournaments.meta' AS origin, rec AS record_id, pos1, pos2, pos3, json_extract_string(x, '$') AS leaf FROM ({_nested_sql('tournaments', 'tournament_id', 'meta', META)}) UNION SELECT 'stages.settings', rec, pos1, pos2, pos3, json_extract_string(x, '$.mode') FROM ({_nested_sql('stages', 'stage_id', 'settings', SETTINGS)})",
        "p6_found": f"WITH zoned AS MATERIALIZED ({_ZONED}), ends AS MATERIALIZED ({_ENDS}), starts AS MATERIALIZED ({_STARTS}), texts AS MATERIALIZED ({_texts_sql()}), counted AS MATERIALIZED ({_COUNTED}) SELECT DISTINCT 'matches.last_game_finished_at' AS field, match_id AS record_id, ms AS utc_ms FROM ends WHERE ms IS NOT NULL AND layout != 'epoch_s' UNION SELECT 'tournaments.start_time_ms', tournament_id, ms FROM starts WHERE ms IS NOT NULL AND layout != 'epoch_ms' UNION SELECT 'players.created_at', player_id, ms FROM texts WHERE ms IS NOT NULL UNION SELECT 'players.created_at', player_id, ms FROM counted WHERE ms IS NOT NULL",
        "p6_numbers": f"WITH zoned AS MATERIALIZED ({_ZONED}), ends AS MATERIALIZED ({_ENDS}), starts AS MATERIALIZED ({_STARTS}) SELECT DISTINCT 'matches.last_game_finished_at' AS field, match_id AS record_id, ms AS utc_ms FROM ends WHERE ms IS NOT NULL AND layout != 'epoch_s' UNION SELECT 'tournaments.start_time_ms', tournament_id, ms FROM starts WHERE ms IS NOT NULL AND layout != 'epoch_ms'",
        "p3_found": f"SELECT DISTINCT reference, record_id, kind FROM ({_MISSES})",
        "p3_report": f"SELECT reference, period, kind, count(*) AS records FROM (SELECT reference, record_id, kind, coalesce(strftime(min(seen) AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period FROM ({_MISSES}) GROUP BY ALL) GROUP BY ALL",
    }
