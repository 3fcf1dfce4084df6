"""Nested documents as relational tables.

A tournament document is {"tournament": {"data": {stage, group, round, match}, "ctx": {..., teams: [{members}]}}}. It is
read by one declared schema, each array becomes a table by `explode`, and unreadable documents give no rows but are
counted. Keys are made unique over the whole input: of rows with the same key the greatest by all columns counts. Where a
team names its active members, only they are on the roster. A match without two opponents, or whose status says so, is a
bye. A tournament may come in several documents, as parts or again: its counts are those of its different matches, teams
and stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.nested import Unreadable, read_text, unfold
from podium.sources.store import Folder

_OPP = "struct<id:long,position:int,score:int,result:string>"
DOCUMENT = (
    "tournament struct<data:struct<"
    "stage:array<struct<id:long,tournament_id:long,name:string,number:int,type:string,settings:map<string,string>>>,"
    "`group`:array<struct<id:long,stage_id:long,number:int>>,"
    "round:array<struct<id:long,stage_id:long,group_id:long,number:int,maps:struct<count:int,type:string>>>,"
    f"match:array<struct<id:long,stage_id:long,group_id:long,round_id:long,number:int,status:string,lastGameFinishedAt:double,createdAt:double,startedAt:double,opponent1:{_OPP},opponent2:{_OPP}>>>,"
    "ctx:struct<id:long,eventId:long,name:string,description:string,startTime:long,isFinalized:boolean,mapPickingStyle:string,tags:string,parentTournamentId:long,"
    "organization:struct<id:long,name:string,slug:string>,author:struct<id:long,username:string,discordId:string>,settings:struct<isRanked:boolean,timezone:string,minMembersPerTeam:int,isLeague:boolean>,"
    "teams:array<struct<id:long,name:string,seed:int,prefersNotToHost:boolean,noScreen:boolean,droppedOut:boolean,inviteCode:string,createdAt:long,activeRosterUserIds:array<long>,"
    "members:array<struct<userId:long,username:string,discordId:string,inGameName:string,country:string,twitch:string,isOwner:boolean,createdAt:long>>>>>>"
)


def write_documents(docs: DataFrame, folder: str, doc: str = "doc", per_file: int = 50) -> int:
    """Documents as files `tournament_{i}.json` of at most `per_file` lines each, one document a line; the number of files."""
    spark = docs.sparkSession
    aside = Folder(spark, f"{folder.rstrip('/')}/_writing")
    docs.where(F.col(doc).isNotNull()).select(F.regexp_replace(doc, "\\s*\\n\\s*", " ").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(aside.path)
    parts = sorted(n for n in aside.names() if n.startswith("part-"))
    for i, n in enumerate(parts):  # a rename per file, as a committer does
        aside._fs.rename(aside._p(n), aside._p(f"../tournament_{i}.json"))
    Folder(spark, folder).delete("_writing")
    return len(parts)


def read_documents(spark: SparkSession, folder: str, pattern: str = "tournament*.json") -> DataFrame:
    """(path, doc): the texts of all files below a folder whose names fit.

    A file holds an object, an array of objects, or an object per line. What is no JSON is one text, to be counted as
    corrupt by `readable`.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    text = text.select(F.col("_metadata.file_path").alias("path"), "value")
    many = F.filter(F.from_json("value", "array<string>"), lambda x: x.isNotNull())
    lines = F.split(F.trim("value"), "\\n(?=\\{)")
    each = F.when(F.ltrim("value").startswith("["), F.when(F.size(many) > 0, many).otherwise(F.array("value"))).otherwise(lines)
    return text.select("path", F.explode(each).alias("doc"))


def readable(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """`docs` with `ok`: whether a text is a tournament document."""
    return docs.withColumn("ok", F.from_json(F.col(doc), "tournament struct<ctx:struct<id:long>>")["tournament"]["ctx"]["id"].isNotNull())


def _one(df: DataFrame, *keys: str) -> DataFrame:
    """The greatest row of each key; rows without a key are left out."""
    rest = [c for c in df.columns if c not in keys]
    g = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r"))
    return g.select(*[c if c in keys else f"r.{c}" for c in df.columns])


def tables(docs: DataFrame, doc: str = "doc") -> dict[str, DataFrame]:
    """The seven tables of documents given as text."""
    t = docs.select(F.from_json(F.col(doc), DOCUMENT)["tournament"].alias("t")).where("t.ctx.id is not null")
    ctx, data = "t.ctx", "t.data"
    tid = F.col(f"{ctx}.id").alias("tournament_id")
    each = lambda c: t.select(tid, F.explode(c).alias("x"))
    tournaments = t.select(
        tid, f"{ctx}.name", F.col(f"{ctx}.startTime").alias("start_time"), F.coalesce(f"{ctx}.isFinalized", F.lit(False)).alias("is_finalized"), F.col(f"{ctx}.mapPickingStyle").alias("map_picking_style"),
        F.filter(F.transform(F.split(f"{ctx}.tags", ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"), F.col(f"{ctx}.organization.slug").alias("org_slug"), F.col(f"{ctx}.author.id").alias("author_id"),
        F.col(f"{ctx}.settings.isRanked").alias("is_ranked"), F.col(f"{ctx}.settings.timezone").alias("settings_timezone"),
    )
    stages = each(f"{data}.stage").select("tournament_id", F.col("x.id").alias("stage_id"), F.col("x.name").alias("stage_name"), F.col("x.number").alias("stage_number"), F.col("x.type").alias("stage_type"), F.to_json("x.settings").alias("settings"))
    groups = each(f"{data}.group").select("tournament_id", F.col("x.stage_id").alias("stage_id"), F.col("x.id").alias("group_id"), F.col("x.number").alias("group_number"))
    rounds = each(f"{data}.round").select("tournament_id", F.col("x.stage_id").alias("stage_id"), F.col("x.group_id").alias("group_id"), F.col("x.id").alias("round_id"), F.col("x.number").alias("round_number"), F.col("x.maps.count").alias("maps_count"), F.col("x.maps.type").alias("maps_type"))
    team = each(f"{ctx}.teams")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c.split(".")[1])
    teams = team.select("tournament_id", F.col("x.id").alias("team_id"), F.col("x.name").alias("team_name"), F.col("x.seed").alias("seed"), no("x.prefersNotToHost"), no("x.noScreen"), no("x.droppedOut"), F.col("x.createdAt").alias("created_at"))
    teams = teams.withColumnsRenamed({"prefersNotToHost": "prefers_not_to_host", "noScreen": "no_screen", "droppedOut": "dropped_out"})
    active = F.col("x.activeRosterUserIds")
    member = team.select("tournament_id", F.col("x.id").alias("team_id"), active.alias("active"), F.explode("x.members").alias("p"))
    member = member.where("active is null or size(active) = 0 or array_contains(active, p.userId)")
    players = member.select("tournament_id", "team_id", F.col("p.userId").alias("user_id"), F.col("p.username").alias("username"), F.col("p.discordId").alias("discord_id"), F.col("p.country").alias("country"), F.coalesce("p.isOwner", F.lit(False)).alias("is_owner"), F.col("p.createdAt").alias("roster_created_at"))
    o1, o2 = F.col("x.opponent1"), F.col("x.opponent2")
    first, second = o1["result"] == "win", o2["result"] == "win"
    by = lambda a, b: F.when(first, a).when(second, b)
    diff = o1["score"] - o2["score"]
    matches = each(f"{data}.match").select(
        "tournament_id", F.col("x.id").alias("match_id"), F.col("x.stage_id").alias("stage_id"), F.col("x.group_id").alias("group_id"), F.col("x.round_id").alias("round_id"), F.col("x.number").alias("match_number"), F.col("x.status").try_cast("int").alias("status"),
        F.col("x.lastGameFinishedAt").alias("last_game_finished_at"), F.coalesce("x.createdAt", "x.startedAt").alias("match_created_at"),
        o1["id"].alias("team1_id"), o1["score"].alias("team1_score"), o2["id"].alias("team2_id"), o2["score"].alias("team2_score"),
        by(o1["id"], o2["id"]).alias("winner_team_id"), by(o2["id"], o1["id"]).alias("loser_team_id"), by(diff, -diff).alias("score_diff"), (o1["score"] + o2["score"]).alias("total_games"),
        (o1.isNull() | o2.isNull() | o1["id"].isNull() | o2["id"].isNull() | F.coalesce(F.col("x.status").isin("bye", "forfeit"), F.lit(False))).alias("is_bye"),
    )
    out = {
        "tournaments": _one(tournaments, "tournament_id"), "stages": _one(stages, "stage_id"), "groups": _one(groups, "group_id"), "rounds": _one(rounds, "round_id"), "teams": _one(teams, "tournament_id", "team_id"),
        "players": _one(players, "tournament_id", "team_id", "user_id"), "matches": _one(matches, "match_id"),
    }
    counts = {"team_count": "teams", "match_count": "matches", "stage_count": "stages"}
    for c, name in counts.items():
        out["tournaments"] = out["tournaments"].join(out[name].groupBy("tournament_id").agg(F.count(F.lit(1)).alias(c)), "tournament_id", "left")
    out["tournaments"] = out["tournaments"].na.fill(0, list(counts))
    return out


def summary(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per tournament of the documents: name, start, state and counts."""
    return tables(docs, doc)["tournaments"].select("tournament_id", "name", "start_time", "is_finalized", "team_count", "match_count", "stage_count")


def votes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(id, username, custom_url, pass_or_fail, tier, suggested) of voting results given as a list of tiers with the users
    that passed and failed; entries without a whole id or tier are left out, repeated ones count once."""
    user = "array<struct<id:string,username:string,customUrl:string,wasSuggested:boolean>>"
    t = docs.select(F.inline(F.from_json(F.col(doc), f"array<struct<tier:string,passed:{user},failed:{user}>>")))
    each = lambda c, label: t.select(F.col("tier").try_cast("int").alias("tier"), F.lit(label).alias("pass_or_fail"), F.inline(c))
    v = each("passed", "pass").unionByName(each("failed", "fail"))
    v = v.select(F.col("id").try_cast("long").alias("id"), "username", F.col("customUrl").alias("custom_url"), "pass_or_fail", "tier", F.coalesce("wasSuggested", F.lit(False)).cast("int").alias("suggested"))
    return _one(v, "id", "pass_or_fail", "tier")


# ---- appearance payloads

#: The input's names for the same thing, in the order in which they count.
WRAPPERS = ("data", "payload", "result")
KEYS = {
    "match": ("matchId", "id"),
    "team": ("teamId", "id"),
    "user": ("userId", "user_id", "id"),
    "member": ("userId", "id"),
    "members": ("players", "userIds", "users", "roster"),
    "matches": ("matchIds", "match_ids", "matches"),
}


def _get(d: object, what: str) -> object:
    if not isinstance(d, dict):
        return None
    return next((d[k] for k in KEYS[what] if d.get(k) is not None), None)


def _number(x: object) -> int | None:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    try:
        n = int(x)
    except (ValueError, OverflowError):
        return None
    return n if -(1 << 63) <= n < 1 << 63 else None


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _of_matches(items: list[dict]) -> Iterator[tuple]:
    for m in items:
        for t in _list(m.get("teams")):
            who = _get(t, "members")
            for p in _list(_get(who, "members") if isinstance(who, dict) else who):
                yield _get(m, "match"), _get(t, "team"), _get(p, "member") if isinstance(p, dict) else p


def _of_players(items: list[dict]) -> Iterator[tuple]:
    for p in items:
        for m in _list(_get(p, "matches")):
            yield m, None, _get(p, "user")


def appearance_rows(payload: object) -> list[tuple[int, int | None, int]]:
    """(match_id, team_id, user_id) of a payload, which lists matches with their teams, or players with their matches.

    Rows without a whole number for match and user are left out; anything else has none.
    """
    while isinstance(payload, dict) and (inner := [k for k in WRAPPERS if k in payload]):
        payload = payload[inner[0]]
    items = [x for x in _list(payload.get("matches") if isinstance(payload, dict) else payload) if isinstance(x, dict)]
    shape = _of_matches if any(not x.keys().isdisjoint(("matchId", "teams")) for x in items) else _of_players
    rows = [tuple(map(_number, r)) for r in shape(items)]
    return [r for r in rows if r[0] is not None and r[2] is not None]


def appearances(docs: DataFrame, tournament: str, payload: str) -> DataFrame:
    """Distinct (tournament_id, match_id, team_id, user_id) from payload texts; unreadable ones give none."""
    cols = ["tournament_id", "match_id", "team_id", "user_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows += [(t, *r) for r in appearance_rows(unfold(read_text(s.as_py())))] if s.is_valid else []
                except Unreadable:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=cols)

    return docs.select(F.col(tournament).cast("long"), payload).mapInArrow(run, ", ".join(f"{c} long" for c in cols)).distinct()


# ---- flat streams

#: What negative references of the flat stream format stand for.
CONSTANTS = {-1: None, -2: True, -3: False, -4: float("nan"), -5: None, -6: float("inf"), -7: None, -8: float("-inf"), -9: -0.0}


def decode_flat(data: list) -> dict:
    """A flat array whose objects refer to keys (`_<index>`) and values by index, as nested values; cycles end in None."""
    memo: dict[int, object] = {}
    open_: set[int] = set()

    def at(i: object) -> object:
        if not isinstance(i, int) or isinstance(i, bool):
            return i
        if i < 0:
            return CONSTANTS.get(i)
        if i >= len(data) or i in open_:
            return None
        if i not in memo:
            open_.add(i)
            memo[i] = value(data[i])
            open_.discard(i)
        return memo[i]

    def value(x: object) -> object:
        if isinstance(x, dict):
            pairs = [(at(int(k[1:])), at(v)) for k, v in x.items() if k[:1] == "_" and k[1:].lstrip("-").isdigit()]
            return {k: v for k, v in pairs if isinstance(k, (str, int, float))}
        return [at(y) for y in x] if isinstance(x, list) else x

    return value(data[0]) if data and isinstance(data[0], dict) else {}
