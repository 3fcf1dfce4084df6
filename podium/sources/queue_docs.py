"""Documents of matchmaking queue matches as related tables, and the rows per player that statistics are made from.

A document is {"match": {ids, times, memento: {users, groups, mapPreferences}, mapList}, groupAlpha, groupBravo: {id,
members}, rawReportedWeapons}, read by one declared schema. Unreadable documents, and those without a match id, give no rows.
Of documents of the same match the greatest text counts. A match's winner is the group that won most maps (the smaller id of
equal ones); without any won map it is cancelled. Who isn't named in a map's preferences is indifferent implicitly, who is
named without one explicitly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIFF = "skillDifference:struct<calculated:boolean,spDiff:double,matchesCount:double,matchesCountNeeded:double,newSp:double>"
_USER = f"struct<plusTier:double,skill:struct<ordinal:double,approximate:boolean,tier:struct<name:string,isPlus:boolean>>,{_DIFF}>"
_MEMBER = "struct<id:long,discordName:string,inGameName:string,plusTier:double,role:string,languages:array<string>>"
_GROUP = f"struct<id:long,members:array<{_MEMBER}>>"
DOCUMENT = (
    "match struct<id:long,alphaGroupId:long,bravoGroupId:long,createdAt:long,reportedAt:long,reportedByUserId:long,"
    f"memento:struct<users:map<string,{_USER}>,groups:map<string,struct<tier:struct<name:string,isPlus:boolean>,{_DIFF}>>,mapPreferences:array<array<struct<userId:long,preference:string>>>>,"
    "mapList:array<struct<id:long,mode:string,stageId:int,source:string,winnerGroupId:long>>>,"
    f"groupAlpha {_GROUP},groupBravo {_GROUP},rawReportedWeapons array<struct<groupMatchMapId:long,weaponSplId:int,userId:long,mapIndex:int>>"
)
# How outcomes and preferences are written.
CANCELLED, ALPHA, BRAVO = "cancelled", "alpha", "bravo"
IMPLICIT, EXPLICIT = "IMPLICIT_INDIFFERENT", "EXPLICIT_INDIFFERENT"


def snake(name: str) -> str:
    """camelCase as snake_case, letter by letter."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def _snaked(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake(c) for c in df.columns})


def tables(docs: DataFrame, doc: str = "doc") -> dict[str, DataFrame]:
    """matches, group_memento, user_memento, maps, groups (members), map_preferences and weapons."""
    d = docs.select(F.from_json(F.col(doc), DOCUMENT).alias("d"), F.col(doc).alias("text")).where("d.match.id is not null")
    d = d.groupBy(F.col("d.match.id").alias("match_id")).agg(F.max_by("d", "text").alias("d"))
    m = d.select("match_id", "d.*")
    won = F.filter(F.transform("match.mapList", lambda x: x["winnerGroupId"]), lambda g: g.isNotNull())
    counted = F.transform(F.array_distinct(won), lambda g: F.struct(F.size(F.filter(won, lambda x: x == g)).alias("n"), (-g).alias("g")))
    best = -F.array_max(counted)["g"]
    winner = F.when(best.isNull(), CANCELLED).when(best == F.col("match.alphaGroupId"), ALPHA).when(best == F.col("match.bravoGroupId"), BRAVO)
    matches = m.select(
        "match_id", F.col("match.alphaGroupId").alias("alpha_team_id"), F.col("match.bravoGroupId").alias("bravo_team_id"), F.col("match.createdAt").alias("created_at"), F.col("match.reportedAt").alias("reported_at"),
        F.col("match.reportedByUserId").alias("reported_by_user_id"), F.coalesce(best.cast("string"), F.lit(CANCELLED)).alias("winner_id"), winner.alias("winner"),
    )
    diff = lambda p: [F.col(f"{p}.skillDifference.{c}").alias(f"skill_difference_{snake(c)}") for c in ("calculated", "spDiff", "matchesCount", "matchesCountNeeded", "newSp")]
    users = m.select("match_id", F.explode("match.memento.users").alias("user_id", "u")).where(F.col("user_id").try_cast("long").isNotNull())
    users = users.select(
        "match_id", F.col("user_id").cast("long").alias("user_id"), F.col("u.plusTier").alias("plus_tier"), F.col("u.skill.ordinal").alias("skill_ordinal"), F.col("u.skill.approximate").alias("skill_approximate"),
        F.col("u.skill.tier.name").alias("skill_tier_name"), F.col("u.skill.tier.isPlus").alias("skill_tier_is_plus"), *diff("u"),
    )
    groups_m = m.select("match_id", F.explode("match.memento.groups").alias("group_id", "g"))
    groups_m = groups_m.select("match_id", F.col("group_id").try_cast("long").alias("group_id"), F.col("g.tier.name").alias("tier_name"), F.col("g.tier.isPlus").alias("tier_is_plus"), *diff("g"))
    maps = _snaked(m.select("match_id", F.posexplode("match.mapList").alias("mapIndex", "x")).select("match_id", "mapIndex", "x.*"))
    side = lambda c, team: m.select("match_id", F.col(f"{c}.id").alias("group_id"), F.explode(f"{c}.members").alias("p"), F.lit(team).alias("team"))
    groups = side("groupAlpha", ALPHA).unionByName(side("groupBravo", BRAVO))
    groups = groups.select("match_id", "group_id", F.col("p.id").alias("user_id"), F.col("p.discordName").alias("discord_name"), F.col("p.inGameName").alias("in_game_name"), F.col("p.plusTier").alias("group_plus_tier"), "team")
    members = groups.groupBy("match_id", "user_id").agg(F.max("group_id").alias("group_id"))
    users = users.join(members, ["match_id", "user_id"], "left")
    ids = F.transform(F.map_keys("match.memento.users"), lambda k: k.try_cast("long"))
    prefs = m.select("match_id", ids.alias("ids"), F.posexplode("match.memento.mapPreferences").alias("map_index", "given"))
    named = lambda u: F.filter("given", lambda p: p["userId"] == u)
    others = F.filter(F.transform("given", lambda p: p["userId"]), lambda u: u.isNotNull() & ~F.coalesce(F.array_contains("ids", u), F.lit(False)))
    everyone = F.array_distinct(F.concat("ids", others))
    choice = lambda u: F.when(F.size(named(u)) == 0, IMPLICIT).otherwise(F.coalesce(F.try_element_at(named(u), F.lit(1))["preference"], F.lit(EXPLICIT)))
    prefs = prefs.select("match_id", "map_index", F.inline(F.transform(everyone, lambda u: F.struct(u.alias("user_id"), choice(u).alias("preference")))))
    weapons = _snaked(m.select("match_id", F.inline("rawReportedWeapons")))
    return {"matches": matches, "group_memento": groups_m, "user_memento": users, "maps": maps, "groups": groups, "map_preferences": prefs, "weapons": weapons}


def merged(t: dict[str, DataFrame]) -> DataFrame:
    """One row per player and match: the player's memento with the match's times and outcome, group, team and enemy group."""
    m = t["matches"].select("match_id", "created_at", "reported_at", "winner", "alpha_team_id", "bravo_team_id")
    g = t["groups"].groupBy("match_id", "user_id", "group_id").agg(F.max("discord_name").alias("discord_name"), F.max("in_game_name").alias("in_game_name"), F.max("team").alias("team"))
    p = t["user_memento"].join(m, "match_id", "left").join(g, ["match_id", "user_id", "group_id"], "left")
    enemy = F.when(F.col("group_id") == F.col("alpha_team_id"), F.col("bravo_team_id")).when(F.col("group_id") == F.col("bravo_team_id"), F.col("alpha_team_id"))
    p = p.withColumns({
        "enemy_group_id": enemy, "is_winner": F.coalesce(F.col("team") == F.col("winner"), F.lit(False)), "sp": 15 * F.col("skill_ordinal") + 1000,
        "created_at_dt": F.timestamp_seconds("created_at"), "reported_at_dt": F.timestamp_seconds("reported_at"),
    })
    return p.drop("alpha_team_id", "bravo_team_id")
