"""One row per entity with count, total and recency for each of many event types.

Types get dense indices, an entity's features are three sparse vectors over them (counts, totals, latest times, as one
array of structs sorted by index), which merge by index; only at the end are they spread into columns. Events are
pre-aggregated per (entity, type) on the map side, so neither a hot entity nor a hot type meets one task.

Defined results: rows whose entity, type or item is null are no events; an item counts once per (entity, type)
however often it is repeated; a null amount adds nothing; an entity without any event has no row; an empty input gives
an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions import instants
from podium.runtime import broadcast_if_small, written

VECTOR = "array<struct<type_idx:int,n:long,total:double,latest_ms:long>>"


def type_index(types: DataFrame, col: str) -> DataFrame:
    """(type_idx, `col`): every distinct type that isn't null with its dense index in sorted order.

    The window has one row per type; types are what becomes columns, hence hundreds or thousands.
    """
    d = types.select(col).where(F.col(col).isNotNull()).distinct()
    return written(d.select((F.row_number().over(Window.orderBy(col)) - 1).alias("type_idx"), col), "types")


def per_type(events: DataFrame) -> DataFrame:
    """(entity, type_idx, n, total, latest_ms) from events (entity, type_idx, amount, at_ms) that are distinct already."""
    return events.groupBy("entity", "type_idx").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0.0)).cast("double").alias("total"), F.max("at_ms").alias("latest_ms")
    )


def sparse(cells: DataFrame) -> DataFrame:
    """(entity, vec): an entity's cells as a sparse vector sorted by type index; its length is bounded by the types."""
    vec = F.array_sort(F.collect_list(F.struct("type_idx", "n", "total", "latest_ms")))
    return cells.groupBy("entity").agg(vec.cast(VECTOR).alias("vec"))


def cells(vectors: DataFrame) -> DataFrame:
    """The cells of sparse vectors, one row each."""
    return vectors.select("entity", F.inline("vec"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The vectors of two disjoint sets of events as one: counts and totals add up, latest times take the maximum."""
    both = cells(a).unionByName(cells(b)).groupBy("entity", "type_idx")
    return sparse(both.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest_ms").alias("latest_ms")))


def expand(vectors: DataFrame, types: list[tuple[int, str]], as_of_ms: int) -> DataFrame:
    """Three columns per type: `n__<type>` and `total__<type>` (0 without events), `days_ago__<type>` (null without)."""
    width = len(types)
    fields = [T.StructField("entity", vectors.schema["entity"].dataType)]
    fields += [T.StructField(f"{p}__{name}", t) for p, t in (("n", T.LongType()), ("total", T.DoubleType()), ("days_ago", T.DoubleType())) for _, name in types]
    schema = T.StructType(fields)
    names = schema.names

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                n = part.num_rows
                vec = part.column(1)
                flat = vec.flatten()
                rows = np.repeat(np.arange(n), vec.value_lengths().to_numpy(zero_copy_only=False))
                cols = flat.field("type_idx").to_numpy(zero_copy_only=False)
                count, total = np.zeros((width, n), np.int64), np.zeros((width, n))
                ago = np.full((width, n), np.nan)
                count[cols, rows] = flat.field("n").to_numpy(zero_copy_only=False)
                total[cols, rows] = flat.field("total").to_numpy(zero_copy_only=False)
                ago[cols, rows] = (as_of_ms - flat.field("latest_ms").to_numpy(zero_copy_only=False)) / 86400000
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, count), *map(pa.array, total), *(pa.array(x, from_pandas=True) for x in ago)], names=names
                )

    return vectors.mapInArrow(spread, schema)


# ---- the same over matches and organisers


def tournament_zones(tournaments: DataFrame) -> DataFrame:
    """(tournament_id, zone): the zone of each tournament's latest import."""
    at = F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))), F.col("settings_timezone"))
    return tournaments.groupBy("tournament_id").agg(F.max_by("settings_timezone", at).alias("zone"))


def match_instants(matches: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Every match row with `utc_ms` of its end; calendar times are in the zone of the row's tournament."""
    zone = broadcast_if_small(written(tournament_zones(tournaments), "zones"))
    m = matches.select("match_id", "tournament_id", "last_game_finished_at", "total_games")
    m = m.join(zone, "tournament_id", "left")
    return instants.resolve(m, "last_game_finished_at", "zone")


def match_ends(matches: DataFrame, tournaments: DataFrame) -> DataFrame:
    """(match_id, at_ms, amount): the latest end among a match's rows and its games, for matches with an end."""
    r = match_instants(matches, tournaments).groupBy("match_id")
    return r.agg(F.max("utc_ms").alias("at_ms"), F.max("total_games").cast("double").alias("amount")).where("at_ms is not null")


def organiser_vectors(appearances: DataFrame, matches: DataFrame, tournaments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, types): for every player the matches, games and latest end per organiser.

    Appearances are reduced to distinct (player, match, organiser) on the whole key before the join on the match, so
    copies and hot matches are split; the join itself is a checked broadcast, else a shuffle with skew handling.
    """
    types = type_index(tournaments, "org_slug")
    owner = tournaments.select("tournament_id", "org_slug").distinct().join(broadcast_if_small(types), "org_slug")
    owner = broadcast_if_small(written(owner.select("tournament_id", "type_idx"), "owners"))
    ends = broadcast_if_small(written(match_ends(matches, tournaments), "ends"))
    seen = appearances.select("player_id", "match_id", "tournament_id").dropna()
    seen = seen.join(owner, "tournament_id").select(F.col("player_id").alias("entity"), "match_id", "type_idx").distinct()
    return sparse(per_type(seen.join(ends, "match_id"))), types
