"""The production run: a window of matches, rated, post-processed and stored with what it was made from."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import convert, graph, summary
from podium.runtime import written
from podium.sources import store


def update(
    spark: SparkSession, out: str, matches: DataFrame, rosters: DataFrame, appearances: DataFrame | None, build: str, at_ms: int, cfg: graph.Engine = graph.Engine(),
    with_influence: bool = True, min_tournaments: int = 1,
) -> dict:
    """Writes the run `build` at `at_ms` below `out` and returns its manifest.

    The bundle `runs/{build}-{at_ms}` holds compiled_matches, compiled_players, rankings, ranking_stats and influence; rankings
    and stats are also added to the tables `rankings` and `stats`, partitioned by run, where a run that is there already
    stays as it is. With influence matches count by their tournament's strength from alternating ratings. The manifest is
    written last: without it a run isn't one. Anything that fails, fails the run.
    """
    m = written(convert.valid(matches).where("ts is not null"), "matches")
    r = written(convert.borrowed_rosters(m, rosters.select("tournament_id", "team_id", "user_id").dropna().distinct()), "rosters")
    a = None if appearances is None else written(convert.legacy_appearances(appearances, m, r), "appearances")
    infl = graph.tick_tock(m, r, cfg)[1] if with_influence else m.select("tournament_id").dropna().distinct().withColumn("strength", F.lit(1.0))
    infl = written(infl, "influence")
    c = written(convert.compact(convert.weighted(m, cfg.now, cfg.rate, infl, cfg.beta), r, a, named=True), "compact")
    rated = written(graph.log_odds(c, cfg), "rated")
    stats = written(convert.player_stats(m, r, a).withColumnRenamed("user_id", "player_id"), "stats")
    ranked = summary.post_processed(rated.withColumnRenamed("id", "player_id"), stats, cfg.now, min_tournaments=min_tournaments)
    played = m.select("tournament_id", F.explode(F.array("winner_team_id", "loser_team_id")).alias("team_id")).distinct()
    tables = {"compiled_matches": m, "compiled_players": r.join(played, ["tournament_id", "team_id"], "left_semi"), "rankings": ranked, "ranking_stats": stats, "influence": infl}
    run = {"build": build, "at": at_ms}
    for name, df in (("rankings", ranked), ("stats", stats)):
        store.add_run(df, f"{out.rstrip('/')}/{name}", run)
    return store.bundle(spark, f"{out.rstrip('/')}/runs/{store.identifier(build)}-{at_ms}", tables, run=run, config=asdict(cfg))


def weeks_back(latest_ms: int | None, now_ms: int, weeks: int, most: int = 260) -> int:
    """Weeks to look back: what is asked for, or what has passed since the latest run and two more, at most `most`."""
    if latest_ms is None:
        return weeks
    ms = latest_ms * 1000 if latest_ms < 10**12 else latest_ms
    passed = max(0.0, (now_ms - ms) / (7 * 86_400_000))
    return max(weeks, max(1, min(int(-(-passed // 1)) + 2, most)))


def days(first: str, last: str) -> list[tuple[str, int]]:
    """(day, its last millisecond) of every day from the first to the last, the anchors of a daily backfill."""
    from datetime import UTC, date, datetime, timedelta

    a, b = date.fromisoformat(first), date.fromisoformat(last)
    out = []
    while a <= b:
        end = datetime(a.year, a.month, a.day, tzinfo=UTC) + timedelta(days=1)
        out.append((a.isoformat(), int(end.timestamp() * 1000) - 1))
        a += timedelta(days=1)
    return out
