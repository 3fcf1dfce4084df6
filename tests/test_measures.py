"""Measures of orders and trust, calibration, loaders, the production run and queue documents on small fixtures."""

import itertools
import json
import math
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions import scalar
from podium.operators import batch, confidence, convert, evaluate, graph, predict, quality, queue, summary
from podium.sources import loaders, queue_docs


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_discordant_pairs_by_blocks(spark, block):
    g = np.random.default_rng(block)
    rows = {k: (g.permutation(n), g.permutation(n)) for k, n in (("a", 40), ("b", 1), ("c", 23), ("d", 2))}
    df = spark.createDataFrame([(k, int(x), int(y)) for k, (a, b) in rows.items() for x, y in zip(a, b, strict=True)], "grp string, seed long, place long")
    got = {r["grp"]: (r["items"], r["discordant"]) for r in quality.discordant(df, ["grp"], block).collect()}
    for k, (a, b) in rows.items():
        want = sum((a[i] < a[j]) != (b[i] < b[j]) for i, j in itertools.combinations(range(len(a)), 2))
        assert got[k] == (len(a), want), k
    assert quality.discordant(df.limit(0), ["grp"], block).count() == 0


def test_orders_with_ties_nulls_and_repeats(spark):
    df = spark.createDataFrame([("t", 1, 3.0, 1.0), ("t", 2, 3.0, 1.0), ("t", 3, 1.0, 9.0), ("t", 4, None, 1.0), ("u", 1, 2.0, 2.0)], "g string, id long, p double, a double")
    o = quality.placed(df, ["g"], "id", -F.col("p"), -F.col("a"))
    assert {(r["g"], r["id"]): (r["seed"], r["place"]) for r in o.collect()} == {("t", 1): (0, 1), ("t", 2): (1, 2), ("t", 3): (2, 0), ("u", 1): (0, 0)}
    r = {x["g"]: x for x in quality.order_agreement(o, ["g"]).collect()}
    assert r["t"]["discordant"] == 2 and abs(r["t"]["agreement"] - 1 / 3) < 1e-12 and r["u"]["agreement"] == 1 and r["u"]["kendall_distance"] == 0 and r["u"]["ndcg"] == 1
    assert quality.order_agreement(quality.placed(df.limit(0), ["g"], "id", F.col("p"), F.col("a")), ["g"]).count() == 0


def test_perfect_ranks(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 101)], "t long, p long")
    assert all(abs(r["correlation"] - 1) < 1e-12 for r in quality.weighted_correlations(df, "t", "p").collect())
    assert {(r["k"], r["accuracy"], r["jaccard"]) for r in quality.top_k_accuracy(df, "t", "p").collect()} == {(k, 1.0, 1.0) for k in (10, 20, 50, 100)}
    assert [r["k"] for r in quality.top_k_accuracy(df.where("t <= 15"), "t", "p").collect()] == [10]
    assert quality.rank_differences(df, "t", "p").first()["max_abs_diff"] == 0


def test_predictions(spark):
    p = spark.createDataFrame([(1, x) for x in (0.8, 0.7, 0.4, 0.9)] + [(2, 0.3), (3, None)], "t long, p double")
    r = {x["t"]: x for x in quality.high_confidence_accuracy(p, ["t"], 0.65).collect()}
    assert r[1]["accuracy"] == 1 and r[1]["confident"] == 3 and r[2]["accuracy"] is None and 3 not in r
    assert abs(r[1]["upset_ratio"] - 0.25 / 0.3) < 1e-12
    m = spark.createDataFrame([(True, False)] * 10 + [(False, True)] * 2 + [(True, True), (None, None)], "a boolean, b boolean")
    x = quality.mcnemar(m, "a", "b").first()
    assert (x["only_first"], x["only_second"]) == (10, 2) and abs(x["statistic"] - 49 / 12) < 1e-12 and abs(x["p_value"] - 0.0433) < 1e-4
    assert quality.mcnemar(m.limit(0), "a", "b").first()["p_value"] == 1
    c = quality.interval_coverage(spark.createDataFrame([(0.0, 0.5, 1.0), (0.5, 1.0, 1.0), (None, 1.0, 1.0)], "l double, h double, y double"), "l", "h", "y").first()
    assert c["n"] == 2 and c["coverage"] == 0.5 and abs(c["error"] - 0.45) < 1e-12 and c["mean_width"] == 0.5
    t = quality.paired_test(spark.createDataFrame([(1.0, 0.5), (2.0, 1.7), (3.0, 2.1), (4.0, 3.3), (1.0, None)], "a double, b double"), "a", "b").first()
    d = np.array([0.5, 0.3, 0.9, 0.7])
    assert abs(t["t"] - d.mean() / (d.std(ddof=1) / 2)) < 1e-9 and 0.015 < t["p_value"] < 0.025  # t = 4.65 with 3 degrees of freedom


def test_skill_of_a_perfect_rating(spark):
    n = 30
    r = spark.createDataFrame([(i, float(2.0 ** (n - i))) for i in range(n)], "id long, rating double")
    m = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "winner_team_id long, loser_team_id long")
    s = quality.skill(m, r).first()
    assert s["loss"] < s["shuffled_loss"] and s["skill"] > 0.5
    at = r.withColumn("at", F.col("id"))
    for k in (1, 2, 3):
        moved = quality.shuffled(at, k)
        assert sorted(x["rating"] for x in moved.collect()) == sorted(x["rating"] for x in r.collect()) and moved.count() == n


def test_effects_and_density(spark):
    g = np.random.default_rng(0)
    x = [(float(v), 1) for v in g.normal(2, 1, 400)] + [(float(v), 0) for v in g.normal(0, 1, 400)] + [(None, 1), (1.0, None)]
    df = spark.createDataFrame(x, "x double, y int")
    e = quality.effect_size(df, "x", "y").first()
    assert abs(e["cohens_d"] - 2) < 0.25 and 0.2 < e["overlap"] < 0.45 and e["top_decile"] > 0.95
    assert quality.effect_size(df.where("y = 1"), "x", "y").first()["cohens_d"] is None
    two = spark.createDataFrame([(float(v),) for v in np.concatenate([g.normal(-5, 0.5, 500), g.normal(5, 0.5, 500)])] + [(float("nan"),), (None,)], "x double")
    d = quality.density(two, "x").collect()
    assert sum(r["peak"] for r in d) == 2 and abs(sum(r["density"] for r in d) * (d[1]["x"] - d[0]["x"]) - 1) < 0.2  # what lies beyond the ends is cut
    assert quality.density(two.limit(0), "x").count() == 0
    b = quality.monotonicity(spark.createDataFrame([(i / 100, float(i > 50)) for i in range(100)], "v double, y double"), "v", "y", 5).orderBy("bin").collect()
    assert [r["n"] for r in b] == [20] * 5 and all(r["rises"] for r in b[1:]) and b[0]["rises"] is None


def _compact(spark):
    rows = [(1, 1, [1, 2], [3, 4], 1.0, 5, 0.25), (2, 1, [1, 2], [5, 6], 1.0, 6, 0.25), (3, 2, [3, 4], [5, 6], 1.0, 7, 0.25)]
    return spark.createDataFrame(rows, "match_id long, tournament_id long, winners array<long>, losers array<long>, weight double, ts long, share double")


def test_one_sided_confidence(spark):
    ranks = spark.createDataFrame([(p, i) for i, p in enumerate((1, 2, 3, 4, 5), 1)], "player_id long, rank long")  # 6 has none
    r = {x["player_id"]: x for x in confidence.asymmetric(_compact(spark), ranks, top=0.4).collect()}
    assert r[1]["outgoing_edges"] == 4 and r[1]["incoming_edges"] == 0 and r[1]["downward_pressure"] == 0.5 and r[1]["top_players_beaten"] == 0
    assert abs(r[1]["outgoing_quality"] - np.mean([0.6, 0.4, 0.2])) < 1e-12
    assert r[3]["beaten_by_top"] == 2 and r[3]["downward_pressure"] == 0.2 and r[6]["upward_mobility"] == 0
    assert r[5]["matches"] == 2 and r[5]["tournaments"] == 2 and r[5]["rankability"] in ("low", "unrankable", "medium", "high")
    assert confidence.special_cases(confidence.asymmetric(_compact(spark).limit(0), ranks)).count() == 0
    u = {x["player_id"]: x for x in confidence.with_uncertainty(summary.confidence(_compact(spark))).collect()}
    assert u[1]["information_bits"] == min(2, math.log2(6)) and 0 < u[1]["percentile_uncertainty"] <= 50
    j = confidence.joined(spark.createDataFrame([(1,), (99,)], "player_id long"), summary.confidence(_compact(spark))).collect()
    assert {x["player_id"]: x["tier"] for x in j} == {1: "provisional", 99: "provisional"} and {x["player_id"]: x["matches"] for x in j} == {1: 2, 99: 0}


def test_calibration_by_format_and_in_time(spark):
    g = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        f = ("a", "b")[i % 2]
        gap = float(g.normal())
        won = g.random() < 1 / (1 + np.exp(-(2.0 if f == "a" else 0.5) * gap))
        rows.append((f, i, gap if won else -gap))
    rows += [("c", 9999, 0.3), (None, 1, 0.1), ("a", 5, None)]
    df = spark.createDataFrame(rows, "format string, ts long, gap double")
    r = {x["format"]: x for x in predict.calibrate_by(df, "format").collect()}
    base = predict.calibrate(df)[0]
    assert abs(r["a"]["slope"] - 2) < 0.25 and abs(r["b"]["slope"] - 0.5) < 0.15 and abs(r["c"]["slope"] - base) < 1e-9 and abs(r[None]["slope"] - base) < 1e-9
    cv = predict.calibration_scores(df, [F.asc("ts"), F.asc("gap")]).orderBy("split").collect()
    assert [x["split"] for x in cv] == [1, 2, 3, 4, 5] and all(x["accuracy"] > 0.6 for x in cv) and cv[0]["train"] < cv[1]["train"]
    assert predict.calibration_scores(df.limit(0), [F.asc("ts")]).count() == 0


def test_adaptive_calibration_follows_its_loop(spark):
    g = np.random.default_rng(2)
    rows = [(k, i, float(x), bool(g.random() < 1 / (1 + np.exp(-2 * x)))) for k in ("a", "b") for i, x in enumerate(g.normal(size=150))]
    got = {(r["k"], r["at"]): r for r in predict.adaptive(spark.createDataFrame(rows, "k string, at long, gap double, won boolean"), "k", ["at"]).collect()}
    for k in ("a", "b"):
        s, b = 1.0, 0.0
        for n, (_, i, x, y) in enumerate((r for r in rows if r[0] == k), 1):
            p = 1 / (1 + math.exp(-(s * x + b)))
            assert abs(got[k, i]["p"] - p) < 1e-12
            if n >= 100:
                s, b = s + 0.01 * (y - p) * x, b + 0.01 * (y - p)


def test_series_and_seeds(spark):
    p = spark.createDataFrame([(0.6,)], "p double").select(predict.series_probability(F.col("p"), 3)).first()[0]
    assert abs(p - (0.36 + 2 * 0.36 * 0.4)) < 1e-12
    seeds = spark.createDataFrame([(1, i, i) for i in range(1, 5)], "tournament_id long, team_id long, seed long")
    places = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 2), (1, 4, 4)], "tournament_id long, team_id long, place long")
    assert predict.seed_accuracy(seeds, places).first()[1:] == (4, 0.5, 1.0, 1.0)
    by_hand = spark.createDataFrame([(1, 2, 3), (1, 3, 2)], "tournament_id long, team_id long, seed long")
    assert predict.seed_accuracy(seeds, places, by_hand).first()["exact"] == 1


def test_moments_ids_and_windows(spark):
    ms = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1000)
    want = {"1700000000": 1_700_000_000_000, "1700000000123": 1_700_000_000_123, "2024-01-31": ms(2024, 2, 1) - 1, "2024-01-31T09:30:00Z": ms(2024, 1, 31, 9, 30), "2024-01-31T09:30:00+02:00": ms(2024, 1, 31, 7, 30), "2024-01-31 09:30:00": ms(2024, 1, 31, 9, 30), "soon": None, "": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in want], "x string").select("x", scalar.moment_ms(F.col("x"))).collect()}
    assert got == want
    u = spark.createDataFrame([("https://a.b/to/123/brackets",), ("https://a.b/to/123",), ("https://a.b/x12",), ("/7?x=/8",), (None,)], "u string").select(scalar.url_id(F.col("u")))
    assert [r[0] for r in u.collect()] == [123, 123, None, 7, None]
    assert [tuple(r) for r in scalar.time_windows(spark, 0, 25, 10).collect()] == [(0, 0, 10), (1, 10, 20), (2, 20, 25)] and scalar.time_windows(spark, 5, 5, 10).count() == 0
    assert batch.weeks_back(None, 0, 3) == 3 and batch.weeks_back(0, 10 * 7 * 86_400_000, 3) == 12 and batch.weeks_back(1, 10**13, 3) == 260
    assert batch.days("2024-02-28", "2024-03-01") == [("2024-02-28", ms(2024, 2, 29) - 1), ("2024-02-29", ms(2024, 3, 1) - 1), ("2024-03-01", ms(2024, 3, 2) - 1)]
    x = scalar.log_centered(spark.createDataFrame([(1.0,), (4.0,)], "v double"), "v").collect()
    assert abs(x[0]["v"] - 0.5) < 1e-9 and abs(x[1]["v"] - 2) < 1e-9


def test_files_of_several_kinds(spark, tmp_path):
    t = pa.table({"a": pa.array([1, None, 3]), "b": ["x", None, "z"]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t)
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,\n3,z\n")
    (tmp_path / "t.json").write_text('{"a": 1, "b": "x"}\n{}\n{"a": 3, "b": "z"}\n')
    spark.createDataFrame(t).write.parquet(str(tmp_path / "t.parquet"))
    for kind in ("arrow", "csv", "json", "parquet"):
        got = loaders.read_file(spark, f"file://{tmp_path}/t.{kind}")
        assert sorted((r["a"] or 0, r["b"] or "") for r in got.collect()) == [(0, ""), (1, "x"), (3, "z")], kind
    assert loaders.latest_number(None) == 0 and loaders.latest_number(spark.createDataFrame([], "match_id long")) == 0
    assert loaders.read_sql(spark, "SELECT :x AS x", x="a' OR 1").first()["x"] == "a' OR 1"


def test_production_run(spark, tmp_path):
    m = spark.createDataFrame([(1, 42, 10, 11, 1_700_000_000), (2, 42, 11, 10, 1_700_000_500), (3, 42, 10, None, 1_700_000_600)], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(42, 10 + t, 1 + 4 * t + j) for t in (0, 1) for j in range(4)], "tournament_id long, team_id long, user_id long")
    a = spark.createDataFrame([(42, i, u, None) for i in (1, 2) for u in range(1, 9)] + [(42, 1, 999, None), (1000, 2, 1, None)], "tournament_id long, match_id long, user_id long, team_id long")
    out = f"file://{tmp_path}/out"
    got = batch.update(spark, out, m, r, a, "b1", 5, graph.Engine(now=1_700_001_000))
    assert {n: t["rows"] for n, t in got["tables"].items()} == {"compiled_matches": 2, "compiled_players": 8, "rankings": 8, "ranking_stats": 8, "influence": 1}
    assert json.loads((tmp_path / "out" / "runs" / "b1-5" / "manifest.json").read_text())["run"] == {"at": 5, "build": "b1"}
    batch.update(spark, out, m, r, None, "b1", 5, graph.Engine(now=1_700_001_000), with_influence=False)  # the same run: nothing is added
    assert spark.read.parquet(f"{out}/rankings").count() == 8
    batch.update(spark, out, m, r, None, "b1", 6, graph.Engine(now=1_700_001_000), with_influence=False)
    assert loaders.impacts(spark, f"{out}/rankings", build="b1", at=6).count() == 8 and spark.read.parquet(f"{out}/stats").count() == 16


def test_settings_and_own_strategies(spark):
    e = graph.Engine.of(graph.Engine(beta=2.0), alpha=0.5, max_ticks=9)
    assert (e.beta, e.pagerank.alpha, e.max_ticks, e.pagerank.tol) == (2.0, 0.5, 9, 1e-8)
    with pytest.raises(TypeError, match="wrong"):
        graph.Engine.of(wrong=1)
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0)], "loser long, winner long, weight_sum double")
    v = {r["id"]: r["v"] for r in graph.teleport(edges, lambda d: d.select(F.col("winner").alias("id"), F.col("weight_sum").alias("raw")).where("id != 1")).collect()}
    assert abs(v[3] / v[2] - 2) < 1e-9 and v[1] < 1e-9
    d = {r["id"]: r["denom"] for r in graph.denominators(edges, lambda loss, win: loss + 10 * win).collect()}
    assert d == {1: 11.0, 2: 12.0, 3: 21.0}
    with pytest.warns(UserWarning, match="still change"):
        graph.pagerank(edges.where("loser != 3"), "weight_sum", graph.teleport(edges), graph.PageRank(max_iter=2)).count()


def test_surprisal_weights_upsets(spark):
    rows = [(i, 1, [1], [2], 1.0, 5, 1.0) for i in range(6)] + [(6, 1, [2], [3], 1.0, 5, 1.0), (7, 1, [3], [1], 1.0, 5, 1.0)]
    c = spark.createDataFrame(rows, "match_id long, tournament_id long, winners array<long>, losers array<long>, weight double, ts long, share double")
    one = {r["id"]: r["score"] for r in graph.surprisal(c, graph.Engine(surprisal_rounds=1, fixed_lambda=0.025)).collect()}
    two = {r["id"]: r["score"] for r in graph.surprisal(c, graph.Engine(surprisal_rounds=2, fixed_lambda=0.025)).collect()}
    plain = {r["id"]: r["score"] for r in graph.log_odds(c, graph.Engine(fixed_lambda=0.025)).collect()}
    assert one == plain and two.keys() == one.keys() and two != one


def test_filters_on_dirty_rows(spark):
    r = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, None, 4)], "tournament_id long, team_id long, user_id long")
    m = spark.createDataFrame([(5, 1, 10, 11, 10, 11, 100), (6, 1, 11, 10, 10, 11, 100), (None, 1, 10, 11, 10, None, 100)], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, team1_id long, team2_id long, ts long")
    a = spark.createDataFrame([(1, 5, 1, None), (1, 5, 1, None), (1, 5, 3, 11), (1, 5, 9, None), (1, 7, 1, None), (1, 5, 4, None), (2, 5, 1, None)], "tournament_id long, match_id long, user_id long, team_id long")
    assert sorted(tuple(x) for x in convert.legacy_appearances(a, m, r).collect()) == [(1, 5, 1, 10), (1, 5, 3, 11)]
    e = {(x["tournament_id"], x["match_id"], x["user_id"]): x["team_id"] for x in convert.enriched(a, m, r).collect()}
    assert e[1, 5, 9] is None and e[1, 5, 1] == 10 and e[1, 7, 1] == 10  # one on each side
    more = a.unionByName(spark.createDataFrame([(1, 5, 2, None)], a.schema))
    assert {x["user_id"]: x["team_id"] for x in convert.enriched(more, m, r).where("tournament_id = 1 and match_id = 5").collect()}[9] == 11
    rated = spark.createDataFrame([(1,), (3,)], "id long")
    assert convert.exclusion_impact(m, r, rated).first()["kept"] == 0 and convert.unrated_filter(m, r, rated, 1).count() == 3
    assert convert.from_cache(a, spark.createDataFrame([(1, 5, 9, 10), (1, 5, 9, 11), (1, 5, 3, 10)], a.schema)).where("user_id = 9").first()["team_id"] == 11


def test_grades_of_every_system(spark):
    run = spark.createDataFrame([(i, float(s)) for i, s in enumerate((-6, -3, 0, 0.5, 5, 6))] + [(9, None)], "player_id long, score double")
    g = {r["player_id"]: r for r in summary.graded(run).collect()}
    assert g[1]["grade_queue"] == "C" and g[2]["grade_queue"] == "B" and g[5]["grade_queue"] == "X★" and g[5]["grade_score"] == "XX★" and 9 not in g
    own = summary.graded(run, {"sign": (F.col("score"), [0], ["low", "high"])}).collect()
    assert {r["player_id"]: r["grade_sign"] for r in own}[3] == "high"


def _match(i, winners, **more):
    users = {"11": {"skill": {"ordinal": 10.0}, "skillDifference": {"calculated": True, "spDiff": 5.0}}, "12": {"plusTier": 2}, "x": {}}
    m = {"id": i, "alphaGroupId": 1, "bravoGroupId": 2, "createdAt": 1000 * i, "reportedAt": 1000 * i + 60, "mapList": [{"id": k, "mode": "m", "winnerGroupId": w} for k, w in enumerate(winners)], "memento": {"users": users, "groups": {"1": {"tier": {"name": "g"}}}, "mapPreferences": [[{"userId": 11, "preference": "PREFER"}, {"userId": 13}], []]}}
    return json.dumps({"match": m, "groupAlpha": {"id": 1, "members": [{"id": 11, "discordName": "a"}]}, "groupBravo": {"id": 2, "members": [{"id": 12, "discordName": "b"}]}, "rawReportedWeapons": [{"groupMatchMapId": 1, "weaponSplId": 3, "userId": 11}]} | more)


def test_queue_documents(spark):
    docs = [_match(1, [1, 2, 1]), _match(1, [1, 2, 1]), _match(2, [1, 2]), _match(3, [None]), _match(4, [2, 2, 9]), _match(5, [9]), "{cut", None, "{}", json.dumps({"match": {"id": 6}})]
    t = queue_docs.tables(spark.createDataFrame([(d,) for d in docs], "doc string"))
    assert {r["match_id"]: (r["winner_id"], r["winner"]) for r in t["matches"].collect()} == {1: ("1", "alpha"), 2: ("1", "alpha"), 3: ("cancelled", "cancelled"), 4: ("2", "bravo"), 5: ("9", None), 6: ("cancelled", "cancelled")}
    assert {(r["user_id"], r["map_index"]): r["preference"] for r in t["map_preferences"].where("match_id = 1 and user_id is not null").collect()} == {(11, 0): "PREFER", (12, 0): "IMPLICIT_INDIFFERENT", (13, 0): "EXPLICIT_INDIFFERENT", (11, 1): "IMPLICIT_INDIFFERENT", (12, 1): "IMPLICIT_INDIFFERENT"}
    assert t["weapons"].where("match_id = 1").first().asDict() == {"match_id": 1, "group_match_map_id": 1, "weapon_spl_id": 3, "user_id": 11, "map_index": None}
    m = {(r["match_id"], r["user_id"]): r for r in queue_docs.merged(t).collect()}
    assert m[1, 11]["sp"] == 1150 and m[1, 11]["is_winner"] and m[1, 11]["enemy_group_id"] == 2 and m[1, 12]["team"] == "bravo" and not m[3, 11]["is_winner"]
    assert queue_docs.snake("createdAtDay") == "created_at_day" and t["group_memento"].where("match_id = 1").first()["tier_name"] == "g"


def test_player_rows(spark):
    docs = [_match(i, [1]) for i in range(1, 10)]
    rows = queue_docs.merged(queue_docs.tables(spark.createDataFrame([(d,) for d in docs], "doc string")))
    x = queue.player_rows(rows, (1.0, 0.0, 1000.0))
    assert len(set(x.columns)) == len(x.columns)
    r = {(q["user_id"], q["match_id"]): q for q in x.collect()}
    assert r[11, 3]["after_sp"] == 1150 + 15 and abs(r[11, 3]["sp_logz"] - math.log(1.15)) < 1e-12 and r[11, 3]["cumulative_matches"] == 2
    assert r[11, 9]["has_calculated_7"] and not r[11, 6]["has_calculated_7"] and r[11, 4]["won_matches_7D"] == 4 and r[11, 4]["won_matches_prior_24H"] == 3
    assert queue.player_rows(rows.limit(0)).count() == 0
    m = spark.createDataFrame([(i, 1000 * i + (5 * 86400 if i > 5 else 0)) for i in range(1, 10)], "match_id long, created_at long")
    again = queue.rebuilt(rows, m)
    assert {q["match_id"] for q in again.select("match_id").collect()} == {6, 7, 8, 9}


def test_lognormal_law(spark):
    g = np.random.default_rng(3)
    df = spark.createDataFrame([(float(500 + np.exp(6 + 0.4 * z)),) for z in g.normal(size=4000)] + [(None,), (float("nan"),)], "x double")
    shape, location, scale = queue.lognormal(df, "x")
    assert abs(location - 500) < 60 and abs(shape - 0.4) < 0.08 and abs(np.log(scale) - 6) < 0.2
    assert queue.kolmogorov(df.where("not isnan(x)"), "x", shape, location, scale) < 0.03
    assert queue.lognormal(df.limit(0), "x") is None and queue.lognormal(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x") is None


def test_holdout_never_learns_from_later(spark):
    m = spark.createDataFrame([(i, i // 2, 1, 2, 100 * i) for i in range(24)], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    seen = []

    def rate(train):
        seen.append(train.agg(F.max("ts")).first()[0])
        return spark.createDataFrame([(1, 2.0), (2, 1.0)], "id long, rating double")

    r = {x["tournament_id"]: x for x in evaluate.sequential_holdout(m, rate, least=9, fit=False).collect()}
    assert sorted(r) == [9, 10, 11] and seen == [1700, 1900, 2100] and all(abs(x["loss"] + math.log(2 / 3)) < 1e-9 for x in r.values())
    assert [x["tournament_id"] for x in evaluate.sequential_holdout(m, rate, least=9, splits=1).collect()] == [11]
    with pytest.raises(ValueError, match="tournaments"):
        evaluate.sequential_holdout(m, rate, least=12)


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(2000)] + [(5000, None)], "id long, hit double")
    a = evaluate.bootstrap(df, "hit", 300).first()
    b = evaluate.bootstrap(df.repartition(7), "hit", 300).first()
    assert a["mean"] == 0.25 and 0.22 < a["low"] < 0.24 and 0.26 < a["high"] < 0.28
    assert abs(a["low"] - b["low"]) < 1e-12 and abs(a["high"] - b["high"]) < 1e-12
    assert evaluate.bootstrap(df.limit(0), "hit", 10).first()["mean"] is None


def test_summaries_of_figures(spark):
    df = spark.createDataFrame([(1, float(i), None) for i in range(11)] + [(2, float("nan"), 1.0)], "g int, x double, y double")
    d = {(r["g"], r["metric"]): r for r in quality.described(df, ["x", "y"], ["g"]).collect()}
    assert d[1, "x"]["mean"] == 5 and d[1, "x"]["n"] == 11 and (1, "y") not in d and d[2, "y"]["sd"] is None
    q = {r["metric"]: r for r in quality.quartiles(df, ["x"]).collect()}["x"]
    assert (q["q1"], q["median"], q["q3"], q["trimmed_mean"]) == (2.5, 5, 7.5, 5)


def test_components(spark):
    g = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    rows = chain + [(int(a), int(b)) for a, b in g.integers(0, 60, (40, 2))] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(rows, "loser long, winner long")).collect()}
    root = {x: x for e in rows for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "loser long, winner long")).count() == 0


def test_engines_by_name(spark):
    m = spark.createDataFrame([(i, 1 + i % 2, 10 + i % 3, 10 + (i + 1) % 3, 1_700_000_000 + i) for i in range(12)], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, 4 * k + j) for t in (1, 2) for k in (10, 11, 12) for j in range(4)], "tournament_id long, team_id long, user_id long")
    for name in ("tick_tock", "log_odds", "tick_tock_log_odds", "surprisal", "players", "teams"):
        x = graph.rate(name, m, r, now=1_700_000_100, alpha=0.8, surprisal_rounds=2)
        assert x.scores.count() == (3 if name == "teams" else 12) and x.config.pagerank.alpha == 0.8 and (x.influence is None) == ("tick" not in name)
        assert x.top(2).count() == 2
    with pytest.raises(ValueError, match="engine"):
        graph.rate("none", m, r)
    a, b = graph.tick_tock(m, r, graph.Engine(now=1_700_000_100)), graph.tick_tock(m, r, graph.Engine(now=1_700_000_100), edges_bound=0)
    for p, q in zip(a, b, strict=True):
        p, q = ({tuple(x)[0]: tuple(x)[1] for x in f.select(*sorted(f.columns, reverse=True)).select(f.columns[0], f.columns[1]).collect()} for f in (p, q))
        assert p.keys() == q.keys() and max(abs(p[k] - q[k]) for k in p) < 1e-7


def test_rolling_over_blocks(spark):
    g = np.random.default_rng(6)
    rows = [(i, int(u), int(t), bool(w), ("alpha", "cancelled")[int(c)]) for i, (u, t, w, c) in enumerate(zip(g.integers(0, 3, 400), g.integers(0, 60 * 86400, 400) * 1_000_000, g.integers(0, 2, 400), g.random(400) < 0.2, strict=True))]
    df = spark.createDataFrame(rows, "match_id long, user_id long, created_us long, is_winner boolean, winner string")
    got = {r["match_id"]: r for r in queue.rolling(df, {"7d": 7 * 86400, "1d": 86400}).collect()}
    cum = {r["match_id"]: r["cum_matches"] for r in queue.cumulative(df).collect()}
    assert len(got) == len(cum) == 400
    for i, u, t, w, x in rows:
        for name, days in (("7d", 7), ("1d", 1)):
            near = [r for r in rows if r[1] == u and t - days * 86400 * 1_000_000 < r[2] <= t]
            assert got[i][f"count_{name}"] == len(near) and got[i][f"won_prior_{name}"] == sum(r[3] for r in near) - w
        assert cum[i] == (0 if x == "cancelled" else sum(r[1] == u and r[4] != "cancelled" and (r[2], r[0]) < (t, i) for r in rows))
    assert queue.cumulative(df.limit(0)).count() == 0


def test_votes_in_tiers(spark):
    from podium.sources import ingest

    doc = json.dumps([{"tier": 1, "passed": [{"id": 5, "username": "a", "wasSuggested": True}, {"id": 5, "username": "a", "wasSuggested": True}, {"id": "x"}], "failed": [{"id": "6"}]}, {"passed": [{"id": 1}]}, {"tier": "2", "failed": None}])
    got = {tuple(r) for r in ingest.votes(spark.createDataFrame([(doc,), ("{cut",), (None,)], "doc string")).collect()}
    assert got == {(5, "a", None, "pass", 1, 1), (6, None, None, "fail", 1, 0)}


def test_searches_and_samples(spark):
    best, tried = evaluate.grid_search(lambda x: (x["a"] - 2) ** 2 + x["b"], {"a": [1, 2, 3], "b": [0.5, 0.1]})
    assert best == {"a": 2, "b": 0.1} and len(tried) == 6
    best, tried = evaluate.random_search(lambda x: abs(x["a"] - 0.3) + abs(math.log10(x["b"]) + 2), {"a": (0.0, 1.0), "b": (1e-4, 1.0)}, 200)
    assert abs(best["a"] - 0.3) < 0.2 and 1e-3 < best["b"] < 1e-1 and len(tried) == 200
    df = spark.range(100)
    a, b = ({r["id"] for r in evaluate.sampled(x, 7, ["id"]).collect()} for x in (df, df.repartition(5)))
    assert a == b and len(a) == 7 and evaluate.sampled(df.limit(3), 7, ["id"]).count() == 3


def test_correlations_with_trust(spark):
    df = spark.createDataFrame([(i, 11 - i, float(i % 3), "xy"[i % 2]) for i in range(1, 11)] + [(1, None, 1.0, "x"), (5, 5, None, "z")], "t long, p long, w double, g string")
    assert abs(quality.weighted_spearman(df, "t", "p", F.col("w")).first()["correlation"] + 1) < 1e-9
    r = {x["g"]: x for x in quality.weighted_spearman(df, "t", "p", F.lit(1.0), ["g"]).collect()}
    assert r["z"]["correlation"] is None and r["z"]["n"] == 1 and abs(r["x"]["correlation"] + 1) < 1e-9
    assert quality.weighted_spearman(df.limit(0), "t", "p", F.lit(1.0)).first()["correlation"] is None


def test_double_elimination_and_stages(spark):
    from podium.operators import synth
    from podium.sources import ingest

    beats = lambda a, b: a < b
    for n in (2, 3, 5, 8, 13, 16):
        games = synth.double_elimination(list(range(1, n + 1)), beats)
        losses = {}
        for _, _, a, b, w in games:
            losses[b if w == a else a] = losses.get(b if w == a else a, 0) + 1
        assert losses.get(1, 0) == 0 and all(losses[t] == 2 for t in range(2, n + 1)) if n > 2 else len(games) >= 1
        assert games[-1][0] == "final" and games[-1][4] == 1
    upset = synth.double_elimination([1, 2], lambda a, b, seen=[]: (seen.append(1), len(seen) == 1)[1] == (a < b))
    assert [g[0] for g in upset][:1] == ["winners"]
    assert sorted(t for g in synth.groups(list(range(10)), 4) for t in g) == list(range(10)) and {len(g) for g in synth.groups(list(range(8)), 4)} == {4}
    stages = synth.multi_stage(list(range(1, 13)), beats)
    assert sum(x[0] != "final stage" for x in stages) == 18 and stages[-1][4] == 1
    r = synth.circuit(spark, synth.pool(spark, 300), 6, 8)
    assert r.count() == 6 * 32 and r.groupBy("tournament_id", "team_id").count().where("count != 4").count() == 0 and r.count() == r.select("tournament_id", "player_id").distinct().count()
    m = spark.createDataFrame([(1, 100001, 100002, 100001, 0.5, 1), (2, 100001, 100002, 100002, 9.0, 1)], "match_id long, a long, b long, winner long, gap double, tournament_id long")
    x = {q["match_id"]: q for q in synth.with_scores(m).collect()}
    assert x[1]["score_a"] == 3 and x[1]["score_b"] in (1, 2) and x[2]["score_b"] == 3 and x[2]["score_a"] in (0, 1)
    t = ingest.tables(synth.documents(r, synth.with_scores(m)))
    assert t["matches"].count() == 2 and t["players"].count() == 6 * 32 and {q["winner_team_id"] for q in t["matches"].collect()} == {100001, 100002}
    e = synth.elite(spark, 500).agg(F.min("skill"), F.max("skill")).first()
    assert e[0] >= 2.0 and e[1] > 2.8
    assert abs(synth.stationary_sd(0.5, 1.0) - 1) < 1e-12 and abs(1 / (1 + math.exp(-synth.slope_for(0.8, 2.0) * 2.0)) - 0.8) < 1e-12


def test_weekly_rows(spark):
    from podium.operators import loo

    m = spark.createDataFrame([(i, 1 + i % 2, 10 + i % 3, 10 + (i + 1 + i % 2) % 3, 1_700_000_000 + i) for i in range(12) if i % 3 != (i + 1 + i % 2) % 3], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, 4 * k + j) for t in (1, 2) for k in (10, 11, 12) for j in range(4)], "tournament_id long, team_id long, user_id long")
    c = convert.compact(convert.weighted(m, 1_700_000_100, 0.0), r)
    scores = graph.log_odds(c, graph.Engine(fixed_lambda=0.025))
    w = loo.weekly(c, scores, 0.025, k=1).collect()
    assert {x["player_id"] for x in w} == set(range(40, 52)) and sorted({x["player_rank"] for x in w}) == list(range(1, 13))
    for x in w:
        assert (x["approx_positive_rank"] is None) != (x["approx_negative_rank"] is None) and x["is_win"] == (x["approx_score_delta"] < 0)
        assert abs(x["exact_new_score"] - x["exact_old_score"] - x["exact_score_delta"]) < 1e-12 and x["tournament_id"] in (1, 2)


def test_backtest_of_a_perfect_order(spark):
    m = spark.createDataFrame([(100 * t + 10 * a + b, t, a, b, 1000 * t) for t in range(6) for a in range(1, 5) for b in range(a + 1, 5)], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    rate = lambda train: spark.createDataFrame([(i, float(10 - i)) for i in range(1, 5)], "id long, rating double")
    r = {x["tournament_id"]: x for x in quality.backtest(m, rate, least=3).collect()}
    assert sorted(r) == [3, 4, 5] and all(x["ndcg"] == 1 and x["discordant"] == 0 and x["mae"] == 0 for x in r.values())
    assert quality.backtest(m, rate, least=9).count() == 0


def test_high_water_mark(spark, tmp_path):
    from podium.sources.store import Versioned
    from podium.streaming import incremental

    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "match_id long")
    where = f"file://{tmp_path}/t"
    assert [incremental.append_above(spark, where, rows(*k)) for k in ((), (1, 2, None), (2, 3), (1, 3), (9,))] == [0, 2, 1, 0, 1]
    assert sorted(r[0] for r in Versioned(spark, where).read().collect()) == [1, 2, 3, 9]


def test_simulated_places_without_a_row_per_run(spark):
    rows = [(t, k, float(k * 7 % 5) / 2) for t, n in ((1, 9), (2, 1), (None, 3)) for k in range(n)]
    teams, runs = spark.createDataFrame(rows, "tournament_id long, team_id long, log_rating double"), 1203
    u = (F.pmod(F.xxhash64("tournament_id", "team_id", "run", F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    t = teams.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("x", F.col("log_rating") - F.log(-F.log(u)))
    n = F.row_number().over(Window.partitionBy("tournament_id", "run").orderBy(F.desc("x"), "team_id"))
    want = t.withColumn("n", n).groupBy("tournament_id", "team_id").agg(F.avg((F.col("n") == 1).cast("double")), F.avg((F.col("n") <= 4).cast("double")), F.avg("n"))
    got = predict.monte_carlo(teams, runs)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == len(rows)
    assert "Window" not in got._jdf.queryExecution().analyzed().toString()  # which sorted a row per run
