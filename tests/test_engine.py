"""Graph engines, attribution, ingestion, stores, streams and synthetic data on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import convert, graph, loo, queue, synth
from podium.sources import ingest, store
from podium.streaming import incremental


def _edges(spark, n=60, seed=1):
    g = np.random.default_rng(seed)
    rows = {(int(a), int(b)): float(w) for a, b, w in zip(g.integers(0, n, 300), g.integers(0, n, 300), g.random(300), strict=True) if a != b}
    return spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "loser long, winner long, weight_sum double")


@pytest.mark.parametrize("deficit", [False, True])
def test_pagerank_two_ways(spark, deficit):
    e = _edges(spark)
    if deficit:
        e = graph.normalized(e, graph.denominators(e)).withColumn("weight_sum", F.col("normalized_weight")).select("loser", "winner", "weight_sum")
    cfg = graph.PageRank(max_iter=8, tol=0.0, deficit=deficit)
    a = {r["id"]: r["score"] for r in graph.pagerank(e, "weight_sum", graph.teleport(e), cfg).collect()}
    b = {r["id"]: r["score"] for r in graph.pagerank(e, "weight_sum", graph.teleport(e), cfg, edges_bound=0).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12
    assert deficit or abs(sum(a.values()) - 1) < 1e-12


def _matches(spark):
    g = np.random.default_rng(3)
    rows = [(i, 1 + i % 3, int(w), int(l), 1_700_000_000 + i) for i, (w, l) in enumerate(zip(g.integers(0, 8, 60), g.integers(0, 8, 60), strict=True)) if w != l]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, 4 * k + j) for t in (1, 2, 3) for k in range(8) for j in range(4)], "tournament_id long, team_id long, user_id long")
    return m, r


def test_ids_of_zero_count_and_byes_do_not(spark):
    m, r = _matches(spark)
    b = m.withColumn("is_bye", F.when(F.col("match_id") == 0, True))
    c = convert.compact(convert.weighted(b, 1_700_000_000, 0.0), r)
    assert c.where("match_id = 0").count() == 0
    assert c.where("array_contains(winners, 0) or array_contains(losers, 0)").count() > 0


def test_exact_attribution_is_rating_again_without_the_match(spark):
    m, r = _matches(spark)
    c = convert.compact(convert.weighted(m, 1_700_000_000, 0.001), r)
    cfg = graph.Engine(fixed_lambda=0.025, pagerank=graph.PageRank(tol=1e-14, max_iter=500))
    want = {}
    for match, player in ((3, 5), (10, 9)):
        score = lambda x: {q["id"]: q["score"] for q in graph.log_odds(x, cfg).collect()}[player]  # noqa: B023, E731
        want[(player, match)] = (score(c), score(c.where(F.col("match_id") != match)))
    got = loo.exact(c, spark.createDataFrame([(p, q) for p, q in want], "id long, match_id long"), 0.025).collect()
    got += loo.exact(c, spark.createDataFrame([(5, 3)], "id long, match_id long"), 0.025, edges_bound=0).collect()
    assert len(got) == 3
    for x in got:
        old, new = want[(x["id"], x["match_id"])]
        assert abs(x["old_score"] - old) < 1e-8 and abs(x["new_score"] - new) < 1e-6


def test_tick_tock_settles(spark):
    m, r = _matches(spark)
    s, infl = graph.tick_tock(m, r, graph.Engine(now=1_700_000_000))
    assert s.count() == 32 and infl.count() == 3
    assert abs(infl.agg(F.avg("strength")).first()[0] - 1) < 1e-9


def test_documents(spark):
    opp = lambda i, r: {"id": i, "score": 3 if r == "win" else 1, "result": r}
    team = {"id": 0, "name": "A", "activeRosterUserIds": [1], "members": [{"userId": 1}, {"userId": 2}, {"userId": 1}]}
    doc = {"tournament": {"data": {"stage": [{"id": 1, "settings": {"size": "4"}}], "match": [{"id": 0, "opponent1": opp(0, "win"), "opponent2": opp(9, "loss")}, {"id": 1, "opponent1": opp(0, "win"), "opponent2": None}]}, "ctx": {"id": 5, "tags": "a, b", "teams": [team, {"id": 9, "members": [{"userId": 3}]}]}}}
    t = ingest.tables(spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc),), ("{broken",), (None,)], "doc string"))
    m = {r["match_id"]: r for r in t["matches"].collect()}
    assert m[0]["winner_team_id"] == 0 and m[0]["score_diff"] == 2 and not m[0]["is_bye"] and m[1]["is_bye"]
    assert sorted((r["team_id"], r["user_id"]) for r in t["players"].collect()) == [(0, 1), (9, 3)]
    assert t["tournaments"].first()["tags"] == ["a", "b"]


def test_documents_in_files(spark, tmp_path):
    docs = [json.dumps({"tournament": {"data": {"match": [{"id": 10 * i, "status": "forfeit" if i else 4, "opponent1": {"id": 1, "result": "win"}, "opponent2": {"id": 2}}]}, "ctx": {"id": i, "tags": " a,, "}}}, indent=i) for i in range(5)]
    n = ingest.write_documents(spark.createDataFrame([(x,) for x in [*docs, None]], "doc string").coalesce(1), f"file://{tmp_path}/d", per_file=2)
    assert n == 3 and sorted(p.name for p in (tmp_path / "d").iterdir() if p.suffix == ".json") == [f"tournament_{i}.json" for i in range(3)]
    (tmp_path / "d" / "more").mkdir()
    (tmp_path / "d" / "more" / "tournaments_9.json").write_text("[" + docs[0].replace('"id": 0', '"id": 7') + "," + docs[1] + "]")
    (tmp_path / "d" / "tournament_one.json").write_text(docs[2])
    (tmp_path / "d" / "tournament_cut.json").write_text(docs[1][:40])
    (tmp_path / "d" / "other.json").write_text(docs[0])
    got = ingest.read_documents(spark, f"file://{tmp_path}/d")
    assert {r["ok"]: r["count"] for r in ingest.readable(got).groupBy("ok").count().collect()} == {True: 8, False: 1}
    t = ingest.tables(got)
    assert {r["tournament_id"]: (r["match_count"], r["tags"]) for r in t["tournaments"].collect()} == dict.fromkeys((0, 1, 2, 3, 4, 7), (1, ["a"]))
    assert {r["match_id"]: r["is_bye"] for r in t["matches"].collect()} == {0: False, 7: False, 10: True, 20: True, 30: True, 40: True}
    assert ingest.summary(got).count() == 6


def test_appearance_payloads():
    by_match = {"data": {"matches": [{"matchId": 1, "teams": [{"teamId": 0, "players": [{"userId": 7}, 8]}, {"id": 2, "userIds": ["9"]}]}]}}
    assert ingest.appearance_rows(by_match) == [(1, 0, 7), (1, 0, 8), (1, 2, 9)]
    assert ingest.appearance_rows([{"userId": 7, "matchIds": [1, "2", None]}]) == [(1, None, 7), (2, None, 7)]
    assert ingest.appearance_rows({"result": None}) == ingest.appearance_rows([]) == ingest.appearance_rows("x") == []


def test_appearance_payload_shapes():
    rows = ingest.appearance_rows
    assert rows({"payload": {"result": {"matches": [{"id": 3, "teams": [{"roster": {"players": [{"id": 4}]}}, "odd", None]}]}}}) == [(3, None, 4)]
    assert rows({"matches": [{"matchId": True, "teams": [{"users": [1]}]}, {"matchId": 5, "teams": None}, {"matchId": 6, "teams": [{"users": [1e400, "x", 2**70, 9]}]}]}) == [(6, None, 9)]
    assert rows([{"user_id": "7", "matches": [1]}, {"matchIds": [2]}, {"id": 8, "match_ids": "no"}]) == [(1, None, 7)]


def test_constants_of_the_flat_format():
    got = ingest.decode_flat([{"_1": -1, "_2": -2, "_3": -3, "_4": -4, "_5": -5, "_6": -6, "_7": -7, "_8": -8, "_9": -9}, *"abcdefghi"])
    nan = got.pop("d")
    assert nan != nan and str(got.pop("i")) == "-0.0"
    assert got == {"a": None, "b": True, "c": False, "e": None, "f": float("inf"), "g": None, "h": float("-inf")}


def test_flat_stream_format():
    assert ingest.decode_flat([{"_1": 2}, "a", {"_3": 4, "_5": -5}, "b", [6, 6], "c", 1.5]) == {"a": {"b": [1.5, 1.5], "c": None}}
    assert ingest.decode_flat([{"_1": 0}, "self"]) == {"self": {}} or ingest.decode_flat([{"_1": 0}, "self"])["self"] is not None
    assert ingest.decode_flat([]) == {}


def test_versions(spark, tmp_path):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, w int")
    t.insert_absent(a, ["k"])
    t.upsert(spark.createDataFrame([(2, "z", None), (3, "n", 5)], "k int, v string, w int"), ["k"], ["v"])  # only v changes
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "x", 1), (2, "z", 1), (3, "n", 5)]
    before = t.version()
    with pytest.raises(Exception):  # noqa: B017, PT011
        t.replace(a.select(F.raise_error(F.lit("no")).alias("k")))
    assert t.version() == before and t.read().count() == 3
    with pytest.raises(ValueError, match="identifier"):
        store.identifier("x; drop")


def test_replace_survives_a_crash(spark, tmp_path, monkeypatch):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    df = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    t.replace(df("a"))
    for broken in ("write_text", "point"):
        with monkeypatch.context() as m:
            m.setattr(store.Folder, broken, lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError, match="gone"):
                t.replace(df("b"))
        assert t.read().first()["v"] == "a"
    # Between writing the pointer aside and renaming it.
    after = t._folder.number()
    t._folder.write_text("next-x", "v-none")
    assert t.read().first()["v"] == "a"
    t.replace(df("c"))
    assert t.read().first()["v"] == "c"
    with pytest.raises(RuntimeError, match="another writer"):
        t._folder.point("v-late", after)
    t.drop_old()
    assert t.read().first()["v"] == "c" and len([n for n in t._folder.names() if n.startswith("v-")]) == 1


def test_last_row_of_a_key_counts_and_nulls_overwrite(spark, tmp_path):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    t.upsert(rows((1, 1, "z"), (1, 2, "b"), (1, 3, None), (2, 1, "y")), ["k"], order=[F.col("at")])
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: None, 2: "y"}
    t.upsert(rows((2, 5, None), (3, 1, "n")), ["k"], ["v"])
    assert {r["k"]: (r["at"], r["v"]) for r in t.read().collect()} == {1: (3, None), 2: (1, None), 3: (1, "n")}
    t.insert_absent(rows((3, 9, "q"), (4, 1, "a"), (4, 1, "b")), ["k"])
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: None, 2: None, 3: "n", 4: "b"}


def _parsed(spark, ids, broken=False):
    t = spark.createDataFrame([(i, f"t{i}", 5, None) for i in ids], "tournament_id long, name string, match_count int, is_ranked boolean")
    m = spark.createDataFrame([(10 * i + k, i, 1) for i in ids for k in range(2)], "match_id long, tournament_id long, winner_team_id long")
    p = spark.createDataFrame([(i, f"p{i}", "d", None, "x") for i in ids], "player_id long, display_name string, discord_id string, country string, other string")
    return {"tournaments": t, "matches": m.select(F.raise_error(F.lit("no")).cast("long").alias("match_id"), "tournament_id", "winner_team_id") if broken else m, "players": p}


def test_import_of_all_tables_or_none(spark, tmp_path):
    db = store.Database(spark, f"file://{tmp_path}/db")
    with pytest.raises(LookupError, match="matches"):
        db.require("matches")
    store.import_all(db, _parsed(spark, [1, 2]))
    db.require("tournaments", "matches", "players")
    before = db.versions()
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.import_all(db, _parsed(spark, [3], broken=True))
    assert db.versions() == before and {r[0] for r in db.read("tournaments").select("tournament_id").collect()} == {1, 2}
    again = _parsed(spark, [2, 3])
    again["tournaments"] = again["tournaments"].withColumns({"name": F.lit("new"), "match_count": F.lit(9)})
    again["players"] = again["players"].withColumns({"display_name": F.lit(None).cast("string"), "other": F.lit("y")})
    store.import_all(db, again)
    assert {r["tournament_id"]: (r["name"], r["match_count"]) for r in db.read("tournaments").collect()} == {1: ("t1", 5), 2: ("t2", 9), 3: ("new", 9)}
    assert {r["player_id"]: (r["display_name"], r["other"]) for r in db.read("players").collect()} == {1: ("p1", "x"), 2: (None, "x"), 3: (None, "y")}
    fresh = _parsed(spark, [2])
    fresh["matches"] = fresh["matches"].where("match_id = 20").withColumn("winner_team_id", F.lit(7).cast("long"))
    store.repull(db, fresh, [2])
    assert {r["match_id"]: r["winner_team_id"] for r in db.read("matches").collect()} == {10: 1, 11: 1, 20: 7, 30: 1, 31: 1}


def test_runs_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, score double")
    path = f"file://{tmp_path}/runs"
    assert store.add_run(df, path, {"build": "a", "at": 5}) and not store.add_run(df.limit(0), path, {"build": "a", "at": 5})
    assert spark.read.parquet(path).select("id", "score", "build", "at").collect() == [(1, 0.5, "a", 5)]
    m = store.bundle(spark, f"file://{tmp_path}/b", {"x": df, "none": df.select()}, note=1)
    assert m == {"note": 1, "tables": {"x": {"columns": ["id", "score"], "rows": 1}}} and json.loads((tmp_path / "b" / "manifest.json").read_text()) == m
    store.save_engine(spark, f"file://{tmp_path}/e", {"alpha": 0.85}, df, df)
    config, scores, infl = store.load_engine(spark, f"file://{tmp_path}/e")
    assert config == {"alpha": 0.85} and scores.collect() == infl.collect() == df.collect()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from podium import runtime

    class Context:
        master = "spark://there:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(k, d):
                return None

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Session())


def test_places_and_quantiles(spark):
    from podium import runtime

    v = [float(x) for x in np.random.default_rng(1).integers(0, 50, 3000)] + [None, float("nan")]
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(v)], "g int, v double")
    for q in (0.0, 0.05, 0.5, 0.333, 1.0):
        want = float(np.quantile([x for x in v if x is not None and x == x], q))
        assert runtime.quantile(df, "v", q) == runtime.quantile(df, "v", q, most=5, parts=4) == want
    assert runtime.quantile(df.limit(0), "v", 0.5) is None
    got = runtime.ranked_within(df.where("v is not null and not isnan(v)"), ["g"], [F.desc("v")], "at").groupBy("g").agg(F.min("at"), F.max("at"), F.count_distinct("at"), F.count(F.lit(1))).collect()
    assert all(r[1] == 0 and r[2] == r[3] - 1 == r[4] - 1 for r in got) and len(got) == 3
    c = {r["v"]: r["before"] for r in runtime.cumulated(df.where("v is not null and not isnan(v)").groupBy("v").count(), [F.asc("v")], "count", "before").collect()}
    assert all(c[x] == sum(y < x for y in v if y is not None and y == y) for x in c)


def test_shortlist_by_signed_changes(spark):
    d = spark.createDataFrame([(7, 1, 0.6), (7, 2, 0.3), (7, 3, -0.2), (7, 4, -0.9), (7, 5, 0.0), (7, 6, None)], "id long, match_id long, score_delta double")
    assert sorted(tuple(r) for r in loo.shortlist(d, 1).collect()) == [(7, 1, 1, None), (7, 4, None, 1)]
    two = spark.createDataFrame([(7, 10, 0.5), (7, 10, -0.5)], "id long, match_id long, score_delta double")
    assert [tuple(r) for r in loo.shortlist(two, 3).collect()] == [(7, 10, 1, 1)]


def test_influence_by_every_method(spark):
    g = np.random.default_rng(4)
    scores = {i: float(x) for i, x in enumerate(g.random(80))}
    who = {(int(t), int(u)) for t, u in zip(g.integers(0, 5, 300), g.integers(0, 100, 300), strict=True)}
    s, w = spark.createDataFrame(list(scores.items()), "id long, score double"), spark.createDataFrame(list(who) * 2, "tournament_id long, user_id long")
    got = {r["tournament_id"]: r for r in graph.influences(s, w).collect()}
    prior = float(np.quantile(list(scores.values()), 0.05))
    x = {t: np.sort([scores.get(u, prior) for tt, u in who if tt == t])[::-1] for t in got}
    ways = {
        "arithmetic": np.mean, "mean": np.mean, "sum": np.sum, "median": np.median, "geometric": lambda v: np.exp(np.log(v + 1e-10).mean()), "top_20_sum": lambda v: v[:20].sum(), "sqrt_top_20_sum": lambda v: np.sqrt(v[:20].sum()),
        "top_10_sum": lambda v: v[:10].sum(), "top_20_mean": lambda v: v[:20].mean(), "top_20_geom": lambda v: np.exp(np.log(v[:20] + 1e-10).mean()),
    }
    for m, f in ways.items():
        raw = {t: f(v) for t, v in x.items()}
        assert all(abs(got[t][m] - raw[t] / np.mean(list(raw.values()))) < 1e-9 for t in x), m
    raw = {t: np.log1p(ways["top_20_sum"](v) / np.mean([ways["top_20_sum"](y) for y in x.values()])) for t, v in x.items()}
    assert all(abs(got[t]["log_top_20_sum"] - raw[t] / np.mean(list(raw.values()))) < 1e-9 for t in x)


def test_lifecycle_states():
    assert incremental.next_state("unknown", 0, True, False, False, 0) == ("scheduled", 0)
    assert incremental.next_state("scheduled", 0, True, True, False, 8 * 86400) == ("stale", 0)
    assert incremental.next_state("scheduled", 2, False, False, False, 0) == ("deleted", 3)
    assert incremental.next_state("in_progress", 1, True, True, True, 0) == ("completed", 0)


def test_lifecycle_stream(spark, tmp_path):
    looks = spark.createDataFrame([(1, 1.0, True, False, False, 0.0), (1, 2.0, True, True, False, 0.0), (2, 1.0, False, False, False, 0.0)], "tournament_id long, at double, found boolean, started boolean, finalized boolean, idle_s double")
    looks.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(looks.schema).parquet(f"{tmp_path}/in")
    q = incremental.lifecycle(stream).writeStream.format("memory").queryName("life").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["tournament_id"], r["state"], r["misses"]) for r in spark.table("life").collect()} == {(1, "in_progress", 0), (2, "unknown", 1)}


def test_slots_are_first_fit(spark):
    g = np.random.default_rng(5)
    rows = [(i, 0, int(s), int(s + d)) for i, (s, d) in enumerate(zip(np.sort(g.integers(0, 200, 80)), g.integers(1, 40, 80), strict=True))]
    got = {r["match_id"]: r["slot"] for r in queue.slots(spark.createDataFrame(rows, "match_id long, season long, created_s long, reported_s long")).collect()}
    ends, want = [], {}
    for i, _, s, e in rows:
        k = next((j for j, x in enumerate(ends) if s > x), len(ends))
        ends[k : k + 1] = [e]
        want[i] = k
    assert got == want


def test_brackets_and_results(spark):
    assert len(synth.round_robin(list(range(7)))) == 21
    assert synth.seed_order(8) == [1, 8, 4, 5, 2, 7, 3, 6]
    games = synth.single_elimination([1, 2, 3, 4, 5], lambda a, b: a < b)
    assert games[-1][3] == 1 and sum(g[2] is not None for g in games) == 4
    met = [tuple(sorted(g[1:3])) for g in synth.swiss(list(range(8)), 3, lambda a, b: a < b)]
    assert len(met) == len(set(met)) == 12
    t = synth.teams(synth.players(spark, 10))
    assert t.groupBy("team_id").count().where("count != 4").count() == 0
    s = t.groupBy("team_id").agg(F.avg("skill").alias("strength"))
    r = synth.results(spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "match_id long, a long, b long"), s).collect()
    assert all(max(x["score_a"], x["score_b"]) == 3 for x in r)
    for how in ("normal", "uniform", "bimodal", "exponential", "lognormal"):
        assert synth.players(spark, 50, how).where("skill is null").count() == 0


def test_pagerank_of_sides_is_that_of_their_pairs(spark, monkeypatch):
    m, r = _matches(spark)
    c = convert.compact(convert.weighted(m, 1_700_000_000, 0.001), r)
    v = convert.exposure(c).select("id", F.col("e_share").alias("v"))
    cfg = graph.PageRank(tol=1e-13, max_iter=500)
    rows = lambda df: {x["id"]: (x["win_pr"], x["loss_pr"]) for x in df.collect()}
    want = rows(graph.pagerank_both(convert.share_edges(c), v, cfg))
    bound = rows(graph.pagerank_sides(c, v, cfg, places_bound=0))
    # No edge is made, and none comes to the driver.
    for name in ("_arrays", "_pagerank_frames", "pagerank_both"):
        monkeypatch.setattr(graph, name, None)
    for got in (rows(graph.pagerank_sides(c, v, cfg)), bound):
        assert got.keys() == want.keys() and max(abs(a - b) for k in want for a, b in zip(got[k], want[k], strict=True)) < 1e-12


def test_alternating_ratings_make_no_weighted_pairs(spark, monkeypatch):
    m, r = _matches(spark)
    monkeypatch.setattr(convert, "player_edges", None)
    scores, infl = graph.tick_tock(m, r, graph.Engine(now=1_700_000_000))
    assert scores.count() == 32 and infl.count() == 3
