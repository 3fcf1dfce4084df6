"""Queries do their whole job: no row or step is left out."""

import duckdb
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from podium.operators import batch, convert, evaluate, graph, loo, nested, predict, queue
from podium.plans import analytics, loading, pipelines, problems, quality, reference
from podium.sources import domain


def test_seasons_of_all_events(spark, data, tmp_path):
    n, lo, hi = duckdb.connect().execute(f"SELECT count(*), min(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)), max(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) FROM '{data}/events.parquet' WHERE user_id IS NOT NULL AND ts IS NOT NULL").fetchone()
    got = analytics.queue_seasons(spark, data).collect()
    assert sum(r["matches"] for r in got) == n and min(r["first_s"] for r in got) == lo and max(r["last_s"] for r in got) == hi


def test_breaks_between_seasons(spark):
    day = 86400
    rows = [(1, 0), (2, day), (3, 3 * day), (4, 5 * day + 1), (5, 5 * day + 2), (6, 9 * day)]
    got = {r["season"]: (r["matches"], r["first_s"], r["last_s"]) for r in queue.season_metadata(queue.seasons(spark.createDataFrame(rows, "match_id long, created_s long"))).collect()}
    assert got == {0: (3, 0, 3 * day), 1: (2, 5 * day + 1, 5 * day + 2), 2: (1, 9 * day, 9 * day)}


def solved(lo, wi, w, v, alpha=0.85):
    """PageRank by a dense solve: the settled scores are in proportion to (1 - alpha P')^-1 v."""
    a = np.zeros((len(v), len(v)))
    np.add.at(a, (wi, lo), w)
    out = a.sum(0)
    x = np.linalg.solve(np.eye(len(v)) - alpha * a / np.where(out > 0, out, 1), v)
    return x / x.sum()


def settled_teams(data):
    e = oracle.connection(data).execute(domain.sql("te", "SELECT loser, winner, weight_sum FROM te")).fetchdf()
    ids = np.unique(np.concatenate([e.loser, e.winner]))
    lo, wi = np.searchsorted(ids, e.loser), np.searchsorted(ids, e.winner)
    v = 1 / np.sqrt(np.maximum(np.bincount(lo, minlength=len(ids)), 1))
    return ids, lo, wi, e.weight_sum.to_numpy(), solved(lo, wi, e.weight_sum.to_numpy(), v / v.sum())


def test_team_pagerank_settles(spark, data):
    ids, _, _, _, want = settled_teams(data)
    got = {r["team_id"]: r["score"] for r in reference.team_pagerank(spark, data).collect()}
    assert np.abs(want - [got[i] for i in ids]).sum() < 1e-6


def test_retrospective_strength_from_pagerank(spark, data):
    ids, lo, wi, w, x = settled_teams(data)
    want = np.bincount(wi, weights=x[lo] * w * np.exp(-0.005 * w), minlength=len(ids))
    got = {r["id"]: r["strength"] for r in reference.retrospective_strength(spark, data).collect()}
    assert set(got) == set(ids[np.unique(wi)])
    assert all(abs(want[i] - got[k]) < 1e-6 for i, k in enumerate(ids) if k in got)


def ttl(rows, rosters, now, rate, ticks, tol):
    """Log-odds in a loop with influence as the reference runs it, over plain arrays; every player plays."""
    ids = sorted({u for us in rosters.values() for u in us})
    at, n = {u: i for i, u in enumerate(ids)}, len(ids)
    who = {}
    for _, t, w, l, _ in rows:
        who.setdefault(t, set()).update([*rosters[t, w], *rosters[t, l]])
    infl, rounds = dict.fromkeys(who, 1.0), 0
    for tick in range(ticks):
        rounds += 1
        lo, wi, sh, e = [], [], [], np.zeros(n)
        for _, t, w, l, ts in rows:
            share = np.exp(-(now - ts) / 86400 * rate) * infl[t] / (len(rosters[t, w]) * len(rosters[t, l]))
            for x in rosters[t, w] + rosters[t, l]:
                e[at[x]] += share
            for x in rosters[t, w]:
                for y in rosters[t, l]:
                    lo.append(at[y]), wi.append(at[x]), sh.append(share)
        rho = (e + 1e-12) / (e + 1e-12).sum()
        lo, wi, sh = np.array(lo), np.array(wi), np.array(sh)
        win, loss = solved(lo, wi, sh, rho), solved(wi, lo, sh, rho)
        lam = 0.025 * np.median(win) / np.median(rho)
        win, loss = win + lam * rho, loss + lam * rho
        raw = {t: np.mean((win / (win + loss))[[at[u] for u in us]]) for t, us in who.items()}
        low, high = min(raw.values()), max(raw.values())
        new = {t: 0.5 + 1.5 * (x - low) / (high - low) for t, x in raw.items()}
        if tick and np.mean([abs(infl[t] - new[t]) for t in infl]) < tol:
            break
        infl = {t: 0.5 * infl[t] + 0.5 * new[t] for t in new} if tick else new
    return dict(zip(ids, np.log(win / loss), strict=True)), infl, rounds


def test_influence_of_log_odds_settles(spark):
    g, now = np.random.default_rng(7), 1_700_000_000
    # A tournament's teams are its own, better or worse on the whole, so that the tournaments' influence differs.
    rosters = {(t, k): [int(x) for x in 4 * ((k + 2 * t) % 10) + np.arange(4)] for t in range(1, 5) for k in range(6)}
    rows = [(i, int(t), int(w), int(l), now - 86400 * i) for i, (t, w, l) in enumerate(zip(g.integers(1, 5, 150), g.integers(0, 6, 150), g.integers(0, 6, 150), strict=True)) if w != l]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, u) for (t, k), us in rosters.items() for u in us], "tournament_id long, team_id long, user_id long")
    for ticks, tol in ((4, 0.0), (30, 0.02)):
        cfg = graph.Engine(now=now, max_ticks=ticks, tick_tol=tol, pagerank=graph.PageRank(tol=1e-13, max_iter=500))
        scores, infl = graph.tick_tock_log_odds(m, r, None, cfg)
        want, want_infl, rounds = ttl(rows, rosters, now, cfg.rate, ticks, tol)
        assert rounds == ticks if tol == 0 else 2 < rounds < ticks
        assert scores.columns == ["id", "score", "win_pr", "loss_pr", "rho", "exposure"]
        assert max(abs(want[x["id"]] - x["score"]) for x in scores.collect()) < 1e-7
        assert max(abs(want_infl[x["tournament_id"]] - x["strength"]) for x in infl.collect()) < 1e-7


def test_no_player_is_lost_by_stores(spark, data):
    con = oracle.connection(data)
    p = {r[0]: r[1:] for r in con.execute(domain.sql("p", "SELECT player_id, name, country FROM p")).fetchall()}
    on = {r[0] for r in con.execute(domain.sql("r", "SELECT DISTINCT user_id FROM r")).fetchall()}
    played = {r[0] for r in con.execute(domain.sql("a", "SELECT DISTINCT user_id FROM a")).fetchall()}
    capitals = lambda x: x and x.upper()
    upserted = {k: (capitals(n) if k in played or k not in on else n, c) for k, (n, c) in p.items()}
    absent = {k: (n if k in on else capitals(n), c) for k, (n, c) in p.items()}
    for query, want in ((pipelines.upsert_players, upserted), (pipelines.insert_absent_players, absent)):
        got = [tuple(r) for r in query(spark, data).select("player_id", "name", "country").collect()]
        assert len(got) == len(p) and {r[0]: r[1:] for r in got} == want


def test_impact_on_every_player(spark, data):
    con = oracle.connection(data)
    x = con.execute(domain.sql("c", "SELECT u AS id, is_win, least(count(*), 10) AS n FROM (SELECT unnest(winners) AS u, true AS is_win FROM c UNION ALL SELECT unnest(losers), false FROM c) GROUP BY 1, 2")).fetchdf().groupby("id").n
    got = pipelines.exact_match_impact(spark, data).select("player_id", "match_id").toPandas()
    n = got.groupby("player_id").match_id.nunique()
    # A match counts once for one who played on both sides.
    assert n.sum() == len(got) and (n.sort_index() >= x.max().sort_index()).all() and (n.sort_index() <= x.sum().sort_index()).all()


@pytest.mark.parametrize("dense", [loo.DENSE, 0])
def test_every_match_without_as_solved_again(spark, dense):
    g = np.random.default_rng(5)
    # Teams share players from one tournament to the next; 40 to 43 have a single match, 50 to 53 only lose.
    rosters = {(t, k): [int(x) for x in (4 * k + 2 * t) % 32 + np.arange(4)] for t in range(3) for k in range(8)} | {(0, 8): [40, 41, 42, 43], (0, 9): [50, 51, 52, 53]}
    rows = [(i, int(t), int(w), int(l), 1_700_000_000 - 86400 * i) for i, (t, w, l) in enumerate(zip(g.integers(0, 3, 40), g.integers(0, 8, 40), g.integers(0, 8, 40), strict=True)) if abs(w - l) > 1]
    rows += [(100, 0, 8, 1, 1_700_000_000), (101, 0, 2, 9, 1_700_000_000), (102, 0, 3, 9, 1_700_000_000)]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, u) for (t, k), us in rosters.items() for u in us], "tournament_id long, team_id long, user_id long")
    c = convert.compact(convert.weighted(m, 1_700_000_000, 0.01), r)
    ids = sorted({u for _, t, w, l, _ in rows for u in rosters[t, w] + rosters[t, l]})
    at = {u: i for i, u in enumerate(ids)}

    def scores(without=None):
        lo, wi, sh, e = [], [], [], np.zeros(len(ids))
        for i, t, w, l, ts in rows:
            if i != without:
                share = np.exp(-(1_700_000_000 - ts) / 86400 * 0.01) / 16
                e[[at[x] for x in rosters[t, w] + rosters[t, l]]] += share
                for x in rosters[t, w]:
                    for y in rosters[t, l]:
                        lo.append(at[y]), wi.append(at[x]), sh.append(share)
        rho = (e + 1e-12) / (e + 1e-12).sum()
        win, loss = (solved(np.array(a), np.array(b), np.array(sh), rho) + 0.025 * rho for a, b in ((lo, wi), (wi, lo)))
        return np.log(win / loss)

    wanted = c.select("match_id", F.explode(F.array_union("winners", "losers")).alias("id"))
    got = loo.exact(c, wanted, 0.025, dense=dense).collect()
    assert len(got) == 8 * len(rows)
    base, new = scores(), {i: scores(i) for i, *_ in rows}
    for x in got:
        i = at[x["id"]]
        assert abs(x["old_score"] - base[i]) < 1e-8 and abs(x["new_score"] - new[x["match_id"]][i]) < 1e-6, x


def test_repetitions_are_the_references(spark, data, monkeypatch):
    seen = {}

    def note(module, name, at, key):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (seen.setdefault(name, []).append(k[key] if key in k else a[at]), f(*a, **k))[1])

    for x in ((predict, "monte_carlo", 1, "runs"), (evaluate, "bootstrap", 2, "replicates"), (evaluate, "folds", 1, "n"), (evaluate, "edge_dropout", 2, "seed")):
        note(*x)
    for q in (analytics.monte_carlo_places, analytics.accuracy_interval, quality.edge_dropout_robustness):
        q(spark, data).collect()
    assert {r["fold"] for r in analytics.temporal_cross_validation(spark, data).collect()} == set(range(5))
    assert seen == {"monte_carlo": [10_000], "bootstrap": [500], "folds": [5], "edge_dropout": [1, 2, 3, 4, 5]}


def test_nodes_of_every_type(spark, data):
    """Every node of the texts has a row, tied to the smallest interval that holds its own."""
    want = set()
    for origin, tab, key, col, lists in (("tournaments.meta", "tournaments", "tournament_id", "meta", problems.META), ("stages.settings", "stages", "stage_id", "settings", problems.SETTINGS)):
        for rid, text in duckdb.connect().execute(f"SELECT DISTINCT {key}, {col} FROM '{data}/{tab}.parquet' WHERE {key} IS NOT NULL AND {col} IS NOT NULL").fetchall():
            try:
                nodes = nested.label(nested.read_record(text, lists[0]), frozenset(lists))
            except nested.Unreadable:
                continue
            for path, pre, post, pos, value in nodes:
                around = [x[1] for x in nodes if x[1] < pre and x[2] > post]
                want.add((origin, rid, path, pre, post, pos, value, max(around) if around else None))
    cols = ["origin", "record_id", "path", "pre", "post", "pos", "value", "parent"]
    got = [tuple(r) for r in problems.queries()["p4_nodes"](spark, data).select(*cols).collect()]
    assert set(got) == want
    paths = {r[2] for r in got}
    assert {"$.staff.user.name", "$.bracketProgression.settings.teamsPerGroup", "$.groups.rounds.bestOf", "$.groups.rounds.maps.mapId", "$.swiss.roundCount"} <= paths
    assert all((r[7] is None) == (r[2] == "$") for r in got)


def test_held_out_ratings_share_the_matches_sides(spark, data, monkeypatch):
    m, r, a = (f(spark, data) for f in (domain.played, domain.rosters, domain.appearances))
    middle = m.agg(F.percentile("ts", 0.5)).first()[0]
    c = convert.compact(convert.weighted(m.where(F.col("ts") < middle), domain.NOW, domain.RATE), r, a)
    scores = graph.log_odds(c, graph.Engine(now=domain.NOW, fixed_lambda=0.025)).select(F.col("id").alias("user_id"), F.exp("score").alias("x"))
    want = {x[0]: x[1] for x in r.join(scores, "user_id").groupBy("team_id").agg(F.avg("x")).collect()}
    sides, calls, compact = reference.with_sides(m, r, a), [], convert.compact
    assert sides.count() == m.count()
    monkeypatch.setattr(convert, "compact", lambda *x: calls.append(1) or compact(*x))
    got = {x["id"]: x["rating"] for x in reference.rated_teams(sides.where(F.col("ts") < middle), r).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) / want[k] for k in want) < 1e-6 and not calls
    monkeypatch.setattr(graph, "log_odds", lambda c, cfg: spark.createDataFrame([(1, 0.0)], "id long, score double"))
    # The fixture has too few tournaments to hold ten out.
    for module, name in ((evaluate, "sequential_holdout"), (loading.quality, "backtest")):
        monkeypatch.setattr(module, name, lambda m, rate, **_: [rate(m) for _ in range(2)])
    for q in (analytics.temporal_cross_validation, loading.sequential_holdout, loading.tournament_backtest):
        calls.clear()
        q(spark, data)
        assert calls == [1], q.__name__


def test_ticks_of_log_odds_share_the_matches_sides(spark, monkeypatch):
    rows = [(i, i % 3, w, l, 1_700_000_000 - 86400 * i) for i, (w, l) in enumerate([(0, 1), (1, 2), (2, 0), (0, 2), (1, 0), (2, 1), (0, 1), (1, 2), (0, 2)])]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    r = spark.createDataFrame([(t, k, 4 * k + i + t) for t in range(3) for k in range(3) for i in range(4)], "tournament_id long, team_id long, user_id long")
    # In the first match one more player appears than the roster has.
    a = spark.createDataFrame([(0, 0, 0, u) for u in (0, 1, 2, 99)], "tournament_id long, match_id long, team_id long, user_id long")
    infl = spark.createDataFrame([(0, 0.5), (1, 2.0)], "tournament_id long, strength double")
    w = lambda *x: convert.compact(convert.weighted(m, 1_700_000_000, 0.01, *x), r, a)
    want = {x["match_id"]: x for x in w(infl, 1.5).collect()}
    for x in convert.scaled(w(), infl, 1.5).collect():
        y = want.pop(x["match_id"])
        assert x["winners"] == y["winners"] and x["losers"] == y["losers"] and abs(x["weight"] / y["weight"] - 1) < 1e-12 and abs(x["share"] / y["share"] - 1) < 1e-12
    assert not want
    calls, compact = [], convert.compact
    monkeypatch.setattr(convert, "compact", lambda *x: calls.append(1) or compact(*x))
    scores, got = graph.tick_tock_log_odds(m, r, a, graph.Engine(now=1_700_000_000, max_ticks=4, tick_tol=0.0))
    assert 99 in {x["id"] for x in scores.collect()} and got.count() == 3 and calls == [1]


def test_production_finds_teams_and_sides_once(spark, tmp_path, monkeypatch):
    rows = [(i, i % 2, w, l, 1_700_000_000 - 86400 * i) for i, (w, l) in enumerate([(0, 1), (1, 2), (2, 0), (0, 2)])]
    m = spark.createDataFrame(rows, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    # Player 1 is on two rosters of tournament 0.
    r = spark.createDataFrame([(t, k, 4 * k + i) for t in range(2) for k in range(3) for i in range(4)] + [(0, 1, 1)], "tournament_id long, team_id long, user_id long")
    a = spark.createDataFrame([(0, 0, 1, None), (0, 0, 0, 0), (0, 0, 4, None), (0, 0, 77, 0), (0, 9, 0, 0)], "tournament_id long, match_id long, user_id long, team_id long")
    got = convert.legacy_appearances(a, m, r)
    assert sorted(tuple(x) for x in got.collect()) == [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 1, 1), (0, 0, 4, 1)]
    w = convert.weighted(m, 1_700_000_000, 0.01)
    sides = [sorted((x["match_id"], x["winners"], x["losers"], x["share"]) for x in convert.compact(w, r, got, named=n).collect()) for n in (False, True)]
    assert sides[0] == sides[1] and sides[0][0][1:3] == ([0, 1], [1, 4])
    names, asked, written, inferred = [], [], graph.written, convert.inferred
    monkeypatch.setattr(graph, "written", lambda df, name="t", *x: names.append(name) or written(df, name, *x))
    monkeypatch.setattr(convert, "inferred", lambda *x: asked.append(1) or inferred(*x))
    batch.update(spark, f"file://{tmp_path}", m, r, a, "build", 1, graph.Engine(now=1_700_000_000, max_ticks=1))
    assert "log_odds" in names and "compact" not in names and not asked


def test_graph_without_matches_stays_on_executors(spark, monkeypatch):
    g = np.random.default_rng(11)
    rows = [(i, w, l, 1_700_000_000 - 86400 * i) for i, (w, l) in enumerate(g.integers(0, 8, (40, 2)).tolist()) if w != l]
    m = spark.createDataFrame([(i, 0, w, l, ts) for i, w, l, ts in rows], "match_id long, tournament_id long, winner_team_id long, loser_team_id long, ts long")
    # Player 3 is on two teams, so also on both sides of their matches.
    r = spark.createDataFrame([(0, k, 4 * k + i) for k in range(8) for i in range(4)] + [(0, 1, 3)], "tournament_id long, team_id long, user_id long")
    c = convert.compact(convert.weighted(m, 1_700_000_000, 0.01), r)
    wanted = c.select("match_id", F.explode(F.array_union("winners", "losers")).alias("id")).where("match_id % 8 = 1")
    frame = type(wanted)

    def never(*_):
        raise AssertionError("a table came to the driver")

    with monkeypatch.context() as x:
        x.setattr(frame, "toArrow", never)
        x.setattr(frame, "toPandas", never)
        x.setattr(type(spark.sparkContext), "broadcast", never)
        got = {(x["id"], x["match_id"]): x for x in loo.exact(c, wanted, 0.025).collect()}
    cfg = graph.Engine(fixed_lambda=0.025, pagerank=graph.PageRank(tol=1e-14, max_iter=500))
    old = {x["id"]: x["score"] for x in graph.log_odds(c, cfg).collect()}
    assert got and all(abs(old[p] - x["old_score"]) < 1e-8 for (p, _), x in got.items())
    k = min(match for _, match in got)
    new = {x["id"]: x["score"] for x in graph.log_odds(c.where(F.col("match_id") != k), cfg).collect()}
    assert all(abs(new[p] - x["new_score"]) < 1e-6 for (p, match), x in got.items() if match == k)


def test_columns_settle_in_few_steps(monkeypatch):
    g = np.random.default_rng(3)
    # Two circuits of 400 players, of whom a few meet: steps alone take some 150 to settle.
    rosters = g.permuted(np.tile(np.arange(400), (120, 1)), axis=1)[:, :4] + 400 * (np.arange(120) % 2)[:, None]
    give, take = g.integers(0, 60, (2, 900)) * 2 + g.integers(0, 2, 900)
    take[:6] ^= 1
    share = g.random(900) + 0.1
    src, dst = (np.repeat(rosters[x], k, axis=1).ravel() if k else np.tile(rosters[y], (1, 4)).ravel() for x, y, k in ((give, take, 4), (give, take, 0)))
    key, at = np.unique(src * 800 + dst, return_inverse=True)
    w = np.bincount(at, weights=np.repeat(share, 16))
    src, dst = key // 800, key % 800
    out = np.bincount(src, weights=w, minlength=800)
    sides = (rosters.ravel(), np.repeat(np.arange(120), 4), give, take, share)
    fast, exact = (loo.Inverse(src, dst, w, out, sides, out + np.bincount(dst, weights=w, minlength=800), 0.85, dense) for dense in (0, 800))
    steps, step = [], loo.Inverse.step
    monkeypatch.setattr(loo.Inverse, "step", lambda self, x: (steps.append(1), step(self, x))[1])
    js = np.arange(0, 800, 13)
    assert np.abs(fast.columns(js) - exact.columns(js)).max() < 1e-8 and len(steps) < 60
