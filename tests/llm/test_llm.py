"""The training-data operators against brute force, exact invariants and held-out accuracy, on small fixtures."""

import collections
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from podium.llm import mix, pack, pairwise, queries, reading, top_n


# ---- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, data, name):
    oracle.assert_same(spark, oracle.connection(data), data, queries.queries()[name], queries.oracle_sql()[name])


# ---- pairwise ranking


def _league(spark, n=40, games=400, seed=0):
    g = np.random.default_rng(seed)
    skill = np.sort(g.normal(0, 1.5, n))
    m, a, r = [], [], []
    for i in range(games):
        x, y = (g.choice(n // 4, 2, replace=False)).tolist()
        p = 1 / (1 + np.exp(-(skill[4 * x : 4 * x + 4].mean() - skill[4 * y : 4 * y + 4].mean())))
        w, l = (x, y) if g.random() < p else (y, x)
        m.append((i, 1, w, l, False, None))
        for t in (w, l):
            for j in range(4):
                a.append((1, i, 4 * t + j, t if (i + j) % 2 else None, 0))
    r = [(1, t, 4 * t + j) for t in range(n // 4) for j in range(4)]
    return (
        spark.createDataFrame(a, "tournament_id long, match_id long, player_id long, team_id long, winner int"),
        spark.createDataFrame(m, "match_id long, tournament_id long, winner_team_id long, loser_team_id long, is_bye boolean, ingested_at timestamp"),
        spark.createDataFrame(r, "tournament_id long, team_id long, player_id long"),
        skill,
    )


def test_vectors_and_frames_agree(spark):
    a, m, r, _ = _league(spark, games=120)
    s = pairwise.sides(a, m, r)
    x = {q["player_id"]: q["strength"] for q in pairwise.strengths(s).collect()}
    y = {q["player_id"]: q["strength"] for q in pairwise.strengths(s, players_bound=5).collect()}
    z = {q["player_id"]: q["strength"] for q in pairwise.strengths(s, side_bound=1).collect()}
    assert x.keys() == y.keys() == z.keys()
    assert max(abs(np.log(x[k] / y[k])) + abs(np.log(y[k] / z[k])) for k in x) < 1e-9


def test_parts_are_summed_up_a_tree(spark, monkeypatch):
    a, m, r, _ = _league(spark, games=120)
    s = pairwise.sides(a, m, r)
    x = {q["player_id"]: q["strength"] for q in pairwise.strengths(s).collect()}
    monkeypatch.setattr(pairwise, "FAN", 2)
    monkeypatch.setattr(pairwise, "CHUNK", 7)
    y = {q["player_id"]: q["strength"] for q in pairwise.strengths(s.repartition(7)).collect()}
    assert x.keys() == y.keys() and max(abs(np.log(x[k] / y[k])) for k in x) < 1e-9


def test_unsettled_strengths_are_told(spark, monkeypatch):
    a, m, r, _ = _league(spark, games=120)
    monkeypatch.setattr(pairwise, "ROUNDS", 1)
    for bound in (pairwise.PLAYERS, 5):
        with pytest.warns(UserWarning, match="still change"):
            pairwise.strengths(pairwise.sides(a, m, r), players_bound=bound).count()


def test_strength_follows_skill(spark):
    a, m, r, skill = _league(spark)
    got = {q["player_id"]: q["strength"] for q in pairwise.rating(a, m, r).collect()}
    k = sorted(got)
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank([skill[i] for i in k]), rank([got[i] for i in k]))[0, 1] > 0.85


def test_dirty_contests(spark):
    m = spark.createDataFrame([(1, 10, 20, None), (1, 10, 20, None), (2, 10, 20, True), (3, None, 20, False), (4, 10, None, False), (5, 20, 10, False), (None, 10, 20, False)], "match_id long, winner_team_id long, loser_team_id long, is_bye boolean").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    a = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 1, 10), (1, 1, 2, None), (1, 1, 3, None), (1, 2, 1, 10), (1, 5, 4, 10), (1, None, 1, 10), (1, 1, None, 10), (None, 1, 9, None)], "tournament_id long, match_id long, player_id long, team_id long")
    r = spark.createDataFrame([(1, 20, 2), (1, 20, 3), (1, 10, 3), (1, None, 2), (1, 20, None)], "tournament_id long, team_id long, player_id long")
    s = {(q["match_id"], q["player_id"]): q["won"] for q in pairwise.sides(a, m, r).collect()}
    assert s == {(1, 1): True, (1, 2): False, (1, 3): None, (1, 9): None, (5, 4): False}
    got = {q["player_id"]: (q["matches"], q["strength"]) for q in pairwise.rating(a, m, r).collect()}
    assert set(got) == {1, 2, 3, 4, 9} and got[3] == (1, None) and got[1][1] > got[2][1]
    assert pairwise.rating(a.limit(0), m, r).count() == pairwise.rating(a, m.limit(0), r).count() == 0
    places = {q["player_id"]: q["place"] for q in pairwise.ranking(pairwise.rating(a, m, r)).collect()}
    assert places == {1: 1, 2: 2}


# ---- top N


@pytest.mark.parametrize("fan", [2, 32])
def test_bisection_keeps_exactly_n(spark, fan):
    g = np.random.default_rng(2)
    rows = {(int(min(9, q)), int(c)) for q, c in zip(g.geometric(0.4, 3000), g.integers(0, 700, 3000), strict=True)}
    df = spark.createDataFrame(sorted(rows), "grp long, code long")
    for n in (1, 5):
        got = collections.defaultdict(set)
        for x in top_n.bisect(df, n, 700, fan).collect():
            got[x["grp"]].add(x["code"])
        for q in {q for q, _ in rows}:
            assert got[q] == set(sorted(c for p, c in rows if p == q)[:n])


def test_top_n_ties_and_dirt(spark):
    members = spark.createDataFrame([(1, i, 0) for i in range(10)] * 2 + [(2, 3, 0), (None, 1, 0), (3, None, 0), (4, 99, 0)], "g long, i long, code int")
    scores = spark.createDataFrame([(i, 1.0) for i in range(8)] + [(8, float("nan")), (9, None), (3, 2.0), (None, 5.0), (0, float("-inf"))], "i long, s double")
    got = [tuple(r) for r in top_n.top_n(members, scores, "g", "i", "s", 3).orderBy("g", "position").collect()]
    assert got == [(1, 3, 2.0, 1), (1, 0, 1.0, 2), (1, 1, 1.0, 3), (2, 3, 2.0, 1)]
    assert top_n.top_n(members.limit(0), scores, "g", "i", "s", 3).count() == 0
    assert top_n.top_n(members, scores.limit(0), "g", "i", "s", 3).count() == 0


# ---- packing


def _packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "doc long, n long, piece int")
    return [tuple(r) for r in pack.pack(df, "doc", "n", capacity).collect()]


@pytest.mark.parametrize("least", [50, 20_000])
def test_packing_is_valid_and_tight(spark, least, monkeypatch):
    monkeypatch.setattr(pack, "LEAST", least)  # one range or several
    g = np.random.default_rng(4)
    sizes = [int(x) for x in g.lognormal(3.3, 0.9, 600)] + [100] * 20 + [0, None, 101, 250]
    got = _packed(spark, sizes, 100)
    by_doc, room = collections.defaultdict(dict), collections.Counter()
    for doc, piece, n, c in got:
        assert piece not in by_doc[doc]
        by_doc[doc][piece] = n
        assert (c is None) == (n == 0)
        room[c] += n
    assert len(by_doc) == len(sizes) and all(sum(p.values()) == (sizes[d] or 0) for d, p in by_doc.items())
    assert all(len(p) == max(1, -(-(sizes[d] or 0) // 100)) for d, p in by_doc.items())
    del room[None]
    assert max(room.values()) <= 100 and sorted(room) == list(range(len(room)))
    assert sum(room.values()) / (100 * len(room)) > 0.97


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc long, n long")
    assert pack.pack(df, "doc", "n", 10).count() == 0


def _plain_sweep(rows):
    """Larger items first, each to the smallest open gap that holds it."""
    open_, pairs = [], []
    for i, (gap, _) in enumerate(rows):
        if gap:
            open_.append(i)
        elif open_:
            pairs.append((open_.pop(), i))
    return pairs


@pytest.mark.parametrize("seed", range(5))
def test_sweep_takes_the_successor(seed):
    g = np.random.default_rng(seed)
    rows = sorted(((bool(g.random() < 0.4 + 0.1 * seed), int(s)) for s in g.integers(1, 40, 300)), key=lambda r: (-r[1], not r[0]))
    gaps, items, alone, open_ = pack.sweep(np.array([r[0] for r in rows]))
    assert sorted(zip(gaps.tolist(), items.tolist(), strict=True)) == sorted(_plain_sweep(rows))
    assert len(gaps) * 2 + len(alone) + len(open_) == 300
    # Swept by parts and matched between them by rank it is the same.
    cuts = [0, 40, 41, 150, 260, 300]
    left_i, left_g, pairs = {}, {}, []
    for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        x, y, i, o = pack.sweep(np.array([r[0] for r in rows[a:z]]))
        pairs += [(a + u, a + v) for u, v in zip(x.tolist(), y.tolist(), strict=True)]
        left_i[p], left_g[p] = [a + k for k in i.tolist()], [a + k for k in o.tolist()]
    of_items, of_gaps = pack.between({p: len(v) for p, v in left_i.items()}, {p: len(v) for p, v in left_g.items()})
    for (p, first, n, m), (q, end, k, m2) in zip(of_items, of_gaps, strict=True):
        assert (n, m) == (k, m2)
        pairs += [(left_g[q][end - 1 - j], left_i[p][first + j]) for j in range(n)]
    assert sorted(pairs) == sorted(_plain_sweep(rows))


def test_packing_of_equal_sizes(spark, monkeypatch):
    monkeypatch.setattr(pack, "LEAST", 40)
    got = _packed(spark, [30] * 400 + [100] * 30 + [1] * 17, 100)
    room = collections.Counter()
    for _, _, n, c in got:
        room[c] += n
    assert len(got) == 447 and max(room.values()) <= 100 and len(room) == 164


# ---- mixing


def test_pivots_keep_size_and_expectation():
    p, size = np.array([0.3] * 9), np.arange(1.0, 10.0)
    total = np.zeros(9)
    for seed in range(4000):
        x, left = pivot(p, size, seed)
        assert abs((x * size).sum() - (p * size).sum()) < 1e-9
        assert sum(0 < v < 1 for v in x) == (left >= 0)
        total += x
    assert np.abs(total / 4000 - 0.3).max() < 0.04


def pivot(p, size, seed):
    return mix.pivot(p, size, np.random.default_rng(seed))


def test_shares(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 40)
    monkeypatch.setattr(mix, "FAN", 3)
    g = np.random.default_rng(6)
    names = ["A-b", " a_B", "a b"] * 100 + ["c"] * 60 + [None, "zzz"] * 5 + ["d"] * 20
    docs = spark.createDataFrame([(i, n, int(g.integers(0, 50))) for i, n in enumerate(names)], "item long, source string, size long").withColumn("key", mix.source_key(F.col("source")))
    targets = spark.createDataFrame([("a_b", 0.5, 1), ("c", 0.3, 9), ("d", 0.4, 1), ("none", 0.1, 3), ("nil", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got, q = mix.mixed(docs, targets)
    s = {r["source"]: r for r in mix.shares(got, q).collect()}
    assert set(s) == {"a_b", "c", "d", "none", "nil"}
    assert {k for k, r in s.items() if r["short"]} == {"d", "none"}
    for k in ("a_b", "c"):
        assert abs(s[k]["drawn_tokens"] - s[k]["wanted"]) <= 50
    assert s["a_b"]["most_repeats"] <= 1 and s["d"]["drawn_tokens"] == s["d"]["tokens"] and s["c"]["most_repeats"] <= 9
    rows = got.collect()
    assert len(rows) == len({r["item"] for r in rows}) == 380
    empty, q = mix.mixed(docs.limit(0), targets)
    assert empty.count() == 0 and mix.shares(empty, q).count() == 5


# ---- reading level


def test_sections():
    s = reading.sections("Title\n(57) Abstract\nA short one.\nDetailed of description the invention\nThe long one.\nWhat claimed it is is:\n1. A thing comprising: a part.")
    assert s["description"].split() == ["The", "long", "one."] and "comprising" in s["claims"] and "short" in s["abstract"]
    s = reading.sections("ABSTRACT A short one. DESCRIPTION Two pins hold the sheet (57). They are long.")
    assert s["description"].split()[-1] == "long."
    s = reading.sections("Ansprüche 1. Etwas nach einem der Ansprüche 1 bis 2, dadurch gekennzeichnet. Beschreibung Das Teil ist rund.")
    assert s["description"].strip() == "Das Teil ist rund." and "description" not in reading.sections("CLAIMS\n1. A thing wherein it is.")
    assert reading.words("ge-\nkürzt x≤3 Ab-satz") == ["gekürzt", "ab", "satz"]


def test_levels_of_little(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "CLAIMS\n1. A b wherein."), (4, "DESCRIPTION\n" + "plain word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reading_level int")
    assert reading.fit(docs, none) is None
    assert [r["prose_level"] for r in reading.levels(docs, None).collect()] == [None] * 4
    bad = spark.createDataFrame([(4, None), (4, 9), (1, 3)], "doc_id long, reading_level int")
    assert reading.fit(docs, bad) is None


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    if not Path(d).exists():
        pytest.skip("no test data here")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/level_labels.parquet").where("reading_level is not null").select("doc_id", "reading_level")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    got = reading.levels(docs, reading.fit(docs, labels.where(fold != 0))).join(labels.where(fold == 0).groupBy("doc_id").agg(F.median("reading_level").alias("y")), "doc_id")
    r = got.where("description_level is not null").agg(F.avg((F.abs(F.col("description_level") - F.col("y")) <= 1).cast("double")), F.avg(((F.col("description_p4") > 0.5) == (F.col("y") >= 4)).cast("double")), F.count(F.lit(1))).first()
    assert r[2] > 100 and r[0] > 0.97 and r[1] > 0.93
