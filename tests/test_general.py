"""The general problems' operators on small fixtures: nulls, blanks, ties, repeats, empty tables, clashing columns."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from podium.functions import instants
from podium.operators import feature_table, nested, orphan_refs


def test_parse_text_layouts():
    ms = lambda *a: int((datetime(*a) - datetime(1970, 1, 1)).total_seconds() * 1000)
    one = lambda s, z=None: set(instants.parse_text(s, z).values())
    assert one("2024-01-31T09:30:00Z") == {ms(2024, 1, 31, 9, 30)}
    assert one(" 2024-01-31t09:30:00z ") == {ms(2024, 1, 31, 9, 30)}
    assert one("2024-01-31\u00a009:30:00 UTC") == {ms(2024, 1, 31, 9, 30)}
    assert one("2024-01-31") == {ms(2024, 2, 1) - 1}
    assert one("20240131") == {ms(2024, 2, 1) - 1}
    assert one("31/Jan/2024:09:30:00 -0330") == {ms(2024, 1, 31, 13, 0)}
    assert one("Apr 1, 2024 12:05:00 AM GMT") == {ms(2024, 4, 1, 0, 5)}
    assert one("2024-01-31T09:30:00.1234996+00:00") == {ms(2024, 1, 31, 9, 30) + 123}
    assert one("2024-01-31T09:30:00.1235+00:00") == {ms(2024, 1, 31, 9, 30) + 124}
    assert one("2021-10-31 02:30:00", "Europe/Berlin") == {ms(2021, 10, 31, 0, 30)}  # twice: the first
    assert one("2021-03-28 02:30:00", "Europe/Berlin") == {ms(2021, 3, 28, 1, 30)}  # never: moved on by an hour
    assert one("2021-10-31 02:30:00 CET") == {ms(2021, 10, 31, 1, 30)}
    assert one("2024-01-31 09:30:00", "Nowhere/Land") == {ms(2024, 1, 31, 9, 30)}
    assert one("2024-01-31T09:30:00." + "1" * 40 + "Z") == {ms(2024, 1, 31, 9, 30) + 111}
    assert one("2024-01-31" + " " * 500 + "09:30:00Z") == {ms(2024, 1, 31, 9, 30)}  # length alone drops nothing
    assert one("1672711950." + "4" * 30) == {1672711950444} and one("0" * 30 + "1672711950") == {1672711950000}
    assert one("9999999999999999999") == one("9223372036854775807") == one("18446744073709551615") == one("2024-01-31 09:30:00 " + "a/b" * 9000) == set()
    assert set(instants.parse_text("1999-12-31T00:00:00Z", window=(0, 10**15)).values()) == {ms(1999, 12, 31)}
    for s in (None, "", "   ", "unknown", "0", "-1", "0000-00-00 00:00:00", "2024-02-30", "2019-01-01", "2024-01-31 09:30:00 Nowhere/Land", "9" * 500):
        assert one(s) == set(), s


def test_resolve_by_mixture(spark):
    rows = [(f"{d:02d}.{m:02d}.2023", "x") for d in (13, 20, 28) for m in (1, 5)] + [("05.06.2023", "x"), ("07.07.2023", "x"), (None, "x"), ("", "x"), ("nope", None)]
    df = spark.createDataFrame(rows, "v string, layout string")
    r = {x["v"]: x for x in instants.resolve(df, "v", prefix="t_").collect()}
    assert r["05.06.2023"]["t_layout"] == "dmy" and r["05.06.2023"]["t_status"] == "resolved"
    assert datetime.fromtimestamp(r["05.06.2023"]["t_utc_ms"] / 1000, UTC).month == 6
    assert r[""]["t_status"] == r["nope"]["t_status"] == "none" and r[None]["t_utc_ms"] is None
    alone = instants.resolve(spark.createDataFrame([("05.06.2023",), ("03.03.2023",)], "v string"), "v").collect()
    assert sorted(x["status"] for x in alone) == ["ambiguous", "resolved"]  # nothing tells day from month


def test_resolve_numbers(spark):
    v = [1672711950.631, 1672711950631.0, 1672711950631000.0, 20230103022330.0, 44929.5, 0.0, -1.0, float("nan"), None, 12.0]
    df = spark.createDataFrame([(x, None) for x in v], "v double, zone string")
    r = [(x["layout"], x["utc_ms"]) for x in instants.resolve(df, "v", "zone").collect()]
    assert r[:3] == [("epoch_s", 1672711950631), ("epoch_ms", 1672711950631), ("epoch_us", 1672711950631)]
    assert r[3] == ("ymdhms_digits", 1672712610000) and r[4] == ("serial_days", 1672747200000)
    assert r[5:] == [(None, None)] * 5
    assert instants.resolve(df.limit(0), "v", "zone").count() == 0


def test_resolve_counts_out_of_range(spark):
    df = spark.createDataFrame([("9999999999999999999",), ("1672711950",), (str(2**63 - 1),)], "v string")
    assert [(r["utc_ms"], r["status"]) for r in instants.resolve(df, "v").collect()] == [(None, "none"), (1672711950000, "resolved"), (None, "none")]
    n = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (1672711950,)], "v long")
    assert [r["utc_ms"] for r in instants.resolve(n, "v").collect()] == [None, None, 1672711950000]
    old = instants.resolve(spark.createDataFrame([(946684800,)], "v long"), "v", window=(0, 1_000_000_000_000))
    assert old.first()["utc_ms"] == 946684800000


def _org(spark, apps, matches, tours):
    a = spark.createDataFrame(apps, "appearance_id long, tournament_id long, match_id long, player_id long, team_id long, org_slug string")
    m = spark.createDataFrame(matches, "match_id long, tournament_id long, last_game_finished_at double, total_games int, entity int")
    t = spark.createDataFrame(tours, "tournament_id long, org_slug string, settings_timezone string, ingested_at timestamp")
    return feature_table.organiser_vectors(a, m, t)


def test_feature_vectors(spark):
    apps = [(1, 1, 10, 7, None, "z"), (2, 1, 10, 7, None, "z"), (3, 1, 11, 7, None, "z"), (4, 2, 12, 7, None, "z"), (5, None, 10, 7, None, "z"), (6, 1, None, 7, None, "z"), (7, 1, 10, None, None, "z"), (8, 3, 10, 8, None, "z")]
    matches = [(10, 1, 1672711950.0, 3, 0), (10, 1, 1672711960.0, None, 0), (11, 1, float("nan"), 5, 0), (12, 2, 1672711950631.0, 4, 0)]
    tours = [(1, "a", None, None), (1, "a", None, None), (2, "b", None, None), (3, None, None, None)]
    v, types = _org(spark, apps, matches, tours)
    got = {(r["entity"], r["type_idx"]): (r["n"], r["total"], r["latest_ms"]) for r in feature_table.cells(v).collect()}
    assert got == {(7, 0): (1, 3.0, 1672711960000), (7, 1): (1, 4.0, 1672711950631)}
    wide = feature_table.expand(v, [(0, "a"), (1, "b")], 1672711960000).first()
    assert (wide["n__a"], wide["total__b"], wide["days_ago__a"]) == (1, 4.0, 0.0)
    double = feature_table.merge(v, v)
    assert sorted(r["n"] for r in feature_table.cells(double).collect()) == [2, 2]
    empty, _ = _org(spark, apps[:0], matches[:0], tours[:0])
    assert empty.count() == 0 and feature_table.expand(empty, [(0, "a")], 0).columns == ["entity", "n__a", "total__a", "days_ago__a"]


def _refs(spark, child, parent, gone, **kw):
    ts = lambda rows: [tuple(datetime(2024, 1, x) if i == len(r) - 1 and x is not None else x for i, x in enumerate(r)) for r in rows]
    c = spark.createDataFrame(ts(child), "id long, ref long, code int, ingested_at timestamp")
    p = spark.createDataFrame(ts(parent), "key long, ingested_at timestamp")
    g = spark.createDataFrame(gone, "entity_type string, internal_id long")
    r = orphan_refs.Reference("c.ref", c, "id", "ref", p, "key", "thing")
    return {(x["record_id"], x["kind"]) for x in orphan_refs.find([r], g, **kw).collect()}


def test_orphans(spark):
    child = [(1, 5, 0, 3), (1, 5, 0, 3), (2, 6, 0, 1), (3, 7, 0, 9), (4, 8, 0, 9), (5, None, 0, 9), (6, 6, 0, None), (7, 9, 0, 1), (7, 9, 0, 8)]
    parent = [(5, 2), (6, 2), (6, 4), (9, 5), (None, 1)]
    gone = [("thing", 7), ("thing", 5), ("other", 8), ("thing", None)]
    want = {(2, "late"), (3, "deleted"), (4, "missing"), (7, "late")}
    assert _refs(spark, child, parent, gone) == want
    many = [(i, 6, 0, 1) for i in range(300)] + [(1000 + i, 2000 + i, 0, 1) for i in range(50)]
    parents = [(i, 1) for i in range(6)] + [(6, 2)] + [(3000 + i, 1) for i in range(100)]
    got = _refs(spark, many, parents, gone, range_parents=10, batch_refs=40)  # one hot key, many ranges
    assert got == {(i, "late") for i in range(300)} | {(1000 + i, "missing") for i in range(50)}
    assert _refs(spark, child[:0], parent, gone) == set()
    assert _refs(spark, [(1, 1, 0, 1)], parent[:0], gone[:0]) == {(1, "missing")}


def test_nested(spark):
    doc = {"bracket_progression": [{"sources": {"placements": [1, None, "3"]}}, None, {"sources": [None, {"placements": 4}, json.dumps({"placements": [5]})]}]}
    texts = [json.dumps(doc), "\ufeff " + json.dumps({"data": doc}), json.dumps(json.dumps(doc)), repr(doc), json.dumps(doc)[:-9], "", None, "null", "[]", "{'a': "]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] * 2, "record_id long, text string, doc int").withColumnRenamed("record_id", "id")
    lists = ("bracketProgression", "sources", "placements")
    paths = tuple("$." + ".".join(lists[: i + 1]) for i in range(3))
    nodes = nested.shred(df, "id", "text", lists[0], lists)
    got = {(r["record_id"], r["pos_1"], r["pos_2"], r["pos"], r["value"]) for r in nested.linked(nodes, paths).collect()}
    want = {(0, 0, 0, "1"), (0, 0, 2, "3"), (2, 1, 0, "4"), (2, 2, 0, "5")}
    assert got == {(i, *w) for i in range(4) for w in want}
    # Intervals nest: what is within another by number is below it by path.
    n = nodes.where("record_id = 0").collect()
    for a in n:
        for b in n:
            inside = a["pre"] < b["pre"] and a["post"] > b["post"]
            assert not inside or b["path"].startswith(a["path"])
    assert len({r["pre"] for r in n}) == len(n) == len({r["post"] for r in n})
    assert nested.linked(nested.shred(df.limit(0), "id", "text", lists[0], lists), paths).count() == 0


def test_nested_oddities(spark):
    lists = ("groups", "rounds", "maps")
    path = "$.groups"
    doc = {"groups": [{"rounds": 1}]}
    wrapped = doc
    for k in ("data", "payload", "result") * 5:
        wrapped = {k: wrapped}
    deep = "[" * 60_000 + "]" * 60_000
    pydeep = "{'a': " * 20_000 + "None" + "}" * 20_000
    texts = ["{'groups': [b'x']}", "{'groups': [{1, 2}]}", "{'groups': [...]}", '{"groups": ["\\ud800x"]}', json.dumps(wrapped), '{"groups": [1], "more": ' + deep + "}", "{'groups': (1, 2), 'more': " + pydeep + "}", '{"groups": [1], "more": ' + deep, "{'groups': [1j]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in nested.shred(df, "id", "text", "groups", lists, (path,)).collect():
        got.setdefault(r["record_id"], []).append(r["value"])
    assert got == {3: ["\ufffdx"], 4: [None], 5: ["1"], 6: ["1", "2"]}
    # The loop reads what the parsers read, and refuses what they refuse.
    for s in ('{"a": [1, {"b": "c,]"}, null, true], "d": {}}', "[]", '"x"', "3", "{'a': (1, None), 2: 'it\\'s'}"):
        assert json.dumps(nested.read_deep(s)) == json.dumps(nested.read_text(s))
    for s in ("[1", "[1]]", "[1 2]", '{"a"}', '{"a": }', '{"a" 1}', "1 2", "", "{[]: 1}", ":", ",", "[,]", '["a]', "x"):
        with pytest.raises(nested.Unreadable):
            nested.read_deep(s)
