"""Caches as VARIANT and nested listings against plain versions."""

import json
import random

from quillgraph.operators import tree
from quillgraph.sources import variants


def test_round_trip_keeps_what_it_does_not_know(spark, tmp_path):
    records = {
        "A": {"item_key": "A", "references": ["W1", {"id": "W2", "title": "Two", "venue": {"name": "x", "year": 1}}, "W9", None, {"title": "no id"}], "new": [1, {"a": None}], "v": 2},
        "B": {"item_key": "B", "references": [], "flag": True},
        "C": {"item_key": "C"},
        "D": {"item_key": "D", "references": "oops"},
        "E": {"item_key": "E", "references": [{"id": "W3", "year": "1999", "citedBy": "many"}]},
    }
    lines = [json.dumps(r) for r in records.values()] + ["{not json", "", json.dumps({"no": "key"}), "[1]"]
    (tmp_path / "in").write_text("\n".join(lines))
    cache = variants.read_lines(spark, str(tmp_path / "in"))
    works = spark.createDataFrame([("W1", "One", 2001), ("W2", "not this", 0)], "id string, title string, year int")
    variants.write_lines(variants.resolved(cache, works), str(tmp_path / "out"))
    again = {r["item_key"]: json.loads(r["j"]) for r in variants.read_lines(spark, str(tmp_path / "out")).selectExpr("item_key", "to_json(record) AS j").collect()}
    records["A"]["references"][0] = {"id": "W1", "title": "One", "year": 2001}
    assert again == records
    rows = sorted(tuple(r)[:-1] for r in variants.entries(cache).collect() if r["id"])
    assert rows == [("A", 0, "W1", True, None, None, None), ("A", 1, "W2", False, "Two", None, None), ("A", 2, "W9", True, None, None, None), ("E", 0, "W3", False, None, 1999, None)]
    assert variants.entries(cache).count() == 6


def test_lookup_keeps_each_list_and_parses_once(spark, tmp_path):
    # two lines of one key, a work that is known twice, a number that reads like an id, a list longer than most
    long = [f"W{i % 50}" if i % 3 else {"id": f"W{i % 50}", "i": i} for i in range(2000)]
    lines = [{"item_key": "A", "references": ["W1", "W7", {"id": "W2"}]}, {"item_key": "A", "references": [{"id": "W1"}, "W2", 1, "1"]}, {"item_key": "B", "references": long}, {"item_key": "C", "references": ["W999"], "note": None}]
    (tmp_path / "in").write_text("\n".join(json.dumps(r) for r in lines))
    cache = variants.read_lines(spark, str(tmp_path / "in"))
    works = spark.createDataFrame([(f"W{i}", f"Work {i}") for i in range(1, 40) if i != 7] + [("W2", "Work 2"), ("1", "One"), (None, "none")], "id string, title string")
    known = {w["id"]: w.asDict() for w in works.collect()}
    found = variants.resolved(cache, works)
    expected = [r | {"references": [known.get(e, e) if isinstance(e, str) else e for e in r["references"]]} for r in lines]
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(json.loads(r["j"]) for r in found.selectExpr("to_json(record) AS j").collect()) == order(expected)
    noted = variants.entries(cache.selectExpr("*", "try_variant_get(record, '$.item_key', 'string') AS again"), more="i:int")
    assert noted.columns == ["item_key", "again", "ref_pos", "id", "bare", "title", "year", "citedBy", "i", "entry"]
    assert sorted(r["i"] for r in noted.filter("i IS NOT NULL").collect()) == [e["i"] for e in long if isinstance(e, dict)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("parseJson") == 2  # the ids and the records; no line for a filter
    assert plan(noted).count("parseJson") == 1


def _plain(nodes, parent):
    own = sorted(((i, n) for i, p, n in nodes if p == parent), key=lambda x: ((x[1] or "").lower(), x[0]))
    return [{"id": i, "name": n or "", "children": _plain(nodes, i)} for i, n in own]


def test_nested_listing(spark):
    random.seed(4)
    names = ["b", "B", "a", None, 'q"x}', "é", ""]
    nodes = [(i, None if i < 2 else random.randrange(i), random.choice(names)) for i in range(30)]
    frame = spark.createDataFrame([*nodes, (90, 91, "cycle"), (91, 90, "cycle")], "id bigint, parent bigint, name string")
    found = {r["id"]: json.loads(r["tree"]) for r in tree.nested(frame).collect()}
    assert found == {t["id"]: t for t in _plain(nodes, None)}
    assert tree.nested(frame.limit(0)).count() == 0
