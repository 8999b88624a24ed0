"""Subtrees by intervals against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import intervals, tree


def _plain(nodes, members):
    """Ancestors of each node by walking up; distinct items of each subtree."""
    up = {i: p if p in dict(nodes) else None for i, p in nodes}
    above = {}
    for i in up:
        seen = []
        while i is not None and i not in seen:
            seen.append(i)
            i = up[i]
        above[seen[0]] = seen
    items = {i: set() for i in up}
    for i, item in members:
        for a in above.get(i, []):
            items[a].add(item)
    return up, above, {i: len(s) for i, s in items.items()}


def _forest(seed):
    random.seed(seed)
    n = 60
    nodes = [(i, None if i == 0 or random.random() < 0.06 else random.choice([i - 1, random.randrange(i), random.randrange(max(0, i - 4), i)])) for i in range(n)]
    if seed % 2:  # a cycle, something below it and leading into it, a parent that isn't there, a self-parent
        nodes += [(100, 102), (101, 100), (102, 101), (103, 101), (104, 103), (105, 999), (106, 106), (107, 106)]
    random.shuffle(nodes)
    members = [(random.choice(nodes)[0], random.choice(["x", "y", "z", "often"])) for _ in range(90)] + [(i, "all") for i, _ in nodes] + [(5000, "lost")]
    return nodes, members


@pytest.mark.parametrize("seed,rounds", [(1, 5), (3, 0)])
def test_subtrees_equal_recursion(spark, monkeypatch, seed, rounds):
    # once by arrays of ancestors, once by intervals
    monkeypatch.setattr(tree, "SHALLOW", rounds)
    monkeypatch.setattr(intervals, "BLOCK", 8)
    nodes, members = _forest(seed)
    up, above, counts = _plain(nodes, members)
    frame, placed = spark.createDataFrame(nodes, "id bigint, parent bigint"), spark.createDataFrame(members, "id bigint, item_key string")
    assert {r["id"]: r["item_count"] for r in tree.subtree_item_counts(frame, placed).collect()} == counts
    asked = spark.createDataFrame([(i,) for i in (0, 7, 100, 103, 106, 4242)], "id bigint")
    wanted = {(s, i) for i, path in above.items() for s in path if s in (0, 7, 100, 103, 106)} | {(4242, 4242), *((s, s) for s in (0, 7, 100, 103, 106))}
    assert {(r["start"], r["id"]) for r in tree.descendants(frame, asked).collect()} == wanted
    spans = {r["id"]: r for r in intervals.intervals(frame).collect()}
    cyclic = {i for i, path in above.items() if up[path[-1]] is not None}
    assert set(spans) == set(up) - cyclic and sorted(r["enter"] for r in spans.values()) == list(range(len(spans)))
    for i, r in spans.items():
        below = {j for j, path in above.items() if i in path}
        assert r["size"] == len(below) and r["depth"] == len(above[i]) - 1 and {spans[j]["enter"] for j in below} == set(range(r["enter"], r["enter"] + r["size"]))


def test_common_ancestors(spark):
    nodes, _ = _forest(6)
    _, above, _ = _plain(nodes, [])
    spans = intervals.intervals(spark.createDataFrame(nodes, "id bigint, parent bigint"))
    enter = {r["id"]: r["enter"] for r in spans.collect()}
    pairs = [(i, j) for i in enter for j in enter if enter[i] <= enter[j] and above[i][-1] == above[j][-1]]
    wanted = {}
    for i, j in pairs:
        low = enter[next(a for a in above[i] if a in above[j])]
        wanted[low] = wanted.get(low, 0) + 1
    found = intervals.common_ancestors(spans, spark.createDataFrame([(enter[i], enter[j], 1) for i, j in pairs], "a bigint, b bigint, n bigint"))
    assert {r["enter"]: r["n"] for r in found.collect()} == wanted


@pytest.mark.parametrize("small", [0, 100])
def test_range_minima(spark, monkeypatch, small):
    # blocks of three in four levels, shuffled or broadcast
    monkeypatch.setattr(intervals, "SPAN", 3)
    monkeypatch.setattr(intervals, "SMALL_BLOCKS", small)
    random.seed(small)
    v = [random.randrange(1000) for _ in range(50)]
    wanted = {(i, j): min(v[i : j + 1], default=None) for i in range(50) for j in range(i - 1, 50, 1 + i % 3)}
    found = intervals.range_minima(spark.createDataFrame(list(enumerate(v)), "place bigint, v bigint"), spark.createDataFrame(list(wanted), "first bigint, last bigint"))
    assert {(r["first"], r["last"]): r["least"] for r in found.collect()} == wanted


def test_many_memberships_of_a_shallow_tree_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(tree, "COUNTED_ROWS", 10)
    asked = []
    monkeypatch.setattr(tree, "distinct_in_subtrees", lambda *a: asked.append(a) or intervals.distinct_in_subtrees(*a))
    nodes, members = _forest(3)
    found = tree.subtree_item_counts(spark.createDataFrame(nodes, "id bigint, parent bigint"), spark.createDataFrame(members, "id bigint, item_key string"))
    assert {r["id"]: r["item_count"] for r in found.collect()} == _plain(nodes, members)[2] and asked


def test_nested_needs_no_paths(spark, monkeypatch):
    monkeypatch.setattr(tree, "_climb", None)
    nodes = [(1, None, "a"), (2, 1, "c"), (3, 1, "B"), (4, 3, "d"), (5, 6, "x"), (6, 5, "y"), (7, 6, "z"), (8, 8, "s"), (9, 77, "e")]
    found = {r["id"]: r["tree"] for r in tree.nested(spark.createDataFrame(nodes, "id bigint, parent bigint, name string")).collect()}
    one = lambda i, n, *inner: f'{{"id":{i},"name":"{n}","children":[{",".join(inner)}]}}'
    assert found == {1: one(1, "a", one(3, "B", one(4, "d")), one(2, "c")), 9: one(9, "e")}


def test_long_chain(spark):
    n = 20_000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    members = spark.range(n).select("id", (F.col("id") % 10).cast("string").alias("item_key"))
    found = {r["id"]: r["item_count"] for r in tree.subtree_item_counts(nodes, members).collect()}
    assert found == {i: min(10, n - i) for i in range(n)}


def test_empty_forest(spark):
    none = spark.createDataFrame([], "id bigint, parent bigint")
    assert tree.subtree_item_counts(none, spark.createDataFrame([], "id bigint, item_key string")).count() == 0
    assert intervals.intervals(none).count() == 0
