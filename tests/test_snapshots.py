"""Several tables under one manifest."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import snapshots
from quillgraph.sources.tables import StaleWriter


def test_readers_see_one_version(spark, tmp_path):
    root, live = str(tmp_path / "s"), tmp_path / "db"
    with pytest.raises(FileNotFoundError):
        snapshots.refreshed(spark, root, dict, [str(live)])
    live.write_text("1")
    side = tmp_path / "db-wal"
    calls = []

    def load():
        calls.append(1)
        n = len(calls)
        return {"a": spark.range(n), "b": spark.range(n).withColumn("x", F.lit(n))}

    paths = [str(live), str(side)]
    tables, stale = snapshots.refreshed(spark, root, load, paths)
    assert not stale and tables["a"].count() == tables["b"].count() == 1 and snapshots.state(spark, root, paths) == "fresh"
    snapshots.refreshed(spark, root, load, paths)
    assert len(calls) == 1  # nothing has changed
    side.write_text("2")  # a side file counts too
    os.utime(side, (2_000_000_000, 2_000_000_000))
    assert snapshots.state(spark, root, paths) == "outdated"
    newer, _ = snapshots.refreshed(spark, root, load, paths)
    assert newer["a"].count() == newer["b"].count() == 2 and tables["a"].count() == tables["b"].count() == 1
    snapshots.refreshed(spark, root, load, paths, force=True)
    assert snapshots.versions(spark, root) == [0, 1, 2]
    live.unlink()
    side.unlink()
    served, stale = snapshots.refreshed(spark, root, load, paths)
    assert stale and served["b"].first()["x"] == 3 and len(calls) == 3


def test_stale_writers_and_tables_that_stay(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.commit(spark, root, {"a": spark.range(2), "b": spark.range(5)}) == 0
    assert snapshots.commit(spark, root, {"a": spark.range(3)}, expected=0) == 1
    assert {n: t.count() for n, t in snapshots.read(spark, root).items()} == {"a": 3, "b": 5}
    with pytest.raises(StaleWriter):
        snapshots.commit(spark, root, {"a": spark.range(9)}, expected=0)
    # a writer that comes between the look and the manifest
    (tmp_path / "s" / "manifests" / "2.json").write_text("{}")
    snapshots.versions, real = lambda *_: [0, 1], snapshots.versions
    try:
        with pytest.raises(StaleWriter):
            snapshots.commit(spark, root, {"a": spark.range(9)})
    finally:
        snapshots.versions = real


def test_derived_results_are_computed_once(spark, tmp_path):
    root, calls = str(tmp_path / "s"), []
    snapshots.commit(spark, root, {"a": spark.range(2)})
    total = lambda tables: (calls.append(1), tables["a"].agg(F.count(F.lit(1)).alias("n")))[1]
    assert [snapshots.derived(spark, root, "t", total).first()["n"] for _ in range(2)] == [2, 2] and len(calls) == 1
    snapshots.commit(spark, root, {"a": spark.range(7)})
    assert snapshots.derived(spark, root, "t", total).first()["n"] == 7 and snapshots.derived(spark, root, "t", total, 0).first()["n"] == 2 and len(calls) == 2
    snapshots.keep_last(spark, root, 1)
    assert snapshots.versions(spark, root) == [1] and len(list((tmp_path / "s" / "tables" / "a").iterdir())) == 1 and [p.name for p in (tmp_path / "s" / "derived" / "t").glob("v=*")] == ["v=1"]


def test_prune_is_guarded(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshots.commit(spark, root, {"r": spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "item_key string, n int"), "other": spark.range(4)})
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "item_key string")
    assert snapshots.prune(spark, root, "r", keys()) == (0, 0) and snapshots.prune(spark, root, "r", keys("a", "a", "z")) == (1, 2)
    assert [r["n"] for r in snapshots.read(spark, root)["r"].collect()] == [1] and snapshots.read(spark, root)["other"].count() == 4
    assert snapshots.prune(spark, root, "r", keys("a")) == (1, 0)
