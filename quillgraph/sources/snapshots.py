"""Snapshots of several tables: a version is one manifest that names every table's files.

Tables are written beside the versions there are, then a manifest with the next number is created, which
fails if another writer was first; so a reader sees all tables of one version or of another, never a
mixture, and old versions stay readable until they are dropped. Creating a file that must not exist yet is
atomic on file systems and HDFS; an object store needs a client that offers conditional puts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import StaleWriter


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, in order."""
    fs, folder = _fs(spark, f"{root}/manifests")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/manifests/{version}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], live: list[str] | None = None, expected: int | None = None) -> int:
    """Writes a version after `expected` (by default the last) and returns its number.

    Tables that the last version has and `tables` hasn't go on as they are. live: the paths that the tables
    were made from; their newest time, taken before anything is read, tells later whether the version is fresh.
    Raises StaleWriter if there is another version by then.
    """
    known = versions(spark, root)
    last = known[-1] if known else -1
    expected = last if expected is None else expected
    if expected != last:
        raise StaleWriter(f"{root} is at version {last}, not {expected}")
    before = _manifest(spark, root, last) if known else {"tables": {}, "newest": None}
    newest = live_time(spark, live) if live is not None else before["newest"]
    paths = dict(before["tables"])
    for name, rows in tables.items():
        paths[name] = f"{root}/tables/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(paths[name])
    fs, at = _fs(spark, f"{root}/manifests/{expected + 1}.json")
    try:
        out = fs.create(at, False)
    except Exception as e:  # the file is there: another writer was first
        raise StaleWriter(f"{root} has a version {expected + 1} already") from e
    out.write(bytearray(json.dumps({"tables": paths, "newest": newest}).encode()))
    out.close()
    return expected + 1


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version, by default the last."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"{root} has no version")
    tables = _manifest(spark, root, known[-1] if version is None else version)["tables"]
    return {name: spark.read.parquet(path) for name, path in tables.items()}


def live_time(spark: SparkSession, live: list[str]) -> int | None:
    """The newest change of the paths that exist (a database and its side files), None if none does."""
    times = []
    for path in live:
        fs, at = _fs(spark, path)
        if fs.exists(at):
            times.append(fs.getFileStatus(at).getModificationTime())
    return max(times, default=None)


def state(spark: SparkSession, root: str, live: list[str]) -> str:
    """`fresh`, `outdated` (the source has changed since), `stale` (the source is gone, what was read of it is served), or `missing`."""
    known, now = versions(spark, root), live_time(spark, live)
    if not known:
        return "missing"
    if now is None:
        return "stale"
    taken = _manifest(spark, root, known[-1])["newest"]
    return "fresh" if taken is not None and taken >= now else "outdated"


def refreshed(spark: SparkSession, root: str, load: Callable[[], dict[str, DataFrame]], live: list[str], force: bool = False) -> tuple[dict[str, DataFrame], bool]:
    """(tables, stale): the last version, made anew from load() if the source has changed; stale if the source is gone. Without source and version an error."""
    how = state(spark, root, live)
    if how == "missing" and live_time(spark, live) is None:
        raise FileNotFoundError("neither the source nor a version of it is there")
    if how in ("missing", "outdated") or force and how == "fresh":
        commit(spark, root, load(), live)
    return read(spark, root), how == "stale"


def derived(spark: SparkSession, root: str, name: str, compute: Callable[[dict[str, DataFrame]], DataFrame], version: int | None = None) -> DataFrame:
    """What compute() makes of a version's tables, computed once for each version and kept beside it."""
    version = versions(spark, root)[-1] if version is None else version
    fs, at = _fs(spark, f"{root}/derived/{name}/v={version}")
    if not fs.exists(at):
        aside = f"{root}/derived/{name}/.tmp-{uuid.uuid4().hex}"
        compute(read(spark, root, version)).write.parquet(aside)
        if not fs.rename(_fs(spark, aside)[1], at):  # somebody else has made it meanwhile
            fs.delete(_fs(spark, aside)[1], True)
    return spark.read.parquet(at.toString())


def prune(spark: SparkSession, root: str, name: str, live: DataFrame, key: str = "item_key") -> tuple[int, int]:
    """(version, pruned): a version in which a table has only rows of live(key).

    Nothing is written if live is empty, which rather means an unreadable library, or if no row is an
    orphan. Raises StaleWriter if another version is committed meanwhile.
    """
    last = versions(spark, root)[-1]
    rows, keys = read(spark, root, last)[name], live.select(key).distinct()
    if keys.isEmpty():
        return last, 0
    gone = rows.join(keys, key, "left_anti").count()
    if not gone:
        return last, 0
    return commit(spark, root, {name: rows.join(keys, key, "left_semi")}, expected=last), gone


def keep_last(spark: SparkSession, root: str, count: int) -> None:
    """Drops all but the last versions, the tables that only those had, and what was derived from them."""
    known = versions(spark, root)
    kept = {path for v in known[-count:] for path in _manifest(spark, root, v)["tables"].values()}
    for v in known[:-count]:
        paths = set(_manifest(spark, root, v)["tables"].values()) - kept
        fs, at = _fs(spark, f"{root}/manifests/{v}.json")
        fs.delete(at, False)  # first, so that no reader finds half a version
        for path in paths:
            fs.delete(_fs(spark, path)[1], True)
    fs, folder = _fs(spark, f"{root}/derived")
    for name in fs.listStatus(folder) if fs.exists(folder) else []:
        for v in fs.listStatus(name.getPath()):
            if v.getPath().getName().startswith("v=") and int(v.getPath().getName()[2:]) in known[:-count]:
                fs.delete(v.getPath(), True)
