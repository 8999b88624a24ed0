"""Incremental records: a stream of fetched records kept as the latest row of each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.citations import is_mapped


def newest(rows: DataFrame, key: str = "item_key", order: str = "fetchedAt") -> DataFrame:
    """The newest row of each key; a map-side aggregate, so a key with many versions stays small."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def todo(selection: DataFrame, records: DataFrame) -> DataFrame:
    """What is still to fetch: everything selected without a mapped record; misses are tried again."""
    return selection.join(records.filter(is_mapped()).select("item_key"), "item_key", "left_anti")


def citers_todo(selection: DataFrame, records: DataFrame) -> DataFrame:
    """Items whose list of citing works is missing or empty."""
    done = records.filter(is_mapped() & (F.coalesce(F.size("citingWorks"), F.lit(0)) > 0)).select("item_key")
    return selection.join(done, "item_key", "left_anti")


def pending_references(records: DataFrame) -> DataFrame:
    """Distinct ids of references that carry nothing but their id."""
    entry = records.select(F.explode("references").alias("e")).filter("e.id IS NOT NULL AND e.title IS NULL AND e.date IS NULL AND e.year IS NULL")
    return entry.select(F.col("e.id").alias("id")).distinct()


#: Parts of the kept state by key; only those that a batch touches are written again.
BUCKETS = 64


def _parts(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """The versions of each bucket, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for version in fs.listStatus(root) if fs.exists(root) else []:
        for bucket in fs.listStatus(version.getPath()):
            if bucket.getPath().getName().startswith("bucket="):
                out.setdefault(int(bucket.getPath().getName()[7:]), []).append(int(version.getPath().getName()[2:]))
    return {b: sorted(v) for b, v in out.items()}


def current(spark: SparkSession, schema: str, state: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The latest records as of a batch (by default the last), of some buckets or all."""
    paths = []
    for bucket, versions in _parts(spark, state).items():
        known = [v for v in versions if upto is None or v <= upto]
        if known and (buckets is None or bucket in buckets):
            paths.append(f"{state}/v={known[-1]}/bucket={bucket}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def follow(spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, key: str = "item_key", buckets: int = BUCKETS, keep: int = 2):
    """Starts a query that reads new record files and keeps the latest record of each item.

    A batch writes state/v=<batch>/bucket=<b> for the buckets of its keys; the rest stays where it is. A
    batch that runs again after a failure overwrites its own version only, so results don't depend on
    restarts. Of each bucket the last `keep` versions stay. then(records, batch) can re-assemble a map.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
        rows = batch.unionByName(current(spark, schema, state, number - 1, touched)) if number else batch
        newest(rows, key).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/v={number}")
        for b, versions in _parts(spark, state).items():
            for old in [v for v in versions if v <= number][:-keep]:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/v={old}/bucket={b}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if then:
            then(current(spark, schema, state, number), number)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_jobs(events: DataFrame) -> DataFrame:
    """A streaming frame of events(doc_id, job_id, status, ts) as the latest job of each document (update mode).

    The state is one row for each document, for as long as the query runs: a document's latest job has no end.
    """
    return events.groupBy("doc_id").agg(F.max_by(F.struct("job_id", "status", "ts"), F.struct("ts", "job_id")).alias("j"))
