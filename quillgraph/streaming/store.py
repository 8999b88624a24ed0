"""Rows in buckets of a key, kept as versions: a batch writes only the buckets that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_of(*columns: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class BucketStore:
    """A folder of v=<number>/bucket=<b>. A bucket's rows are those of its last version up to a number.

    A version is written whole before any reader is told of it (see IncrementalMap), and a batch that runs
    again overwrites its own version only. A bucket that a batch leaves empty has an empty folder there.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket, in order."""
        fs, folder = self._fs()
        out: dict[int, list[int]] = {}
        for version in fs.listStatus(folder) if fs.exists(folder) else []:
            for bucket in fs.listStatus(version.getPath()):
                if bucket.getPath().getName().startswith("bucket="):
                    out.setdefault(int(bucket.getPath().getName()[7:]), []).append(int(version.getPath().getName()[2:]))
        return {b: sorted(v) for b, v in out.items()}

    def read(self, upto: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of a number, of some buckets or of all."""
        paths = []
        for bucket, versions in self.versions().items():
            known = [v for v in versions if v <= upto]
            if known and (buckets is None or bucket in buckets):
                paths.append(f"{self.root}/v={known[-1]}/bucket={bucket}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, number: int, touched: list[int]) -> None:
        """The new rows (with a column `bucket`) of the touched buckets."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={number}")
        fs, _ = self._fs()
        for b in touched:
            fs.mkdirs(self._path(f"v={number}/bucket={b}"))

    def trim(self, number: int, keep: int) -> None:
        """Of each bucket, only the last `keep` versions up to a number stay."""
        fs, _ = self._fs()
        for b, versions in self.versions().items():
            for old in [v for v in versions if v <= number][:-keep]:
                fs.delete(self._path(f"v={old}/bucket={b}"), True)
