"""Citation maps that are kept up to date while records arrive, by what each batch adds and takes away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations
from ..storage import written
from .records import newest
from .store import BucketStore, bucket_of

_META = "title string, year int, date string, doi string, cited_by bigint"
_REFERENCES = "array<struct<id:string,title:string,year:int,date:string,doi:string,citedBy:bigint>>"
#: What a record holds; fetchedAt orders the versions of a record.
RECORD = f"item_key string, status string, v int, date string, cited_by bigint, doi string, `references` {_REFERENCES}, citingWorks {_REFERENCES}, fetchedAt timestamp"
_ENTRY = f"item_key string, sel_pos bigint, ref_pos int, id string, {_META}, n bigint"
_PARTIAL = f"id string, occurrences bigint, first struct<sel_pos:bigint,ref_pos:int,meta:struct<{_META.replace(' ', ':').replace(',:', ',')}>>"
#: Buckets of records and of entries; buckets that the entries of one work are spread over.
BUCKETS, SPREAD = 64, 8


class IncrementalMap:
    """The map of a selection(item_key, sel_pos) under a folder, after any number of batches of records.

    Three stores: the latest records by item, the entries of their lists by (work, part of the items), and
    each bucket's share of every work's node. A batch's changed records subtract their old entries and add
    their new ones; buckets of touched works are counted again from their entries (a first mention may be
    gone), all others are neither read nor written. The entries of one work lie in `spread` buckets, so a
    landmark work fills no bucket alone.

    apply() may run again for a batch after a failure: it reads the state before that batch and overwrites
    what the batch wrote. Readers see batches as a whole, up to the last that ended.
    """

    def __init__(self, spark: SparkSession, root: str, selection: DataFrame, column: str = "references", cited_by: bool = False, buckets: int = BUCKETS, spread: int = SPREAD, keep: int = 2):
        self.spark, self.root, self.selection, self.column, self.cited_by = spark, root, selection.select("item_key", "sel_pos"), column, cited_by
        self.buckets, self.spread, self.keep = buckets, spread, keep
        self.records, self.entries, self.partials = (BucketStore(spark, f"{root}/{name}", schema) for name, schema in (("records", RECORD), ("entries", _ENTRY), ("partials", _PARTIAL)))
        #: Buckets that the last batch read and wrote, of records and of entries.
        self.touched: tuple[list[int], list[int]] = ([], [])

    def _marks(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ended")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def last(self) -> int:
        """The number of the last batch that ended, -1 before the first."""
        fs, folder = self._marks()
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=-1) if fs.exists(folder) else -1

    def _listed(self, records: DataFrame) -> DataFrame:
        """The entries of records: what the map counts."""
        rows = citations.entries(records.filter(citations.is_mapped()), self.column).join(self.selection, "item_key")
        e = F.col("entry")
        return rows.select("item_key", "sel_pos", "ref_pos", e["id"].alias("id"), e["title"].alias("title"), e["year"].alias("year"), e["date"].alias("date"), e["doi"].alias("doi"), e["citedBy"].alias("cited_by"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch of records; of several versions of a record the newest counts, also against what is known."""
        by_item = bucket_of("item_key", buckets=self.buckets)
        incoming = written(newest(batch).withColumn("bucket", by_item))
        items = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most `buckets`
        before = self.records.read(number - 1, items)
        merged = written(newest(before.unionByName(incoming.drop("bucket"))))
        self.records.write(merged.withColumn("bucket", by_item), number, items)

        changed = incoming.select("item_key")
        old, new = (self._listed(rows.join(changed, "item_key", "left_semi")) for rows in (before, merged))
        # works are spread by item, so that one work's entries fill several buckets
        part = F.pmod(F.xxhash64("item_key"), F.lit(self.spread))
        by_work = F.pmod(F.xxhash64("id") + part * F.lit(0x9E3779B9), F.lit(self.buckets)).cast("int")
        columns = [c for c in old.columns]
        delta = old.withColumn("n", F.lit(-1)).unionByName(new.withColumn("n", F.lit(1))).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
        delta = written(delta.withColumn("bucket", by_work))
        works = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
        total = self.entries.read(number - 1, works).unionByName(delta.drop("bucket")).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n > 0")
        total = written(total.withColumn("bucket", by_work))
        self.entries.write(total, number, works)
        meta = F.struct("title", "year", "date", "doi", "cited_by")
        shares = total.groupBy("bucket", "id").agg(F.sum("n").alias("occurrences"), F.min(F.struct("sel_pos", "ref_pos", meta.alias("meta"))).alias("first"))
        self.partials.write(shares, number, works)

        fs, folder = self._marks()
        fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(number)))
        for store in (self.records, self.entries, self.partials):
            store.trim(number, self.keep)
        self.touched = (sorted(items), sorted(works))

    def nodes(self, items: DataFrame, paths: DataFrame) -> DataFrame:
        """The nodes as citation_map() gives them for all records so far."""
        upto = self.last()
        met = self.partials.read(upto).groupBy("id").agg(F.sum("occurrences").alias("occurrences"), F.min("first").alias("first"))
        return citations.owned_nodes(self.selection, self.records.read(upto), items, paths).unionByName(citations.external_rows(met))

    def edges(self) -> DataFrame:
        """The edges, one for each entry."""
        rows = self.entries.read(self.last()).select("item_key", "id", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
        ends = ("id", "item_key") if self.cited_by else ("item_key", "id")
        return rows.select(F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"))

    def coverage(self) -> DataFrame:
        return citations.coverage(self.selection, self.records.read(self.last()))

    def follow(self, folder: str, checkpoint: str, files: int = 1000):
        """Starts a query that takes in new record files of a folder; a restart goes on where the last run stopped."""
        stream = self.spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files).parquet(folder)
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
