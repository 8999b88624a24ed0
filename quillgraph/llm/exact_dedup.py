"""Operator 10, exact dedup: a log-structured merge index of text digests. DataFrame functions only.

Every task cuts its rows into memtables of at most `memtable` rows. The n-th memtables of all tasks
are flushed together as a run: one entry for each digest, in order, with the extreme identifier and
the number of rows, and with a Bloom filter in its Parquet files. When a level holds `fanin` runs
these are merged into one run of the next level, which again keeps the extreme identifier. A few
runs are left, and each gets a filter of bits.

An entry is looked up in the other runs by their filters first: what no other run may hold is
settled, only the rest is read together. Digests of several rows are hits; a filter of them picks the
rows whose bytes are verified: the least and the greatest text of a digest must be the same text.
Should two texts ever share a digest, these are grouped by their whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, new_folder, remove_at_exit, remove_folder, saved, semi_by_id, table

#: Rows of a memtable; runs that one add() flushes at most (a task's later memtables go to the first
#: runs again); runs of a level that are merged into one.
MEMTABLE_ROWS, FLUSHED_RUNS, FANIN = 16_384, 16, 8
#: Bits of a filter for each entry, bits that all filters together have at most (so that they can be
#: broadcast: 32 MB; beyond that they only let more through), and bits of one row of a filter.
BITS, MOST_BITS, ROW_BITS = 32, 1 << 28, 1 << 15
#: Hits up to which they are broadcast to the rows (some 100 bytes each).
FEW_HITS = 200_000


class Filters:
    """Filters of named sets of digests, as rows of bits; small by MOST_BITS."""

    def __init__(self, entries: DataFrame, name: str = "run"):
        """entries(digest, name): each set's digests."""
        sets = entries.groupBy(name).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
        rows = max(1, min(MOST_BITS // max(1, sets[0]), BITS * (sets[1] or 0)) // ROW_BITS)
        self.place = F.pmod(F.xxhash64("digest"), F.lit(rows * ROW_BITS))
        place = entries.select(name, self.place.alias("__at")).select(name, F.floor(F.col("__at") / ROW_BITS).alias("__row"), (F.col("__at") % ROW_BITS).alias("__bit"))
        bits = place.groupBy(name, "__row").agg(F.bitmap_construct_agg("__bit").alias("bits"))
        self.table = saved(bits.groupBy("__row").agg(F.collect_list(F.struct(F.col(name).alias("set"), "bits")).alias("__sets")))

    def probe(self, rows: DataFrame, other_than: Column | None = None) -> DataFrame:
        """rows(digest, ...) with maybe: whether a set (other than the row's own) may hold the digest."""
        at = rows.withColumn("__at", self.place).withColumn("__row", F.floor(F.col("__at") / ROW_BITS)).withColumn("__own", F.lit(None).cast("int") if other_than is None else other_than)
        byte, bit = F.floor((F.col("__at") % ROW_BITS) / 8).cast("int"), (F.col("__at") % 8).cast("int")

        def has(one: Column) -> Column:
            value = F.conv(F.hex(F.substring(one["bits"], byte + 1, F.lit(1))), 16, 10).cast("int")
            return (F.call_function("shiftright", value, bit).bitwiseAND(1) == 1) & ~one["set"].eqNullSafe(F.col("__own"))

        joined = at.join(F.broadcast(self.table), "__row", "left")
        return joined.withColumn("maybe", F.coalesce(F.exists("__sets", has), F.lit(False))).drop("__at", "__row", "__own", "__sets")


class DigestIndex:
    """Levels of runs in the shared folder. Entries: digest, id, rows."""

    def __init__(self, spark: SparkSession, keep: str = "min", memtable: int = MEMTABLE_ROWS, fanin: int = FANIN):
        if keep not in ("min", "max"):
            raise ValueError("keep: min or max")
        self.spark, self.pick, self.memtable, self.fanin = spark, F.min if keep == "min" else F.max, memtable, fanin
        self.levels: list[list[str]] = [[]]
        self.kinds = ""  # the schema of entries

    def _write(self, runs: DataFrame, level: int) -> None:
        """Writes runs(digest, id, rows, run) to a level: a folder for each run, sorted by digest."""
        root = new_folder(self.spark)
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable)}
        runs.sortWithinPartitions("run", "digest").write.options(**options).partitionBy("run").parquet(root)
        remove_at_exit(self.spark, root)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        folders = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level] += sorted(f.getPath().toString() for f in folders if f.getPath().getName().startswith("run="))
        self.kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name != "run")

    def _merged(self, entries: DataFrame, *by: str) -> DataFrame:
        return entries.groupBy(*by, "digest").agg(self.pick("id").alias("id"), F.sum("rows").alias("rows"))

    def _read(self, runs: list[str], group: int) -> DataFrame:
        """Entries of runs with the number of their run, or of the group of so many runs."""
        parts = [self.spark.read.schema(self.kinds).parquet(*runs[i : i + group]).withColumn("run", F.lit(i // group)) for i in range(0, len(runs), group)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def add(self, rows: DataFrame) -> None:
        """Flushes rows(digest, id). The number of runs depends on a task's rows, not on the table's."""
        within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        numbered = rows.select("digest", "id", F.lit(1).cast("bigint").alias("rows"), (F.floor(within / self.memtable) % FLUSHED_RUNS).cast("int").alias("run"))
        self._write(self._merged(numbered, "run"), 0)
        self.compact()

    def compact(self) -> None:
        """Merges the runs of every level that holds fanin or more; one job for all merges of a level."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanin:
                self.levels[level] = []
                self._write(self._merged(self._read(runs, self.fanin), "run"), level + 1)
                for path in runs:
                    remove_folder(self.spark, path)
            level += 1

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def hits(self) -> DataFrame:
        """digest, keep_id, group_size of all digests that stand in more than one row."""
        entries = self._read(self.runs, 1)
        if len(self.runs) > 1:
            probed = Filters(entries).probe(entries, F.col("run"))
            entries = probed.filter("NOT maybe").select("digest", "id", "rows").unionByName(self._merged(probed.filter("maybe")))
        return entries.filter("rows > 1").select("digest", F.col("id").alias("keep_id"), F.col("rows").alias("group_size"))


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "min", memtable: int = MEMTABLE_ROWS, fanin: int = FANIN) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, and texts
    of any length count whole. Of equal texts the row with the smallest (keep="max": largest) key
    stays. A repeated row counts in group_size and is kept with its twin, for it is the same row. A
    row without a key is kept only if no row with a key has its text; keep_id is then null. An empty
    table gives no rows; other columns don't matter.
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = saved(docs.select(F.col(key).alias("id"), _digest(norm).alias("digest")))
    index = DigestIndex(docs.sparkSession, keep, memtable, fanin)
    index.add(rows)
    alone = rows.select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    if not index.runs:
        return _result(alone, key)
    hits = saved(index.hits())
    filters = Filters(hits.select("digest", F.lit(0).alias("run")))

    # byte verification: of the texts only those of hits (and what the filter lets through) are shuffled
    texts = docs.select(F.col(key).alias("id"), norm.alias("norm")).withColumn("digest", _digest(F.col("norm")))
    probed = filters.probe(texts).filter("maybe").drop("maybe")
    clashing = saved(probed.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest"))

    looked_up = filters.probe(rows)
    few = hits.limit(FEW_HITS + 1).count() <= FEW_HITS
    found = looked_up.filter("maybe").join(F.broadcast(hits) if few else hits, "digest", "left")
    found = found.select("digest", "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"))
    out = looked_up.filter("NOT maybe").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")).unionByName(found)
    if not clashing.isEmpty():
        mixed = probed.join(clashing, "digest", "left_semi")
        by_text = mixed.groupBy("digest", "norm").agg(index.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = mixed.join(by_text, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size")
        out = out.join(clashing, "digest", "left_anti").unionByName(apart)
    return _result(out, key)


def _result(out: DataFrame, key: str) -> DataFrame:
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts one row, by exact_groups(); rows without a key all stay.

    Rows are told apart by key and digest, so that another text of the same key isn't touched; of
    several rows with one key and text, the one with the least columns stays.
    """
    groups = saved(exact_groups(docs, text, key, keep).select(F.col(key).alias("__key"), "kept", F.unhex("text_sha256").alias("__digest")).filter("__key IS NOT NULL"))
    rows = docs.withColumn("__key", F.col(key)).withColumn("__digest", _digest(ascii_lower(F.coalesce(F.col(text), F.lit("")))))
    both = ["__key", "__digest"]
    out = semi_by_id(rows, groups.filter("NOT kept"), both, "left_anti", FEW_HITS)
    twins = saved(groups.filter("kept").groupBy(*both).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*both))
    if not twins.isEmpty():
        one = semi_by_id(out, twins, both, most=FEW_HITS).groupBy(*both).agg(F.min(F.struct(*docs.columns)).alias("row"))
        out = semi_by_id(out, twins, both, "left_anti", FEW_HITS).select(docs.columns).unionByName(one.select("row.*"))
    return out.select(docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
