"""Reading library extracts, citation caches, job logs; writing versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("citedBy", T.LongType())]
)
#: Entries are kept as text first: an entry is either an object or a bare id.
RECORD = "struct<doi:string,openalexId:string,year:string,date:string,citedBy:bigint,`references`:array<string>,citingWorks:array<string>,status:string,fetchedAt:double,v:int>"
JOB = "id string, status string, stage string, progress int, detail string, error string, kind string, title string, docId string, durationMin double, faithfulness string, result string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sqlite_table(spark: SparkSession, path: str, name: str, driver: str = "org.sqlite.JDBC") -> DataFrame:
    """A table of a SQLite snapshot; needs that JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=f"jdbc:sqlite:file:{path}?mode=ro&immutable=1", dbtable=name, driver=driver).load()


def as_entry(raw: Column) -> Column:
    """A reference entry as a struct: objects are parsed, bare ids give a struct with only the id."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, ENTRY)).otherwise(F.struct(raw.alias("id"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY.fields[1:])))


def citation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON cache {item_key: record}; a file that can't be parsed gives none.

    Such a file is one value and so one row of one task; caches of any size are read by citation_lines().
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{RECORD}>").alias("m"))
    return _records(whole.select(F.explode("m").alias("item_key", "r")))


def citation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a cache with one {"item_key": ..., record} a line, read in as many tasks as the files give; bad lines are left out."""
    lines = spark.read.text(path).select(F.from_json("value", f"struct<item_key:string,{RECORD[7:-1]}>").alias("r"))
    return _records(lines.filter("r.item_key IS NOT NULL").select(F.col("r.item_key").alias("item_key"), "r"))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(
        "item_key",
        F.col("r.doi").alias("doi"),
        F.col("r.openalexId").alias("openalexId"),
        F.col("r.year").alias("year"),
        F.col("r.date").alias("date"),
        F.col("r.citedBy").alias("cited_by"),
        F.transform(F.coalesce("r.references", F.array().cast("array<string>")), as_entry).alias("references"),
        F.transform(F.coalesce("r.citingWorks", F.array().cast("array<string>")), as_entry).alias("citingWorks"),
        F.col("r.status").alias("status"),
        F.col("r.fetchedAt").alias("fetchedAt"),
        F.col("r.v").alias("v"),
    )


def job_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each job file that can be read, with the file's time and path."""
    rows = spark.read.schema(JOB).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.select(F.col("id").alias("job_id"), F.col("docId").alias("doc_id"), "*", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_path").alias("path")).drop("id", "docId")


class StaleWriter(RuntimeError):
    """Another version was committed, or the store was reset, since this writer read it."""


def _versions(spark: SparkSession, root: str):
    """The file system, the folder, and the numbers of complete versions."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, folder, sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def latest_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version, -1 without any."""
    return max(_versions(spark, root)[2], default=-1)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A version, by default the newest. Readers of older ones aren't disturbed by later writes."""
    return spark.read.parquet(f"{root}/v={latest_version(spark, root) if number is None else number}")


def commit_version(rows: DataFrame, root: str, expected: int) -> int:
    """Writes rows as the version after `expected`; raises StaleWriter if that isn't the newest any more.

    Rows are written aside and renamed, so that a version is there as a whole or not at all, and of two
    writers with one expectation only one gets through.
    """
    spark = rows.sparkSession
    aside = f"{root}/.tmp-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    fs, folder, known = _versions(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if max(known, default=-1) != expected or not fs.rename(path(aside), path(f"{root}/v={expected + 1}")):
        fs.delete(path(aside), True)
        raise StaleWriter(f"{root} is at version {max(known, default=-1)}, not {expected}")
    return expected + 1


def reset_versions(spark: SparkSession, root: str, empty: DataFrame) -> int:
    """Replaces what is there by an empty version; writers that read an older one are stale. Older versions go."""
    fs, folder, known = _versions(spark, root)
    number = commit_version(empty, root, max(known, default=-1))
    for old in known:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={old}"), True)
    return number


def upsert_version(root: str, changes: DataFrame, key: str, expected: int) -> int:
    """A new version in which changes replace rows of the same key. expected: the version that the changes were made for."""
    spark = changes.sparkSession
    if latest_version(spark, root) != expected:
        raise StaleWriter(f"{root} isn't at version {expected}")
    current = read_version(spark, root, expected)
    kept = current.join(changes.select(key).distinct(), key, "left_anti")
    return commit_version(kept.unionByName(changes, allowMissingColumns=True), root, expected)


def is_fresh(spark: SparkSession, root: str, live: str) -> bool:
    """Whether the newest version is at least as new as the live file; without a live file, whether there is a version."""
    fs, folder, known = _versions(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(live)
    if not known:
        return False
    live_fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={known[-1]}")
    return not live_fs.exists(path) or fs.getFileStatus(newest).getModificationTime() >= live_fs.getFileStatus(path).getModificationTime()
