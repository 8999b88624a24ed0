"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted, narrow table is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; a temporary folder only in local mode where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_store(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/quillgraph-store-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)  # only what exists can be marked
    fs.deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and nothing is computed twice. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def written_in_two(df: DataFrame, flag: Column) -> tuple[DataFrame | None, DataFrame | None]:
    """df as written tables of the rows whose flag is true and of the others, by one job; None for one without rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-table-{uuid.uuid4().hex}"
    df.withColumn("__flag", flag).write.partitionBy("__flag").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(folder)
    parts = [f"{path}/__flag={value}" for value in ("true", "false")]
    return tuple(spark.read.schema(df.schema).parquet(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) else None for p in parts)


def dropped(*frames: DataFrame) -> None:
    """Removes written() tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder = folder.getParent() if folder.getName().startswith("__flag=") else folder
            if folder.getName().startswith("quillgraph-table-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame) -> DataFrame:
    """A broadcast hint for a written table that was counted and is small; beyond that, none."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bytes that a task reads of a shuffle within dealt(), and twice as many of files; narrow rows are several times as large in memory.
TASK_BYTES = 8 << 20


@contextmanager
def dealt(spark: SparkSession, tasks: float) -> Iterator[None]:
    """What is written inside is shuffled over at least so many partitions, of bounded size; adaptive execution still joins small ones and splits skewed ones."""
    partitions = max(math.ceil(tasks), int(spark.conf.get("spark.sql.shuffle.partitions")))
    inside = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.files.maxPartitionBytes": 2 * TASK_BYTES}
    kept = {key: spark.conf.get(key, None) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers, which needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillgraph-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
