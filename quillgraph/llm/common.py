"""Shared plumbing of the training-data operators: tables, shared scratch space, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that the vectorised code handles at once; it bounds the size of its arrays.
SLICE_BYTES = 1 << 20

#: Largest number of integer ids that is ever broadcast (16 bytes each at most, so 16 MB).
BROADCAST_IDS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space as the word contracts define it.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers, which needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="quillgraph-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def release_memory() -> None:
    """Gives a finished task's memory back: Python workers live on, and so would tables in reference cycles."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with this library on the workers, which free a task's memory at its end."""
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(released, schema)


#: Folders that the open scratch() blocks will remove, the innermost last.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, outlives: bool = False) -> str:
    """A new folder in the shared one. It goes with the innermost scratch() block (outlives: with the one around that)."""
    path = f"{shared_dir(spark)}/quillgraph-{uuid.uuid4().hex}"
    depth = len(_scratch) - 1 - outlives
    if depth >= 0:
        _scratch[depth].append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """What a lazy result still reads can go only with the application."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every table that was saved within it."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove_folder(spark, path)


def saved(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_folder(spark, outlives)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes tables that saved() wrote and that no later plan reads."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("quillgraph-"):
                remove_folder(spark, folder.toString())


def portions(batch: pa.RecordBatch, column: int, rows: int = 256, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and bytes of a text column; a longer text is a part of its own."""
    _, offs = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = max(i + 1, min(j, i + rows))
        yield batch.slice(i, j - i)
        i = j


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """rows whose key is (not) in ids(key). ids are broadcast only when counted and few; else both sides shuffle."""
    ids = ids.select(key).distinct()
    small = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if small else ids, key, how)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as the empty text, without copying what needn't be."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def slices(data: np.ndarray, offs: np.ndarray, cut: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Splits texts into runs of about limit bytes: (row numbers, bytes, offsets, place in data).

    A text above the limit is cut behind a byte that is True in cut (a table of 256), so that no
    word is divided; its parts come in order under the same row number. A text without such a byte
    stays whole.
    """
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        if j > i:
            yield np.arange(i, j), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], int(offs[i])
            i = j
            continue
        at, end = int(offs[i]), int(offs[i + 1])
        while at < end:
            stop = min(at + limit, end)
            if stop < end:
                back = np.flatnonzero(cut[data[at:stop]])
                if len(back):
                    stop = at + int(back[-1]) + 1
                else:
                    ahead = np.flatnonzero(cut[data[stop:end]])
                    stop = stop + int(ahead[0]) + 1 if len(ahead) else end
            yield np.array([i]), data[at:stop], np.array([0, stop - at]), at
            at = stop
        i += 1
