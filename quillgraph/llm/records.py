"""Operator 11, token-ID binary output: sequences of token ids in length-delimited binary records.

The data source `framed_sequences` writes and reads a folder of

* `part-*.seq`: records one behind the other, each framed as
  `length (8 bytes) | masked checksum of the length (4) | payload (length bytes) | masked checksum of the payload (4)`.
  A payload is `width of an id in bytes (1) | whether there is a key (1) | 6 zero bytes | key (8) | ids (width bytes each)`.
  Numbers are little-endian. A checksum is a CRC-32, rotated right by 15 bits, plus a constant, as checksums
  of data that hold checksums are masked; a frame that doesn't fit raises an error with its place.
* `part-*.idx`, the offset index: 24 bytes a record, `offset of its frame (8) | ids before it in its file (8) | its ids (8)`.
* `manifest.json`, written when all tasks are done: the files in order, with their records, ids and bytes.

Every task attempt writes files of its own name, and only those of attempts that Spark commits get into
the manifest, so tasks may run again or twice. Readers take ranges of record numbers: in order, or (option
`seed`) in a pseudo-random order of all records, for which each reader asks the index for its records'
places; no Spark shuffle is needed for it.

Files are opened through Arrow's file systems, so the folder may be in any store that these know.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import arrow, new_folder, portions, remove_at_exit, ship, table
from .packing import END_ID, Encoder, tokenizer_path
from .words import mix

FORMAT = "framed_sequences"
#: Bytes of records that one reader takes, about.
SPLIT_BYTES = 32 << 20
#: Records that a reader hands over at once.
BATCH_RECORDS = 256
_MASK_PLUS = 0xA282EAD8
_HEAD, _TAIL, _OWN, _ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BB6xq"), struct.Struct("<qqq")
_BUFFER = 1 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_PLUS) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A payload with its length and checksums."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def payload_of(key: int | None, ids: np.ndarray) -> bytes:
    """The payload of one sequence; ids take two bytes each where all fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return _OWN.pack(width, key is not None, key or 0) + ids.astype(f"<u{width}").tobytes()


def read_frame(data: memoryview, at: int, where: str) -> tuple[memoryview, int]:
    """The payload of the frame at a place of data, and where the next one begins."""
    if at + _HEAD.size > len(data):
        raise ValueError(f"{where}: a frame is cut off")
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"{where}: the length's checksum is wrong")
    begin = at + _HEAD.size
    end = begin + length
    if end + _TAIL.size > len(data):
        raise ValueError(f"{where}: a frame is cut off")
    if masked(data[begin:end]) != _TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"{where}: the payload's checksum is wrong")
    return data[begin:end], end + _TAIL.size


def sequence_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    width, has_key, key = _OWN.unpack_from(payload, 0)
    return key if has_key else None, np.frombuffer(payload, f"<u{width}", offset=_OWN.size).astype("<u4")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


@dataclass
class WrittenFile(WriterCommitMessage):
    """What one task attempt wrote; name is None if it had no rows."""

    part: int
    name: str | None
    records: int
    ids: int
    size: int


class SequenceWriter(DataSourceArrowWriter):
    """Rows of (key, ids as little-endian 4-byte numbers) into record files, in the order of partitions and rows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        part = TaskContext.get().partitionId()
        name, files, index, ids_before, offset, records = f"part-{part:06d}-{uuid.uuid4().hex}", None, None, 0, 0, 0
        fs, folder = _store(self.path)
        try:
            for batch in iterator:
                if batch.num_rows and files is None:
                    fs.create_dir(folder, recursive=True)
                    files = fs.open_output_stream(f"{folder}/{name}.seq", buffer_size=_BUFFER)
                    index = fs.open_output_stream(f"{folder}/{name}.idx", buffer_size=_BUFFER)
                keys, values = batch.column(0), batch.column(1)
                for key, raw in zip(keys.to_pylist(), values, strict=True):
                    ids = np.frombuffer(raw.as_buffer() or b"", "<u4")
                    framed = frame(payload_of(key, ids))
                    files.write(framed)
                    index.write(_ENTRY.pack(offset, ids_before, len(ids)))
                    offset, ids_before, records = offset + len(framed), ids_before + len(ids), records + 1
        finally:
            for out in (files, index):
                if out is not None:
                    out.close()
        return WrittenFile(part, name if records else None, records, ids_before, offset)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        there = fs.get_file_info(pafs.FileSelector(folder))
        if not self.overwrite and any(x.base_name == "manifest.json" for x in there):
            self.abort(messages)
            raise ValueError(f"{self.path} holds sequences already")
        files = [m for m in sorted((m for m in messages if m), key=lambda m: m.part) if m.name]
        with fs.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"files": [[m.name, m.records, m.ids, m.size] for m in files]}).encode())
        kept = {m.name for m in files}
        for x in there:  # of attempts that weren't committed, or of what was here before
            if x.base_name.startswith("part-") and x.base_name.rpartition(".")[0] not in kept:
                fs.delete_file(x.path)

    def abort(self, messages: list[WrittenFile | None]) -> None:
        fs, folder = _store(self.path)
        for m in messages:
            for kind in ("seq", "idx") if m and m.name else ():
                if fs.get_file_info(path := f"{folder}/{m.name}.{kind}").type != pafs.FileType.NotFound:
                    fs.delete_file(path)


def shuffled(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a pseudo-random order of 0..n-1 has these places' numbers: a Feistel network, walked until below n."""
    bits = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low = np.uint64((1 << bits) - 1)
    keys = mix(np.uint64(seed & (1 << 64) - 1) + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(bits), x & low
        for key in keys:
            left, right = right, left ^ (mix(right + key) & low)
        out[todo] = left << np.uint64(bits) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Range(InputPartition):
    """Record numbers from first to before last."""

    first: int
    last: int


class SequenceReader(DataSourceReader):
    def __init__(self, path: str, seed: int | None, as_bytes: bool, split: int):
        self.path, self.seed, self.as_bytes, self.split = path, seed, as_bytes, split
        fs, folder = _store(path)
        with fs.open_input_stream(f"{folder}/manifest.json") as f:
            self.files = json.loads(f.read())["files"]
        counts = np.array([[records, ids, size] for _, records, ids, size in self.files], np.int64).reshape(-1, 3)
        # of each file: records and ids in those before it
        self.before = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(counts, axis=0)])

    def partitions(self) -> list[Range]:
        total, out = int(self.before[-1, 0]), []
        if self.seed is not None:
            parts = max(1, math.ceil(int(self.before[-1, 2]) / self.split))
            return [Range(total * k // parts, total * (k + 1) // parts) for k in range(parts)]
        for k, (_, records, _, size) in enumerate(self.files):
            parts = min(records, max(1, math.ceil(size / self.split)))
            first = int(self.before[k, 0])
            out += [Range(first + records * j // parts, first + records * (j + 1) // parts) for j in range(parts)]
        return out or [Range(0, 0)]

    def _entries(self, fs, folder: str, file: int, rows: np.ndarray) -> np.ndarray:
        """Index entries of ascending rows of a file; rows near one another are read at once."""
        with fs.open_input_file(f"{folder}/{self.files[file][0]}.idx") as f:
            if int(rows[-1]) - int(rows[0]) < 64 * len(rows):
                raw = f.read_at(_ENTRY.size * int(rows[-1] - rows[0] + 1), _ENTRY.size * int(rows[0]))
                return np.frombuffer(raw, "<i8").reshape(-1, 3)[rows - rows[0]]
            return np.concatenate([np.frombuffer(f.read_at(_ENTRY.size, _ENTRY.size * r), "<i8").reshape(1, 3) for r in rows.tolist()])

    def _sequences(self, fs, folder: str, numbers: np.ndarray) -> list[tuple]:
        """(key, start, number of ids, ids) of these records, in their order."""
        order = np.argsort(numbers, kind="stable")
        wanted = numbers[order]
        file_of = np.searchsorted(self.before[:, 0], wanted, side="right") - 1
        out: list[tuple] = [()] * len(numbers)
        for file in np.unique(file_of).tolist():
            at = np.flatnonzero(file_of == file)
            name, _, _, size = self.files[file]
            rows = wanted[at] - self.before[file, 0]
            entries = self._entries(fs, folder, file, rows)
            # frames are read up to the next record of the file, several at once where these are neighbours
            sizes = _HEAD.size + _TAIL.size + _OWN.size + 4 * entries[:, 2]
            runs = np.split(np.arange(len(at)), np.flatnonzero(np.diff(rows) > 1) + 1)
            with fs.open_input_file(f"{folder}/{name}.seq") as f:
                for run in runs:
                    begin = int(entries[run[0], 0])
                    data = memoryview(f.read_at(min(size, int(entries[run[-1], 0] + sizes[run[-1]])) - begin, begin))
                    for k in run.tolist():
                        payload, _ = read_frame(data, int(entries[k, 0]) - begin, f"{self.path}/{name}.seq at {int(entries[k, 0])}")
                        key, ids = sequence_of(payload)
                        if len(ids) != entries[k, 2]:
                            raise ValueError(f"{self.path}/{name}.idx disagrees with record {int(rows[k])}")
                        out[order[at[k]]] = (key, int(self.before[file, 1] + entries[k, 1]), len(ids), ids)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(self.path)
        for first in range(partition.first, partition.last, BATCH_RECORDS):
            numbers = np.arange(first, min(first + BATCH_RECORDS, partition.last))
            if self.seed is not None:
                numbers = shuffled(numbers, int(self.before[-1, 0]), self.seed)
            keys, starts, counts, ids = zip(*self._sequences(fs, folder, numbers), strict=True)
            if self.as_bytes:
                values = pa.array([x.tobytes() for x in ids], pa.binary())
            else:
                bounds = np.concatenate([[0], np.cumsum(counts)])
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), values], names=["key", "start", "n_tokens", "ids"])


class FramedSequences(DataSource):
    """Options for reading: seed (a shuffled order), ids = array or bytes (little-endian 4-byte numbers), split (bytes a reader takes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = "binary" if self.options.get("ids") == "bytes" else "array<bigint>"
        return f"key bigint, start bigint, n_tokens bigint, ids {kind}"

    def reader(self, schema) -> SequenceReader:
        seed = self.options.get("seed")
        return SequenceReader(self.options["path"], None if seed is None else int(seed), self.options.get("ids") == "bytes", int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> SequenceWriter:
        return SequenceWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FramedSequences)


def token_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(key, ids): each row's token ids and then end_id, as little-endian 4-byte numbers; rows keep their order."""
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            ids = [np.append(x, np.uint32(end_id)).astype("<u4").tobytes() for x in encoder([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    return arrow(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("__text")), encode, "key bigint, ids binary")


def write_sequences(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = END_ID, overwrite: bool = False) -> None:
    """Writes one record for each row, in ascending order of key, into a folder of `framed_sequences`.

    Rows are dealt to ranges of key and hash of text, so that a key which many rows share is divided;
    within one key rows are ordered by that hash, then text. A row without key is written before all
    others and read with a null key. A null or empty text is end_id alone. Texts of any length are
    encoded whole, words a slice at a time. An empty table gives a folder without records; other
    columns don't matter.
    """
    spark = docs.sparkSession
    register(spark)
    order = [F.col("__key"), F.col("__tie"), F.col("__text")]
    rows = docs.select(F.col(key).cast("bigint").alias("__key"), F.col(text).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    token_ids(ordered, "__text", "__key", path, end_id).write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def read_sequences(spark: SparkSession, folder: str, seed: int | None = None, ids: str = "array") -> DataFrame:
    """key, start (ids in all records before it), n_tokens and ids of every record; with a seed in a shuffled order."""
    register(spark)
    reader = spark.read.format(FORMAT).option("ids", ids)
    return (reader if seed is None else reader.option("seed", seed)).load(folder)


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    write_sequences(table(spark, sf_dir, "documents"), folder)
    remove_at_exit(spark, folder)  # the result still reads it
    return read_sequences(spark, folder, ids="bytes").select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
