"""Operator 7, best-fit packing: token ids of documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of open bins, whose free spaces stand in a bitset;
a piece goes to the open bin that it fills best; when it fits none and all places are taken, the
fullest bin closes first.

Each input partition is packed by itself in one pass (no text is shuffled). Bins that are still
open at a partition's end and not nearly full give their pieces back; these few pieces (numbers,
no text) meet in fewer tasks, longest first, and are packed the same way.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, portions, saved, slices, table, utf8
from .words import SPACE, Column, WordTable, hashes, spans

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 256
#: A bin that is left open at a partition's end stays as it is from this fill on.
FULL_ENOUGH = 0.995
#: Pieces of words whose ids are kept.
KEPT_PIECES = 60_000
#: Tokens of given-back pieces that one task of the second pass packs.
SECOND_PASS_TOKENS = 2_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Online best-fit with at most `places` open bins of `size`."""

    def __init__(self, size: int = SEQUENCE, places: int = OPEN_BINS):
        self.size, self.places = size, places
        self.free_set = 0  # bit f: an open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            del self.by_free[free]
            self.free_set &= ~(1 << free)
        self.open -= 1
        return chosen

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece."""
        fits = self.free_set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open == self.places:  # the fullest closes: the lowest bit
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            free, chosen = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(chosen)
            self.free_set |= 1 << left
            self.open += 1
        return chosen, self.size - free

    def left_open(self) -> dict[int, int]:
        """Open bins and their free space."""
        return {b: free for free, bins in self.by_free.items() for b in bins}


@lru_cache(maxsize=2)
def _model(path: str) -> tuple:
    """The tokenizer; its own merging for words in common bytes; the split pattern.

    The merges run in a byte-pair library that knows only one symbol a byte: a word's last byte,
    which carries the word end, gets a byte of its own. Words with bytes outside that alphabet are
    left to the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    shown = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    inner = [b for b in range(33, 127) if not 65 <= b <= 90] + list(range(0x80, 0xC0)) + [0xC2, 0xC3, 0xC4, 0xC5]
    last = [b for b in range(33, 127) if not 65 <= b <= 90] + list(range(0x9F, 0xC0))
    inner_code, last_code = {b: i for i, b in enumerate(inner)}, {b: len(inner) + i for i, b in enumerate(last)}
    ranks = {}
    for token, i in vocab.items():
        ended = token.endswith("</w>")
        raw = [shown[c] for c in (token[:-4] if ended else token)]
        codes = [inner_code.get(b) for b in raw]
        if ended and raw:
            codes[-1] = last_code.get(raw[-1])
        if codes and None not in codes:
            ranks[bytes(codes)] = i
    # what the vocabulary lacks must still be a rank, but no word may use it
    for b in range(256):
        ranks.setdefault(bytes([b]), 1_000_000 + b)
    encoding = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    # not part of that library's public interface: without it, every word goes to the tokenizer
    merge = getattr(getattr(encoding, "_core_bpe", None), "encode_single_piece", None)
    return (
        Tokenizer.from_file(path),
        merge,
        bytes(inner_code.get(b, 0) for b in range(256)),
        [bytes([last_code[b]]) if b in last_code else None for b in range(256)],
        frozenset(inner),
        regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"),
    )


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, with each white-space word's ids kept in a bounded table."""

    def __init__(self, path: str):
        self.tokenizer, self.merge, self.inner, self.last, self.known, self.pattern = _model(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pool, self.start, self.count = Column(np.uint32), Column(np.int64), Column(np.int64)
        self.pieces: dict[str, list[int]] = {}
        self.table = WordTable(self._learn, self._reset)

    def _reset(self) -> None:
        for column in (self.pool, self.start, self.count):
            column.clear()

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        if self.merge is not None and (end := self.last[raw[-1]]) is not None and self.known.issuperset(raw[:-1]):
            ids = self.merge(raw[:-1].translate(self.inner) + end)
            if max(ids) < 1_000_000:
                return ids
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        known, find, out, counts = self.pieces, self.pattern.findall, [], []
        for word in words:
            n = len(out)
            for piece in find(word.decode("utf-8", "replace")):
                ids = known.get(piece)
                if ids is None:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    ids = known[piece] = self._piece(piece)
                out += ids
            counts.append(len(out) - n)
        starts = self.pool.n + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.pool.extend(np.array(out, np.uint32))
        self.start.extend(starts)
        self.count.extend(counts)

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            import unicodedata

            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # else a final one is lower-cased in another way
        return text.lower()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, without an end id."""
        plain = ["" if any(s in t for s in self.specials) else self._normal(t) for t in texts]
        raw = [t.encode() for t in plain]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        held: list[np.ndarray] = []
        done = 0
        for rows, part, at, place in slices(data, offs, SPACE):
            starts, ends = spans(part, at, SPACE)
            index = self.table.index(hashes(part, starts, ends), part, starts, ends)
            counts = self.count.values[index]
            bounds = np.concatenate([[0], np.cumsum(counts)])
            ids = self.pool.values[np.repeat(self.start.values[index] - bounds[:-1], counts) + np.arange(bounds[-1])]
            cut = bounds[np.searchsorted(starts, at)]
            for k, row in enumerate(rows.tolist()):
                while done < row:  # texts without bytes are in no slice of their own
                    yield self._end(texts[done], held)
                    held, done = [], done + 1
                held.append(ids[cut[k] : cut[k + 1]])
        while done < len(texts):
            yield self._end(texts[done], held)
            held, done = [], done + 1

    def _end(self, text: str, held: list[np.ndarray]) -> np.ndarray:
        if any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(held) if held else np.zeros(0, np.uint32)


_OUT = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())]
_OUT_SQL = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint, settled boolean"


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, size: int = SEQUENCE, places: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows with their places: key, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are its text's and then end_id; a null or empty text gives end_id alone. Rows above
    `size` ids are cut into pieces of `size`, the last perhaps shorter; texts of any length are encoded
    whole, words a slice at a time. Every row of repeated keys is packed. Offsets in a sequence run from 0 without gaps. Ties: among bins of equal free space, the
    one that got it last. An empty table gives no rows; other columns don't matter.
    """
    path = path or tokenizer_path()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = Encoder(path), Packer(size, places), TaskContext.get().partitionId() << 32
        # what is kept of each piece until its bin is known to stay: 41 bytes and the key
        out = [array(t) for t in "iqqqqi"]
        keys: list[pa.Array] = []

        for batch in (part for whole in batches for part in portions(whole, 1)):
            rows: list[int] = []
            for row, ids in enumerate(encoder([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id))
                raw = memoryview(ids.astype("<u4").tobytes())
                for piece, start in enumerate(range(0, len(ids), size)):
                    length = min(size, len(ids) - start)
                    chosen, offset = packer.put(length)
                    rows.append(row)
                    for column, value in zip(out, (piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), chosen, offset), strict=True):
                        column.append(value)
            keys.append(batch.column(0).take(pa.array(rows, pa.int64())))
        if not out[0]:
            return
        given_back = np.array([b for b, free in packer.left_open().items() if free > size * (1 - FULL_ENOUGH)], np.int64)
        piece, start, length, crc, bins, offset = (np.frombuffer(c, c.typecode) for c in out)
        columns = (piece, start, length, crc, base + bins, offset.astype(np.int64), ~np.isin(bins, given_back))
        arrays = [pa.concat_arrays(keys), *(pa.array(c, t) for c, (_, t) in zip(columns, _OUT, strict=True))]
        yield from pa.Table.from_arrays(arrays, names=[key, *(n for n, _ in _OUT)]).to_batches(max_chunksize=20_000)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(size, places), (1 << 62) + (TaskContext.get().partitionId() << 32)
        for batch in batches:  # sorted, longest first
            placed = [packer.put(n) for n in batch.column("length").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["sequence_id"] = pa.array([base + b for b, _ in placed], pa.int64())
            columns["offset"] = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    chosen = docs.select(F.col(key), F.col(text).alias("__text"))
    kind = chosen.schema.fields[0].dataType.simpleString()
    schema = f"`{key}` {kind}, {_OUT_SQL}"
    # written, so that a task that runs again can't pack what others have read in another order
    first = saved(arrow(chosen, first_pass, schema))
    loose = first.filter(~F.col("settled"))
    tokens = loose.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(tokens / SECOND_PASS_TOKENS))
    order = [F.desc("length"), F.col(key), "piece", "sequence_id", "offset"]
    again = saved(arrow(loose.repartition(tasks).sortWithinPartitions(*order), second_pass, schema))
    return first.filter("settled").unionByName(again).drop("settled")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
