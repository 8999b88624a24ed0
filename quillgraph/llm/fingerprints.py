"""Operator 2, document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, further cut at every end of a sentence, and sentences of
over PARAGRAPH_WORDS words behind each PARAGRAPH_WORDS words (so that texts of one line have
paragraphs to share). A text of over a megabyte is also cut behind the last white space of each.
Each paragraph, with the number of equal ones before it, gives a 64-bit digest. A sketch has cells;
each digest goes to one cell of each of three parts, where counts are added and digests and their
32-bit checks are xor-ed. The fingerprint is a sketch of CELLS cells.

Two versions are compared by their fingerprints: these are subtracted and the difference is peeled (a
cell with a single digest gives it away, which frees further cells) until all differing digests are
known. If peeling gets stuck, it is tried again with a larger sketch of both, for as many digests as
both texts have, then with one of twice as many cells, and so on. Likeness is the number of common
digests over that of all (1 for two texts without any).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, portions, saved, slices, table, utf8
from .words import SPACE, hashes, lut, mix, spans

PARAGRAPH_WORDS = 6
#: Cells of the fingerprint; more after each failure.
CELLS, GROWTH = 12, 2
#: Cells for each differing digest with which peeling rarely gets stuck.
ROOM = 1.5
#: Cells that are peeled at once, which bounds memory.
TOGETHER = 1 << 20
#: Parts of the order of documents that rows are dealt by, and documents that one part should hold.
MOST_PARTS, PART_ROWS = 1 << 16, 250
#: Bits of a check.
_CHECK_BITS = np.uint64(0xFFFFFFFF)

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
_CHECK = np.uint64(0x082EFA98EC4E6C89)
_NTH = np.uint64(0x452821E638D01377)
_STEP = 0xBE5466CF34E90C6D
_STOP = lut(b".!?")
_LINE = lut(b"\n")


def _weights(n: int) -> np.ndarray:
    steps = np.full(n, _STEP, np.uint64)
    return np.multiply.accumulate(steps) if n else steps


_WORD_WEIGHT = _weights(PARAGRAPH_WORDS)


def paragraph_digests(column: pa.Array) -> list[np.ndarray]:
    """The distinct digests of each text's paragraphs."""
    data, offs = utf8(column)
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for rows, part, at, _ in slices(data, offs, SPACE):
        starts, ends = spans(part, at, SPACE)
        if not len(starts):
            continue
        h = hashes(part, starts, ends)
        # a word begins a paragraph after a line's or sentence's end, or after enough words
        lines = np.concatenate([[0], np.cumsum(_LINE[part])])
        new = np.ones(len(starts), bool)
        new[1:] = (lines[starts[1:]] > lines[ends[:-1]]) | _STOP[part[ends[:-1] - 1]]
        cut = np.searchsorted(starts, at)
        new[cut[:-1][cut[:-1] < len(new)]] = True
        begin = np.flatnonzero(new)
        place = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
        place %= PARAGRAPH_WORDS
        first = np.flatnonzero(place == 0)
        digests = mix(np.add.reduceat(h * _WORD_WEIGHT[place], first))
        bounds = np.searchsorted(first, cut)
        for k, row in enumerate(rows.tolist()):
            out[row].append(digests[bounds[k] : bounds[k + 1]])
    return [_numbered(np.concatenate(parts) if parts else np.zeros(0, np.uint64)) for parts in out]


def _numbered(digests: np.ndarray) -> np.ndarray:
    """Equal paragraphs of one text are told apart by how many stand before them."""
    n = len(digests)
    if n < 2:
        return digests
    ordered = np.sort(digests)
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(same):
        begin = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        nth = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        ordered = np.where(nth > 0, mix(ordered + nth.astype(np.uint64) * _NTH), ordered)
    return ordered


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest."""
    third = np.uint64(cells // 3)
    return np.stack([(mix(digests ^ s) % third + np.uint64(j) * third).astype(np.int64) for j, s in enumerate(_SEEDS)])


class Sketches:
    """Sketches of several digest sets (or differences of two), one behind the other."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys, self.checks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Sketches:
        out = cls(len(sets), cells)
        sizes = np.array([len(s) for s in sets], np.int64)
        if sizes.sum():
            out.add(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), np.ones(sizes.sum(), np.int64))
        return out

    def minus(self, other: Sketches) -> Sketches:
        """The sketches of the differences, cell by cell."""
        out = Sketches(self.n, self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def take(self, which: np.ndarray) -> Sketches:
        out = Sketches(len(which), self.cells)
        for name in ("count", "keys", "checks"):
            setattr(out, name, getattr(self, name).reshape(self.n, -1)[which].reshape(-1))
        return out

    def add(self, which: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        checks = mix(digests ^ _CHECK) & _CHECK_BITS
        for part in _cells(digests, self.cells):
            at = which * self.cells + part
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, digests)
            np.bitwise_xor.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, digest, sign) of what was recovered, and for each sketch whether that is all."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            keys = self.keys[look]
            pure = (np.abs(self.count[look]) == 1) & (mix(keys ^ _CHECK) & _CHECK_BITS == self.checks[look])
            look, keys = look[pure], keys[pure]
            if not len(look):
                break
            which = look // self.cells
            order = np.lexsort((keys, which))
            once = np.ones(len(order), bool)
            once[1:] = (keys[order][1:] != keys[order][:-1]) | (which[order][1:] != which[order][:-1])
            take = order[once]
            which, keys, sign = which[take], keys[take], self.count[look[take]]
            self.add(which, keys, -sign)
            found.append((which, keys, sign))
            look = np.unique(np.concatenate([which * self.cells + part for part in _cells(keys, self.cells)]))
        whole = ~(self.count.reshape(self.n, -1).any(axis=1) | self.keys.reshape(self.n, -1).any(axis=1))
        which, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return which, keys, sign, whole

    def texts(self, sizes: list[int]) -> list[str]:
        """Each sketch with the number of its digests, in base64: what to_sketches() reads."""
        rows = zip(sizes, *(a.astype(t).reshape(self.n, -1) for a, t in ((self.count, "<u4"), (self.keys, "<u8"), (self.checks, "<u4"))), strict=True)
        return [base64.b64encode(b"".join([struct.pack("<I", n), c.tobytes(), k.tobytes(), h.tobytes()])).decode() for n, c, k, h in rows]


def to_sketches(texts: list[str]) -> tuple[list[int], Sketches]:
    """Numbers of digests and sketches of emitted fingerprints."""
    raw = [base64.b64decode(t) for t in texts]
    out = Sketches(len(raw), (len(raw[0]) - 4) // 16 if raw else CELLS)
    data = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    own = lambda a, b, t: np.ascontiguousarray(data[:, a:b]).view(t).reshape(-1)
    c = out.cells
    out.count, out.keys, out.checks = own(4, 4 + 4 * c, "<i4").astype(np.int64), own(4 + 4 * c, 4 + 12 * c, "<u8").astype(np.uint64), own(4 + 12 * c, 4 + 16 * c, "<u4").astype(np.uint64)
    return own(0, 4, "<u4").tolist(), out


def _room(n: int) -> int:
    """Cells in which n differing digests are likely to be peeled."""
    cells = CELLS
    while cells < ROOM * n:
        cells *= GROWTH
    return cells


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], first: Sketches | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of digest sets, the digests that only the first and only the second has, and the cells it took.

    first: the differences of the pairs' fingerprints, which are peeled first.
    """
    out: list = [None] * len(pairs)
    waiting: dict[int, list[int]] = {CELLS: list(range(len(pairs)))}
    while waiting:
        cells = min(waiting)
        tried = waiting.pop(cells)
        group = max(1, TOGETHER // cells)
        for i in range(0, len(tried), group):
            own = tried[i : i + group]
            if cells == CELLS and first is not None:
                sketch = first.take(np.array(own))
            else:
                sketch = Sketches.of([pairs[p][0] for p in own], cells).minus(Sketches.of([pairs[p][1] for p in own], cells))
            which, keys, sign, whole = sketch.peel()
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(len(own) + 1))
            for k, p in enumerate(own):
                if whole[k]:
                    mine = order[bounds[k] : bounds[k + 1]]
                    out[p] = (keys[mine][sign[mine] > 0], keys[mine][sign[mine] < 0], cells)
                else:
                    waiting.setdefault(max(cells * GROWTH, _room(len(pairs[p][0]) + len(pairs[p][1]))), []).append(p)
    return out


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]], first: Sketches | None = None) -> tuple[list[float], list[int]]:
    """The likeness of each pair, and the cells of the sketch that told it."""
    out, cells = [], []
    for (a, b), (only_a, only_b, used) in zip(pairs, differences(pairs, first), strict=True):
        every = len(b) + len(only_a)
        out.append((len(a) - len(only_a)) / every if every else 1.0)
        cells.append(used)
    return out, cells


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What documents are ordered by: key, then (for rows of one key) length and hash of the text.
_BORDERS = "array<struct<id:bigint,n:int,h:bigint>>"


def with_next(docs: DataFrame, text: str, key: str) -> DataFrame:
    """part, guard, id, text: rows dealt by ranges of their order, with each range's successor as a guard row.

    The borders of the ranges are every so manieth row of the order, taken from a sort of keys without
    texts; they are at most MOST_PARTS and one for each task of that sort. A row finds its range by a
    binary search among them; one that is a border also goes to the range before, the first of all to
    the last range.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id IS NOT NULL")
    rows = rows.withColumn("place", F.struct("id", F.length("text").alias("n"), F.xxhash64("text").alias("h")))
    keys = saved(rows.select("place.*"))
    every = max(PART_ROWS, -(-keys.count() // MOST_PARTS))
    ordered = keys.repartitionByRange("id", "n", "h").sortWithinPartitions("id", "n", "h")
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    borders = sorted({(r["id"], r["n"], r["h"]) for r in ordered.withColumn("nth", nth).filter(F.col("nth") % every == 0).collect()})
    if not borders:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("guard"), "id", "text")
    listed = F.from_json(F.lit(json.dumps([{"id": i, "n": n, "h": h} for i, n, h in borders])), _BORDERS)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))))
    # the number of borders that aren't behind the row
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(borders)) & (F.try_element_at(listed, at + step) <= F.col("place")), at + step).otherwise(at))
    found = rows.withColumn("part", upto - 1)
    border = F.element_at(listed, F.col("part") + 1) == F.col("place")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guard"))
    ahead = F.struct(F.pmod(F.col("part") - 1, F.lit(len(borders))).alias("part"), F.lit(1).alias("guard"))
    dealt = found.withColumn("dealt", F.explode(F.when(border, F.array(own, ahead)).otherwise(F.array(own))))
    return dealt.select("dealt.part", "dealt.guard", "id", "text", "place").repartition("part").sortWithinPartitions("part", "guard", "place").drop("place")


def fingerprint_versions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells_edited, cells_next for every row.

    A null text is empty; texts of any length count whole. The edited text is the text with its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's text, by
    ascending key, after the last row the first. near_edited is the likeness of the text's and the
    edited text's fingerprints, near_next that of the text's and the next text's; cells_... tell the
    size of the sketch that could be peeled (CELLS: the fingerprints themselves). Rows of one repeated
    key follow each other by length and hash of their text; equal rows stand beside each other. Rows
    without a key have no place in the order and give no rows. An empty table gives no rows; other
    columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # the last row of what came before: part, guard, id, text, digests
        for batch in (part for whole in batches for part in portions(whole, 3)):
            own = paragraph_digests(batch.column(3))
            rows = [*waiting, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), own, strict=True)]
            waiting = rows[-1:]
            at = np.array([i for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if not a[1] and a[0] == b[0]], np.int64)
            if not len(at):
                continue
            every = [r[4] for r in rows]
            texts = [edited(rows[i][3], rows[i + 1][3]) for i in at.tolist()]
            changed = paragraph_digests(pa.array(texts, pa.large_string()))
            sketches, edits = Sketches.of(every, CELLS), Sketches.of(changed, CELLS)
            mine, following = sketches.take(at), sketches.take(at + 1)
            sets = [every[i] for i in at.tolist()]
            near, cells = likenesses(list(zip(sets, changed, strict=True)), mine.minus(edits))
            near_next, cells_next = likenesses([(every[i], every[i + 1]) for i in at.tolist()], mine.minus(following))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in at.tolist()], pa.int64()),
                    pa.array([len(rows[i][3]) for i in at.tolist()], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                    pa.array(mine.texts([len(s) for s in sets])),
                    pa.array(edits.texts([len(s) for s in changed])),
                    pa.array(near),
                    pa.array(near_next),
                    pa.array(cells, pa.int32()),
                    pa.array(cells_next, pa.int32()),
                ],
                names,
            )

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next"]
    kinds = ["bigint", "bigint", "string", "string", "string", "double", "double", "int", "int"]
    return arrow(with_next(docs, text, key), run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
