"""Operator 13, periodic run detection: stretches of a text that repeat the same few words over and over.

Karp-Miller-Rosenberg naming: level 0 names words, level k+1 names pairs of level-k names 2^k apart, so
that equal names are equal stretches of 2^k words, by comparison of integers only.

A run of period q and at least max(least, repeats * q) words matches itself q words further at no fewer
than g(q) consecutive places, the length less q. So a grid of every g(q)-th place has a place in each
run. Grid places whose word matches, and eight words on one side as well, are candidates. Those of one
run are linked by names of g(q) words; the first is extended to the left and the last to the right by
descending name levels. What is extended never exceeds g(q) words, because the next grid place would
match too. Of equal stretches the one with the smallest period is the run.

All texts of a batch lie behind one another, with a word of its own between any two; rows stay in their
partitions and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, portions, table, utf8
from .words import SPACE, spans

#: The fewest words of a run, and how often its period must fit in.
LEAST, REPEATS = 24, 3
#: Words above which a batch (one long text) is searched one doubling of the period at a time.
AT_ONCE = 1 << 20
#: Words that must match beside a grid place; a grid is never narrower than twice that.
SIEVE = 8


class Names:
    """Names of the stretches of 2^k words from each place, made when first asked for."""

    def __init__(self, words: np.ndarray):
        self.levels = [words.astype(np.int32)]

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = len(last)
            whole = max(0, n - 2 * half + 1)
            pairs = last[:whole].astype(np.int64) << 32 | last[half : half + whole].astype(np.int64) & 0xFFFFFFFF
            named = -1 - np.arange(n, dtype=np.int32)  # stretches that would pass the end equal no other
            if whole:
                named[:whole] = np.unique(pairs, return_inverse=True)[1]
            self.levels.append(named)
        return self.levels[level]

    def ahead(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """How many words from i on equal those from j on, up to a count below the power of two above most."""
        i, j, began = i.copy(), j.copy(), i
        for level in range(most.bit_length() - 1, -1, -1):
            names = self[level]
            step = (names[i] == names[j]).astype(np.int64) << level
            i += step
            j += step
        return i - began

    def back(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """How many words before i equal those before j."""
        i, j, began = i.copy(), j.copy(), i
        for level in range(most.bit_length() - 1, -1, -1):
            names, size = self[level], 1 << level
            step = ((i >= size) & (names[np.maximum(i - size, 0)] == names[np.maximum(j - size, 0)])).astype(np.int64) << level
            i -= step
            j -= step
        return began - i

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of size words from i and j are equal: two names that overlap."""
        out = np.zeros(len(i), bool)
        levels = np.floor(np.log2(size)).astype(np.int64)
        for level in np.unique(levels).tolist():
            at = levels == level
            names, over = self[level], size[at] - (1 << level)
            out[at] = (names[i[at]] == names[j[at]]) & (names[i[at] + over] == names[j[at] + over])
        return out


def _grid(q, least: int, repeats: int):
    """Consecutive places at which a run of period q matches itself."""
    return np.maximum(least - q, (repeats - 1) * q)


def _candidates(words: np.ndarray, periods: range, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places and periods, ordered by period, with eight equal words on one side."""
    places, found, n = [], [], len(words)
    for q in periods:
        step = int(_grid(q, least, repeats))
        hit = np.flatnonzero(words[: n - q : step] == words[q::step])
        if len(hit):
            places.append(hit * step)
            found.append(q)
    sizes = [len(p) for p in places]
    i = np.concatenate(places) if places else np.zeros(0, np.int64)
    q = np.repeat(np.array(found, np.int64), sizes)
    width = min(SIEVE, int(_grid(max(1, least // repeats), least, repeats)) // 2)
    right = np.ones(len(i), bool)
    left = np.ones(len(i), bool)
    for d in range(1, width + 1):
        k = np.flatnonzero(right)
        right[k[words[np.minimum(i[k] + q[k] + d - 1, n - 1)] != words[i[k] + d - 1]]] = False
        k = np.flatnonzero(left)
        left[k[(i[k] < d) | (words[i[k] - d] != words[i[k] + q[k] - d])]] = False
    keep = right | left
    return i[keep], q[keep]


def _extended(names: Names, i: np.ndarray, q: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows of start, end, period: maximal stretches of period q (perhaps not their smallest) that are long enough."""
    step = _grid(q, least, repeats)
    linked = np.zeros(len(i), bool)  # to the candidate before
    next_to = np.flatnonzero((q[1:] == q[:-1]) & (i[1:] - i[:-1] == step[1:])) + 1
    before = next_to - 1
    linked[next_to] = names.equal(i[before], i[before] + q[before], step[before])
    first = np.flatnonzero(~linked)
    last = np.append(first[1:], len(i)) - 1
    out = np.empty((len(first), 3), np.int64)
    for level in np.unique(np.floor(np.log2(step[first])).astype(np.int64)).tolist() if len(first) else []:
        at = np.flatnonzero(step[first] >> level == 1)
        a, b, p = i[first[at]], i[last[at]], q[first[at]]
        most = 1 << level
        out[at, 0] = a - names.back(a, a + p, most)
        out[at, 1] = b + p + names.ahead(b, b + p, most)
        out[at, 2] = p
    return out[out[:, 1] - out[:, 0] >= np.maximum(least, repeats * out[:, 2])]


def runs_of(words: np.ndarray, offs: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """Runs of each text: rows of start, length, period, by start and then period.

    words: a number for each word, the same for equal words; offs: where texts begin and end.
    """
    n_texts, sizes = len(offs) - 1, np.diff(offs)
    # a word of its own stands before and behind each text
    text_of = np.repeat(np.arange(n_texts), sizes)
    place = np.arange(len(words)) + text_of + 1
    line = -1 - np.arange(len(words) + n_texts + 1, dtype=np.int64)
    line[place] = words
    begins = offs[:-1] + np.arange(n_texts) + 1
    longest = int(sizes.max(initial=0)) // repeats
    tops = [1 << k for k in range(longest.bit_length() + 1)] if len(words) > AT_ONCE else [1, longest + 1]
    empty = np.zeros((0, 3), np.int64)
    found: list[np.ndarray] = []
    kept = names = None
    for low, high in zip(tops, tops[1:], strict=False):
        i, q = _candidates(line, range(low, min(high, longest + 1)), least, repeats)
        own = np.searchsorted(begins, i, side="right")
        same = own == np.searchsorted(begins, i + q, side="right")
        i, q, own = i[same], q[same], own[same]
        if not len(i):
            continue
        if names is None:
            # names are made only for texts that have candidates, here the texts' numbers from 1
            hot = np.unique(own) if len(tops) == 2 else np.arange(1, n_texts + 1)
            begin, end = begins[hot - 1] - 1, begins[hot - 1] + sizes[hot - 1] + 1
            moved = np.cumsum(np.append(0, (end - begin)[:-1]))
            kept = np.repeat(begin - moved, end - begin) + np.arange((end - begin).sum())
            names = Names(line[kept] if len(hot) < n_texts else line)
            shift = np.zeros(n_texts + 1, np.int64)
            shift[hot] = begin - moved
            if len(hot) == n_texts:
                shift[:] = 0
        # the grid's order by place within a period is kept
        stretches = _extended(names, i - shift[own], q, least, repeats)
        if len(hot) < n_texts:
            stretches[:, :2] += (kept[stretches[:, 0]] - stretches[:, 0])[:, None]
        found.append(stretches)
    if not found:
        return [empty] * n_texts
    rows = np.concatenate(found)
    # of equal stretches the smallest period; then by place and period
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(begins, rows[:, 0], side="right") - 1
    rows = np.stack([rows[:, 0] - begins[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    at = np.searchsorted(text, np.arange(n_texts + 1))
    return [rows[at[k] : at[k + 1]] for k in range(n_texts)]


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; words with equal bytes, and only these, have the same."""
    if not len(starts):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(starts), np.int64)  # words and the gaps behind them, by turns
    edges[0::2], edges[1::2] = starts, ends
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    words = pieces.take(pa.array(np.arange(0, 2 * len(starts) - 1, 2)))
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def strongest(runs: np.ndarray) -> np.ndarray | None:
    """The run with the greatest length over period, compared exactly; ties: smallest start, then smallest period."""
    if not len(runs):
        return None
    near = runs[runs[:, 1] / runs[:, 2] >= (runs[:, 1] / runs[:, 2]).max() * (1 - 1e-9)].tolist()
    return np.array(min(near, key=cmp_to_key(lambda a, b: b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2])))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def _structs(rows: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN))


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Every row's key, n_words, runs (by start, then period), strongest run and collapsed text.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D). A run is a stretch of words with
    smallest period q and at least max(least, repeats * q) words which no neighbouring word extends at
    that period. collapsed: the words, one space between them, without those that any run contains
    behind its first q. strongest: the run with the greatest length over period (ties: smallest start,
    then period), null without runs.

    A null, empty or blank text has no runs, no words and an empty collapsed text. Repeated rows and
    rows without a key each have a row; an empty table gives none; other columns don't matter. A text
    of any length is searched whole: a text of n words takes some 4 n log2(n) bytes while names of all
    levels are needed.
    """
    if repeats < 2 or least < 2 * repeats:
        raise ValueError("a run holds its period twice at least, and twice as many words as it has repeats")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1, rows=4096)):
            data, offs = utf8(batch.column(1))
            data, offs = data[offs[0] : offs[-1]], offs - offs[0]
            starts, ends = spans(data, offs, SPACE)
            at = np.searchsorted(starts, offs)
            runs = runs_of(_word_numbers(data, starts, ends), at, least, repeats)
            dropped = np.zeros(len(starts) + 1, np.int64)
            for k, rows in enumerate(runs):
                np.add.at(dropped, at[k] + rows[:, 0] + rows[:, 2], 1)
                np.add.at(dropped, at[k] + rows[:, 0] + rows[:, 1], -1)
            gone = np.cumsum(dropped[:-1]) > 0
            # the kept words' bytes, each word with one byte behind it that is overwritten by a space
            kept = np.flatnonzero(~gone)
            sizes = ends[kept] - starts[kept] + 1
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            line = np.append(data, np.uint8(32))[np.repeat(starts[kept] - bounds[:-1], sizes) + np.arange(bounds[-1])]
            line[bounds[1:] - 1] = 32
            cut = bounds[np.searchsorted(kept, at)]
            whole = line.tobytes()
            collapsed = [whole[a : b - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            best = [strongest(rows) for rows in runs]
            counts = np.array([len(rows) for rows in runs])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), _structs(np.concatenate(runs))),
                    pa.array([None if b is None else dict(zip(("start", "length", "period"), b.tolist(), strict=True)) for b in best], _RUN),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=[key, "n_words", "runs", "strongest", "collapsed"],
            )

    chosen = docs.select(F.col(key), F.col(text).alias("__text"))
    kind = chosen.schema.fields[0].dataType.simpleString()
    return arrow(chosen, search, f"`{key}` {kind}, n_words bigint, runs array<{_RUN_SQL}>, strongest {_RUN_SQL}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of the contract: a text whose doc_id's checksum ends in 0 gets a periodic tail of its own words, one space between words."""
    words, h, g, a = (F.col(c) for c in ("__words", "__h", "__g", "__a"))
    n = F.size(words)
    p = F.col("__p")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return (
        docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("__h"))
        .select("doc_id", "text", F.floor(h / 10).alias("__g"), F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("__words"))
        .select("*", F.when(n > 0, F.pmod(g, n)).cast("int").alias("__a"))
        .select("*", F.when(n > 0, 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int").alias("__p"))
        .select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents"))
    best = F.col("strongest")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return find_runs(docs).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
