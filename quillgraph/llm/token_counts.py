"""Operator 1, token counts: a count-only Viterbi search under a unigram vocabulary.

The vocabulary is that of a public sentencepiece model (pieces with scores, byte fallback); the
result equals the number of tokens that a unigram tokenizer with this vocabulary, byte fallback and
a "▁" word marker (a marker for each space, one more before the text) gives, without making tokens.
Aho-Corasick enumerates the pieces that end at each character, longest first; dynamic programming
carries the best score and its number of pieces. A later candidate replaces an earlier one only if
its score is higher: among equal scores, the piece that starts first wins. A character that no
piece of its own covers scores the vocabulary's least score minus 10 and counts as its UTF-8 bytes.

No piece holds a space or newline before another character, so that each word is scored on its own
and kept in a bounded table; scores are whole numbers, whose sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow, slices, table, utf8
from .words import Column, WordTable, hashes, lut, spans, sums

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_SPLIT = lut((0x20, 0x0A))
_MARK_BYTES = MARK.encode()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class Counter:
    """Counts the best path's pieces."""

    def __init__(self, vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        # a word can be scored apart from its neighbours only if nothing spans the cuts
        self.cuts = not any("\n" in p or " " in p for p in pieces)

    def path(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through a word; only as many places are kept as the longest piece spans."""
        width = self.longest + 1
        best: list[float | None] = [None] * width
        count = [0] * width
        best[0] = 0.0
        hits = iter(self.automaton.iter(word))
        hit = next(hits, None)
        for end in range(1, len(word) + 1):
            top, pieces, alone = None, 0, False
            while hit is not None and hit[0] == end - 1:
                length, score = hit[1]
                at = (end - length) % width
                alone = alone or length == 1
                if best[at] is not None and (top is None or best[at] + score > top):
                    top, pieces = best[at] + score, count[at] + 1
                hit = next(hits, None)
            at = (end - 1) % width
            if not alone and best[at] is not None:
                score = best[at] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[at] + (len(word[end - 1].encode()) if self.bytes else 1)
            best[end % width], count[end % width] = top, pieces
        return count[len(word) % width], best[len(word) % width]

    def whole(self, text: str) -> tuple[int, float]:
        """The plain way: each marked word by itself. Used where a text holds the marker literally."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        parts = marked.split(MARK)[1:]
        found = [self.path(MARK + p) for p in parts]
        return sum(c for c, _ in found), sum(s for _, s in found)


class Batch:
    """Counts for batches of texts, with the paths of words kept from batch to batch."""

    def __init__(self, path: str):
        self.counter = Counter(load_vocabulary(path))
        self.count, self.score = Column(np.int64), Column(np.float64)
        self.table = WordTable(self.learn, lambda: (self.count.clear(), self.score.clear()))
        self.lone = self.counter.path(MARK)
        self.newline = self.counter.path("\n")

    def learn(self, words: list[bytes]) -> None:
        # the first byte tells whether a marker stands before the word
        found = [self.counter.path((MARK if w[:1] == b" " else "") + w[1:].decode("utf-8", "replace")) for w in words]
        self.count.extend([c for c, _ in found])
        self.score.extend([s for _, s in found])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = utf8(column)
        counts, scores = np.zeros(len(column), np.int64), np.zeros(len(column), np.float64)
        for rows, part, at, place in slices(data, offs, _SPLIT):
            before = int(data[place - 1]) if place > offs[rows[0]] else None
            counts_, scores_ = (self._long_word if len(part) > 2 * SLICE_BYTES else self._slice)(part, at, before)
            counts[rows] += counts_
            scores[rows] += scores_
        return counts, scores

    def _long_word(self, part: np.ndarray, at: np.ndarray, before: int | None) -> tuple[int, float]:
        """A part that couldn't be cut: one word, and perhaps the space or newline behind it."""
        last = int(part[-1])
        word = (part[:-1] if _SPLIT[last] else part).tobytes().decode("utf-8", "replace")
        count, score = self.counter.path((MARK if before is None or before == 0x20 else "") + word)
        for c, s in ((self.lone,) if last == 0x20 else (self.newline,) if last == 0x0A else ()):
            count, score = count + c, score + s
        return (count - self.lone[0], score - self.lone[1]) if before == 0x20 else (count, score)

    def _slice(self, part: np.ndarray, at: np.ndarray, before: int | None) -> tuple[np.ndarray, np.ndarray]:
        """before: the byte before a later part of a long text."""
        if not len(part):
            return np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
        # before each text stands a space unless it starts with one
        lead = np.zeros(len(at) - 1, bool)
        filled = at[1:] > at[:-1]
        if before is None:
            lead[filled] = part[at[:-1][filled]] != 0x20
        shift = np.concatenate([[0], np.cumsum(lead)])
        whole = np.insert(part, at[:-1][lead], 0x20)
        at = at + shift
        starts, ends = spans(whole, at, _SPLIT)
        prior = whole[np.maximum(starts - 1, 0)]
        prior[np.isin(starts, at[:-1])] = 0x0A if before is None else before
        marked = prior == 0x20
        ahead = bool(before == 0x20 and len(starts) and starts[0] == 0)  # its marker ends the part before
        h = hashes(whole, starts, ends)
        h = np.where(marked, h, h ^ np.uint64(0x5851F42D4C957F2D))
        # what is learned gets a byte before it: a space or a newline
        index = self._index(h, whole, starts, ends, marked)
        counts = sums(self.count.values[index], starts, at)
        scores = sums(self.score.values[index], starts, at)
        # spaces that don't mark a word, and newlines
        space = (whole == 0x20).astype(np.int64)
        space[starts[marked & (starts > 0)] - 1] = 0
        line = (whole == 0x0A).astype(np.int64)
        for flags, (c, s) in ((space, self.lone), (line, self.newline)):
            total = np.concatenate([[0], np.cumsum(flags)])
            n = total[at[1:]] - total[at[:-1]]
            counts = counts + n * c
            scores = scores + n * s
        return (counts - self.lone[0], scores - self.lone[1]) if ahead else (counts, scores)

    def _index(self, h, whole, starts, ends, marked):
        framed = np.concatenate([np.array([0x0A], np.uint8), whole])
        # a word behind anything but a space is taken as behind a newline
        framed[starts] = np.where(marked, 0x20, 0x0A)
        return self.table.index(h, framed, starts, ends + 1)


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep, n_tokens and best_score of every row's whole text.

    A null or empty text has 0 tokens and score 0; a text of any length is counted a slice at a time,
    one without spaces with as many places as the longest piece spans. Ties between paths go as the
    module says. Repeated rows are counted each by itself; an empty table gives no rows; other columns
    don't matter. path: a sentencepiece model file, by default the public 32k vocabulary.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Batch(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts, scores = count(column)
            data, offs = utf8(column)
            raw = data[offs[0] : offs[-1]].tobytes() if len(column) else b""
            if _MARK_BYTES in raw:
                for i, one in enumerate(column):
                    if one.as_py() and MARK in one.as_py():
                        counts[i], scores[i] = count.counter.whole(one.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), pa.array(scores)], [*batch.schema.names[:-1], "n_tokens", "best_score"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return arrow(chosen, run, f"{schema}, n_tokens bigint, best_score double")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
