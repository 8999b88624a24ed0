"""Operator 4, toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to letters and leaves words of letters
with one space between. Entries are words or word beginnings; their weights are log-odds learned
from labelled rows. Matches inside exception phrases don't count. A text's weight, as a sum and by
its length, goes through a logistic function that is fitted on the same rows.

Only labelled rows outside the held-out fold are learned from, at most FIT_ROWS of them (the ones
with the least hash of their key); scores see nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, saved, slices, table, utf8
from .words import SPACE, Column, WordTable, hashes, spans, sums

#: Labelled rows that the lexicon and the logistic function are fitted on.
FIT_ROWS = 20_000
#: Letters of a word beginning that can become an entry.
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
MIN_SUPPORT = 3
MIN_LOG_ODDS = 2.0

#: Letters of other scripts that look like Latin ones, and common substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i", "ⅼ": "l", "ǀ": "l",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a"}
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")
_FULL_WIDTH = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTIONS) | str.maketrans(dict.fromkeys(INVISIBLE, "")) | {k: SUBSTITUTIONS.get(v.lower(), v.lower()) for k, v in _FULL_WIDTH.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
_DOLLAR = re.compile(r"(?<=[^\W\d_])\$(?=[^\W\d_])")

#: Words that are entries before anything is learned, and phrases in which an entry is harmless.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "clown fish", "soap scum", "pond scum")
SEED_WEIGHT = 3.0


def fold(text: str) -> str:
    """The folded words of a text with a space before and behind each: " like this "."""
    folded = text.lower().translate(_FOLD)
    if "$" in folded:
        folded = _DOLLAR.sub("s", folded)
    words = _LETTERS.findall(folded)
    return f" {' '.join(words)} " if words else " "


def features(folded: str) -> set[str]:
    """Word beginnings (" idio") and whole words (" idiot ") of a folded text."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
        for n in PREFIXES:
            if len(word) < n:
                break
            out.add(f" {word[:n]}")
    return out


def _features_of(text: str) -> set[str]:
    """The features of a whole text, a slice at a time."""
    raw, out = np.frombuffer(text.encode("utf-8", "replace"), np.uint8), set()
    for _, part, _, _ in slices(raw, np.array([0, len(raw)]), SPACE):
        out |= features(fold(part.tobytes().decode("utf-8", "replace")))
    return out


class Lexicon:
    """Entries with weights; the logistic function's three numbers."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, bias: float = -3.0, total: float = 3.0, density: float = 0.0):
        self.weights, self.exceptions = weights, tuple(exceptions)
        self.bias, self.total, self.density = bias, total, density
        #: Words of the longest exception.
        self.reach = max((len(fold(e).split()) for e in self.exceptions), default=1)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            self.automaton.add_word(f" {fold(phrase).strip()} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def weight(self, folded: str) -> float:
        """The weight of all matches outside exceptions: of a word's entries, the greatest."""
        if self.automaton is None:
            self._build()
        if not len(self.automaton):
            return 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if not spared:
            return sum(best.values())
        total, free = 0.0, 0  # one sweep: exceptions by their start, and how far they reach so far
        spared.sort()
        at = 0
        for start in sorted(best):
            while at < len(spared) and spared[at][0] <= start:
                free = max(free, spared[at][1])
                at += 1
            if start >= free:
                total += best[start]
        return total

    def inputs(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.inputs(weight, words) @ np.array([self.bias, self.total, self.density])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> None:
        """Newton steps of a logistic regression with a light penalty."""
        x, beta = self.inputs(weight, words), np.zeros(3)
        penalty = np.diag([1e-3, 0.05, 0.05])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        self.bias, self.total, self.density = beta.tolist()


class Weigher:
    """Weights and numbers of words of whole batches. Words are looked up in a bounded table; texts
    with any match are then matched as a whole, so that exception phrases are seen."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.hit = lexicon, Column(np.float64)
        # no exceptions here: a word alone can't tell
        self.alone = Lexicon(lexicon.weights, ())
        self.table = WordTable(self._learn, self.hit.clear)

    def _learn(self, words: list[bytes]) -> None:
        self.hit.extend([self.alone.weight(fold(w.decode("utf-8", "replace"))) for w in words])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = utf8(column)
        weight, words = np.zeros(len(column)), np.zeros(len(column))
        for rows, part, at, _ in slices(data, offs, SPACE):
            starts, ends = spans(part, at, SPACE)
            index = self.table.index(hashes(part, starts, ends), part, starts, ends)
            weight[rows] += sums(self.hit.values[index], starts, at)
            words[rows] += np.diff(np.searchsorted(starts, at))
        for i in np.flatnonzero(weight > 1e-9).tolist():
            weight[i] = self._whole(data[offs[i] : offs[i + 1]])
        return weight, words

    def _whole(self, raw: np.ndarray) -> float:
        """The weight of a whole text, a slice at a time. The last words of a slice are seen again with
        the next one, for an exception phrase may begin there; what they weighed alone is taken off."""
        total, tail = 0.0, " "
        for _, part, _, _ in slices(raw, np.array([0, len(raw)]), SPACE):
            folded = fold(part.tobytes().decode("utf-8", "replace"))
            together = tail + folded[1:]
            total += self.lexicon.weight(together) - (self.lexicon.weight(tail) if len(tail) > 1 else 0.0)
            tail = " " + "".join(f"{w} " for w in together.split()[-self.lexicon.reach :])
        return total


def _held_out(key: SparkColumn) -> SparkColumn:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fold. Without any, the seeds with a fixed weight.

    Rows without key or label teach nothing; of several labels of a key the greatest counts; documents
    of one key share its label. exceptions: phrases in which entries are harmless.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(~_held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__toxic"))
    # fit_rows bounds what is broadcast here and gathered below
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = saved(docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id").select("__toxic", "__text"))

    def count(wanted: frozenset[str] | None, toxic: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for batch in batches:
                for one in batch.column(0):
                    own = _features_of(one.as_py() or "")
                    found.update(own if wanted is None else own & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])

        counted = arrow(rows.filter(F.col("__toxic") == toxic).select("__text"), run, "feature string, n bigint")
        return counted.groupBy("feature").agg(F.sum("n").alias("n"))

    sizes = {r["__toxic"]: r["n"] for r in rows.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    weights = {f" {w}": SEED_WEIGHT for w in SEEDS}
    if not p or not n:
        return Lexicon(weights, exceptions)
    likely = {r["feature"]: r["n"] for r in count(None, 1).filter(F.col("n") >= max(MIN_SUPPORT, p // 500)).collect()}
    wanted = frozenset(likely) | frozenset(weights)
    against = {r["feature"]: r["n"] for r in count(wanted, 0).collect()}
    threshold = 2 * math.log(len(wanted))
    odds, surprise = {}, {}
    for feature in wanted:
        a, b = likely.get(feature, 0), against.get(feature, 0)
        odds[feature] = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))
        expected = (a + b) * p / (p + n)
        surprise[feature] = 2 * a * math.log(a / expected) + (2 * b * math.log(b / (a + b - expected)) if b else 0) if a else 0
    chosen: dict[str, float] = {}
    longer: set[str] = set()  # beginnings of chosen entries
    # of entries of which one begins the other, the one that tells more; of equal ones the longest, so
    # that no entry takes in more words than the labels show, but endings stay open
    for feature in sorted(wanted, key=lambda f: (-surprise[f], -len(f.strip()), f.endswith(" "), f)):
        if odds[feature] < MIN_LOG_ODDS or surprise[feature] < threshold:
            continue
        if feature in longer or any(feature[:k] in chosen for k in range(2, len(feature))):
            continue
        chosen[feature] = round(odds[feature], 4)
        longer.update(feature[:k] for k in range(2, len(feature)))
    for seed, weight in weights.items():  # a seed stays unless the labels speak against it
        unseen = not likely.get(seed) and not against.get(seed)
        if seed not in longer and not any(seed[:k] in chosen for k in range(2, len(seed) + 1)) and (unseen or odds[seed] > 1):
            chosen[seed] = weight
    lexicon = Lexicon(chosen, exceptions)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(lexicon)
        for batch in batches:
            weight, words = weigher(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(words)], ["toxic", "weight", "words"])

    fitted = arrow(rows, weigh, "toxic int, weight double, words double").toPandas()
    fitted = fitted.sort_values(["toxic", "weight", "words"])
    lexicon.fit(fitted["weight"].to_numpy(), fitted["words"].to_numpy(), fitted["toxic"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, weight, score (0 to 1) and predicted (1 if score >= 0.5) of every row's whole text.

    A null or empty text has weight 0 and the score of any text without a match; texts of any length
    are weighed whole. Of entries that begin at the same letter the heaviest counts. Every one of
    repeated rows is scored; an empty table gives no rows; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(lexicon)
        for batch in batches:
            weight, words = weigher(batch.column(batch.num_columns - 1))
            found = lexicon.score(weight, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "weight", "score", "predicted"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return arrow(chosen, run, f"{schema}, weight double, score double, predicted int")


def clean(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns; null and empty texts stay."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(lexicon)
        for batch in batches:
            yield batch.filter(pa.array(lexicon.score(*weigher(batch.column(place))) < 0.5))

    return arrow(docs, run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "weight")
