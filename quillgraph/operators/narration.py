"""From page blocks to text, chunks, digests, a script and speech chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as X
from ..storage import ship

CHUNK_CHARS = 3500
#: Marks that end a sentence before a space, the preferred first; else a part ends at a space.
SENTENCE_ENDS = ".?!"
PASSED = "OK"


def reading_order(blocks: DataFrame) -> DataFrame:
    """Text blocks of pages in reading order: (doc_id, pos, page, text) of blocks(doc_id, page, width, x0, y0, x1, y1, text, kind).

    Left column before right, then by top edge (one decimal) and left edge; positions count from 0
    within a page.
    """
    from pyspark.sql import Window

    kept = blocks.filter((F.coalesce("kind", F.lit(0)) == 0) & (X.collapse_ws(F.coalesce("text", F.lit(""))) != ""))
    column = L.page_column(F.col("x0"), F.col("x1"), F.col("width"))
    order = Window.partitionBy("doc_id", "page").orderBy(column, F.round("y0", 1), "x0", "y0", "text")
    return kept.select("doc_id", "page", (F.row_number().over(order) - 1).alias("pos"), X.collapse_ws(F.col("text")).alias("text"))


def document_texts(ordered: DataFrame) -> DataFrame:
    """(doc_id, text): a document's blocks by page and position, one a line, without its bibliography."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "text"))), lambda b: b["text"])
    return ordered.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text")).select("doc_id", X.strip_bibliography(F.col("text")).alias("text"))


def _places(flat: str) -> list[tuple[np.ndarray, int]]:
    """Where each kind of separator stands, the kinds that are preferred first, and how many characters it has."""
    code = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    blank = code == ord(" ")
    ends = [(np.flatnonzero((code[:-1] == ord(mark)) & blank[1:]), 2) for mark in SENTENCE_ENDS]
    return [*ends, (np.flatnonzero(blank), 1)]


def _last_within(places: np.ndarray, low: int, high: int) -> int | None:
    """The last of ascending places from low to high."""
    k = int(np.searchsorted(places, high, side="right")) - 1
    return int(places[k]) if k >= 0 and places[k] >= low else None


def chunk(text: str | None, size: int = CHUNK_CHARS) -> list[str]:
    """Cuts a text into parts of at most `size` characters, white space collapsed.

    All separators are found once. A part ends behind the last separator, of the best kind that has one,
    among the `size` characters from its begin on; where that is its first character, or there is none, it
    is `size` long.
    """
    flat = re.sub(r"\s+", " ", text or "").strip()
    kinds, begins = _places(flat), [0]
    while (edge := begins[-1] + size) < len(flat):
        last = (_last_within(places, begins[-1], edge - width) for places, width in kinds)
        best = next((p for p in last if p is not None), begins[-1])
        begins.append(best + 1 if best > begins[-1] else edge)
    parts = (flat[a:b].strip() for a, b in pairwise([*begins, len(flat)]))
    return [p for p in parts if p]


def chunks(docs: DataFrame, size: int = CHUNK_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, chunk); each cut depends on the one before, so it is an Arrow-batched function."""

    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk(t, size) for t in texts])

    return docs.select(key, F.posexplode(cut(text)).alias("pos", "chunk"))


def with_model(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a model's answers. model gets a list of prompts; any callable will do, so tests use a plain one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: model(frame[prompt].tolist())})

    ship(prompts.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{schema}, `{out}` string")


def digest_prompts(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """One prompt for each chunk with its number and how many there are."""
    sizes = cut.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = cut.join(sizes, key)
    prompt = F.format_string("Part %d of %d of a paper. Sum up its claims, methods and results in plain sentences.\n\n%s", F.col("pos") + 1, F.col("n"), F.col("chunk"))
    return rows.select(key, "pos", prompt.alias("prompt"))


def compose_prompts(digests: DataFrame, key: str = "doc_id", answer: str = "answer") -> DataFrame:
    """One prompt for each document: its digests in order, an empty line between."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(answer).alias("a")))), lambda x: x["a"])
    joined = digests.groupBy(key).agg(F.array_join(parts, "\n\n").alias("digests"))
    return joined.select(key, F.concat(F.lit("Write a spoken narration of a paper from these notes.\n\n"), "digests").alias("prompt"), "digests")


def checked(notes: DataFrame, note: str = "note") -> DataFrame:
    """A failed check never blocks: a missing note reads as passed."""
    return notes.withColumn(note, F.coalesce(X.blank_to_null(X.ws_trim(F.col(note))), F.lit(PASSED)))


def speech(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, chunk): cleaned text in chunks for synthesis."""
    return docs.select(key, F.posexplode(X.speech_chunks(X.clean_for_speech(F.col(text)))).alias("pos", "chunk"))


def minutes(parts: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, duration_min) of parts(key, ms)."""
    return parts.groupBy(key).agg(F.round(F.sum("ms") / 60000, 2).alias("duration_min"))


def byte_shares(files: DataFrame) -> DataFrame:
    """(kind, bytes, percent) of files(kind, bytes): totals and their share of all bytes."""
    sums = files.groupBy("kind").agg(F.sum("bytes").alias("bytes"))
    total = sums.agg(F.sum("bytes").alias("total"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("kind", "bytes", (100.0 * F.col("bytes") / F.col("total")).alias("percent"))
