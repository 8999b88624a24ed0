"""Operator 12, embedding whitening: vectors on the unit-variance principal components of their set.

Residue-number scatter. Entries are quantised to integers x = floor(scale * c). Over the fit list (each
distinct x vector once) n and the sums S are exact, and so are the centred integers n*x - S. Their scatter
matrix, which would need hundreds of bits, is computed modulo several primes below 2^20: each partition
multiplies blocks of residues as doubles, which is exact for 4,096 rows, and keeps sums modulo each prime.
Partial sums of partitions meet in a tree. The Chinese remainder theorem gives the exact scatter from the
residues; over n^3 it is the covariance, rounded once, whose eigenvectors are found in doubles.

How many primes are needed follows from n and the largest centred entry, so no sum can overflow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, saved, table

#: Entries become floor(SCALE * entry).
SCALE = 256
#: Components of the query.
COMPONENTS = 4
#: Rows of a block: products of two residues below 2^20, summed over so many rows, stay below 2^53.
BLOCK_ROWS = 4096
_PRIME_BITS = 20
#: Partial scatters that one task adds up.
FAN_IN = 64
_LONG = (1 << 63) - 1


@cache
def primes(count: int) -> list[int]:
    """The largest primes below 2^20."""
    out, n = [], (1 << _PRIME_BITS) - 1
    while len(out) < count:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            out.append(n)
        n -= 2
    return out


def reconstructed(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Integers (as Python's) from their residues modulo each prime (first axis), taken nearest to zero."""
    product = math.prod(moduli)
    total = np.zeros(residues.shape[1:], object)
    for part, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + part.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


@dataclass
class Whitening:
    """A fitted whitening. Eigenvalues fall; a component is a column, its largest entry positive."""

    n: int
    sums: list[int]
    scatter: np.ndarray  # of n*x - S, exact integers
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def usable(self, count: int) -> np.ndarray:
        """Which of the first components have variance beyond rounding errors."""
        e = self.eigenvalues[:count]
        return e > self.dimension * np.finfo(float).eps * max(self.trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles: the whole part of S/n is taken off as an integer."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        if max(map(abs, whole)) < 1 << 62 and (not len(x) or max(int(x.max()), -int(x.min())) < 1 << 62):
            off = (x - np.array(whole, np.int64)).astype(float)
        else:
            off = (x.astype(object) - np.array(whole, object)).astype(float)
        return off - np.array([r / self.n for r in rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2 over the dimensions; None where it exceeds a long."""
        if not len(x):
            return []
        most = max(self.n * max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, self.sums)))
        if 4 * most * most * self.dimension <= _LONG:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return [d if d <= _LONG else None for d in (y * y).sum(axis=1)]

    def whitened(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first components' coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable(count), 1 / np.sqrt(np.abs(self.eigenvalues[:count])), np.nan)
        return self.centred(x) @ self.components[:, :count] * scale


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors with a column `x` of long entries, without rows whose vector is null, empty, or holds a null or non-finite entry, and without vectors of another length than most have (ties: the shorter).

    Entries whose multiple exceeds a long become the nearest long.
    """
    entry = F.col(vector)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    sound = vectors.filter(entry.isNotNull() & (F.size(entry) > 0) & ~bad)
    usual = sound.groupBy(F.size(entry).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return vectors.filter(F.lit(False)).withColumn("x", F.lit(None).cast("array<bigint>"))
    return sound.filter(F.size(entry) == usual["size"]).withColumn("x", F.transform(entry, lambda c: F.floor(c.cast("double") * scale)))


def _totals(distinct: DataFrame) -> tuple[int, list[int], int]:
    """n, the sums of all dimensions and the largest absolute entry, exactly: halves of 32 bits are added apart."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, most = 0, 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
                most = max(most, min(_LONG, -int(x.min())), int(x.max()))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "most": [most], "high": [high.tolist()], "low": [low.tolist()]})

    parts = arrow(distinct.select("x"), part, "n bigint, most bigint, high array<bigint>, low array<bigint>")
    rows = (
        parts.select("n", "most", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
        .groupBy("at")
        .agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
        .orderBy("at")
        .collect()
    )
    return (rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows], rows[0]["most"]) if rows else (0, [], 0)


def _added(parts: DataFrame, moduli: list[int], schema: str) -> DataFrame:
    """One row of residues a task, the sum of all that it reads."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                one = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64).reshape(len(moduli), -1)
                first = batch.column(0)[k].as_py() if first is None else first
                total = one if total is None else (total + one) % np.array(moduli)[:, None]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [first // FAN_IN], "residues": [total.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("residues", pa.binary())]))

    return arrow(parts, add, schema)


def scatter(distinct: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """The exact scatter matrix of n*x - S over the rows of a written table, as Python integers."""
    d = len(sums)
    bound = n * (n * (most + 1) + max(map(abs, sums))) ** 2
    moduli = primes((2 * bound).bit_length() // (_PRIME_BITS - 1) + 1)
    sums_of = [np.array([s % p for s in sums], np.int64) for p in moduli]
    schema = "part bigint, residues binary"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), d, d), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(k, BLOCK_ROWS))
                for j, p in enumerate(moduli):
                    y = ((x % p * (n % p) - sums_of[j]) % p).astype(float)
                    total[j] = (total[j] + (y.T @ y).astype(np.int64)) % p
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "residues": [total.tobytes()]})

    parts, count = arrow(distinct.select("x"), multiply, schema), distinct.rdd.getNumPartitions()
    while count > 1:
        count = math.ceil(count / FAN_IN)
        parts = _added(parts.repartition(count, F.floor(F.col("part") / FAN_IN)), moduli, schema)
    raw = parts.collect()[0]["residues"]
    return reconstructed(np.frombuffer(raw, np.int64).reshape(len(moduli), d, d), moduli)


def _solve(n: int, sums: list[int], exact: np.ndarray) -> Whitening:
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in exact.tolist()], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(sums))] < 0, -1.0, 1.0)
    return Whitening(n, sums, exact, values, vectors, sum(int(exact[i, i]) for i in range(len(sums))) / cube)


def _identity_error(distinct: DataFrame, model: Whitening, count: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over usable components."""
    kept = int(model.usable(count).sum())
    if not kept:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column(0)), kept)
                total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"w": [np.append(total.ravel(), mean).tolist()]})

    rows = arrow(distinct.select("x"), part, "w array<double>").select(F.posexplode("w").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    values = np.array([r["v"] for r in rows]) / model.n
    # rows are centred before they are multiplied; what is left of their mean is a rounding error
    mean = values[kept * kept :]
    return float(np.abs(values[: kept * kept].reshape(kept, kept) - np.outer(mean, mean) - np.eye(kept)).max())


def fit(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors of `x` (see quantised); None if there are none.

    Equal vectors are reduced within tasks before they are shuffled, so a vector that many rows share is
    no hot key. The driver gets sums and one matrix of dimension squared, whatever the number of rows.
    """
    distinct = saved(vectors.select("x").distinct())
    n, sums, most = _totals(distinct)
    if not n:
        return None
    model = _solve(n, sums, scatter(distinct, n, sums, most))
    model.identity_error = _identity_error(distinct, model, min(components or model.dimension, model.dimension))
    return model


def transform(vectors: DataFrame, model: Whitening, components: int | None = None) -> DataFrame:
    """vectors with `deviation` and `whitened` (array, null for components without variance); other columns stay."""
    count = min(components or model.dimension, model.dimension)
    kept = [c for c in vectors.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(kept)))
            w = model.whitened(x, count)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * count), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.deviations(x), pa.int64()), lists], names=[*kept, "deviation", "whitened"])

    schema = vectors.select(*(F.col(f"`{c}`") for c in kept), F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema
    return arrow(vectors.select(*(F.col(f"`{c}`") for c in kept), "x"), run, schema)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every sound vector.

    A vector is left out if it is null, empty, holds a null or non-finite entry, or has another length than
    most. Repeated rows and rows without key each have rows; repeated vectors count once in the fit. A
    component without variance (one distinct vector, or fewer directions than components) has a null
    whitened, and identity_error is over the others, null without any. explained is null if nothing varies.
    deviation is null where it exceeds a long. An empty table gives no rows; other columns don't matter.
    """
    # the key has a name of its own, so that no other column can clash with it
    x = quantised(vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")), "__vector", scale).select("__key", "x")
    model = fit(x, components)
    kind = x.schema["__key"].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shares = [max(0.0, float(e)) / model.trace if model.trace > 0 else None for e in model.eigenvalues[:components]]
    explained = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("component"))
    return (
        transform(x, model, components)
        .select(F.col("__key").alias(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .withColumn("component", F.col("at") + 1)
        .select(key, "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
