"""Operator 3, mixing sources to target weights. DataFrame functions only.

Tokens are summed per source; weights give each source a target and so a repetition rate; every
document is emitted floor(rate) times and once more by a draw of its own, whose probability is the
rate's fraction: a hash of its key and size, under the source's seed, lies below the fraction.

A few long documents can carry a source, so that one set of independent draws may miss its target by
far. Therefore SEEDS seeds are tried for each source, all in one aggregate, and the one whose draws
come nearest to the target is taken (rerandomisation). Draws stay independent of each other under
every seed, and over many base seeds a document that is small in its source is drawn with the
fraction as its frequency; one that alone outweighs the target's tolerance is drawn when that helps.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Seeds that are tried for each source; the prime of the draws' hash family.
SEEDS, PRIME = 64, (1 << 31) - 1
#: Sources up to which what is known of each is broadcast.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: runs without white space, counted without an array of them."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("bigint")


def positions(sources: DataFrame, by: list[Column]) -> DataFrame:
    """sources with position (from 0) in the order `by`, without bringing them to one task."""
    spread = saved(sources.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each partition of the small table of sources
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.withColumn("__part", part).join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("position", own + F.col("__before")).drop("__at", "__part", "__before")


def targets(sources: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """sources(source, source_size) with weight and target.

    A target stops at max_rate times the source's size; what is over is shared again by weight until
    no target is above. Every round is one aggregate over the sources and stops at least one more.
    """
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = saved(
        positions(sources, [F.col("source").asc_nulls_last()]).select(
            "source", "source_size", cycle[(F.col("position") % len(weights)).cast("int")].cast("bigint").alias("weight")
        )
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(max_rate) * F.col("source_size")
    unit = None  # words for each weight
    while True:
        stopped = F.lit(False) if unit is None else F.lit(unit) * F.col("weight") > cap
        row = ranked.agg(F.sum(F.when(stopped, cap)).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight"), F.count_if(stopped).alias("n")).first()
        following = (total - (row["held"] or 0)) / row["weight"] if row["weight"] else math.inf
        if following == unit or unit is not None and row["n"] == held:
            break
        unit, held = following, row["n"]
    target = F.least(F.lit(float(unit)) * F.col("weight"), cap.cast("double")) if math.isfinite(unit) else cap.cast("double")
    return ranked.withColumn("target", target)


def _multipliers(base: int) -> list[tuple[int, int]]:
    """The two numbers of each seed, below PRIME, from the md5 of base and the seed's number."""
    digest = lambda k, part: int(hashlib.md5(f"{part}:{base}:{k}".encode()).hexdigest()[:8], 16)
    return [(1 + digest(k, "a") % (PRIME - 1), digest(k, "b") % PRIME) for k in range(SEEDS)]


def _document_hash(key: Column, size: Column) -> Column:
    """A number below PRIME; rows of one key and size share it. A missing key is an empty text."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def _draw(h: Column, a: Column, b: Column) -> Column:
    """The hash of a document under a seed, in [0, 1)."""
    return ((a * h + b) % F.lit(PRIME)) / F.lit(float(PRIME))


def _seeded(sized: DataFrame, aims: DataFrame, max_rate: int, base: int) -> DataFrame:
    """aims with each source's rate, fraction and the numbers of its seed: one aggregate over all documents."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    rated = aims.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))
    rows = _with_source(sized, rated)
    numbers = _multipliers(base)
    taken = [F.sum(F.when(_draw(F.col("h"), F.lit(a), F.lit(b)) < F.col("fraction"), F.col("size")).otherwise(F.lit(0).cast("bigint"))) for a, b in numbers]
    sums = rows.groupBy("__source").agg(F.first("fraction").alias("__f"), F.first("source_size").alias("__n"), F.array(*taken).alias("took"))
    off = F.transform("took", lambda t, k: F.struct(F.abs(t - F.col("__f") * F.col("__n")).alias("off"), k.alias("k")))
    chosen = sums.select(F.col("__source").alias("__of"), F.array_min(off)["k"].alias("seed"))
    pairs = F.array(*(F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in numbers))
    return rated.join(chosen, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("__ab", pairs[F.coalesce("seed", F.lit(0))]).drop("__of", "seed")


def _with_source(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """rows with what is known of their source."""
    many = plan.limit(FEW_SOURCES + 1).count() > FEW_SOURCES
    return rows.join(plan if many else F.broadcast(plan), F.col(source).eqNullSafe(F.col("__source")))


def _plan(docs: DataFrame, text: str, key: str, source: str, weights, max_rate: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and one row for each source."""
    size = F.coalesce(word_count(F.col(text)), F.lit(0)).cast("bigint")
    sized = saved(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size")).withColumn("h", _document_hash(F.col("id"), F.col("size"))))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(per_source, weights, max_rate).select(F.col("source").alias("__source"), "source_size", "target")
    return sized, saved(_seeded(sized, saved(aims), max_rate, seed))


def _copies(h: Column) -> Column:
    extra = F.when(_draw(h, F.col("__ab")[0], F.col("__ab")[1]) < F.col("fraction"), F.lit(1)).otherwise(F.lit(0))
    return (F.floor("rate") + extra).cast("bigint")


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0) -> DataFrame:
    """key, source, size, source_size, target, copies for every row.

    A null or empty text has size 0; a null source is a source of its own, the last. A source without
    words has target 0 and no copies. Rows of one key and size draw alike, repeated ones too; ties
    between seeds go to the first. Texts are only counted, so that their length doesn't matter. An
    empty table gives no rows; other columns don't matter.
    """
    sized, plan = _plan(docs, text, key, source, weights, max_rate, seed)
    rows = _with_source(sized, plan)
    return rows.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", _copies(F.col("h")).alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = 0) -> DataFrame:
    """docs, each row as often as copies() says, with its own columns. No text is shuffled: a draw needs only its row."""
    _, plan = _plan(docs, text, key, source, weights, max_rate, seed)
    plan = plan.select("__source", "rate", "fraction", "__ab")
    own = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("__row"))
    row = lambda n: F.col("__row").getField(n)
    size = F.coalesce(word_count(row(text)), F.lit(0)).cast("bigint")
    joined = _with_source(own.withColumn("__from", row(source)), plan, "__from").withColumn("__copies", _copies(_document_hash(row(key), size)))
    return joined.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*(row(n).alias(n) for n in docs.columns))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM s
), u AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM r
), t AS (
  SELECT min_by(unit, k) AS unit FROM u WHERE unit * weight <= 3 * source_size
), p AS (
  SELECT source, source_size, least(t.unit * weight, (3 * source_size)::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN least(least(t.unit * weight, (3 * source_size)::DOUBLE) / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM s, t
), h AS (
  SELECT d.doc_id, d.size, p.*, rate - floor(rate) AS fraction, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || size)[1:8])::BIGINT % {PRIME} AS h
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), seeds AS (
  SELECT k, 1 + ('0x' || md5('a:0:' || k)[1:8])::BIGINT % {PRIME - 1} AS a, ('0x' || md5('b:0:' || k)[1:8])::BIGINT % {PRIME} AS b FROM (SELECT unnest(range({SEEDS})) AS k)
), tried AS (
  SELECT source, k, any_value(a) AS a, any_value(b) AS b,
         abs(sum(CASE WHEN ((a * h + b) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE < fraction THEN size ELSE 0 END)::DOUBLE - any_value(fraction) * any_value(source_size)) AS off
  FROM h, seeds GROUP BY source, k
), best AS (
  SELECT source, a, b FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM tried) WHERE n = 1
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN ((a * h + b) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE < fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h JOIN best ON best.source IS NOT DISTINCT FROM h.source
"""
