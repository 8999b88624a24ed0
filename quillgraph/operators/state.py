"""Derived state: which writes count after a reset, states of jobs from their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import few, written
from .intervals import indexed, running

#: Order in which a job's states follow each other.
STEPS = {"queued": 0, "running": 1, "done": 2, "error": 2}
NO_TEXT = "no text found"


def accepted_writes(writes: DataFrame, resets: DataFrame) -> DataFrame:
    """(store, write_id, generation, accepted) of writes(store, write_id, claimed_at, committed_at) and resets(store, at).

    A writer claims the generation of its store and may commit only in the same one: every reset begins a
    new generation, at the very moment it happens. Generations are running counts within each store.
    """
    events = resets.select("store", F.col("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("write_id"))
    for kind, column in ((1, "claimed_at"), (2, "committed_at")):
        events = events.unionByName(writes.select("store", F.col(column).alias("at"), F.lit(kind).alias("kind"), F.col("write_id").cast("bigint").alias("write_id")))
    # numbers from range partitions and sums of blocks: no store's events meet in one task
    ordered = written(indexed(events.withColumn("n", F.when(F.col("kind") == 0, 1).otherwise(0)), ["store", "at", "kind", "write_id"]).withColumnRenamed("index", "enter"))
    counted = written(running(ordered, F.col("n")))
    before = written(counted.groupBy(F.col("store").alias("__store")).agg(F.min(F.col("upto") - F.col("n")).alias("before")))
    counted = counted.filter("kind > 0").join(few(before), F.col("store").eqNullSafe(F.col("__store"))).withColumn("generation", F.col("upto") - F.col("before"))
    both = counted.groupBy("store", "write_id").agg(F.max(F.when(F.col("kind") == 1, F.col("generation"))).alias("generation"), F.max(F.when(F.col("kind") == 2, F.col("generation"))).alias("last"))
    return both.select("store", "write_id", "generation", (F.col("generation") == F.col("last")).alias("accepted"))


def fold_log(log: DataFrame) -> DataFrame:
    """(job_id, status, since, entries) of a log(job_id, status, at): each job's state by the order of states.

    The first terminal entry ends a job, later ones are ignored; an entry of an earlier state never takes a
    job back. One aggregate with partial sums, however long a job's log is.
    """
    step = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))[F.col("status")]
    # the furthest step, of terminal entries the first, of others the first too: when the state was entered
    best = log.withColumn("step", step).groupBy("job_id").agg(F.min(F.struct((-F.col("step")).alias("minus"), "at", "status")).alias("b"), F.count(F.lit(1)).alias("entries"))
    return best.select("job_id", F.col("b.status").alias("status"), F.col("b.at").alias("since"), "entries")


CANCELLED = "cancelled"


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs(job_id, status, ...) with `error` after requests(job_id): queued ones end before they start, running ones at their next step, others stay."""
    asked = jobs.join(requests.select("job_id").distinct().withColumn("__asked", F.lit(True)), "job_id", "left")
    ends = F.coalesce("__asked", F.lit(False)) & F.col("status").isin("queued", "running")
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return asked.withColumn("error", F.when(ends, CANCELLED).otherwise(error)).withColumn("status", F.when(ends, "error").otherwise(F.col("status"))).drop("__asked")


def cleared(log: DataFrame) -> DataFrame:
    """A log without the entries of jobs that have ended."""
    ended = fold_log(log).filter(F.col("status").isin("done", "error")).select("job_id")
    return log.join(ended, "job_id", "left_anti")


def audio_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, file): of files(name) the first "*--<job>.mp3", else "<job>.mp3", else null."""
    named = files.select("name", F.regexp_extract("name", r"^(?:.*--)?([^-]*)\.mp3$", 1).alias("of")).filter("of <> ''")
    own = named.groupBy("of").agg(F.min(F.when(F.col("name").contains("--"), F.col("name"))).alias("titled"), F.min(F.when(~F.col("name").contains("--"), F.col("name"))).alias("plain"))
    return jobs.select("job_id").join(own, F.col("job_id").cast("string") == F.col("of"), "left").select("job_id", F.coalesce("titled", "plain").alias("file"))


def narration_start(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, status, error): documents whose text is blank fail at once, all others are queued."""
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", F.lit(True))
    return docs.select(key, F.when(blank, "error").otherwise("queued").alias("status"), F.when(blank, NO_TEXT).alias("error"))
