"""Background jobs as a log: latest states, retention, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error")
ACTIVE = ("queued", "running")
RETAIN = 200
PUBLIC = ("job_id", "status", "stage", "progress", "detail", "error", "result")
INTERRUPTED = "interrupted by restart"


def latest(jobs: DataFrame, statuses: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """The newest job of each document among some statuses; of equally new ones the least job id. jobs(job_id, doc_id, status, mtime)."""
    wanted = jobs.filter(F.col("status").isin(*statuses))
    order = F.struct(F.col("mtime").alias("mtime"), (-F.col("job_id")).alias("minus"))
    return wanted.groupBy(key).agg(F.max_by(F.struct("job_id", "status", "mtime"), order).alias("j")).select(key, "j.job_id", "j.status", "j.mtime")


def registry(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """The latest finished narration of each live document."""
    return latest(jobs, ("done",)).join(live.select("doc_id").distinct(), "doc_id", "left_semi")


def view_state(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, job_id, state): an active job, else a finished narration, else idle."""
    active = latest(jobs, ACTIVE).select("doc_id", F.col("job_id").alias("a"))
    done = latest(jobs, ("done",)).select("doc_id", F.col("job_id").alias("d"))
    rows = docs.select("doc_id").distinct().join(active, "doc_id", "left").join(done, "doc_id", "left")
    state = F.when(F.col("a").isNotNull(), "active").when(F.col("d").isNotNull(), "done").otherwise("idle")
    return rows.select("doc_id", F.coalesce("a", "d").alias("job_id"), state.alias("state"))


def retention_delete(jobs: DataFrame, keep: int = RETAIN) -> DataFrame:
    """Finished jobs beyond the newest `keep` (later paths first among equals), only when there are over `keep` jobs at all.

    The boundary is the keep-th greatest (mtime, path), found by a top-k; no task sorts all jobs.
    """
    total = jobs.limit(keep + 1).count()
    done = jobs.filter(F.col("status").isin(*TERMINAL))
    if total <= keep:
        return done.limit(0)
    newest = done.orderBy(F.desc("mtime"), F.desc("path")).limit(keep).select("job_id")
    return done.join(F.broadcast(newest), "job_id", "left_anti")  # at most keep rows


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: active ones have failed."""
    stopped = F.col("status").isin(*ACTIVE)
    return jobs.withColumn("error", F.when(stopped, F.lit(INTERRUPTED)).otherwise(F.col("error"))).withColumn("status", F.when(stopped, F.lit("error")).otherwise(F.col("status")))


def active_ids(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs.filter((F.col("kind") == kind) & F.col("status").isin(*ACTIVE)).select("job_id")


def public(jobs: DataFrame) -> DataFrame:
    """The public fields, missing ones as nulls."""
    return jobs.select(*(F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c) for c in PUBLIC))


def last_wins(sources: DataFrame) -> DataFrame:
    """(item_key, title): of several sources(item_key, title, priority) the one with the greatest priority."""
    return sources.groupBy("item_key").agg(F.max_by("title", "priority").alias("title"))


def row_status(items: DataFrame, ready: DataFrame, narrated: DataFrame) -> DataFrame:
    """(item_key, status, playable) for a listing."""
    r = ready.select("item_key").distinct().withColumn("r", F.lit(True))
    n = narrated.select("item_key").distinct().withColumn("p", F.lit(True))
    rows = items.join(r, "item_key", "left").join(n, "item_key", "left")
    status = F.when(F.col("doi").isNull(), "not mappable").when(F.col("r"), "check").otherwise("")
    return rows.select("item_key", status.alias("status"), F.coalesce("p", F.lit(False)).alias("playable"))


def window_rank(jobs: DataFrame) -> DataFrame:
    """Rank of each finished job within its document, newest first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("mtime"), "job_id")
    return jobs.filter(F.col("status").isin(*TERMINAL)).withColumn("rank", F.row_number().over(order))


def by_family(jobs: DataFrame) -> DataFrame:
    """(family, status, jobs): one log for all families of jobs."""
    return jobs.groupBy("family", "status").agg(F.count(F.lit(1)).alias("jobs"))
