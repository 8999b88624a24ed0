"""Background jobs as a state machine over a stream of log entries.

A log has rows (job_id, at, kind, generation, stage, progress, detail). Kinds: `queued`, `progress` (the
first one starts the job), `done`, `failed`, `cancel` (somebody asks for it). Rules:

* A job claims the generation of the store when it starts. An entry of its worker under another
  generation ends it with the error RESET.
* A request to cancel takes effect at the job's next progress (the start too): it ends with the error
  `cancelled`. A job that is done before that stays done.
* A running job from which nothing was heard for `patience` is interrupted, at the end of that time.
* What has ended stays as it is; entries that make no sense in a state are passed over.

The state is one row a job. Timers on event time end silent jobs while the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.jobs import INTERRUPTED
from ..storage import ship

CANCELLED, RESET = "cancelled", "derived state was reset"
LOG = "job_id bigint, at timestamp, kind string, generation bigint, stage string, progress int, detail string"
STATES = "job_id bigint, status string, stage string, progress int, error string, since timestamp, heard timestamp, entries bigint"
#: The place of kinds that have the same time.
_ORDER = {"queued": 0, "cancel": 1, "progress": 2, "failed": 3, "done": 4}
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Job:
    """A job's state; times in microseconds."""

    status: str | None = None
    stage: str | None = None
    progress: int | None = None
    error: str | None = None
    since: int | None = None
    heard: int | None = None
    generation: int | None = None
    asked: bool = False
    entries: int = 0

    @property
    def ended(self) -> bool:
        return self.status in ("done", "error")

    def failed(self, error: str, at: int) -> Job:
        return replace(self, status="error", error=error, since=at)

    def silent(self, now: int, patience: int) -> bool:
        return self.status == "running" and now > self.heard + patience

    def after(self, kind: str, at: int, generation: int | None, stage: str | None, progress: int | None, detail: str | None, patience: int) -> Job:
        """The state after an entry of the log."""
        job = replace(self, entries=self.entries + 1)
        if job.ended:
            return job
        if job.silent(at, patience):
            return job.failed(INTERRUPTED, job.heard + patience)
        if kind == "cancel":
            return replace(job, asked=True)
        if kind == "queued":
            return job if job.status else replace(job, status="queued", stage="queued", progress=0, since=at)
        if kind == "progress" and job.status != "running":
            if job.asked:
                return job.failed(CANCELLED, at)
            return replace(job, status="running", stage=stage, progress=progress, since=at, heard=at, generation=generation)
        if job.status != "running":
            return job
        if kind == "failed":
            return job.failed(detail or "error", at)
        if generation != job.generation:
            return job.failed(RESET, at)
        if kind == "progress":
            return job.failed(CANCELLED, at) if job.asked else replace(job, stage=stage, progress=progress, heard=at)
        return replace(job, status="done", stage="done", progress=100, since=at) if kind == "done" else job


_FIELDS = "status string, stage string, progress int, error string, since bigint, heard bigint, generation bigint, asked boolean, entries bigint"


class JobMachine(StatefulProcessor):
    """Keeps a Job for each key; gives its row whenever entries or a timer have changed it."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _FIELDS)

    def _timer(self, job: Job) -> int:
        """Fires at the first watermark after this millisecond."""
        return (job.heard + self.patience) // 1000 + 1

    def _keep(self, key: Any, before: Job, job: Job) -> Row:
        self.state.update((job.status, job.stage, job.progress, job.error, job.since, job.heard, job.generation, job.asked, job.entries))
        old, new = (self._timer(j) if j.status == "running" else None for j in (before, job))
        if old != new and old is not None:
            self.handle.deleteTimer(old)
        if old != new and new is not None:
            self.handle.registerTimer(new)
        return Row(job_id=key[0], status=job.status, stage=job.stage, progress=job.progress, error=job.error, since=job.since, heard=job.heard, entries=job.entries)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = job = Job(*self.state.get()) if self.state.exists() else Job()
        # the entries of one job in one batch
        for r in sorted(rows, key=lambda r: (r.micros, _ORDER[r.kind])):
            job = job.after(r.kind, r.micros, r.generation, r.stage, r.progress, r.detail, self.patience)
        yield self._keep(key, before, job)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        job = Job(*self.state.get())
        if job.status == "running" and expiredTimerInfo.getExpiryTimeInMs() >= self._timer(job):
            ended = job.failed(INTERRUPTED, job.heard + self.patience)
            yield self._keep(key, job, ended)

    def close(self) -> None:
        pass


def job_states(log: DataFrame, patience_hours: float, late: str = "0 seconds") -> DataFrame:
    """A streaming frame of a streaming log: rows of STATES, each replacing earlier ones of its job."""
    machine = JobMachine(int(patience_hours * 3_600_000_000))
    # times go in and out as microseconds, which no time zone touches
    timed = log.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    rows = timed.groupBy("job_id").transformWithState(machine, STATES.replace("timestamp", "bigint"), "Update", "EventTime")
    return rows.withColumn("since", F.timestamp_micros("since")).withColumn("heard", F.timestamp_micros("heard"))


def follow(spark: SparkSession, log: DataFrame, states: str, checkpoint: str, patience_hours: float):
    """Starts a query over a streaming log of LOG; each batch's changed rows go to states/batch=<number>.

    A batch that runs again overwrites its own rows. The state is kept by Spark's RocksDB store in the
    checkpoint, so a restart goes on where the last run stopped. The setting of the store is the session's.
    """
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{states}/batch={number}")
    return job_states(log, patience_hours).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states_at(spark: SparkSession, states: str, patience_hours: float, now: Any = None) -> DataFrame:
    """(job_id, status, stage, progress, error, since): the last row of every job that has a state.

    now (a one-row frame's column `now`): a job that was silent for longer than patience by then is
    interrupted, even if no batch has come since to fire its timer.
    """
    rows = spark.read.schema(STATES + ", batch bigint").parquet(states)
    fields = [c for c in rows.columns if c not in ("job_id", "batch")]
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("entries", "batch")).alias("s")).select("job_id", "s.*").filter("status IS NOT NULL")
    if now is not None:
        end = F.col("heard") + F.make_dt_interval(hours=F.lit(int(patience_hours)), mins=F.lit(round(patience_hours * 60) % 60))
        gone = (F.col("status") == "running") & (F.col("now") > end)
        last = last.crossJoin(F.broadcast(now)).select("job_id", F.when(gone, "error").otherwise(F.col("status")).alias("status"), "stage", "progress", F.when(gone, INTERRUPTED).otherwise(F.col("error")).alias("error"), F.when(gone, end).otherwise(F.col("since")).alias("since"))
    return last.select("job_id", "status", "stage", "progress", "error", "since")
