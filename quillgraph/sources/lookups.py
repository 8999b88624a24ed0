"""Paged lookups at a service, as a data source: what cites a work, page by page, and works by id in batches.

`paged_lookups` walks the pages of every request: it begins at the cursor FIRST, follows `next_cursor`,
and stops at a page without results, without a next cursor, after `limit` results, or where the service
gives nothing (not found, or still failing after ATTEMPTS tries); what came before stays. Requests that
fail are tried again after growing pauses. The batch reader has a partition for each part of the
requests; the streaming reader takes the parts that have come since the last batch, and its offset is the
number of parts taken, so a restart asks for nothing twice that a finished batch has.

Here the service is a recording (see record()): parts of requests beside the pages that answer them.
Another one is a subclass of PagedLookups whose service() gives an object with get().
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..storage import ship

#: Fixed values of the service: the first cursor, results a page, most results a request, ids a batch.
FIRST, PAGE, LIMIT, BATCH = "*", 50, 100, 50
#: Tries of a request that fails, and seconds between them: doubled from the first pause, up to the longest; a pause that the service asks for counts up to its own limit.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE, LONGEST_ASKED = 4, 0.5, 10.0, 8.0
#: Answers after which a request is tried again.
TRANSIENT = (429, 500, 502, 503, 504)
FORMAT = "paged_lookups"
PAGES = "request string, cursor string, status int, fails int, retry_after double, results array<string>, next_cursor string"
SCHEMA = "request string, position int, id string"


def pause(attempt: int, asked: float | None) -> float:
    """Seconds to wait after a failed try."""
    return min(asked, LONGEST_ASKED) if asked is not None else min(FIRST_PAUSE * 2**attempt, LONGEST_PAUSE)


def answer(service, request: str, cursor: str, sleep=time.sleep) -> dict | None:
    """A page, or None for what isn't there or fails for good."""
    for attempt in range(ATTEMPTS):
        status, page, asked = service.get(request, cursor, attempt)
        if status not in TRANSIENT:
            return page if status == 200 else None
        if attempt < ATTEMPTS - 1:
            sleep(pause(attempt, asked))
    return None


def walk(service, request: str | None, limit: int = LIMIT, sleep=time.sleep) -> Iterator[str]:
    """The ids of a request's pages in their order; results without an id are passed over. No request, no ids."""
    cursor, found = FIRST, 0
    while request and cursor and found < limit:
        page = answer(service, request, cursor, sleep)
        if not page or not page["results"]:
            return
        for i in page["results"]:
            if i and found < limit:
                found += 1
                yield i
        cursor = page["next_cursor"]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


#: Rows, and bytes of a column, that a reader holds.
ROWS, COLUMN_BYTES = 512, 1 << 20


def _rows(path: str) -> Iterator[dict]:
    """The rows of a folder of Parquet files, a small batch at a time, for a page has many ids."""
    fs, folder = _store(path)
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f, buffer_size=COLUMN_BYTES).iter_batches(batch_size=ROWS):
                    yield from batch.to_pylist()


class Recording:
    """A service that answers from one part of a recording, of which it holds the pages of one request.

    A part is in the order of requests, and so are the questions; what is asked out of order is looked for
    from the beginning.
    """

    def __init__(self, path: str, part: int):
        self.path = f"{path}/pages/part={part}"
        self._begin()

    def _begin(self) -> None:
        self.request, self.pages = None, {}
        self.groups = groupby((p for p in _rows(self.path) if p["request"] is not None), key=lambda p: p["request"])
        self.ahead = next(self.groups, None)

    def _seek(self, request: str) -> None:
        """Takes the pages of a request, none if the part has none."""
        if self.request is not None and request < self.request:
            self._begin()
        while self.ahead and self.ahead[0] < request:
            self.ahead = next(self.groups, None)
        self.request, self.pages = request, {p["cursor"]: p for p in self.ahead[1]} if self.ahead and self.ahead[0] == request else {}

    def get(self, request: str, cursor: str, attempt: int) -> tuple[int, dict | None, float | None]:
        """Status, page, and the pause that the service asks for."""
        if request != self.request:
            self._seek(request)
        page = self.pages.get(cursor)
        if page is None:
            return 404, None, None
        if attempt < page["fails"]:
            return 503, None, page["retry_after"]
        return page["status"], page, None


@dataclass
class Part(InputPartition):
    number: int


class _Walker:
    """What both readers share."""

    def __init__(self, source: PagedLookups):
        self.source, self.path, self.limit = source, source.options["path"], int(source.options.get("limit", LIMIT))

    def parts(self) -> int:
        """How many parts the recording has by now."""
        return recorded_parts(self.path)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        service, rows = self.source.service(partition.number), []
        for r in _rows(f"{self.path}/requests/part={partition.number}"):
            rows += [(r["request"], k, i) for k, i in enumerate(walk(service, r["request"], self.limit, self.source.sleep))]
            if len(rows) > 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    requests, places, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(requests, pa.string()), pa.array(places, pa.int32()), pa.array(ids, pa.string())], names=["request", "position", "id"])


class LookupReader(_Walker, DataSourceReader):
    def partitions(self) -> list[Part]:
        return [Part(k) for k in range(self.parts())] or [Part(-1)]  # a part that nobody wrote has no rows


class LookupStream(_Walker, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": self.parts()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(k) for k in range(start["parts"], end["parts"])]

    def commit(self, end: dict) -> None:
        """Parts stay; the next batch begins behind them."""


class PagedLookups(DataSource):
    """Options: path (of a recording), limit (results a request)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def service(self, part: int):
        return Recording(self.options["path"], part)

    @staticmethod
    def sleep(seconds: float) -> None:
        """A recording needs no pauses; a live service takes time.sleep."""

    def reader(self, schema) -> LookupReader:
        return LookupReader(self)

    def streamReader(self, schema) -> LookupStream:
        return LookupStream(self)


def register(spark: SparkSession, source: type[PagedLookups] = PagedLookups) -> None:
    ship(spark)
    spark.dataSource.register(source)


def recorded_parts(path: str) -> int:
    """The parts of a recording, 0 if there is none."""
    fs, folder = _store(path)
    name = f"{folder}/parts.json"
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return 0
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())["parts"]


def record(requests: DataFrame, pages: DataFrame, path: str, parts: int) -> None:
    """Adds requests(request) and the pages (columns of PAGES) that answer them to a recording, as so many parts more.

    A part is what one task walks. It is written in the order of requests, so that a reader holds the pages
    of one request, whatever the size of a part. Readers see the new parts when all is written.
    """
    first = recorded_parts(path)
    part = (F.lit(first) + F.pmod(F.xxhash64("request"), F.lit(parts))).cast("int").alias("part")
    for name, rows in (("requests", requests.select("request").distinct()), ("pages", pages)):
        rows.select("*", part).repartition("part").sortWithinPartitions("part", "request").write.mode("append").partitionBy("part").parquet(f"{path}/{name}")
    fs, folder = _store(path)
    with fs.open_output_stream(f"{folder}/parts.json") as f:
        f.write(json.dumps({"parts": first + parts}).encode())


def paged(results: DataFrame, size: int = PAGE) -> DataFrame:
    """Pages (request, cursor, results, next_cursor) of results(request, rank, id), ranks from 1: how a service cuts a sorted answer."""
    page = F.floor((F.col("rank") - 1) / size)
    cut = results.groupBy("request", page.alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]).alias("results"))  # at most `size`
    last = results.groupBy("request").agg(F.max(page).alias("last"))
    mark = lambda p: F.when(p == 0, FIRST).otherwise(F.concat(F.lit("after-"), p.cast("string")))
    return cut.join(last, "request").select("request", "page", mark(F.col("page")).alias("cursor"), "results", F.when(F.col("page") < F.col("last"), mark(F.col("page") + 1)).alias("next_cursor"))


def resolved_in_batches(refs: DataFrame, works: DataFrame, failed: DataFrame, size: int = BATCH) -> DataFrame:
    """(item_key, id, batch, title): each list's ids without repeats and blanks, in batches; works(id, title) that a batch finds.

    A batch in failed(item_key, batch) is passed over: its ids stay, without a title, like unknown ones.
    """
    from ..operators.citations import lookup_batches

    asked = lookup_batches(refs, size)
    answered = asked.join(failed.select("item_key", "batch").distinct().withColumn("lost", F.lit(True)), ["item_key", "batch"], "left").join(works.select("id", "title"), "id", "left")
    return answered.select("item_key", "id", "batch", F.when(F.col("lost").isNull(), F.col("title")).alias("title"))
