"""Incremental maps, the job machine, paged lookups and the title index against plain versions of themselves."""

import datetime
import json
import random

import pytest
from helpers import bag
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import citations, matching
from quillgraph.operators.jobs import INTERRUPTED
from quillgraph.sources import lookups
from quillgraph.streaming import machine, maps
from quillgraph.streaming.records import newest

# incremental maps


def _record(key, status, fetched, refs):
    entries = [(i, t, 2000 + n, None, None, n) for n, (i, t) in enumerate(refs)]
    return (key, status, 2, "2020-01-01", len(refs), None, entries, [], datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=fetched))


def _batches(n, seed):
    """Records that come, change, lose entries, become misses, come again unchanged or too late."""
    random.seed(seed)
    clock, out = 0, []
    for _ in range(n):
        rows = []
        for _ in range(random.randint(0, 12)):
            clock += 1
            refs = [(random.choice(["w1", "w2", "w3", "hot", None, ""]), random.choice([None, "A", "B"])) for _ in range(random.randint(0, 5))] + [("hot", "Hot")] * random.randint(0, 2)
            rows.append(_record(f"k{random.randrange(9)}", random.choice(["mapped", "mapped", "not_found"]), clock - random.choice([0, 0, 0, 15]), refs))
        out.append(rows)
    return out


def _full(spark, batches, selection, items):
    rows = [r for b in batches for r in b]
    records = newest(spark.createDataFrame(rows, maps.RECORD))
    none = selection.limit(0).select("item_key", F.lit("").alias("path"))
    return citations.citation_map(selection, records, items, none)


def _selection(spark):
    # k8 and k0 aren't selected
    selection = spark.createDataFrame([(f"k{i}", 20 - i) for i in range(1, 8)], "item_key string, sel_pos bigint")
    return selection, selection.select("item_key", F.lit("T").alias("title"), F.lit("1999").alias("year"))


def test_map_equals_a_full_rebuild_after_each_batch(spark, tmp_path):
    selection, items = _selection(spark)
    none = selection.limit(0).select("item_key", F.lit("").alias("path"))
    live = maps.IncrementalMap(spark, str(tmp_path / "m"), selection, buckets=6, spread=2)
    batches = _batches(5, 3)
    assert live.last() == -1 and live.edges().count() == 0
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, maps.RECORD)
        live.apply(frame, number)
        if number == 2:  # runs again after a failure
            live.apply(frame, number)
        nodes, edges = _full(spark, batches[: number + 1], selection, items)
        assert bag(live.nodes(items, none).toPandas()) == bag(nodes.toPandas())
        assert bag(live.edges().toPandas()) == bag(edges.toPandas())
    assert live.last() == 4


def test_only_touched_buckets_are_read(spark, tmp_path):
    selection = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "item_key string, sel_pos bigint")
    live = maps.IncrementalMap(spark, str(tmp_path / "m"), selection, buckets=32, spread=4)
    live.apply(spark.createDataFrame([_record(f"k{i}", "mapped", i, [(f"w{i}", None), ("hot", None)]) for i in range(200)], maps.RECORD), 0)
    assert len(live.touched[0]) > 25
    read = []
    for store in (live.records, live.entries):
        store.read = lambda upto, buckets=None, f=store.read: (read.append(buckets), f(upto, buckets))[1]
    live.apply(spark.createDataFrame([_record("k5", "mapped", 999, [("w5", None), ("new", None)])], maps.RECORD), 1)
    # one record; the work that came and the one that lost a mention
    assert len(live.touched[0]) == 1 and len(live.touched[1]) <= 2 and read == [live.touched[0], read[1]] and sorted(read[1]) == live.touched[1]
    # the entries of one work lie in several buckets
    places = live.entries.versions()
    homes = {b for b in places if live.entries.read(1, [b]).filter("id = 'hot'").count()}
    assert 1 < len(homes) <= 4
    # an unchanged record touches nothing of the map
    live.apply(spark.createDataFrame([_record("k5", "mapped", 1500, [("w5", None), ("new", None)])], maps.RECORD), 2)
    assert live.touched[1] == []


def test_map_follows_a_folder_and_starts_again(spark, tmp_path):
    selection, items = _selection(spark)
    none = selection.limit(0).select("item_key", F.lit("").alias("path"))
    batches = _batches(4, 8)
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, maps.RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if number % 2:  # a new object and a new query each time
            live = maps.IncrementalMap(spark, str(tmp_path / "m"), selection, buckets=6, spread=2)
            live.follow(str(tmp_path / "in"), str(tmp_path / "c"), files=1).awaitTermination()
            nodes, edges = _full(spark, batches[: number + 1], selection, items)
            assert bag(live.nodes(items, none).toPandas()) == bag(nodes.toPandas()) and bag(live.edges().toPandas()) == bag(edges.toPandas())


# the job machine

HOUR = datetime.timedelta(hours=1)
START = datetime.datetime(2024, 1, 1)


def _entry(job, hours, kind, generation=1, stage=None, progress=None, detail=None):
    return (job, START + hours * HOUR, kind, generation, stage, progress, detail)


def _final(log, patience):
    """The machine's rule applied entry by entry, then the silent ones."""
    jobs = {}
    for job, at, kind, *rest in sorted(log, key=lambda e: (e[1], machine._ORDER[e[2]])):
        micros = int((at - START) / datetime.timedelta(microseconds=1))
        jobs[job] = jobs.get(job, machine.Job()).after(kind, micros, *rest, patience=int(patience * 3.6e9))
    now = int((max(e[1] for e in log) - START) / datetime.timedelta(microseconds=1))
    jobs = {k: j.failed(INTERRUPTED, j.heard + int(patience * 3.6e9)) if j.silent(now, int(patience * 3.6e9)) else j for k, j in jobs.items()}
    return {k: (j.status, j.stage, j.progress, j.error, START + datetime.timedelta(microseconds=j.since)) for k, j in jobs.items() if j.status}


def test_rules_of_the_machine():
    log = [
        _entry(1, 0, "queued"), _entry(1, 1, "progress", 1, "a", 5), _entry(1, 2, "done"),
        _entry(2, 0, "queued"), _entry(2, 1, "cancel"), _entry(2, 2, "progress", 1, "a", 5), _entry(2, 3, "done"),
        _entry(3, 0, "progress", 1, "a", 5), _entry(3, 1, "cancel"), _entry(3, 2, "done"),
        _entry(4, 0, "progress", 1, "a", 5), _entry(4, 1, "cancel"), _entry(4, 2, "progress", 1, "b", 9),
        _entry(5, 0, "progress", 1, "a", 5), _entry(5, 1, "progress", 2, "b", 9), _entry(5, 2, "done", 2),
        _entry(6, 0, "progress", 1, "a", 5), _entry(6, 1, "failed", 1, None, None, "no luck"), _entry(6, 2, "done"),
        _entry(7, 0, "progress", 1, "a", 5), _entry(7, 9, "done"),
        _entry(8, 5, "progress", 1, "a", 5), _entry(9, 8, "progress", 1, "a", 7), _entry(10, 0, "queued"), _entry(11, 3, "cancel"), _entry(12, 3, "done"),
    ]
    found = {k: v[0:2] + v[3:] for k, v in _final(log, 3).items()}
    at = lambda h: START + h * HOUR
    assert found == {
        1: ("done", "done", None, at(2)),
        2: ("error", "queued", "cancelled", at(2)),
        3: ("done", "done", None, at(2)),
        4: ("error", "a", "cancelled", at(2)),
        5: ("error", "a", machine.RESET, at(1)),
        6: ("error", "a", "no luck", at(1)),
        7: ("error", "a", INTERRUPTED, at(3)),
        8: ("error", "a", INTERRUPTED, at(8)),
        9: ("running", "a", None, at(8)),
        10: ("queued", "queued", None, at(0)),
    }


@pytest.mark.parametrize("parts", [1, 4])
def test_any_batching_gives_the_same_states(spark, tmp_path, parts):
    random.seed(5)
    kinds = ["progress", "progress", "progress", "progress", "queued", "cancel", "done", "failed"]
    log = [_entry(random.randrange(25), h + random.random() / 2, random.choice(kinds), 1 + (h > 70), f"s{h % 3}", h % 100, "broken") for h in range(140)]
    log.sort(key=lambda e: e[1])
    for k in range(parts):
        rows = log[len(log) * k // parts : len(log) * (k + 1) // parts]
        spark.createDataFrame(rows, machine.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each time another query over the same checkpoint
        stream = spark.readStream.schema(machine.LOG).parquet(str(tmp_path / "in"))
        machine.follow(spark, stream, str(tmp_path / "states"), str(tmp_path / "checkpoint"), 12).awaitTermination()
    now = spark.createDataFrame([(log[-1][1],)], "now timestamp")
    found = {r["job_id"]: (r["status"], r["stage"], r["progress"], r["error"], r["since"]) for r in machine.states_at(spark, str(tmp_path / "states"), 12, now).collect()}
    assert found == _final(log, 12) and len({v[3] for v in found.values()}) >= 4


# paged lookups


class Scripted:
    """Gives each cursor's answers one after the other, the last again and again."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def get(self, request, cursor, attempt):
        self.asked.append((cursor, attempt))
        answers = self.pages.get(cursor, [(404, None, None)])
        return answers[min(attempt, len(answers) - 1)]


def _page(ids, following=None):
    return {"results": ids, "next_cursor": following}


def test_walk():
    ids = lambda service, **k: list(lookups.walk(service, "r", sleep=pauses.append, **k))
    pauses = []
    two = {"*": [(200, _page(["a", None, "b"], "n"), None)], "n": [(200, _page(["c"]), None)]}
    assert ids(Scripted(two)) == ["a", "b", "c"] and ids(Scripted(two), limit=2) == ["a", "b"] and list(lookups.walk(Scripted(two), "")) == list(lookups.walk(Scripted(two), None)) == []
    assert ids(Scripted({"*": [(200, _page(["a"], "n"), None)], "n": [(200, _page([], "m"), None)], "m": [(200, _page(["x"]), None)]})) == ["a"]  # an empty page ends it
    assert ids(Scripted({"*": [(200, _page(["a"], "n"), None)]})) == ["a"] and ids(Scripted({})) == [] and ids(Scripted({"*": [(400, None, None)]})) == []
    assert pauses == []
    flaky = Scripted({"*": [(503, None, None), (429, None, 99.0), (200, _page(["a"], "n"), None)], "n": [(500, None, None)]})
    assert ids(flaky) == ["a"] and pauses == [0.5, 8.0, 0.5, 1.0, 2.0] and flaky.asked == [("*", 0), ("*", 1), ("*", 2), ("n", 0), ("n", 1), ("n", 2), ("n", 3)]
    assert [lookups.pause(a, None) for a in (0, 1, 5)] == [0.5, 1.0, 10.0]


def _recording(spark, keys):
    results = spark.createDataFrame([(f"r{k}", i, f"r{k}-{i}") for k in keys for i in range(1, 20 + 7 * k)], "request string, rank int, id string")
    pages = lookups.paged(results, 10).select("request", "cursor", F.lit(200).alias("status"), F.when((F.col("request") == "r3") & (F.col("page") == 1), 9).otherwise(1).alias("fails"), F.lit(None).cast("double").alias("retry_after"), "results", "next_cursor")
    wanted = {f"r{k}": [f"r{k}-{i}" for i in range(1, 20 + 7 * k)][: 10 if k == 3 else 30] for k in keys}
    return spark.createDataFrame([(f"r{k}",) for k in keys] + [("unknown",), (None,)], "request string"), pages, wanted


def _lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["request"], r["position"])):
        out.setdefault(r["request"], []).append(r["id"])
        assert r["position"] == len(out[r["request"]]) - 1
    return out


def test_paged_source_equals_a_plain_walk(spark, tmp_path):
    lookups.register(spark)
    requests, pages, wanted = _recording(spark, range(8))
    lookups.record(requests, pages, str(tmp_path / "r"), 3)
    assert _lists(spark.read.format(lookups.FORMAT).option("limit", 30).load(str(tmp_path / "r")).collect()) == wanted
    (tmp_path / "e").mkdir()
    assert spark.read.format(lookups.FORMAT).load(str(tmp_path / "e")).count() == 0


def test_paged_stream_asks_for_nothing_twice(spark, tmp_path):
    lookups.register(spark)
    wanted, seen = {}, []

    def take(rows, number):
        seen.append((number, rows.collect()))

    for k in range(3):
        requests, pages, more = _recording(spark, range(3 * k, 3 * k + 3))
        lookups.record(requests, pages, str(tmp_path / "r"), 2)
        wanted |= more
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.format(lookups.FORMAT).option("limit", 30).load(str(tmp_path / "r"))
            stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and _lists([r for _, rows in seen for r in rows]) == wanted
    assert json.loads((tmp_path / "r" / "parts.json").read_text()) == {"parts": 6}


def test_a_reader_holds_the_pages_of_one_request(spark, tmp_path, monkeypatch):
    requests, pages, wanted = _recording(spark, range(40))
    lookups.record(requests, pages, str(tmp_path / "r"), 1)
    monkeypatch.setattr(lookups, "ROWS", 2)
    service, most = lookups.Recording(str(tmp_path / "r"), 0), 0
    for r in [*sorted(wanted), "r0", "none", "r1"]:  # the last three out of order
        assert list(lookups.walk(service, r, 30, lambda s: None)) == wanted.get(r, [])
        most = max(most, len(service.pages))
    assert 1 < most == pages.groupBy("request").count().agg(F.max("count")).first()[0]


def test_batches_of_fifty(spark):
    refs = spark.createDataFrame([("a", p, f"w{p % 120}") for p in range(240)] + [("a", 500, ""), ("b", 0, "w1"), ("b", 1, "none")], "item_key string, ref_pos int, id string")
    works = spark.createDataFrame([(f"w{i}", f"T{i}") for i in range(120)], "id string, title string")
    failed = spark.createDataFrame([("a", 1), ("a", 1)], "item_key string, batch int")
    rows = lookups.resolved_in_batches(refs, works, failed).collect()
    found = {(r["item_key"], r["id"]): (r["batch"], r["title"]) for r in rows}
    assert len(rows) == 122 and all(found["a", f"w{i}"] == (i // 50, None if i // 50 == 1 else f"T{i}") for i in range(120)) and found["b", "none"] == (0, None) and found["b", "w1"] == (0, "T1")


# the title index


def _plain_matches(queries, titles):
    """Every query against every title."""
    tokens = lambda s: set("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    out = {}
    for number, query in queries:
        ql, ranked = " ".join((query or "").lower().split()), []
        for place, doc, title in titles:
            tl = (title or "").lower()
            asked, own = tokens(query or ""), tokens(title or "")
            score = len(asked & own) / len(asked) if asked and own else 0.0
            rule, score = (0, 1.0) if doc == query else (1, 1.0) if ql and (ql in tl or tl in ql) else (2, score) if score >= matching.ACCEPT else (3, score)
            ranked.append((rule, -score, place, doc))
        best = min(ranked)
        if best[0] < 3 or len(titles) == 1:
            out[number] = (best[3], best[0], -best[1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_title_index_equals_all_pairs(spark, seed):
    random.seed(seed)
    words = ["deep", "nets", "of", "a", "text", "é", "be", "ab", "zz", "mining", "of the"]
    some = lambda n: " ".join(random.choice(words) for _ in range(random.randrange(n)))
    titles = [(i, f"d{i}", random.choice([None, "", some(3), some(6)]) if i % 9 == 0 and seed else some(6).title() or "Deep") for i in range(40 if seed != 3 else 1)]
    queries = [(0, None), (1, ""), (2, " "), (3, "d7"), (4, "B"), (5, "EE"), (6, "xyz"), (7, "ne  ts"), (8, "x\ty")] + [(10 + i, random.choice([some(9), some(4).upper(), "  " + some(5), some(3)[:-1], some(6)[1:]])) for i in range(60)]
    frames = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(titles, "ord int, doc_id string, title string")
    found = matching.resolve_titles(*frames)
    assert {r["query_id"]: (r["doc_id"], r["rule"], r["score"]) for r in found.collect()} == _plain_matches(queries, titles)
    if seed == 0:
        text = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        # the one nested loop is that with the row of the empty title
        assert text.count("NestedLoop") <= 1 and "CartesianProduct" not in text


def test_containment(spark):
    random.seed(11)
    some = lambda: "".join(random.choice("ab ") for _ in range(random.randint(1, 9)))
    inner, outer = {some() for _ in range(60)}, {some() for _ in range(60)} | {"😀ab", "b😀"}
    frame = lambda rows: spark.createDataFrame([(s,) for s in rows], "s string")
    found = {(r["s"], r["whole"]) for r in matching.contained(frame(inner | {"😀"}), frame(outer)).collect()}
    assert found == {(s, w) for s in inner | {"😀"} for w in outer if s in w}
    assert spark.range(1).select(X.contains_either(F.lit("ab"), F.lit("b"))).first()[0]


def test_pages_are_dealt_by_order_and_request_alone(spark):
    import re

    from helpers import DATA

    from quillgraph.plans import live

    plan = live._pages(spark, DATA)[1]._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\w+", "", k).split(", ")[:-1] for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert keys and all(k in (["l_orderkey"], ["o_orderkey"], ["request"]) for k in keys)
