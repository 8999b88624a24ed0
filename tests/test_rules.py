"""Hand-written cases of the rules."""

import datetime
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import layout as L
from quillgraph.functions import text as X
from quillgraph.operators import citations, components, jobs, library, matching, narration, state, timeline, tree
from quillgraph.plans import queries
from quillgraph.sources import tables
from quillgraph.streaming import records


def values(spark, rule, *inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_doi(spark):
    given = ["https://DX.doi.org/10.1/AbC ", "doi.org/10.2/x", " 10.3/Y\n", "https://doi.org/", "", None, "http://dx.doi.org/ 10.4/z"]
    assert values(spark, X.normalize_doi, *given) == ["10.1/abc", "10.2/x", "10.3/y", None, None, None, "10.4/z"]
    assert values(spark, X.strip_doi_address, "HTTPS://doi.org/10.1/AbC", "https://dx.doi.org/1", "", None) == ["10.1/AbC", "https://dx.doi.org/1", None, None]


def test_small_text_rules(spark):
    assert values(spark, X.short_id, "https://x.org/W1//", "W2", None) == ["W1", "W2", ""]
    assert values(spark, X.first_year, "May 2019-2020", "no", None, "in 12345") == ["2019", None, None, "1234"]
    assert values(spark, X.slug, "  A Title: of (Things)! ", "é", None, "x" * 70, "a" * 59 + " b") == ["a-title-of-things", "", "", "x" * 60, "a" * 59]
    assert values(spark, X.title_tokens, "A red, red Fox", "") == [["a", "red", "fox"], []]
    assert values(spark, X.ws_trim, "  a b\t\n") == ["a b"]
    assert values(spark, X.html_escape, "a<b & c>") == ["a&lt;b &amp; c&gt;"]
    assert values(spark, lambda c: X.passage_hit(F.lit("The end of it all. And more"), c), "the END of", "the", "nothing here", "so. The end of it all. And more...", "", "the end. ") == [True, True, False, True, False, False]
    # dots go from the very end only, and short blocks never count
    assert values(spark, lambda c: X.passage_hit(c, F.lit("abc. def ghi")), "abc.", "abc", "abc. d", "ABC. DEF GHI...") == [False, False, True, True]


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        units = s.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    given = ["", "abc", "é", "😀x"]
    assert values(spark, X.fnv1a, *given) == [fnv(s) for s in given]
    assert values(spark, X.palette_index, "ab", "", None) == [(97 * 31 + 98) % 15, None, None]


def test_authors(spark):
    links = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 2), (1, 4, 3), (2, 4, 0)], "itemID int, creatorID int, orderIndex int")
    people = spark.createDataFrame([(1, "Doe", "Jo", 0), (2, "Group", "x", 1), (3, None, "Solo", 0), (4, "", "", 0)], "creatorID int, lastName string, firstName string, fieldMode int")
    assert {r["itemID"]: r["authors"] for r in library.authors(links, people).collect()} == {1: ["Group", "Doe, Jo", "Solo"]}


def test_library_items(spark):
    items = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 2, "C"), (4, 3, "D"), (5, 1, "E")], "itemID int, itemTypeID int, key string")
    types = spark.createDataFrame([(1, "journalArticle"), (2, "note"), (3, "thesis")], "itemTypeID int, typeName string")
    data = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (4, 1, 4)], "itemID int, fieldID int, valueID int")
    vals = spark.createDataFrame([(1, "T"), (2, "no year"), (3, "doi.org/10.1/A"), (4, "")], "valueID int, value string")
    fields = spark.createDataFrame([(1, "title"), (2, "date"), (3, "DOI"), (9, "extra")], "fieldID int, fieldName string")
    gone = spark.createDataFrame([(5,)], "itemID int")
    found = {r["item_key"]: r for r in library.library_items(items, types, data, vals, fields, gone).collect()}
    assert set(found) == {"A", "B", "D"}
    assert (found["A"]["title"], found["A"]["year"], found["A"]["doi"]) == ("T", None, "10.1/a")
    assert found["B"]["title"] is None and found["D"]["is_book_default_off"]
    assert {r["doc_id"]: r["title"] for r in library.papers(spark.createDataFrame([(r["item_key"], r["title"]) for r in found.values()], "item_key string, title string")).collect()} == {"A": "T", "B": "B", "D": "D"}


def test_attachments(spark):
    att = spark.createDataFrame([(1, 10, "application/pdf", 0, "STORAGE:a.pdf"), (2, 10, "application/pdf", 0, "storage:b.pdf"), (3, 11, "application/pdf", 1, "storage:c.pdf"), (4, 12, "text/html", 0, "storage:d")], "itemID int, parentItemID int, contentType string, linkMode int, path string")
    items = spark.createDataFrame([(i, f"K{i}") for i in range(1, 5)], "itemID int, key string")
    files = spark.createDataFrame([("/s/K2/b.pdf",), ("/s/K3/c.pdf",)], "path string")
    assert [tuple(r) for r in library.primary_attachments(att, items, files, "/s/").collect()] == [(10, "/s/K2/b.pdf")]


def test_tree(spark):
    # 4 has a missing parent, 5 and 6 are a cycle, 7 hangs on it
    nodes = spark.createDataFrame([(1, None, ""), (2, 1, "b"), (3, 2, "c"), (4, 99, "d"), (5, 6, "e"), (6, 5, "f"), (7, 6, "g")], "id bigint, parent bigint, name string")
    assert {r["id"]: (r["depth"], r["path"]) for r in tree.forest(nodes).collect()} == {1: (0, ""), 2: (1, "b"), 3: (2, "b / c"), 4: (0, "d")}
    pairs = {tuple(r) for r in tree.closure(nodes).select("ancestor", "id").collect()}
    assert {(1, 3), (2, 3), (5, 6), (6, 5), (5, 5), (5, 7)} <= pairs and (3, 1) not in pairs
    start = spark.createDataFrame([(1,), (42,)], "id bigint")
    assert {tuple(r) for r in tree.descendants(nodes, start).collect()} == {(1, 1), (1, 2), (1, 3), (42, 42)}
    assert {tuple(r) for r in tree.descendants(nodes, start, False).collect()} == {(1, 1), (42, 42)}
    members = spark.createDataFrame([(2, "x"), (3, "x"), (3, "y"), (5, "z"), (8, "w")], "id bigint, item_key string")
    counts = {r["id"]: r["item_count"] for r in tree.subtree_item_counts(nodes, members).collect()}
    assert (counts[1], counts[2], counts[3], counts[4], counts[6]) == (2, 2, 2, 0, 1)
    assert {tuple(r) for r in tree.primary_paths(members, tree.forest(nodes)).collect()} == {("x", "b"), ("y", "b / c"), ("z", ""), ("w", "")}


def _cache(spark, tmp_path):
    entry = {"id": "W1", "title": "One", "year": 2001, "citedBy": 5}
    cache = {
        "A": {"status": "mapped", "v": 2, "citedBy": 3, "date": "2010-05-01", "references": [entry, "W2", {"id": "W1", "title": "Late"}, {"title": "no id"}]},
        "B": {"status": "mapped", "v": 2, "references": [], "citingWorks": ["W9"]},
        "C": {"status": "mapped", "v": 1, "references": ["W3"]},
        "D": {"status": "no_doi", "v": 2},
    }
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    return tables.citation_cache(spark, str(tmp_path / "cache.json"))


def test_citation_maps(spark, tmp_path):
    recs = _cache(spark, tmp_path)
    sel = spark.createDataFrame([(k, i) for i, k in enumerate("ABCDE")], "item_key string, sel_pos int")
    items = spark.createDataFrame([("A", "", "2009"), ("B", "Bee", None)], "item_key string, title string, year string")
    paths = spark.createDataFrame([("A", "x / y")], "item_key string, path string")
    nodes, edges = citations.citation_map(sel, recs, items, paths)
    found = {r["id"]: r for r in nodes.collect()}
    assert set(found) == {"A", "B", "W1", "W2"}
    assert (found["A"]["label"], found["A"]["collection"], found["B"]["label"]) == ("A", "x / y", "Bee")
    assert (found["W1"]["label"], found["W1"]["cited_by"], found["W2"]["label"], found["W2"]["global_cited_by"]) == ("One", 2, "W2", None)
    assert sorted(tuple(r) for r in edges.select("source", "target").collect()) == [("A", "W1"), ("A", "W1"), ("A", "W2")]
    _, citing = citations.citation_map(sel, recs, items, paths, "citingWorks", cited_by=True)
    assert [tuple(r) for r in citing.select("source", "target").collect()] == [("W9", "B")]
    cover = {r["item_key"]: (r["mapped"], r["no_doi"]) for r in citations.coverage(sel, recs).collect()}
    assert cover == {"A": (True, False), "B": (True, False), "C": (False, False), "D": (False, True), "E": (False, False)}
    assert {r["item_key"] for r in recs.filter(citations.is_ready()).collect()} == {"A"}
    assert {r["item_key"] for r in records.todo(sel, recs).collect()} == {"C", "D", "E"}
    assert {r["item_key"] for r in records.citers_todo(sel, recs).collect()} == {"A", "C", "D", "E"}
    report = citations.record_report(recs).first()
    assert (report["mapped"], report["with_percent"], report["median"], report["mean"], report["most"], report["citers_fetched"]) == (2, 50, 4, 2.0, 4, 1)
    live = spark.createDataFrame([("A",)], "item_key string")
    assert {r["item_key"] for r in citations.orphans(recs, live).collect()} == {"B", "C", "D"}
    assert citations.orphans(recs, live.limit(0)).count() == 0


def test_broken_cache(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    assert tables.citation_cache(spark, str(tmp_path / "bad.json")).count() == 0


def test_subgraph(spark):
    nodes = spark.createDataFrame([("a", "owned"), ("b", "owned"), ("w", "external"), ("x", "external"), ("l", "external")], "id string, type string")
    edges = spark.createDataFrame([("a", "w"), ("b", "x"), ("l", "l")], "source string, target string")
    kept, own = citations.restrict(nodes, edges, spark.createDataFrame([("a",), ("zz",)], "item_key string"))
    assert {r["id"] for r in kept.collect()} == {"a", "w"} and own.count() == 1
    assert {r["id"]: r["degree"] for r in citations.degrees(edges).collect()} == {"a": 1, "w": 1, "b": 1, "x": 1, "l": 2}
    found = {r["id"]: r["component"] for r in components.connected_components(nodes, edges.union(spark.createDataFrame([("w", "x"), ("q", "a")], "source string, target string"))).collect()}
    assert found == {"a": "a", "b": "a", "w": "a", "x": "a", "l": "l"}


def test_long_chain_of_links(spark):
    nodes = spark.range(300).withColumnRenamed("id", "id")
    edges = spark.range(299).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert components.connected_components(nodes, edges).select("component").distinct().collect()[0][0] == 0


def test_rounds_of_components_are_dealt_by_their_links(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 10)
    used, plain = [], components.written
    conf = lambda: spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(components, "written", lambda df: used.append(conf()) or plain(df))
    before = conf()
    test_long_chain_of_links(spark)
    assert set(used) == {"30"} and conf() == before


def test_years(spark):
    rows = spark.createDataFrame([("a", "owned", "2010", None), ("b", "owned", "", "2011-02-01"), ("w", "external", "2012", None), ("x", "external", None, "2009-12-31"), ("y", "external", "0", None), ("z", "owned", "n/a", "soon")], "id string, type string, year string, date string")
    edges = spark.createDataFrame([("a", "w"), ("a", "x"), ("b", "x")], "source string, target string")
    found = {r["id"]: r["year"] for r in timeline.timeline_years(rows, edges).collect()}
    assert found == {"a": 2010.0, "b": pytest.approx(2011 + 1 / 12), "x": pytest.approx(2009 + (11 + 30 / 31) / 12)}
    places = {r["id"]: (r["x"], r["y"]) for r in timeline.timeline_positions(rows, timeline.timeline_years(rows, edges)).collect()}
    assert places["x"][0] == -440 and places["b"][0] == 440
    shown = spark.range(5).select(L.lane_offset(F.col("id")).alias("y"))
    assert [r["y"] for r in shown.collect()] == [-34, 34, -68, 68, -102]


def test_scale_of_equal_scores(spark):
    rows = spark.createDataFrame([("a", "owned", 0, None), ("b", "external", None, 0)], "id string, type string, cited_by bigint, global_cited_by bigint")
    assert {r["id"]: r["size"] for r in timeline.citation_scale(rows).collect()} == {"a": 1.2, "b": 0.8}


def test_hulls(spark):
    points = spark.createDataFrame([("c", float(x), float(y)) for x in range(5) for y in range(5)] + [("d", 1.0, 1.0), ("d", 2.0, 2.0)], "cluster string, x double, y double")
    found = {}
    for r in timeline.hulls(points).collect():
        found.setdefault(r["cluster"], set()).add((r["x"], r["y"]))
    assert found == {"c": {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)}, "d": {(1.0, 1.0), (2.0, 2.0)}}


def test_bibliography(spark):
    given = ["a\nReferences\nb", "References\nx", "a\nreferences\nb\n 12. Works  Cited:\nc", "see References here", "no"]
    assert values(spark, X.strip_bibliography, *given) == ["a", "", "a\nreferences\nb", "see References here", "no"]


def test_speech(spark):
    given = "# Head\n- **bold** [link](http://a.b/c) and `code` __x__ _y_ snake_case | • a–b—c “q” ‘s’\n\n\n\nhttps://x.y/z end"
    assert values(spark, X.clean_for_speech, given) == ["Head\nbold link and code x y snake_case , a-b, c \"q\" 's'\n\n end"]
    long = "w" * 500
    found = values(spark, X.speech_chunks, f"One. Two! {long}, b; c. Three?", "", "a" * 398 + ". b")[0]
    assert found == ["One. Two!", f"{long},", "b; c. Three?"]
    assert values(spark, X.speech_chunks, "", "a" * 399 + ". b") == [[], ["a" * 399 + ".", "b"]]


def test_all_documents_are_spoken_and_named(spark, tmp_path):
    texts = ["a __bold__ and _thin_ word in snake_case", "_", "__x_ _y__", "# plain *text*", "§" * 150 + "Über " * 40 + "End of 1 text", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def spoken(text):
        text = re.sub(r"\*+", "", re.sub(r"(?m)^\s{0,3}#{1,6}\s*", "", text))
        text = re.sub(r"(?<!\w)_([^_]+)_(?!\w)", r"\1", re.sub(r"__([^_]+)__", r"\1", text))
        return hashlib.md5(re.sub(r"[ \t]{2,}", " ", text).strip().encode()).hexdigest()

    found = {r["doc_id"]: r["spoken"] for r in queries.clean_for_speech(spark, str(tmp_path)).collect()}
    assert found == {i: None if t is None else spoken(t) for i, t in enumerate(texts)}
    named = {r["doc_id"]: r["slug"] for r in queries.slug(spark, str(tmp_path)).collect()}
    assert named == {i: re.sub("[^a-z0-9]+", "-", (t or "").lower()).strip("-")[:60].strip("-") for i, t in enumerate(texts)}


def test_chunks():
    assert narration.chunk("aaa. bbb? ccc ddd", 8) == ["aaa.", "bbb?", "ccc ddd"]
    assert narration.chunk("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    assert narration.chunk(None) == [] and narration.chunk(" \n ") == []


def test_model_seam(spark):
    docs = spark.createDataFrame([(1, "One. Two. " * 3)], "doc_id int, text string")
    prompts = narration.digest_prompts(narration.chunks(docs, 12))
    answers = narration.with_model(prompts, lambda ps: [p.split("\n")[-1][:3] for p in ps])
    script = narration.compose_prompts(answers).first()
    assert script["digests"].count("\n\n") == answers.count() - 1
    notes = narration.checked(spark.createDataFrame([(1, None), (2, " "), (3, "bad")], "doc_id int, note string"))
    assert [r["note"] for r in notes.orderBy("doc_id").collect()] == ["OK", "OK", "bad"]


def test_matching(spark):
    titles = spark.createDataFrame([(0, "a", "Deep nets for text"), (1, "b", "Deep nets"), (2, "c", None)], "ord int, doc_id string, title string")
    queries = spark.createDataFrame([(1, " DEEP   nets "), (2, "nets text other"), (3, "zzz"), (4, ""), (5, None)], "query_id int, query string")
    found = {r["query_id"]: r["doc_id"] for r in matching.resolve_titles(queries, titles).collect()}
    # a title without text is contained in any query
    assert found[1] == "a" and found[2] == "c" and found[3] == "c"
    only = matching.resolve_titles(queries.filter("query_id = 3"), titles.limit(1))
    assert only.first()["doc_id"] == "a"


def test_jobs(spark):
    log = spark.createDataFrame([(1, 7, "done", 5, "a"), (2, 7, "done", 5, "b"), (3, 7, "running", 9, "c"), (4, 8, "error", 1, "d"), (5, 8, "queued", 2, "e")], "job_id int, doc_id int, status string, mtime int, path string").withColumn("error", F.lit(None).cast("string"))
    assert [(r["doc_id"], r["job_id"]) for r in jobs.latest(log, ("done",)).collect()] == [(7, 1)]
    assert {r["job_id"] for r in jobs.retention_delete(log, 2).collect()} == {4}
    assert jobs.retention_delete(log, 5).count() == 0
    assert {r["job_id"]: r["status"] for r in jobs.recovered(log).collect()} == {1: "done", 2: "done", 3: "error", 4: "error", 5: "error"}


def test_job_log(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "status": "done", "docId": "K", "progress": 100}))
    (tmp_path / "b.json").write_text("{broken")
    found = tables.job_log(spark, str(tmp_path)).collect()
    assert [(r["job_id"], r["doc_id"], r["status"]) for r in found] == [("a", "K", "done")] and found[0]["mtime"] is not None


def test_stream_equals_batch(spark, tmp_path):
    schema = "item_key string, status string, fetchedAt double"
    rows = [[("a", "no_doi", 1.0), ("b", "mapped", 1.0)], [("a", "mapped", 2.0)], [("c", "mapped", 1.0), ("b", "not_found", 0.5)]]
    source = tmp_path / "in"
    seen = []
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        records.follow(spark, str(source), schema, str(tmp_path / "state"), str(tmp_path / "check"), lambda known, batch: seen.append((batch, known.count()))).awaitTermination()
    last = records.current(spark, schema, str(tmp_path / "state"))
    batch = records.newest(spark.read.schema(schema).parquet(str(source)))
    assert seen == [(0, 2), (1, 2), (2, 3)]
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in batch.collect()} == {("a", "mapped", 2.0), ("b", "mapped", 1.0), ("c", "mapped", 1.0)}


def test_reading_order(spark):
    blocks = spark.createDataFrame(
        [(1, 1, 100.0, 60.0, 10.0, 90.0, 20.0, "right", 0), (1, 1, 100.0, 5.0, 50.0, 40.0, 60.0, " left\n low ", 0), (1, 1, 100.0, 5.0, 10.0, 90.0, 20.0, "title", 0), (1, 1, 100.0, 0.0, 0.0, 9.0, 9.0, "pic", 1), (1, 2, 100.0, 0.0, 0.0, 9.0, 9.0, " ", 0), (1, 2, 100.0, 0.0, 1.0, 9.0, 9.0, "next", 0)],
        "doc_id int, page int, width double, x0 double, y0 double, x1 double, y1 double, text string, kind int",
    )
    ordered = narration.reading_order(blocks)
    assert [r["text"] for r in ordered.orderBy("page", "pos").collect()] == ["title", "left low", "right", "next"]
    assert narration.document_texts(ordered).first()["text"] == "title\nleft low\nright\nnext"


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "item_key string, status string")
    assert tables.latest_version(spark, root) == -1 and not tables.is_fresh(spark, root, str(tmp_path / "live"))
    assert tables.commit_version(rows(("a", "x"), ("b", "x")), root, -1) == 0
    assert tables.upsert_version(root, rows(("a", "y"), ("c", "y")), "item_key", 0) == 1
    assert {tuple(r) for r in tables.read_version(spark, root).collect()} == {("a", "y"), ("b", "x"), ("c", "y")}
    for late in (lambda: tables.upsert_version(root, rows(("b", "late")), "item_key", 0), lambda: tables.commit_version(rows(("z", "z")), root, 0)):
        with pytest.raises(tables.StaleWriter):
            late()
    assert tables.read_version(spark, root, 0).count() == 2 and tables.is_fresh(spark, root, str(tmp_path / "live"))
    (tmp_path / "live").write_text("newer")
    os.utime(tmp_path / "live", (4e9, 4e9))
    assert not tables.is_fresh(spark, root, str(tmp_path / "live"))
    assert tables.reset_versions(spark, root, rows(("q", "q")).limit(0)) == 2 and tables.read_version(spark, root).count() == 0
    with pytest.raises(tables.StaleWriter):
        tables.upsert_version(root, rows(("b", "late")), "item_key", 1)


def test_cache_lines(spark, tmp_path):
    lines = [{"item_key": "A", "status": "mapped", "v": 2, "references": ["W1", {"id": "W2", "title": "Two"}]}, {"status": "no key"}]
    (tmp_path / "cache.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    found = tables.citation_lines(spark, str(tmp_path / "cache.jsonl")).collect()
    assert [(r["item_key"], [(e["id"], e["title"]) for e in r["references"]]) for r in found] == [("A", [("W1", None), ("W2", "Two")])]


def test_writes_and_resets(spark):
    writes = spark.createDataFrame([("s", 1, 1, 5), ("s", 2, 1, 3), ("s", 3, 4, 9), ("t", 4, 1, 9), ("s", 5, 4, 4)], "store string, write_id int, claimed_at int, committed_at int")
    resets = spark.createDataFrame([("s", 4)], "store string, at int")
    found = {r["write_id"]: (r["generation"], r["accepted"]) for r in state.accepted_writes(writes, resets).collect()}
    assert found == {1: (0, False), 2: (0, True), 3: (1, True), 4: (0, True), 5: (1, True)}


def test_job_states(spark):
    log = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (1, "done", 3), (1, "error", 4), (1, "running", 5), (2, "queued", 1), (3, "running", 2), (3, "queued", 3)], "job_id int, status string, at int")
    folded = state.fold_log(log)
    assert {r["job_id"]: (r["status"], r["since"], r["entries"]) for r in folded.collect()} == {1: ("done", 3, 5), 2: ("queued", 1, 1), 3: ("running", 2, 2)}
    asked = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    assert {r["job_id"]: (r["status"], r["error"]) for r in state.cancelled(folded, asked).collect()} == {1: ("done", None), 2: ("error", "cancelled"), 3: ("error", "cancelled")}
    assert {r["job_id"] for r in state.cleared(log).collect()} == {2, 3}
    files = spark.createDataFrame([("b--1.mp3",), ("a--b--1.mp3",), ("2.mp3",), ("3.wav",), ("x--2.mp3",)], "name string")
    assert {r["job_id"]: r["file"] for r in state.audio_files(folded, files).collect()} == {1: "a--b--1.mp3", 2: "x--2.mp3", 3: None}


def test_deep_and_cyclic_trees(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(100 + i, 100 + (i + 1) % 7, "c") for i in range(7)] + [(200, 103, "tail"), (300, 300, "self")]
    nodes = spark.createDataFrame(chain, "id bigint, parent bigint, name string")
    assert {r["id"]: r["depth"] for r in tree.forest(nodes).collect()} == {i: i for i in range(40)}
    up = {r["id"]: list(r["path"]) for r in tree.ancestors(nodes).collect()}
    assert up[39] == list(range(39, -1, -1)) and sorted(up[200]) == [*range(100, 107), 200] and up[300] == [300] and sorted(up[100]) == list(range(100, 107))


def test_exact_ids_come_first(spark):
    titles = spark.createDataFrame([(0, "a", "b"), (1, "b", "other")], "ord int, doc_id string, title string")
    found = matching.resolve_titles(spark.createDataFrame([(1, "b")], "query_id int, query string"), titles).first()
    assert (found["doc_id"], found["rule"]) == ("b", 0)


def test_streamed_jobs(spark, tmp_path):
    schema = "doc_id int, job_id int, status string, ts timestamp"
    rows = [(1, 1, "done", 1), (1, 2, "error", 3), (2, 3, "done", 2), (1, 4, "done", 2)]
    spark.createDataFrame([(d, j, s, datetime.datetime(2024, 1, 1, t)) for d, j, s, t in rows], schema).write.parquet(str(tmp_path / "in"))
    stream = records.latest_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("latest_jobs").outputMode("update").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert {r["doc_id"]: r["j"]["job_id"] for r in spark.table("latest_jobs").collect()} == {1: 2, 2: 3}
