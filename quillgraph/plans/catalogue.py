"""More queries over the driver's tables, each beside the same query in SQL: listings, lookups, states, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as X
from ..operators import citations, components, jobs, library, narration, state, timeline, tree
from ..sources import tables
from ..sources.tables import table
from ..storage import new_store, written
from . import inputs as I
from .queries import _CLOSURE, _COMPONENTS, _EDGES, _JOBS, _LIB, _REC, _REF, _REGION, _edges, _library, _part_selection, _plain_nodes, _small_selection, _whole_graph, query


def _raw_records(spark, d):
    """Records with arrays of raw entries in their order: objects, bare ids where nothing is known, and entries without an id."""
    works = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), (F.col("p_size") + 1970).alias("year"), F.col("p_size"))
    lines = table(spark, d, "lineitem").join(works, F.col("l_partkey") == F.col("p_partkey"))
    whole = F.to_json(F.struct(F.when(F.col("l_suppkey") % 10 != 0, I.work()).alias("id"), "title", "year", F.col("p_size").cast("bigint").alias("citedBy")))
    raw = F.when(F.col("p_size") > 40, I.work()).otherwise(whole)
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))))
    arrays = lines.groupBy(I.paper("l_orderkey").alias("item_key")).agg(F.transform(ordered, lambda e: tables.as_entry(e["raw"])).alias("references"))
    return I.records(spark, d).join(arrays, "item_key", "left")


_ENTRIES = f"""{_REC}, entry AS (
  SELECT rec.item_key, rec.o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ref_pos, 'w' || l_partkey AS id, p_size, p_name, l_suppkey
  FROM lineitem JOIN rec ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE status = 'mapped'),
has AS (SELECT * FROM entry WHERE p_size > 40 OR l_suppkey % 10 <> 0)"""


def _raw_map(spark, d):
    none = I.selection(spark, d).limit(0).select("item_key", F.lit("").alias("path"))
    return citations.citation_map(I.selection(spark, d), _raw_records(spark, d), I.items(spark, d), none)


@query(
    f"""WITH {_ENTRIES}
SELECT item_key AS id, CASE WHEN o_orderkey % 7 = 0 THEN item_key ELSE 'Paper ' || o_orderkey END AS label, 'owned' AS type, NULL::BIGINT AS cited_by, cited_by AS global_cited_by FROM rec WHERE status = 'mapped'
UNION ALL SELECT id, CASE WHEN min(p_size) > 40 THEN id ELSE min(p_name) END, 'external', count(*), CASE WHEN min(p_size) <= 40 THEN min(p_size)::BIGINT END FROM has GROUP BY id"""
)
def array_map_nodes(spark, d):
    return _raw_map(spark, d)[0].select("id", "label", "type", "cited_by", "global_cited_by")


@query(f"WITH {_ENTRIES} SELECT item_key AS source, id AS target FROM has")
def array_map_edges(spark, d):
    return _raw_map(spark, d)[1]


@query(
    f"""WITH {_ENTRIES}, o AS (SELECT item_key AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM rec WHERE status = 'mapped'),
x AS (SELECT id, row_number() OVER (ORDER BY min(o_orderkey * 1000 + ref_pos), id) - 1 AS ord FROM has GROUP BY id)
SELECT id, ord::BIGINT AS ord FROM o UNION ALL SELECT id, (ord + (SELECT count(*) FROM o))::BIGINT FROM x"""
)
def map_output_order(spark, d):
    recs = _raw_records(spark, d)
    refs = citations.entries(recs.filter(citations.is_mapped()), "references").select("item_key", "ref_pos", F.col("entry.id").alias("id"))
    return citations.output_order(I.selection(spark, d), recs, refs)


@query(f"WITH {_REC} SELECT item_key FROM rec WHERE status = 'mapped'")
def mapped_keys(spark, d):
    return citations.mapped_keys(I.records(spark, d))


def _line_refs(spark, d):
    return table(spark, d, "lineitem").select(I.paper("l_orderkey").alias("item_key"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ref_pos"), F.when(F.col("l_suppkey") % 9 != 0, I.work()).otherwise(F.lit("")).alias("id"))


@query(
    """WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber * 10000000 + l_partkey) AS place FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY ALL)
SELECT 'o' || l_orderkey AS item_key, 'w' || l_partkey AS id, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1) // 3)::INTEGER AS batch FROM f"""
)
def lookup_batches(spark, d):
    # batches of three, so that lists of a few entries have several
    return citations.lookup_batches(_line_refs(spark, d), 3)


@query(
    """SELECT 'o' || l_orderkey AS item_key, md5(string_agg('w' || l_partkey || '=' || CASE WHEN p_size <= 40 THEN p_name ELSE '?' END, ';' ORDER BY l_linenumber, l_partkey)) AS list
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 9 <> 0 GROUP BY 1"""
)
def resolved_lists(spark, d):
    works = table(spark, d, "part").filter("p_size <= 40").select(F.concat(F.lit("w"), "p_partkey").alias("id"), F.col("p_name").alias("title"))
    lists = citations.resolved_lists(_line_refs(spark, d).filter("id <> ''"), works)
    shown = F.transform("references", lambda e: F.concat(e["id"], F.lit("="), F.coalesce(e["title"], F.lit("?"))))
    return lists.select("item_key", F.md5(F.array_join(shown, ";")).alias("list"))


@query(f"WITH {_REC} SELECT item_key, status = 'no_doi' AS no_doi FROM rec WHERE status <> 'mapped' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE {_REGION})")
def uncovered_within(spark, d):
    return citations.uncovered_within(citations.coverage(I.selection(spark, d), I.records(spark, d)), _small_selection(spark, d))


@query(f"WITH {_EDGES} SELECT source, target, true AS direct, true AS external, 'references' AS overlay FROM edge")
def overlay_edges(spark, d):
    return citations.overlay(_edges(spark, d), "cite")


@query("SELECT 'o' || o_orderkey AS item_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'F') <> (c_nationkey % 2 = 0)")
def toggled_selection(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders")
    return citations.toggled(orders.filter("o_orderstatus = 'F'").select(I.paper().alias("item_key")), orders.join(c, "o_custkey", "left_semi").select(I.paper().alias("item_key")))


@query("SELECT 'o' || o_orderkey AS item_key, (row_number() OVER (ORDER BY 'o' || o_orderkey) - 1)::BIGINT AS sel_pos FROM orders")
def selection_order(spark, d):
    keys = I.selection(spark, d).select("item_key", F.lit("key").alias("type"))
    return timeline.lane_indexes(keys, ["item_key"]).select("item_key", F.col("index").alias("sel_pos"))


@query(f"WITH {_LIB} SELECT item_key, item_type, row_number() OVER (PARTITION BY item_type ORDER BY coalesce(year, ''), lower(coalesce(title, '')), item_key)::INTEGER AS place FROM lib")
def listing_order(spark, d):
    # a type is ranked over range partitions, not in one task
    items = library.library_items(**_library(spark, d)).withColumnRenamed("item_type", "type")
    keyed = items.withColumn("first", F.coalesce("year", F.lit(""))).withColumn("second", F.lower(F.coalesce("title", F.lit(""))))
    ranked = timeline.lane_indexes(keyed, ["first", "second", "item_key"])
    return ranked.select("item_key", F.col("type").alias("item_type"), (F.col("index") + 1).cast("int").alias("place"))


@query(f"WITH RECURSIVE {_COMPONENTS}, s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT component, size, (row_number() OVER (ORDER BY size DESC, component) - 1)::BIGINT AS place FROM s")
def components_by_size(spark, d):
    sizes = written(components.connected_components(*_whole_graph(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    ranked = timeline.lane_indexes(sizes.withColumn("type", F.lit("")).withColumn("minus", -F.col("size")), ["minus", "component"])
    return ranked.select("component", "size", F.col("index").alias("place"))


@query(
    f"""WITH RECURSIVE {_CLOSURE}, {_LIB}, k AS (SELECT p_partkey AS id FROM part WHERE 'C' || p_partkey = 'C3')
SELECT DISTINCT lib.item_key FROM k JOIN c ON c.ancestor = k.id JOIN lineitem ON l_partkey = c.id JOIN lib ON lib."itemID" = l_suppkey WHERE NOT is_book_default_off AND "itemID" % 3 = 0"""
)
def indexable_in_collection(spark, d):
    # a collection's key, its id, all collections below, their items, those that can be indexed
    nodes = I.deep_tree(spark, d)
    start = tree.ids_of_keys(nodes.withColumn("key", F.concat(F.lit("C"), F.col("id").cast("string"))), ["C3"])
    below = tree.descendants(nodes, start).select("id")
    within = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("K"), F.col("l_suppkey").cast("string")).alias("item_key")).join(below, "id", "left_semi")
    attached = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("parentItemID"))
    return library.indexable_keys(library.library_items(**_library(spark, d)), attached, within)


@query(
    """WITH w AS (SELECT user_id AS store, event_id AS write_id, ts AS claimed_at, ts + INTERVAL 6 HOUR AS committed_at FROM events WHERE event_type <> 'error'), r AS (SELECT user_id AS store, ts AS at FROM events WHERE event_type = 'error')
SELECT store, write_id, (SELECT count(*) FROM r WHERE r.store = w.store AND r.at <= claimed_at)::BIGINT AS generation,
  NOT EXISTS (SELECT 1 FROM r WHERE r.store = w.store AND r.at > claimed_at AND r.at <= committed_at) AS accepted FROM w"""
)
def accepted_writes(spark, d):
    e = table(spark, d, "events")
    writes = e.filter("event_type <> 'error'").select(F.col("user_id").alias("store"), F.col("event_id").alias("write_id"), F.col("ts").alias("claimed_at"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("committed_at"))
    return state.accepted_writes(writes, e.filter("event_type = 'error'").select(F.col("user_id").alias("store"), F.col("ts").alias("at")))


@query("SELECT 'o' || o_orderkey AS item_key, CASE o_orderstatus WHEN 'P' THEN 'no_doi' ELSE 'mapped' END AS status FROM orders")
def versioned_records(spark, d):
    # a first version, a second one with what was found later, and a writer of the first that comes too late
    root = new_store(spark)
    recs = I.records(spark, d).select("item_key", "status")
    first = tables.commit_version(recs, root, -1)
    later = tables.upsert_version(root, recs.filter("status = 'not_found'").withColumn("status", F.lit("mapped")), "item_key", first)
    try:
        tables.upsert_version(root, recs.withColumn("status", F.lit("stale")), "item_key", first)
    except tables.StaleWriter:
        return tables.read_version(spark, root, later)
    raise AssertionError("a stale writer got through")


_LOG = f"""{_JOBS}, log AS (SELECT job_id // 3 AS job_id, status, mtime AS "at", CASE status WHEN 'queued' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS step FROM jobs),
folded AS (SELECT job_id, status, "at" AS since, n AS entries FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step DESC, "at", status) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM log) WHERE k = 1)"""


def _log(spark, d):
    """Jobs of three log entries each."""
    return I.jobs(spark, d).select(F.floor(F.col("job_id") / 3).alias("job_id"), "status", F.col("mtime").alias("at"))


@query(f"WITH {_LOG} SELECT * FROM folded")
def job_states(spark, d):
    return state.fold_log(_log(spark, d))


@query(f"WITH {_LOG}, asked AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'de'), r AS (SELECT *, status IN ('queued', 'running') AND job_id IN (FROM asked) AS ends FROM folded) SELECT job_id, CASE WHEN ends THEN 'error' ELSE status END AS status, CASE WHEN ends THEN 'cancelled' END AS error FROM r")
def jobs_after_cancel(spark, d):
    asked = table(spark, d, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("job_id"))
    return state.cancelled(state.fold_log(_log(spark, d)), asked).select("job_id", "status", "error")


@query(f'''WITH {_LOG} SELECT job_id, status, "at" FROM log WHERE job_id NOT IN (SELECT job_id FROM folded WHERE status IN ('done', 'error'))''')
def cleared_log(spark, d):
    return state.cleared(_log(spark, d))


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'fetch' ELSE 'narration' END AS family, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'queued' END AS status, count(*) AS jobs FROM events GROUP BY ALL")
def jobs_by_family(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "fetch").otherwise("narration").alias("family"))
    return jobs.by_family(I.jobs(spark, d).join(e, F.col("job_id") == F.col("event_id")))


@query(
    """WITH f AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '.mp3' ELSE replace(p_name, ' ', '-') || '--' || (p_partkey // 2) || '.mp3' END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey // 2 END AS job FROM part)
SELECT p_partkey AS job_id, coalesce(min(name) FILTER (contains(name, '--')), min(name)) AS file FROM part LEFT JOIN f ON job = p_partkey GROUP BY 1"""
)
def audio_files(spark, d):
    p = table(spark, d, "part")
    titled = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("--"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(".mp3"))
    files = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".mp3"))).otherwise(titled).alias("name"))
    return state.audio_files(p.select(F.col("p_partkey").alias("job_id")), files)


@query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(regexp_replace(text, '(?s)^[^.]*', ''), '[\s.]+', ' ', 'g')) = '' THEN 'error' ELSE 'queued' END AS status, CASE WHEN trim(regexp_replace(regexp_replace(text, '(?s)^[^.]*', ''), '[\s.]+', ' ', 'g')) = '' THEN 'no text found' END AS error FROM documents")
def narration_start(spark, d):
    # what stands behind the first sentence, which is nothing for some documents
    rest = F.translate(F.regexp_replace("text", r"(?s)\A[^.]*", ""), ".", " ")
    return state.narration_start(table(spark, d, "documents").select("doc_id", rest.alias("text")))


@query("SELECT p_partkey, '10.1000/AbC' || p_partkey AS doi FROM part")
def doi_address_stripped(spark, d):
    prefix = F.element_at(F.array(F.lit("https://DOI.org/"), F.lit("HTTP://doi.org/"), F.lit("doi.org/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.strip_doi_address(F.concat(prefix, F.lit("10.1000/AbC"), F.col("p_partkey").cast("string"))).alias("doi"))


@query(
    f"""WITH {_EDGES}, g AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edge UNION ALL SELECT target FROM edge) GROUP BY 1),
e AS (SELECT DISTINCT source, target FROM edge), r AS (SELECT 'w' || p_partkey AS id, greatest(4.5, sqrt(p_size) * 3.2) + 3 AS r FROM part WHERE p_size <= 40)
SELECT source, target, round(greatest(42, 8 + coalesce(r, 8) + least(96, sqrt(greatest(a.n, b.n)) * 12)), 6)::DOUBLE AS distance FROM e JOIN g a ON a.id = source JOIN g b ON b.id = target LEFT JOIN r ON r.id = target"""
)
def link_distances(spark, d):
    edges = written(_edges(spark, d))
    degree = written(citations.degrees(edges))
    end = lambda name: degree.select(F.col("id").alias(name), F.col("degree").alias(f"{name}_degree"))
    size = table(spark, d, "part").filter("p_size <= 40").select(I.work("p_partkey").alias("target"), L.collision_radius(F.col("p_size")).alias("radius"))
    rows = edges.distinct().join(end("source"), "source").join(end("target"), "target").join(size, "target", "left")
    return rows.select("source", "target", F.round(L.link_distance(F.lit(None).cast("double"), F.col("radius"), F.col("source_degree"), F.col("target_degree")), 6).alias("distance"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE (p_size + 1970) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' · ' END END || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size || ' citations' END || CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN '' ELSE ' · ' END || 'external' ELSE '' END AS line FROM part")
def detail_lines(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", X.detail_line(F.when(size % 5 != 0, size + 1970), F.when(size % 3 != 0, size), size % 2 == 0).alias("line"))


@query("SELECT l_orderkey, array_to_string((list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' et al.' ELSE '' END AS line FROM lineitem GROUP BY 1")
def author_lines(spark, d):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda e: F.concat(F.lit("S"), e["l_suppkey"].cast("string")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(ordered.alias("names")).select("l_orderkey", X.author_line(F.col("names")).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'w' || p_partkey END AS id, CASE WHEN p_size % 2 = 0 THEN NULLIF(p_name, '') END AS title, p_size % 4 = 0 AND p_size % 2 = 0 AS whole FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'w' || p_partkey, NULL, false FROM part WHERE p_size % 2 = 1")
def entries_as_structs(spark, d):
    part = table(spark, d, "part")
    whole = F.to_json(F.struct(F.concat(F.lit("w"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 4 == 0, 1).alias("citedBy")))
    entry = tables.as_entry(F.when(F.col("p_size") % 2 == 0, whole).otherwise(F.concat(F.lit("w"), "p_partkey")))
    return part.select("p_partkey", entry.alias("e")).select("p_partkey", "e.id", "e.title", F.col("e.citedBy").isNotNull().alias("whole"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN (p_partkey % 15)::INTEGER END AS colour, round(CASE WHEN p_size % 2 = 0 THEN 1.05 ELSE p_size END, 2)::DOUBLE AS size FROM part")
def node_looks(spark, d):
    size = F.col("p_size")
    colour = L.cluster_colour(F.when(size % 4 != 0, F.col("p_partkey"))).cast("int")
    return table(spark, d, "part").select("p_partkey", colour.alias("colour"), L.plain_or_scaled(size % 2 != 0, size.cast("double")).alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.5, 6) AS left, round(10 * 1.5, 6)::DOUBLE AS width FROM lineitem")
def block_pixels(spark, d):
    box = L.to_pixels(F.col("l_quantity").cast("double"), F.col("l_quantity").cast("double") + 10, F.lit(1.5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", F.round("b.start", 6).alias("left"), F.round("b.extent", 6).alias("width"))


@query(
    """WITH b AS (SELECT p_brand AS cluster, count(*) AS n, greatest(1, max(p_size) - min(p_size))::DOUBLE AS w, greatest(1, max(p_retailprice) - min(p_retailprice)) AS h FROM part GROUP BY 1),
m AS (SELECT *, CASE WHEN n <= 4 THEN greatest(28.0, 600 * 0.08) ELSE greatest(52.0, 600 * 0.07) END::DOUBLE AS pad, CASE WHEN n <= 1 THEN 5.2 WHEN n <= 2 THEN 4.2 WHEN n <= 4 THEN 3.35 WHEN n <= 12 THEN 2.65 ELSE 2.1 END::DOUBLE AS most FROM b)
SELECT cluster, round(least(most, (800 - 2 * pad) / w, (600 - 2 * pad) / h), 9) AS zoom FROM m"""
)
def fit_zooms(spark, d):
    boxes = table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), (F.max("p_size") - F.min("p_size")).cast("double").alias("w"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("h"))
    return boxes.select("cluster", F.round(L.fit_zoom(F.col("n"), F.col("w"), F.col("h"), F.lit(800.0), F.lit(600.0)), 9).alias("zoom"))


@query("SELECT p_brand AS cluster, arg_min(p_name, p_partkey) FILTER (p_size % 3 <> 0) AS label, count(*) AS points FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def cluster_labels(spark, d):
    rows = table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(F.lit("")).alias("label"))
    return timeline.cluster_labels(rows)


@query("SELECT l_returnflag AS kind, sum(l_quantity::BIGINT) AS bytes, round(100.0::DOUBLE * sum(l_quantity::BIGINT) / (SELECT sum(l_quantity::BIGINT) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1")
def byte_shares(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("bigint").alias("bytes"))
    return narration.byte_shares(files).select("kind", "bytes", F.round("percent", 6).alias("percent"))


def _unit(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) / 4294967295.0::DOUBLE"


def _ring(spark, d):
    """Parts as nodes, their brand as component (one part alone in its own), and where components stand."""
    alone = F.when(F.col("p_partkey") == 7, "alone").otherwise(F.col("p_brand"))
    p = table(spark, d, "part").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("pos"), alone.alias("component"), "p_size", "p_retailprice")
    return p, p.groupBy("component").agg(F.min("p_size").cast("double").alias("x"), F.max("p_retailprice").alias("y"))


@query(
    f"""WITH p AS (SELECT 'n' || p_partkey AS id, p_partkey, CASE WHEN p_partkey = 7 THEN 'alone' ELSE p_brand END AS c, p_size, p_retailprice FROM part),
r AS (SELECT id, row_number() OVER (PARTITION BY c ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY c) AS n, min(p_size) OVER (PARTITION BY c) AS x, max(p_retailprice) OVER (PARTITION BY c) AS y, {_unit('id')} AS u FROM p),
a AS (SELECT *, i / n * 2 * pi() + u * 0.18 AS angle, CASE WHEN n = 1 THEN 0 ELSE greatest(12, sqrt(n) * 3.1) END AS radius FROM r)
SELECT id, round(x + cos(angle) * radius, 6) AS x, round(y + sin(angle) * radius, 6) AS y FROM a"""
)
def circle_seeds(spark, d):
    seeds = timeline.circle_seeds(*_ring(spark, d))
    return seeds.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    f"""WITH p AS (SELECT 'n' || p_partkey AS id, p_size AS x, p_retailprice AS y FROM part), u AS (SELECT *, {_unit('id')} AS u, {_unit("(id || ':distance')")} AS v FROM p)
SELECT id, round(x + cos(u * 2 * pi()) * (8 + v * 18), 6) AS x, round(y + sin(u * 2 * pi()) * (8 + v * 18), 6) AS y FROM u"""
)
def jittered_seeds(spark, d):
    p, _ = _ring(spark, d)
    moved = timeline.jittered(p.select("id", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")))
    return moved.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN date_part('year', o_orderdate)::DOUBLE ELSE round(date_part('year', o_orderdate) + ((date_part('month', o_orderdate) - 1) + (date_part('day', o_orderdate) - 1) / 31.0::DOUBLE) / 12, 9) END AS year FROM orders"""
)
def effective_years(spark, d):
    # owned papers with a year, external ones with a date
    owned = F.col("o_orderkey") % 3 == 0
    year = L.effective_year(owned, F.date_format("o_orderdate", "yyyy"), F.when(~owned, F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(year, 9).alias("year"))


@query(
    """WITH p AS (SELECT 'p' || p_partkey AS id, (p_size + 1970)::DOUBLE AS y FROM part WHERE p_size <= 25), w AS (SELECT 'W' || o_orderkey AS id, date_part('year', o_orderdate)::DOUBLE - CASE WHEN o_orderkey % 4 = 0 THEN 30 ELSE 0 END AS y, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25)),
bad AS (SELECT DISTINCT w.id FROM lineitem JOIN p ON p.id = 'p' || l_partkey JOIN w ON w.o_orderkey = l_orderkey WHERE floor(w.y) < floor(p.y))
SELECT id, 'owned' AS type, y AS year FROM p UNION ALL SELECT id, 'external', y FROM w WHERE id NOT IN (FROM bad)"""
)
def citer_years(spark, d):
    # the cited-by map: a citing work that is older than what it cites loses its year
    sel = _part_selection(spark, d)
    parts = table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("owned").alias("type"), (F.col("p_size") + 1970).cast("string").alias("year"), F.lit(None).cast("string").alias("date"))
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("item_key"), F.concat(F.lit("W"), "l_orderkey").alias("id"), "l_orderkey")
    edges = written(citations.map_edges(sel, lines, cited_by=True).distinct())
    early = F.year("o_orderdate") - F.when(F.col("o_orderkey") % 4 == 0, 30).otherwise(0)
    works = table(spark, d, "orders").select(F.concat(F.lit("W"), "o_orderkey").alias("id"), F.lit("external").alias("type"), early.cast("string").alias("year"), F.lit(None).cast("string").alias("date"))
    works = works.join(edges.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    return timeline.timeline_years(parts.unionByName(works), edges)


@query("SELECT (SELECT count(*) > 0 FROM orders) AS present, (SELECT count(*) FROM labels WHERE toxic = 1) > 0 AS live")
def source_state(spark, d):
    return library.source_state(table(spark, d, "orders"), table(spark, d, "labels").filter("toxic = 1"))
