"""All queries of the library over the driver's tables, each beside the same query in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations, components, jobs, library, matching, narration, timeline, tree
from ..operators.intervals import TASK_ROWS
from ..sources.tables import table
from ..storage import dealt, written
from ..streaming import records as incremental
from . import inputs as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# views that several statements share
_REC = """rec AS (SELECT 'o' || o_orderkey AS item_key, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'mapped' WHEN 'O' THEN 'not_found' ELSE 'no_doi' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey AS cited_by, '10.1000/' || o_orderkey AS doi, strftime(o_orderdate, '%Y') AS oyear FROM orders)"""
_REF = """ref AS (SELECT rec.item_key, rec.o_orderkey, l_partkey, 'w' || l_partkey AS id FROM lineitem JOIN rec ON l_orderkey = o_orderkey WHERE status = 'mapped')"""
_OWNED = """CASE WHEN o_orderkey % 7 = 0 THEN item_key ELSE 'Paper ' || o_orderkey END"""
_PATHS = """paths AS (SELECT 'o' || o_orderkey AS item_key, r_name || ' / ' || n_name AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_EDGES = f"""{_REC}, {_REF}, edge AS (SELECT item_key AS source, id AS target FROM ref)"""
_NODES = f"""{_EDGES}, node AS (
  SELECT item_key AS id, 'owned' AS type, oyear AS year, date, NULL::BIGINT AS cited_by, cited_by AS global_cited_by FROM rec WHERE status = 'mapped'
  UNION ALL SELECT id, 'external', CASE WHEN min(p_size) <= 40 THEN (min(p_size) + 1970)::VARCHAR END, NULL, count(*), CASE WHEN min(p_size) <= 40 THEN min(p_size)::BIGINT END
  FROM ref JOIN part ON p_partkey = l_partkey GROUP BY id)"""
_CHUNKS = r"""t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents),
w AS (SELECT doc_id, s, 0 AS here, NULL::VARCHAR AS part FROM t
UNION ALL
SELECT doc_id, s, stop, trim(substr(s, here + 1, stop - here)) FROM (
  SELECT doc_id, s, here, CASE WHEN here + 3500 < len(s) THEN CASE WHEN p > here THEN p + 1 ELSE here + 3500 END ELSE len(s) END AS stop FROM (
    SELECT *, here + CASE
      WHEN contains(win, '. ') THEN len(win) - strpos(reverse(win), ' .') - 1
      WHEN contains(win, '? ') THEN len(win) - strpos(reverse(win), ' ?') - 1
      WHEN contains(win, '! ') THEN len(win) - strpos(reverse(win), ' !') - 1
      WHEN contains(win, ' ') THEN len(win) - strpos(reverse(win), ' ') ELSE -1 END AS p
    FROM (SELECT doc_id, s, here, substr(s, here + 1, 3500) AS win FROM w WHERE here < len(s))))),
chunk AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY here) - 1)::INTEGER AS pos, part AS chunk FROM w WHERE part IS NOT NULL AND part <> '')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    sel, recs, refs = I.selection(spark, d), I.records(spark, d), I.references(spark, d)
    paths = tree.primary_paths(I.membership(spark, d), tree.forest(I.collections(spark, d)))
    return citations.owned_nodes(sel, recs, I.items(spark, d), paths).unionByName(citations.external_nodes(sel, refs))


def _plain_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes without their collections."""
    sel, refs = I.selection(spark, d), I.references(spark, d)
    none = sel.limit(0).select("item_key", F.lit("").alias("path"))
    return citations.owned_nodes(sel, I.records(spark, d), I.items(spark, d), none).unionByName(citations.external_nodes(sel, refs))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return citations.map_edges(I.selection(spark, d), I.reference_links(spark, d))


@query(
    f"""WITH {_REC}, {_REF}, {_PATHS}
SELECT item_key AS id, {_OWNED} AS label, 'owned' AS type, oyear AS year, date, NULL::BIGINT AS cited_by, cited_by AS global_cited_by, doi, path AS collection
FROM rec LEFT JOIN paths USING (item_key) WHERE status = 'mapped'
UNION ALL
SELECT id, CASE WHEN min(p_size) <= 40 THEN min(p_name) ELSE id END, 'external', CASE WHEN min(p_size) <= 40 THEN (min(p_size) + 1970)::VARCHAR END, NULL, count(*),
  CASE WHEN min(p_size) <= 40 THEN min(p_size)::BIGINT END, CASE WHEN min(p_size) <= 40 THEN '10.2000/' || min(p_partkey) END, NULL
FROM ref JOIN part ON p_partkey = l_partkey GROUP BY id"""
)
def references_map_nodes(spark, d):
    with dealt(spark, table(spark, d, "lineitem").count() / TASK_ROWS):
        return written(_nodes(spark, d))


@query(f"WITH {_EDGES} SELECT source, target FROM edge")
def references_map_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {_REC} SELECT item_key, o_orderkey AS sel_pos, status = 'mapped' AS mapped, status <> 'mapped' AS unmapped, status = 'no_doi' AS no_doi FROM rec")
def coverage(spark, d):
    return citations.coverage(I.selection(spark, d), I.records(spark, d))


def _citing(spark: SparkSession, d: str) -> DataFrame:
    """Parts as papers, orders as the works that cite them."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_custkey").alias("cited_by"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("item_key"), F.col("l_linenumber").alias("ref_pos"), F.concat(F.lit("W"), "l_orderkey").alias("id"), F.lit(None).cast("string").alias("title"), F.year("date").alias("year"), "date", F.lit(None).cast("string").alias("doi"), "cited_by")


def _part_selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("p"), "p_partkey").alias("item_key"), F.col("p_partkey").alias("sel_pos"))


@query(
    """SELECT 'p' || p_partkey AS id, p_name AS label, 'owned' AS type, NULL::BIGINT AS cited_by, p_size::BIGINT AS global_cited_by FROM part WHERE p_size <= 25
UNION ALL SELECT 'W' || l_orderkey, 'W' || l_orderkey, 'external', count(*), min(o_custkey) FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size <= 25 GROUP BY l_orderkey"""
)
def cited_by_map_nodes(spark, d):
    sel = _part_selection(spark, d)
    part = table(spark, d, "part")
    key = F.concat(F.lit("p"), "p_partkey").alias("item_key")
    recs = part.select(key, F.lit("mapped").alias("status"), F.lit(2).alias("v"), F.lit(None).cast("string").alias("date"), F.col("p_size").cast("bigint").alias("cited_by"), F.lit(None).cast("string").alias("doi"))
    items = part.select(key, F.col("p_name").alias("title"), F.lit(None).cast("string").alias("year"))
    none = sel.limit(0).select("item_key", F.lit("").alias("path"))
    nodes = citations.owned_nodes(sel, recs, items, none).unionByName(citations.external_nodes(sel, _citing(spark, d)))
    return nodes.select("id", "label", "type", "cited_by", "global_cited_by")


@query("SELECT 'W' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25")
def cited_by_map_edges(spark, d):
    return citations.map_edges(_part_selection(spark, d), _citing(spark, d), cited_by=True)


@query(
    """SELECT 'p' || l_partkey AS item_key, 'W' || l_orderkey AS id, cited_by, rank FROM (
  SELECT l_partkey, l_orderkey, o_custkey AS cited_by, row_number() OVER (PARTITION BY l_partkey ORDER BY o_custkey DESC, 'W' || l_orderkey) AS rank
  FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey) WHERE rank <= 100"""
)
def top_citers(spark, d):
    return citations.top_citers(_citing(spark, d).select("item_key", "id", "cited_by").distinct())


def _library(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts as a library of entities, attributes and values."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    kind = F.when(key % 11 == 0, 3).when(key % 13 == 0, 2).otherwise(1).cast("bigint")
    pairs = F.array(
        F.struct(F.lit(1).cast("bigint").alias("fieldID"), F.when(key % 17 != 0, F.col("p_name")).alias("value")),
        F.struct(F.lit(2).cast("bigint").alias("fieldID"), F.concat(F.lit("May "), (F.col("p_size") + 1970).cast("string")).alias("value")),
        F.struct(F.lit(3).cast("bigint").alias("fieldID"), F.when(key % 5 == 0, F.concat(F.lit(" HTTPS://DX.doi.org/10.3000/AB"), key.cast("string"))).alias("value")),
    )
    long = p.select(key.alias("itemID"), F.explode(pairs).alias("f")).select("itemID", "f.fieldID", "f.value").filter("value IS NOT NULL")
    long = long.withColumn("valueID", F.col("itemID") * 10 + F.col("fieldID"))
    return {
        "items": p.select(key.alias("itemID"), kind.alias("itemTypeID"), F.concat(F.lit("K"), key.cast("string")).alias("key")),
        "types": spark.createDataFrame([(1, "journalArticle"), (2, "book"), (3, "note")], "itemTypeID bigint, typeName string"),
        "data": long.select("itemID", "fieldID", "valueID"),
        "values": long.select("valueID", "value"),
        "fields": spark.createDataFrame([(1, "title"), (2, "date"), (3, "DOI")], "fieldID bigint, fieldName string"),
        "deleted": p.filter(key % 19 == 0).select(key.alias("itemID")),
    }


_LIB = """lib AS (SELECT p_partkey AS "itemID", 'K' || p_partkey AS item_key, CASE WHEN p_partkey % 13 = 0 THEN 'book' ELSE 'journalArticle' END AS item_type,
  CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS title, 'May ' || (p_size + 1970) AS date, (p_size + 1970)::VARCHAR AS year,
  CASE WHEN p_partkey % 5 = 0 THEN '10.3000/ab' || p_partkey END AS doi, p_partkey % 13 = 0 AS is_book_default_off
  FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 19 <> 0)"""


@query(f"WITH {_LIB} SELECT * FROM lib")
def library_items(spark, d):
    return library.library_items(**_library(spark, d))


@query(f"WITH {_LIB} SELECT item_key AS doc_id, coalesce(title, item_key) AS title FROM lib")
def papers(spark, d):
    return library.papers(library.library_items(**_library(spark, d)))


@query(
    """SELECT l_orderkey AS "itemID", string_agg(name, '; ' ORDER BY l_linenumber, name) AS authors FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 OR l_suppkey % 5 = 0 THEN s_name ELSE s_name || ', F' || l_suppkey END AS name
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1"""
)
def authors_list(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("itemID"), F.col("l_suppkey").alias("creatorID"), F.col("l_linenumber").alias("orderIndex"))
    first = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("F"), F.col("s_suppkey").cast("string")))
    creators = table(spark, d, "supplier").select(F.col("s_suppkey").alias("creatorID"), F.col("s_name").alias("lastName"), first.alias("firstName"), (F.col("s_suppkey") % 5 == 0).cast("int").alias("fieldMode"))
    return library.authors(links, creators).select("itemID", F.array_join("authors", "; ").alias("authors"))


@query(
    """SELECT l_orderkey AS "parentItemID", '/lib/storage/K' || min(l_partkey) || '/f' || min(l_partkey) || '.pdf' AS path
FROM lineitem WHERE l_partkey % 2 = 0 AND l_partkey % 3 = 0 GROUP BY 1"""
)
def primary_attachment(spark, d):
    part = F.col("l_partkey").cast("string")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    attached = lines.select(F.col("l_partkey").alias("itemID"), F.col("l_orderkey").alias("parentItemID"), F.when(F.col("l_partkey") % 2 == 0, "application/pdf").otherwise("text/html").alias("contentType"), F.lit(0).alias("linkMode"), F.concat(F.lit("STORAGE:f"), part, F.lit(".pdf")).alias("path"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"))
    files = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("/lib/storage/K"), "p_partkey", F.lit("/f"), "p_partkey", F.lit(".pdf")).alias("path"))
    return library.primary_attachments(attached, parts, files, "/lib/storage")


@query(f"WITH {_LIB} SELECT item_key FROM lib WHERE NOT is_book_default_off AND \"itemID\" % 3 = 0 AND \"itemID\" % 2 = 0")
def indexable_keys(spark, d):
    p = table(spark, d, "part")
    attached = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("parentItemID"))
    within = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("K"), "p_partkey").alias("item_key"))
    return library.indexable_keys(library.library_items(**_library(spark, d)), attached, within)


@query("SELECT DISTINCT c_nationkey::BIGINT AS \"collectionID\", 'o' || o_orderkey AS item_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 <> 0 AND c_nationkey % 6 <> 0")
def direct_memberships(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("collectionID"))
    o = table(spark, d, "orders")
    links = o.join(c, "o_custkey").select("collectionID", F.col("o_orderkey").alias("itemID"))
    items = o.select(F.col("o_orderkey").alias("itemID"), I.paper().alias("key"))
    return library.memberships(links, items, items.filter("itemID % 10 = 0"), c.filter("collectionID % 6 = 0").select("collectionID"))


@query(
    """SELECT r_regionkey::BIGINT AS id, r_name AS name, 0 AS depth, r_name AS path FROM region
UNION ALL SELECT n_nationkey + 1000, n_name, 1, r_name || ' / ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey"""
)
def collection_forest(spark, d):
    return tree.forest(I.collections(spark, d)).select("id", "name", "depth", "path")


@query(
    """WITH RECURSIVE t AS (SELECT p_partkey AS id, p_name AS path, 0 AS depth FROM part WHERE p_partkey = 0
UNION ALL SELECT p.p_partkey, t.path || ' / ' || p.p_name, t.depth + 1 FROM part p JOIN t ON p.p_partkey > 0 AND floor((p.p_partkey - 1) / 2) = t.id)
SELECT id, depth, path FROM t"""
)
def deep_forest_paths(spark, d):
    return tree.forest(I.deep_tree(spark, d)).select("id", "depth", "path")


_CLOSURE = """c AS (SELECT p_partkey AS ancestor, p_partkey AS id FROM part
UNION ALL SELECT c.ancestor, p.p_partkey FROM part p JOIN c ON p.p_partkey > 0 AND floor((p.p_partkey - 1) / 2) = c.id)"""


@query(f"WITH RECURSIVE {_CLOSURE} SELECT ancestor AS id, count(DISTINCT l_orderkey) AS item_count FROM c LEFT JOIN lineitem ON l_partkey = id GROUP BY ancestor")
def subtree_item_count(spark, d):
    return tree.subtree_item_counts(I.deep_tree(spark, d), I.deep_membership(spark, d))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT ancestor AS start, id FROM c WHERE ancestor IN (3, 11, 20)")
def descendants(spark, d):
    return tree.descendants(I.deep_tree(spark, d), spark.createDataFrame([(3,), (11,), (20,)], "id bigint"))


@query(f"WITH {_PATHS} SELECT item_key, path FROM paths")
def primary_collection_path(spark, d):
    return tree.primary_paths(I.membership(spark, d), tree.forest(I.collections(spark, d)))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'P') AS total FROM orders")
def prefetch_pending(spark, d):
    return citations.pending(I.items(spark, d), I.records(spark, d))


@query(f"WITH {_EDGES} SELECT DISTINCT source AS item_key FROM edge")
def ready_keys(spark, d):
    return I.records_with_arrays(spark, d).filter(citations.is_ready()).select("item_key")


@query(f"WITH {_REC} SELECT item_key, status FROM rec WHERE o_orderkey % 3 = 0")
def orphans(spark, d):
    live = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(I.paper().alias("item_key"))
    return citations.orphans(I.records(spark, d), live).select("item_key", "status")


@query(f"WITH {_NODES} SELECT id, type FROM node WHERE id IN (SELECT source FROM edge UNION SELECT target FROM edge)")
def isolate_free_nodes(spark, d):
    return citations.without_isolates(_plain_nodes(spark, d), _edges(spark, d)).select("id", "type")


#: The papers of one collection of the library: those of the customers of a region.
_REGION = "o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')"


def _small_selection(spark, d):
    asia = table(spark, d, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    theirs = table(spark, d, "nation").join(asia, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, d, "customer").join(theirs, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(customers, "o_custkey", "left_semi").select(I.paper().alias("item_key"))


@query(
    f"""WITH {_NODES}, own AS (SELECT id FROM node WHERE type = 'owned' AND id IN (SELECT 'o' || o_orderkey FROM orders WHERE {_REGION})), kept AS (SELECT * FROM edge WHERE source IN (FROM own) OR target IN (FROM own))
SELECT id, type FROM node WHERE id IN (FROM own) OR id IN (SELECT source FROM kept) OR id IN (SELECT target FROM kept)"""
)
def restricted_subgraph_nodes(spark, d):
    return citations.restrict(_plain_nodes(spark, d), _edges(spark, d), _small_selection(spark, d))[0].select("id", "type")


@query(f"WITH {_EDGES} SELECT source, target FROM edge WHERE source IN (SELECT 'o' || o_orderkey FROM orders WHERE {_REGION})")
def restricted_subgraph_edges(spark, d):
    return citations.restrict(_plain_nodes(spark, d), _edges(spark, d), _small_selection(spark, d))[1].select("source", "target")


@query(f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edge UNION ALL SELECT target FROM edge) GROUP BY id")
def degree(spark, d):
    return citations.degrees(_edges(spark, d))


_JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS doc_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'queued' END AS status, ts AS mtime, lpad(event_id::VARCHAR, 12, '0') AS path FROM events)"""


def _latest_sql(statuses: str) -> str:
    return f"SELECT doc_id, job_id, status, mtime FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mtime DESC, job_id) AS n FROM jobs WHERE status IN ({statuses})) WHERE n = 1"


@query(f"WITH {_JOBS} {_latest_sql("'done'")}")
def latest_narration(spark, d):
    return jobs.latest(I.jobs(spark, d), ("done",))


@query(f"WITH {_JOBS} {_latest_sql("'queued', 'running'")}")
def active_narration(spark, d):
    return jobs.latest(I.jobs(spark, d), jobs.ACTIVE)


@query(f"WITH {_JOBS} SELECT * FROM ({_latest_sql("'done'")}) WHERE doc_id % 2 = 0")
def narration_registry(spark, d):
    return jobs.registry(I.jobs(spark, d), table(spark, d, "documents").filter("doc_id % 2 = 0"))


@query(f"WITH {_JOBS} SELECT job_id, doc_id, status, mtime FROM (SELECT *, row_number() OVER (ORDER BY mtime DESC, path DESC) AS n FROM jobs WHERE status IN ('done', 'error')) WHERE n > 200")
def retention_delete(spark, d):
    return jobs.retention_delete(I.jobs(spark, d)).select("job_id", "doc_id", "status", "mtime")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'error' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'interrupted by restart' END AS error FROM jobs")
def recovered_jobs(spark, d):
    return jobs.recovered(I.jobs(spark, d)).select("job_id", "status", "error")


@query(
    f"""WITH {_JOBS}, a AS ({_latest_sql("'queued', 'running'")}), n AS ({_latest_sql("'done'")})
SELECT documents.doc_id, coalesce(a.job_id, n.job_id) AS job_id, CASE WHEN a.job_id IS NOT NULL THEN 'active' WHEN n.job_id IS NOT NULL THEN 'done' ELSE 'idle' END AS state
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def narration_state(spark, d):
    return jobs.view_state(I.jobs(spark, d), table(spark, d, "documents"))


_SCORE = "CASE WHEN global_cited_by > 0 THEN global_cited_by ELSE greatest(0, coalesce(cited_by, 0)) END"


@query(
    f"""WITH {_NODES}, s AS (SELECT id, type, {_SCORE} AS score, log10({_SCORE} + 1) AS value FROM node), e AS (SELECT min(value) AS low, max(value) AS high FROM s),
n AS (SELECT id, score, type, CASE WHEN high > low THEN greatest(0, least(1, (value - low) / (high - low))) ELSE 0 END AS part FROM s, e)
SELECT id, score, round(CASE WHEN type = 'owned' THEN 1.2::DOUBLE + (9.5::DOUBLE - 1.2::DOUBLE) * pow(part, 0.8) ELSE 0.8::DOUBLE + (6.25::DOUBLE - 0.8::DOUBLE) * pow(part, 0.8) END, 6) AS size FROM n"""
)
def citation_scale(spark, d):
    return timeline.citation_scale(_plain_nodes(spark, d)).select("id", F.col("score").cast("bigint").alias("score"), F.round("size", 6).alias("size"))


_YEARS = f"""{_NODES}, y AS (SELECT id, type, CASE WHEN type = 'owned' THEN year::DOUBLE ELSE year::DOUBLE END AS y FROM node WHERE year IS NOT NULL),
wrong AS (SELECT DISTINCT t.id FROM edge JOIN y s ON s.id = source JOIN y t ON t.id = target WHERE floor(t.y) > floor(s.y)),
kept AS (SELECT id, type, y AS year FROM y WHERE id NOT IN (FROM wrong))"""


@query(f"WITH {_YEARS} SELECT id, type, year FROM kept")
def timeline_years(spark, d):
    return timeline.timeline_years(_plain_nodes(spark, d), _edges(spark, d))


@query(
    f"""WITH {_YEARS}, o AS (SELECT node.id, node.type, kept.year, row_number() OVER (PARTITION BY node.type ORDER BY coalesce(kept.year, 0), node.id) - 1 AS i FROM node LEFT JOIN kept ON kept.id = node.id),
l AS (SELECT id, type, year, i, CASE WHEN type = 'owned' THEN i - 1 ELSE i END % 12 AS lane FROM o), e AS (SELECT min(year) AS low, max(year) AS high FROM kept)
SELECT id, round(-440 + (year - low) / CASE WHEN high <> low THEN high - low ELSE 1 END * 880, 6) AS x,
  (CASE WHEN type = 'owned' AND i = 0 THEN 0 ELSE (CASE WHEN lane % 2 = 0 THEN -1 ELSE 1 END) * (floor(lane / 2) + 1) * 34 END)::DOUBLE AS y
FROM l, e WHERE year IS NOT NULL"""
)
def timeline_positions(spark, d):
    nodes = written(_plain_nodes(spark, d).select("id", "type", "year", "date"))
    return timeline.timeline_positions(nodes, timeline.timeline_years(nodes, _edges(spark, d))).select("id", F.round("x", 6).alias("x"), "y")


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '10.1000/' || lower(replace(p_brand, ' ', '')) END AS doi FROM part")
def normalize_doi(spark, d):
    raw = F.when(F.col("p_partkey") % 9 == 0, F.lit(" https://doi.org/ ")).otherwise(F.concat(F.lit("\tHTTPS://DX.DOI.ORG/10.1000/"), F.replace("p_brand", F.lit(" "), F.lit("")), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", X.normalize_doi(raw).alias("doi"))


@query("SELECT p_partkey, 'W' || p_partkey AS short_id, (p_size + 1970)::VARCHAR AS year FROM part")
def identifiers(spark, d):
    url = F.concat(F.lit("https://example.org/works/W"), F.col("p_partkey").cast("string"), F.lit("//"))
    return table(spark, d, "part").select("p_partkey", X.short_id(url).alias("short_id"), X.first_year(F.concat(F.lit("ca. "), (F.col("p_size") + 1970).cast("string"), F.lit("-1999"))).alias("year"))


@query("SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '^-+|-+$', '', 'g') AS slug FROM documents")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(
    """SELECT p_partkey, list_reduce(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295) % 15 AS palette,
  list_reduce(list_prepend(2166136261, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS fnv FROM part"""
)
def name_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", X.palette_index(F.col("p_name")).cast("bigint").alias("palette"), X.fnv1a(F.col("p_name")).alias("fnv"))


_TITLES = [(1, "red widget"), (2, "WIDGET   ring"), (3, "something else entirely"), (4, ""), (5, "gear of the small ring")]


@query(
    f"""WITH q(query_id, query) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in _TITLES)}),
t AS (SELECT p_partkey AS ord, p_partkey AS doc_id, p_name, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: w <> '')) AS tt FROM part),
m AS (SELECT query_id, doc_id, ord, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS ql, lower(p_name) AS tl, tt, list_distinct(list_filter(string_split(lower(query), ' '), lambda w: w <> '')) AS qt FROM q, t),
r AS (SELECT *, ql <> '' AND (contains(tl, ql) OR contains(ql, tl)) AS hit, CASE WHEN len(qt) > 0 AND len(tt) > 0 THEN len(list_intersect(qt, tt))::DOUBLE / len(qt) ELSE 0.0::DOUBLE END AS overlap FROM m),
b AS (SELECT query_id, doc_id, CASE WHEN hit THEN 1 WHEN overlap >= 0.45 THEN 2 ELSE 3 END AS rule, CASE WHEN hit THEN 1.0::DOUBLE ELSE overlap END AS score, ord FROM r)
SELECT query_id, doc_id, rule, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rule, -score, ord) AS n FROM b) WHERE n = 1 AND rule < 3"""
)
def fuzzy_match(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return matching.resolve_titles(spark.createDataFrame(_TITLES, "query_id int, query string"), titles)


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, replace(replace(t, '```', ' '), '`', '') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s{0,3}#{1,6}\s*', '', 'g'), '(?m)^\s{0,3}>\s?', '', 'g'), '(?m)^\s{0,3}([-*+]|\d{1,2}[.)])\s+', '', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(replace(regexp_replace(t, '\*+', '', 'g'), '~~', ''), '__([^_]+)__', '\1', 'g') AS t FROM c),
-- no look-behind here: a match takes its neighbours along, so that the next one is found by a second pass
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^\pL\pM\pN_])_([^_]+)_($|[^\pL\pM\pN_])', '\1\2\3', 'g'), '(^|[^\pL\pM\pN_])_([^_]+)_($|[^\pL\pM\pN_])', '\1\2\3', 'g') AS t FROM d),
f AS (SELECT doc_id, replace(replace(replace(replace(regexp_replace(regexp_replace(t, '[“”]', '"', 'g'), '[‘’]', chr(39), 'g'), '|', ' '), '•', ', '), '–', '-'), '—', ', ') AS t FROM e)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS spoken FROM f"""
)
def clean_for_speech(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_for_speech(F.col("text"))).alias("spoken"))


@query(
    r"""WITH t AS (SELECT doc_id, replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), chr(10), ' ') AS s FROM documents),
p AS (SELECT doc_id, list_transform(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS sentences FROM t),
u AS (SELECT doc_id, list_filter(flatten(list_transform(sentences, lambda x: CASE WHEN len(x) > 400 THEN list_transform(string_split(regexp_replace(x, '([,;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)) ELSE [x] END)), lambda y: y <> '') AS units FROM p),
a AS (SELECT doc_id, list_reduce(list_prepend('', units), lambda acc, x: CASE WHEN regexp_extract(acc, '[^\x02]*$') = '' THEN acc || x
  WHEN len(regexp_extract(acc, '[^\x02]*$')) + len(x) + 1 <= 400 THEN acc || ' ' || x ELSE acc || chr(2) || x END) AS packed FROM u WHERE len(units) > 0)
SELECT doc_id, (unnest(range(len(string_split(packed, chr(2))))))::INTEGER AS pos, unnest(string_split(packed, chr(2))) AS chunk FROM a"""
)
def speech_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.speech_chunks(F.col("text"))).alias("pos", "chunk"))


@query(
    f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, pos, chunk FROM chunk"""
)
def doc_chunks(spark, d):
    return narration.chunks(table(spark, d, "documents"))


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents")
def strip_bibliography(spark, d):
    with_list = F.concat("text", F.lit("\nReferences\nfirst list\n 7. Works  cited:\n[1] A paper.\nReferences to others"))
    first_kept = F.regexp_replace(X.strip_bibliography(with_list), r"\nReferences\nfirst list$", "")
    return table(spark, d, "documents").select("doc_id", F.md5(X.ws_trim(first_kept)).alias("body"))


@query(
    """SELECT l_orderkey AS doc_id, l_linenumber AS page, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_quantity + 5 < 25 THEN 0 ELSE 1 END, round(l_extendedprice, 1), l_quantity, l_extendedprice, l_shipdate::DATE::VARCHAR || ' ' || l_partkey) - 1)::INTEGER AS pos,
  l_shipdate::DATE::VARCHAR || ' ' || l_partkey AS text FROM lineitem WHERE l_returnflag <> 'R'"""
)
def reading_order(spark, d):
    blocks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(50.0).alias("width"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), (F.col("l_quantity") + 10).alias("x1"), F.col("l_extendedprice").alias("y1"),
        F.concat(F.lit(" "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("\n "), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("kind"),
    )
    return narration.reading_order(blocks)


# labels spread along all edges; the number of rounds is above the graph's diameter
_COMPONENTS = """e AS (SELECT l_orderkey AS a, 100000000 + l_partkey AS b FROM lineitem UNION SELECT 100000000 + l_partkey, l_orderkey FROM lineitem UNION SELECT o_orderkey, o_orderkey FROM orders UNION SELECT 100000000 + p_partkey, 100000000 + p_partkey FROM part),
r AS (SELECT 0 AS i, a AS id, a AS component FROM e WHERE a = b UNION ALL SELECT r.i + 1, e.b, min(r.component) FROM r JOIN e ON e.a = r.id WHERE r.i < 40 GROUP BY r.i + 1, e.b),
c AS (SELECT id, component FROM r WHERE i = 40)"""


def _whole_graph(spark, d):
    """All orders and parts, all lines between them."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (F.lit(100000000) + F.col("l_partkey")).alias("target"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, d, "part").select((F.lit(100000000) + F.col("p_partkey")).alias("id"))), edges


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT id, component FROM c")
def connected_components(spark, d):
    return components.connected_components(*_whole_graph(spark, d))


@query(
    f"""WITH RECURSIVE {_COMPONENTS}, v AS (SELECT component, greatest(4.5, sqrt((id % 7)::DOUBLE) * 3.2) + 3 AS r FROM c)
SELECT component, count(*) AS size, round(greatest(28.0, sqrt(sum(r * r)) * 1.12, sqrt(count(*)) * 8), 6)::DOUBLE AS radius FROM v GROUP BY component"""
)
def component_shapes(spark, d):
    found = components.connected_components(*_whole_graph(spark, d)).withColumn("value", (F.col("id") % 7).cast("double"))
    return timeline.component_shapes(found).select("component", "size", F.round("radius", 6).alias("radius"))


@query(
    """WITH p AS (SELECT DISTINCT p_brand AS cluster, p_size::DOUBLE AS x, p_retailprice AS y FROM part), n AS (SELECT cluster, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT a.cluster, a.x, a.y, b.x AS bx, b.y AS by FROM p a JOIN p b ON a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y)),
-- a side of the hull: all other points lie left of it, or on it between its ends
w AS (SELECT s.cluster, s.x, s.y FROM s JOIN p c ON c.cluster = s.cluster GROUP BY s.cluster, s.x, s.y, s.bx, s.by
  HAVING bool_and((s.bx - s.x) * (c.y - s.y) - (s.by - s.y) * (c.x - s.x) > 0 OR ((s.bx - s.x) * (c.y - s.y) - (s.by - s.y) * (c.x - s.x) = 0
    AND c.x BETWEEN least(s.x, s.bx) AND greatest(s.x, s.bx) AND c.y BETWEEN least(s.y, s.by) AND greatest(s.y, s.by))))
SELECT cluster, x, y FROM w UNION SELECT p.cluster, x, y FROM p JOIN n USING (cluster) WHERE n < 3"""
)
def cluster_hulls(spark, d):
    return timeline.hulls(table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))).select("cluster", "x", "y")


@query(
    f"""WITH {_REC}, n AS (SELECT rec.o_orderkey, min(rec.cited_by) AS c, count(l_partkey) AS n FROM rec LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE status = 'mapped' GROUP BY 1)
SELECT count(*)::BIGINT AS mapped, count(*) FILTER (n > 0)::BIGINT AS with_references, count(*) FILTER (n = 0)::BIGINT AS without_references, (100 * count(*) FILTER (n > 0) // count(*))::BIGINT AS with_percent,
  (list_sort(list(n)))[count(*) // 2 + 1]::INTEGER AS median, round(sum(n) / count(*), 1)::DOUBLE AS mean, max(n)::INTEGER AS most, count(*) FILTER (n > 0 AND c % 3 = 0)::BIGINT AS citers_fetched FROM n"""
)
def cache_report(spark, d):
    return citations.record_report(I.records_with_arrays(spark, d))


@query(f"WITH {_REC} SELECT status, count(*) AS records FROM rec GROUP BY status")
def status_histogram(spark, d):
    return citations.status_counts(I.records(spark, d))


@query(f"WITH {_REC} SELECT item_key FROM rec WHERE status = 'mapped' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY item_key LIMIT 10")
def empty_records_sample(spark, d):
    return citations.empty_sample(I.records_with_arrays(spark, d))


@query("SELECT user_id AS item_key, arg_max(event_type, ts) AS status, max(ts) AS \"fetchedAt\" FROM events GROUP BY 1")
def newest_records(spark, d):
    return incremental.newest(table(spark, d, "events").select(F.col("user_id").alias("item_key"), F.col("event_type").alias("status"), F.col("ts").alias("fetchedAt")))


@query("SELECT 'o' || o_orderkey AS item_key, o_orderkey AS sel_pos FROM orders WHERE o_orderstatus <> 'F'")
def records_to_fetch(spark, d):
    return incremental.todo(I.selection(spark, d), I.records(spark, d))


@query("SELECT DISTINCT 'w' || l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size > 40")
def pending_reference_ids(spark, d):
    e = F.struct("id", "title", "date", "year")
    return incremental.pending_references(I.references(spark, d).select(F.array(e).alias("references")))


@query(
    rf"""WITH RECURSIVE {_CHUNKS},
n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, chunk FROM chunk),
a AS (SELECT doc_id, pos, md5('Part ' || (pos + 1) || ' of ' || n || ' of a paper. Sum up its claims, methods and results in plain sentences.' || chr(10) || chr(10) || chunk) AS answer FROM n),
s AS (SELECT doc_id, count(*) AS prompts, 'Write a spoken narration of a paper from these notes.' || chr(10) || chr(10) || string_agg(answer, chr(10) || chr(10) ORDER BY pos) AS prompt FROM a GROUP BY doc_id)
SELECT doc_id, prompts, md5(prompt) AS script, CASE WHEN prompts % 2 = 0 THEN 'OK' ELSE 'check ' || prompts END AS note FROM s"""
)
def narration_prompts(spark, d):
    # a stand-in for a model: it answers with the prompt's digest, and with a blank where it has nothing to say
    digest = lambda prompts: [hashlib.md5(p.encode()).hexdigest() for p in prompts]
    verdict = lambda prompts: [" " if (n := p.count("\n\n")) % 2 == 0 else f"check {n}" for p in prompts]
    answered = narration.with_model(narration.digest_prompts(narration.chunks(table(spark, d, "documents"))), digest)
    script = narration.compose_prompts(answered)
    counts = answered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("prompts"))
    noted = narration.checked(narration.with_model(script, verdict, out="note"))
    return noted.join(counts, "doc_id").select("doc_id", "prompts", F.md5("prompt").alias("script"), "note")


_SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey || '.mp3' ELSE {_SLUG} || '--' || p_partkey || '.mp3' END AS file FROM part")
def audio_names(spark, d):
    title = F.when(F.col("p_partkey") % 4 == 0, F.lit("?!")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.audio_name(title, F.col("p_partkey").cast("string")).alias("file"))


@query("SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), ['small', 'red', 'ring'])) / 3.0::DOUBLE AS overlap FROM part")
def title_overlap(spark, d):
    return table(spark, d, "part").select("p_partkey", X.token_overlap(F.lit("Small, RED ring!"), F.col("p_name")).alias("overlap"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents")
def html_escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.html_escape(F.col("text"))).alias("escaped"))


_NEAT = r"trim(regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '[.]+$', ''))"


@query(
    f"""SELECT item_id, len(body) >= 4 AND (contains(p, body) OR n <> '' AND contains(body, n)) AS hit FROM (SELECT *, array_to_string((string_split(p, ' '))[1:8], ' ') AS n FROM (
  SELECT item_id, {_NEAT.format('substr(text, 1 + item_id % 7, 20 + item_id % 90)')} AS body, {_NEAT.format('substr(text, 1 + item_id % 40)')} AS p FROM benchmark))"""
)
def passage_hits(spark, d):
    # parts of benchmark passages as blocks; what is looked for begins somewhere in each, often within a word
    i, text = F.col("item_id"), F.col("text")
    block = F.substring(text, (i % 7 + 1).cast("int"), (i % 90 + 20).cast("int"))
    return table(spark, d, "benchmark").select("item_id", X.passage_hit(block, F.substring(text, (i % 40 + 1).cast("int"), F.length("text"))).alias("hit"))


@query(
    rf"""WITH b AS (SELECT item_id, generate_subscripts(parts, 1) - 1 AS block, unnest(parts) AS text FROM (SELECT item_id, string_split(text, ' ') AS words, list_transform(range(0, len(words), 5), lambda i: array_to_string(words[i + 1:i + 5], ' ')) AS parts FROM benchmark)),
f AS (SELECT item_id, block, {_NEAT.format('text')} AS form FROM b), p AS (SELECT item_id, k AS passage, {_NEAT.format('substr(text, 1 + (item_id * 37 + k * 211) % (len(text) + 1), 60 + 40 * k)')} AS p FROM benchmark, range(3) t(k)),
n AS (SELECT *, array_to_string((string_split(p, ' '))[1:8], ' ') AS n FROM p)
SELECT n.item_id, n.passage::INTEGER AS passage, f.block::INTEGER AS block FROM n JOIN f ON f.item_id = n.item_id AND len(form) >= 4 AND (contains(p, form) OR n <> '' AND contains(form, n)) GROUP BY ALL"""
)
def passage_blocks(spark, d):
    # five words as a block, three passages of each text, which begin anywhere and run over several blocks
    texts = table(spark, d, "benchmark")
    words = F.split("text", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(5)), lambda i: F.array_join(F.slice(words, i + 1, 5), " "))
    blocks = texts.select("item_id", F.posexplode(cut).alias("block", "text"))
    k = F.col("passage")
    begin = (F.pmod(F.col("item_id") * 37 + k * 211, F.length("text") + 1) + 1).cast("int")
    passages = texts.withColumn("passage", F.explode(F.array(*(F.lit(n) for n in range(3))))).select("item_id", "passage", F.substring(F.col("text"), begin, 60 + 40 * k).alias("text"))
    return matching.passage_blocks(blocks, passages, "item_id")


@query("SELECT l_orderkey AS job_id, round(sum(l_quantity::BIGINT * 1000) / 60000.0::DOUBLE, 2) AS duration_min FROM lineitem GROUP BY 1")
def audio_minutes(spark, d):
    return narration.minutes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_quantity").cast("bigint") * 1000).alias("ms")))


def _points(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("component"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(3.0).alias("radius"))


@query("SELECT min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part")
def bounding_box(spark, d):
    return timeline.extremes(_points(spark, d))


@query(
    """WITH m AS (SELECT p_brand AS component, avg(p_size::DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1)
SELECT component, round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(sqrt((p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y)) + 3), 4) AS reach FROM m JOIN part ON p_brand = component GROUP BY component"""
)
def component_centroids(spark, d):
    return timeline.centroids(_points(spark, d)).select("component", *(F.round(c, 4).alias(c) for c in ("x", "y", "reach")))


@query(
    """SELECT l_orderkey AS id, round(avg(p_size::DOUBLE), 6) AS x, round(avg(p_retailprice), 4) AS y FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 2 = 0 GROUP BY 1"""
)
def seed_positions(spark, d):
    off = 100000000
    placed = table(spark, d, "part").filter("p_partkey % 2 = 0").select((F.col("p_partkey") + off).alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") + off).alias("target"))
    free = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return timeline.seed_positions(free, placed, edges).select("id", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {_YEARS} SELECT source, target FROM edge WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def visible_edges(spark, d):
    nodes, edges = _plain_nodes(spark, d), _edges(spark, d)
    return timeline.visible(nodes, edges, timeline.timeline_years(nodes, edges))[1].select("source", "target")


@query(f"WITH {_EDGES} SELECT target AS id, count(*) AS cited_by FROM edge GROUP BY target HAVING count(*) >= 2")
def citation_gaps(spark, d):
    return citations.gaps(_plain_nodes(spark, d)).select("id", "cited_by")


@query(
    f"""WITH {_EDGES}, deg AS (SELECT target AS id, count(*) AS n FROM edge GROUP BY target)
SELECT item_key AS id, substr({_OWNED}, 1, 32) AS shown FROM rec WHERE status = 'mapped'
UNION ALL SELECT ref.id, CASE WHEN min(n) >= 2 THEN substr(CASE WHEN min(p_size) <= 40 THEN min(p_name) ELSE ref.id END, 1, 32) END FROM ref JOIN part ON p_partkey = l_partkey JOIN deg ON deg.id = ref.id GROUP BY ref.id"""
)
def shown_labels(spark, d):
    return citations.shown_labels(_plain_nodes(spark, d), citations.degrees(_edges(spark, d)))


@query(f"SELECT count(*) > 0 AS meet FROM orders WHERE {_REGION}")
def selections_meet(spark, d):
    return citations.selections_meet(I.selection(spark, d), _small_selection(spark, d))


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') = 0 AS complete, count(*) FILTER (o_orderstatus <> 'F') AS unmapped FROM orders")
def layer_complete(spark, d):
    return citations.layer_complete(citations.coverage(I.selection(spark, d), I.records(spark, d)))


@query(f"WITH {_JOBS} SELECT job_id FROM jobs WHERE status IN ('queued', 'running') AND doc_id % 2 = 0")
def active_jobs(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "prefetch").otherwise("fetch")
    return jobs.active_ids(I.jobs(spark, d).withColumn("kind", kind), "prefetch")


@query(
    """SELECT event_id AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'queued' END AS status,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'step ' || (event_id % 5) ELSE 'queued' END AS stage, CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN event_id % 100 ELSE 0 END::BIGINT AS progress,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'page ' || event_id END AS detail, CASE WHEN event_type = 'error' THEN 'failure ' || (event_id % 4) END AS error, NULL::VARCHAR AS result FROM events"""
)
def public_jobs(spark, d):
    # jobs as they are kept, with fields that aren't shown and without one that is
    kind, n = F.col("event_type"), F.col("event_id")
    extra = table(spark, d, "events").select(
        n.alias("job_id"),
        F.when(kind == "purchase", "done").when(kind == "click", F.concat(F.lit("step "), (n % 5).cast("string"))).otherwise("queued").alias("stage"),
        F.when(kind == "purchase", 100).when(kind == "click", n % 100).otherwise(0).cast("bigint").alias("progress"),
        F.when((kind == "click") & (n % 3 == 0), F.concat(F.lit("page "), n.cast("string"))).alias("detail"),
        F.when(kind == "error", F.concat(F.lit("failure "), (n % 4).cast("string"))).alias("error"),
    )
    return jobs.public(I.jobs(spark, d).drop("error").join(extra, "job_id"))


@query(f"WITH {_JOBS} SELECT job_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY mtime DESC, job_id)::INTEGER AS rank FROM jobs WHERE status IN ('done', 'error')")
def job_ranks(spark, d):
    return jobs.window_rank(I.jobs(spark, d)).select("job_id", "doc_id", "rank")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS title FROM part")
def last_titles(spark, d):
    p = table(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("item_key"), F.col("p_name").alias("title"), F.lit(1).alias("priority"))
    new = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item_key"), F.concat(F.lit("new "), "p_name").alias("title"), F.lit(2).alias("priority"))
    return jobs.last_wins(old.unionByName(new)).select(F.col("item_key").alias("p_partkey"), "title")


@query(f"WITH {_EDGES} SELECT 'o' || o_orderkey AS item_key, CASE WHEN o_orderstatus = 'P' THEN 'not mappable' WHEN 'o' || o_orderkey IN (SELECT source FROM edge) THEN 'check' ELSE '' END AS status, o_orderkey % 4 = 0 AS playable FROM orders")
def row_status(spark, d):
    ready = I.records_with_arrays(spark, d).filter(citations.is_ready())
    narrated = table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(I.paper().alias("item_key"))
    return jobs.row_status(I.items(spark, d), ready, narrated)


@query(f"WITH {_EDGES} SELECT item_key, o_orderkey AS sel_pos FROM rec WHERE NOT (status = 'mapped' AND cited_by % 3 = 0 AND item_key IN (SELECT source FROM edge))")
def citers_to_fetch(spark, d):
    return incremental.citers_todo(I.selection(spark, d), I.records_with_arrays(spark, d))


@query("SELECT p_partkey, (5 + trunc(35 * p_size / 50.0))::INTEGER AS progress FROM part")
def fetch_progress(spark, d):
    return table(spark, d, "part").select("p_partkey", X.progress(5, 35, F.col("p_size"), F.lit(50)).alias("progress"))


@query("SELECT r_regionkey::BIGINT AS parent, (n_nationkey + 1000)::BIGINT AS id, row_number() OVER (PARTITION BY r_regionkey ORDER BY lower(n_name), n_nationkey)::INTEGER AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def sibling_order(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("parent").orderBy("sort_path")
    return tree.forest(I.collections(spark, d)).filter("parent IS NOT NULL").select("parent", "id", F.row_number().over(order).alias("place"))
