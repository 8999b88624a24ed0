"""Queries over what arrives bit by bit: incremental maps, job logs, paged lookups. Each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching, tree
from ..sources import lookups, snapshots, variants
from ..sources.tables import table
from ..storage import dealt, new_store
from ..streaming import machine
from ..streaming.maps import IncrementalMap
from . import inputs as I
from .queries import query

#: Batches that the log of records arrives in; an event's number decides, so that older versions also come after newer ones.
BATCHES = 4

#: Lines of orders that a task of a written cache takes: some MB of a shuffle.
LINES_A_TASK = 100_000


def _incremental(spark, d):
    log = I.record_log(spark, d)
    users = table(spark, d, "events").select(F.col("user_id")).distinct()
    selection = users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_key"), F.col("user_id").alias("sel_pos"))
    live = IncrementalMap(spark, new_store(spark), selection, buckets=16, spread=4)  # a few files a batch
    for number in range(BATCHES):
        live.apply(log.filter(F.pmod("event_id", F.lit(BATCHES)) == number).drop("event_id"), number)
    return live, selection


_LIVE = """last AS (SELECT user_id, event_id AS e, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
entry AS (SELECT user_id, e, j, (e * 7 + j * j) % 997 AS w FROM last, range(6) r(j) WHERE event_type <> 'error' AND j <= e % 6 AND (e + j) % 11 <> 0)"""


@query(
    f"""WITH {_LIVE}, x AS (SELECT w, count(*) AS n, arg_min(e, user_id * 10 + j) AS e FROM entry GROUP BY w)
SELECT 'u' || user_id AS id, 'u' || user_id AS label, 'owned' AS type, NULL::BIGINT AS cited_by, e % 500 AS global_cited_by, strftime(ts, '%Y-%m-%d') AS date, NULL AS year FROM last WHERE event_type <> 'error'
UNION ALL SELECT 'w' || w, CASE WHEN w % 4 <> 0 THEN 'Work ' || w || ', as cited ' || (e % 3) ELSE 'w' || w END, 'external', n, w + e % 3, NULL, (w % 40 + 1980)::VARCHAR FROM x"""
)
def incremental_map_nodes(spark, d):
    live, selection = _incremental(spark, d)
    items = selection.select("item_key", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("year"))
    none = selection.limit(0).select("item_key", F.lit("").alias("path"))
    return live.nodes(items, none).select("id", "label", "type", "cited_by", "global_cited_by", "date", "year")


@query(f"WITH {_LIVE} SELECT 'u' || user_id AS source, 'w' || w AS target FROM entry")
def incremental_map_edges(spark, d):
    return _incremental(spark, d)[0].edges()


#: Hours after which a silent job counts as interrupted.
PATIENCE_HOURS = 30.0


def _job_log(events):
    """Every user has a job in five days each; the store's generation changes once in that time."""
    day = F.dayofmonth("ts")
    kind = F.when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "click", "cancel").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("queued")
    kind = F.when(F.col("event_type").isin("click", "purchase", "error") & (F.pmod("event_id", F.lit(3)) != 0), "progress").otherwise(kind)
    return events.select(
        (F.col("user_id") * 100 + F.floor(day / 5)).alias("job_id"),
        F.col("ts").cast("timestamp").alias("at"),
        kind.alias("kind"),
        F.floor((day + 2) / 5).alias("generation"),
        F.concat(F.lit("step "), F.pmod("event_id", F.lit(7)).cast("string")).alias("stage"),
        F.pmod("event_id", F.lit(100)).cast("int").alias("progress"),
        F.concat(F.lit("failure "), F.pmod("event_id", F.lit(5)).cast("string")).alias("detail"),
    )


#: Written from the rules, not from the machine: what each entry after a job's start would end it with, and the first that does.
MACHINE_SQL = """WITH raw AS (SELECT *, day(ts) AS d FROM events),
log AS (SELECT user_id * 100 + d // 5 AS job_id, ts AS tm, event_id, (d + 2) // 5 AS generation, 'step ' || (event_id % 7) AS stage, (event_id % 100)::INTEGER AS progress, 'failure ' || (event_id % 5) AS detail,
  CASE WHEN event_type = 'view' OR (event_type IN ('click', 'purchase', 'error') AND event_id % 3 <> 0) THEN 'progress' WHEN event_type = 'click' THEN 'cancel' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'queued' END AS kind FROM raw),
started AS (SELECT job_id, min(tm) FILTER (kind = 'progress') AS start, min(tm) FILTER (kind = 'cancel') AS asked, min(tm) FILTER (kind = 'queued') AS queued FROM log GROUP BY job_id),
first AS (SELECT log.job_id, generation AS own FROM log JOIN started ON started.job_id = log.job_id AND tm = start),
later AS (SELECT log.*, own, asked, max(tm) FILTER (kind = 'progress') OVER (PARTITION BY log.job_id ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heard
  FROM log JOIN started USING (job_id) JOIN first USING (job_id) WHERE tm >= start AND (asked IS NULL OR asked > start)),
told AS (SELECT *, CASE WHEN heard IS NULL OR kind = 'queued' AND NOT tm > heard + INTERVAL 30 HOUR OR kind = 'cancel' AND NOT tm > heard + INTERVAL 30 HOUR THEN NULL WHEN tm > heard + INTERVAL 30 HOUR THEN 'interrupted by restart' WHEN kind = 'failed' THEN detail
  WHEN generation <> own THEN 'derived state was reset' WHEN kind = 'progress' AND tm > asked THEN 'cancelled' WHEN kind = 'done' THEN 'ok' END AS ending FROM later),
ended AS (SELECT job_id, arg_min(ending, tm) AS ending, arg_min(CASE WHEN ending = 'interrupted by restart' THEN heard + INTERVAL 30 HOUR ELSE tm END, tm) AS since, min(tm) AS stopped FROM told WHERE ending IS NOT NULL GROUP BY job_id),
steps AS (SELECT told.job_id, max(tm) AS heard, arg_max(stage, tm) AS stage, arg_max(progress, tm) AS progress FROM told LEFT JOIN ended USING (job_id) WHERE kind = 'progress' AND (stopped IS NULL OR tm < stopped) GROUP BY told.job_id),
late AS (SELECT max(tm) AS now FROM log)
SELECT job_id,
  CASE WHEN start IS NULL THEN 'queued' WHEN asked < start THEN 'error' WHEN ending = 'ok' THEN 'done' WHEN ending IS NOT NULL OR now > heard + INTERVAL 30 HOUR THEN 'error' ELSE 'running' END AS status,
  CASE WHEN start IS NULL OR asked < start AND queued < start THEN 'queued' WHEN asked < start THEN NULL WHEN ending = 'ok' THEN 'done' ELSE stage END AS stage,
  CASE WHEN start IS NULL OR asked < start AND queued < start THEN 0 WHEN asked < start THEN NULL WHEN ending = 'ok' THEN 100 ELSE progress END::INTEGER AS progress,
  CASE WHEN start IS NULL THEN NULL WHEN asked < start THEN 'cancelled' WHEN ending = 'ok' THEN NULL WHEN ending IS NOT NULL THEN ending WHEN now > heard + INTERVAL 30 HOUR THEN 'interrupted by restart' END AS error,
  CASE WHEN start IS NULL THEN queued WHEN asked < start THEN start WHEN ending IS NOT NULL THEN since WHEN now > heard + INTERVAL 30 HOUR THEN heard + INTERVAL 30 HOUR ELSE start END AS since
FROM started LEFT JOIN ended USING (job_id) LEFT JOIN steps USING (job_id), late WHERE start IS NOT NULL OR queued IS NOT NULL"""


@query(MACHINE_SQL)
def job_machine(spark, d):
    root, events = new_store(spark), table(spark, d, "events")
    log = _job_log(spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet"))  # a pattern, for the table may be a file or a folder
    machine.follow(spark, log, f"{root}/states", f"{root}/checkpoint", PATIENCE_HOURS).awaitTermination()
    return machine.states_at(spark, f"{root}/states", PATIENCE_HOURS, events.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))).withColumn("since", F.col("since").cast("timestamp_ntz"))


def _supplier_citers(spark, d):
    """(request, rank, id): suppliers as works, the orders that cite them by their number of citations."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cited_by"))
    # dealt by order once, for the distinct rows and the join, and by request once, for ranks and pages
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").repartition("l_orderkey")
    rows = lines.distinct().join(o, "l_orderkey").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("request"), "cited_by", "l_orderkey")
    # a service sorts each answer; 600 lines a supplier at any size
    order = Window.partitionBy("request").orderBy(F.desc("cited_by"), "l_orderkey")
    return rows.select("request", F.row_number().over(order).alias("rank"), F.concat(F.lit("W"), F.col("l_orderkey").cast("string")).alias("id"))


def _pages(spark, d):
    """(requests, pages) of a recording in which some pages fail once or for good, some answers go on to an empty page, and some suppliers are unknown."""
    n = F.substring("request", 2, 20).cast("bigint")
    pages = lookups.paged(_supplier_citers(spark, d).filter(n % 7 != 0))
    empty = (n % 5 == 1) & (F.col("page") == 1)
    fails = F.when((n % 11 == 2) & (F.col("page") == 1), lookups.ATTEMPTS).otherwise(F.pmod(n + F.col("page"), F.lit(3))).cast("int")
    pages = pages.select(
        "request", "cursor", F.lit(200).alias("status"), fails.alias("fails"), F.when(n % 2 == 0, F.lit(1.5)).alias("retry_after"), F.when(empty, F.array().cast("array<string>")).otherwise(F.col("results")).alias("results"), "next_cursor"
    )
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("request")), pages


_PAGED = """WITH r AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY o_custkey DESC, l_orderkey) AS rank FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT 's' || l_suppkey AS request, (rank - 1)::INTEGER AS position, 'W' || l_orderkey AS id FROM r WHERE l_suppkey % 7 <> 0 AND rank <= CASE WHEN l_suppkey % 5 = 1 OR l_suppkey % 11 = 2 THEN 50 ELSE 100 END"""


@query(_PAGED)
def paged_citers(spark, d):
    root = new_store(spark)
    lookups.record(*_pages(spark, d), root, 12)
    lookups.register(spark)
    return spark.read.format(lookups.FORMAT).load(root)


@query(_PAGED)
def streamed_citers(spark, d):
    # the same walk by a query that is started again after each third of the requests
    root, out = new_store(spark), new_store(spark)
    requests, pages = _pages(spark, d)
    lookups.register(spark)
    third = F.pmod(F.substring("request", 2, 20).cast("bigint"), F.lit(3))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    for k in range(3):
        lookups.record(requests.filter(third == k), pages.filter(third == k), root, 4)
        stream = spark.readStream.format(lookups.FORMAT).load(root)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(lookups.SCHEMA).parquet(f"{out}/rows/batch=*")


@query(
    """WITH f AS (SELECT l_suppkey, l_partkey, min((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) AS place FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL),
b AS (SELECT *, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY place) - 1) // 50)::INTEGER AS batch FROM f)
SELECT 's' || l_suppkey AS item_key, 'w' || l_partkey AS id, batch, CASE WHEN (l_suppkey + batch) % 4 <> 0 AND p_size <= 40 THEN p_name END AS title FROM b JOIN part ON p_partkey = l_partkey"""
)
def batched_lookups(spark, d):
    # lists of hundreds of works in batches of fifty, of which every fourth fails
    lines = table(spark, d, "lineitem")
    refs = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("item_key"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("ref_pos"), F.when(F.col("l_linenumber") != 7, I.work()).otherwise(F.lit("")).alias("id"))
    works = table(spark, d, "part").filter("p_size <= 40").select(I.work("p_partkey").alias("id"), F.col("p_name").alias("title"))
    batches = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("batch")).filter("(s_suppkey + batch) % 4 = 0")
    failed = batches.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("item_key"), "batch")
    return lookups.resolved_in_batches(refs, works, failed)


#: Customers as people who type titles: as they are but untidy, a part of one, one with more around it, its words turned round, or nothing that exists.
_TYPED = """t AS (SELECT p_partkey AS ord, p_partkey AS doc_id, p_name AS title, lower(p_name) AS tl FROM part), k AS (SELECT count(*) AS n FROM part),
q AS (SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN '  ' || upper(p_name) || ' ' WHEN 1 THEN substr(p_name, 3, 7) WHEN 2 THEN 'about the ' || p_name || ' of ' || c_custkey WHEN 3 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') || ' x' ELSE 'zz' || c_custkey END AS query
  FROM customer, k JOIN part ON p_partkey = c_custkey * 7 % n)"""


@query(
    f"""WITH {_TYPED}, tt AS (SELECT *, list_distinct(list_filter(string_split(tl, ' '), lambda w: w <> '')) AS words FROM t),
qq AS (SELECT query_id, query, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS ql FROM q), qw AS (SELECT *, list_distinct(list_filter(string_split(ql, ' '), lambda w: w <> '')) AS asked FROM qq),
r AS (SELECT query_id, doc_id, ord, query = doc_id::VARCHAR AS same, ql <> '' AND (contains(tl, ql) OR contains(ql, tl)) AS hit, len(list_intersect(asked, words))::DOUBLE / greatest(1, len(asked)) AS overlap FROM qw, tt),
b AS (SELECT query_id, doc_id, ord, CASE WHEN same THEN 0 WHEN hit THEN 1 WHEN overlap >= 0.45 THEN 2 ELSE 3 END AS rule, CASE WHEN same OR hit THEN 1.0::DOUBLE ELSE overlap END AS score FROM r)
SELECT query_id, doc_id, rule, score FROM b WHERE rule < 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rule, score DESC, ord) = 1"""
)
def typed_titles(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    c = table(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n"))))  # one row
    key, name = F.col("c_custkey"), F.col("p_name")
    typed = (
        F.when(key % 5 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(key % 5 == 1, F.substring(name, 3, 7))
        .when(key % 5 == 2, F.concat(F.lit("about the "), name, F.lit(" of "), key.cast("string")))
        .when(key % 5 == 3, F.concat(F.array_join(F.reverse(F.split(name, " ")), " "), F.lit(" x")))
        .otherwise(F.concat(F.lit("zz"), key.cast("string")))
    )
    queries = c.withColumn("p_partkey", key * 7 % F.col("n")).join(p, "p_partkey").select(key.alias("query_id"), typed.alias("query"))
    return matching.resolve_titles(queries, p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title")))


@query(
    """SELECT r_regionkey::BIGINT AS id, '{"id":' || r_regionkey || ',"name":"' || r_name || '","children":[' || coalesce(string_agg('{"id":' || (n_nationkey + 1000) || ',"name":"' || n_name || '","children":[]}', ',' ORDER BY lower(n_name), n_nationkey), '') || ']}' AS tree
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""
)
def nested_collections(spark, d):
    return tree.nested(I.collections(spark, d)).select("id", "tree")


@query(
    """WITH RECURSIVE k AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey > 0 THEN floor((p_partkey - 1) / 2)::BIGINT END AS parent FROM part),
t AS (SELECT id, name, parent, 0 AS depth FROM k WHERE parent IS NULL UNION ALL SELECT k.id, k.name, k.parent, t.depth + 1 FROM k JOIN t ON k.parent = t.id),
o AS (SELECT count(*) AS nodes, sum(length('{"id":' || id || ',"name":"' || name || '","children":[]}')) AS own, sum(CASE WHEN depth > 0 THEN 1 ELSE 0 END) AS inner_nodes, count(DISTINCT parent) AS parents FROM t)
SELECT 0::BIGINT AS id, (own + inner_nodes - parents)::BIGINT AS length, nodes FROM o"""
)
def deep_nested_tree(spark, d):
    # one value for the whole tree of parts: its length is that of its objects and the commas between siblings
    found = tree.nested(I.deep_tree(spark, d))
    return found.select("id", F.length("tree").cast("bigint").alias("length"), F.size(F.regexp_extract_all("tree", F.lit('"children"'), F.lit(0))).cast("bigint").alias("nodes"))


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ref_pos FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'o' || l_orderkey AS item_key, ref_pos::INTEGER AS ref_pos, CASE WHEN p_size % 3 = 0 AND l_suppkey % 10 = 0 THEN NULL ELSE 'w' || l_partkey END AS id, p_size % 3 <> 0 AND p_size > 40 AS bare,
  CASE WHEN p_size % 3 = 0 THEN NULLIF(p_name, '') WHEN p_size <= 40 THEN 'found ' || p_name END AS title, CASE WHEN p_size % 3 = 0 THEN 'Venue ' || (l_partkey % 7) END AS venue, 'kept ' || (l_orderkey % 5) AS note FROM l"""
)
def cache_round_trip(spark, d):
    # bare ids, and objects with a field that nobody knows; read, looked up, written and read again
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    known = F.col("p_size") % 3 == 0
    whole = F.to_json(F.struct(F.when(F.col("l_suppkey") % 10 != 0, I.work()).alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("Venue "), (F.col("l_partkey") % 7).cast("string")).alias("venue")))
    raw = F.when(known, whole).otherwise(F.concat(F.lit('"'), I.work(), F.lit('"')))
    lists = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw")))), lambda e: e["raw"]), ",").alias("refs"))
    text = F.concat(F.lit('{"item_key":"o'), F.col("l_orderkey").cast("string"), F.lit('","note":"kept '), (F.col("l_orderkey") % 5).cast("string"), F.lit('","references":['), F.col("refs"), F.lit("]}"))
    root = new_store(spark)
    works = table(spark, d, "part").filter("p_size <= 40").select(I.work("p_partkey").alias("id"), F.concat(F.lit("found "), F.col("p_name")).alias("title"))
    with dealt(spark, table(spark, d, "lineitem").count() / LINES_A_TASK):
        lists.select(text.alias("value")).write.text(f"{root}/first")
        variants.write_lines(variants.resolved(variants.read_lines(spark, f"{root}/first"), works), f"{root}/second")
    again = variants.read_lines(spark, f"{root}/second")
    noted = again.withColumn("note", F.try_variant_get("record", "$.note", "string"))
    return variants.entries(noted, more="venue:string").select("item_key", "ref_pos", "id", "bare", "title", "venue", "note")


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS n, o_orderkey, o_orderstatus AS s FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 0 AS version, n::BIGINT AS nation, count(*) AS records, count(*) FILTER (s = 'F') AS mapped FROM c GROUP BY n
UNION ALL SELECT 1, n::BIGINT, count(*), count(*) FILTER (s = 'F') FROM c WHERE o_orderkey % 3 <> 0 GROUP BY n"""
)
def snapshot_reports(spark, d):
    # records and their places under one manifest; a prune with an empty library changes nothing, one with a real one makes a version
    root = new_store(spark)
    place = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("nation"))
    places = table(spark, d, "orders").join(place, "o_custkey").select(I.paper().alias("item_key"), "nation")
    snapshots.commit(spark, root, {"records": I.records(spark, d), "places": places}, [f"{d}/orders.parquet"])

    def report(tables):
        joined = tables["records"].join(tables["places"], "item_key")
        return joined.groupBy("nation").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "mapped").alias("mapped"))

    live = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(I.paper().alias("item_key"))
    snapshots.prune(spark, root, "records", live.limit(0))
    snapshots.prune(spark, root, "records", live)
    both = [snapshots.derived(spark, root, "report", report, v).withColumn("version", F.lit(v)) for v in snapshots.versions(spark, root)]
    return both[0].unionByName(both[1])
