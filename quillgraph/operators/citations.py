"""Citation maps of a selection, and what is known about its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed value: the version of citation records that counts as current.
RECORD_VERSION = 2


def is_mapped(status: str = "status", version: str = "v") -> Column:
    return F.coalesce((F.col(status) == "mapped") & (F.col(version) == RECORD_VERSION), F.lit(False))


def is_ready(references: str = "references") -> Column:
    return is_mapped() & (F.coalesce(F.size(references), F.lit(0)) > 0)


def coverage(selection: DataFrame, records: DataFrame) -> DataFrame:
    """(item_key, sel_pos, mapped, unmapped, no_doi) of a selection(item_key, sel_pos); no_doi implies unmapped."""
    known = records.select("item_key", is_mapped().alias("m"), (F.col("status") == "no_doi").alias("d"))
    rows = selection.join(known, "item_key", "left")
    mapped = F.coalesce("m", F.lit(False))
    return rows.select("item_key", "sel_pos", mapped.alias("mapped"), (~mapped).alias("unmapped"), (~mapped & F.coalesce("d", F.lit(False))).alias("no_doi"))


def entries(records: DataFrame, column: str) -> DataFrame:
    """(item_key, ref_pos, entry) of an array column of records; entries without an id are left out."""
    rows = records.select("item_key", F.posexplode(column).alias("ref_pos", "entry"))
    return rows.filter(X.blank_to_null(F.col("entry.id")).isNotNull())


def map_edges(selected: DataFrame, refs: DataFrame, cited_by: bool = False) -> DataFrame:
    """One edge for each occurrence: item to reference, or citing work to item. refs(item_key, id, ...)."""
    rows = refs.join(selected.select("item_key"), "item_key")
    ends = (F.col("id").alias("source"), F.col("item_key").alias("target")) if cited_by else (F.col("item_key").alias("source"), F.col("id").alias("target"))
    return rows.select(*ends)


def external_nodes(selected: DataFrame, refs: DataFrame) -> DataFrame:
    """One row for each work: its metadata where first met (selection order, then position), and how often it is met.

    refs(item_key, ref_pos, id, title, year, date, doi, cited_by); selected(item_key, sel_pos). One
    aggregation with partial sums: a landmark work doesn't gather its edges anywhere.
    """
    rows = refs.join(selected.select("item_key", "sel_pos"), "item_key")
    meta = F.struct("title", "year", "date", "doi", "cited_by")
    return external_rows(rows.groupBy("id").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("sel_pos", "ref_pos", meta.alias("meta"))).alias("first")))


def external_rows(met: DataFrame) -> DataFrame:
    """External nodes of met(id, occurrences, first)."""
    m = F.col("first.meta")
    return met.select("id", X.first_present(m["title"], F.col("id")).alias("label"), F.lit("external").alias("type"), m["year"].cast("string").alias("year"), m["date"].alias("date"), F.col("occurrences").alias("cited_by"), m["cited_by"].alias("global_cited_by"), m["doi"].alias("doi"), F.lit(None).cast("string").alias("collection"))


def owned_nodes(selected: DataFrame, records: DataFrame, items: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for each mapped item of the selection, with or without references."""
    known = records.filter(is_mapped()).select("item_key", F.col("date").alias("rdate"), F.col("cited_by").alias("rcited"), F.col("doi").alias("rdoi"))
    rows = selected.join(known, "item_key").join(items.select("item_key", "title", F.col("year").alias("iyear")), "item_key", "left").join(paths, "item_key", "left")
    return rows.select(F.col("item_key").alias("id"), X.first_present(F.col("title"), F.col("item_key")).alias("label"), F.lit("owned").alias("type"), F.col("iyear").alias("year"), F.col("rdate").alias("date"), F.lit(None).cast("bigint").alias("cited_by"), F.col("rcited").alias("global_cited_by"), F.col("rdoi").alias("doi"), F.col("path").alias("collection"))


def citation_map(selection: DataFrame, records: DataFrame, items: DataFrame, paths: DataFrame, column: str = "references", cited_by: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the references map, or with column="citingWorks", cited_by=True the cited-by map."""
    mapped = records.filter(is_mapped())
    refs = entries(mapped, column).select("item_key", "ref_pos", F.col("entry.id").alias("id"), F.col("entry.title").alias("title"), F.col("entry.year").alias("year"), F.col("entry.date").alias("date"), F.col("entry.doi").alias("doi"), F.col("entry.citedBy").alias("cited_by"))
    nodes = owned_nodes(selection, records, items, paths).unionByName(external_nodes(selection, refs))
    return nodes, map_edges(selection, refs, cited_by)


def pending(items: DataFrame, records: DataFrame) -> DataFrame:
    """(pending, total): items with a DOI that have no mapped record, and all with a DOI."""
    wanted = items.filter("doi IS NOT NULL").select("item_key").distinct()
    done = records.filter(is_mapped()).select("item_key", F.lit(1).alias("done"))
    return wanted.join(done, "item_key", "left").agg((F.count(F.lit(1)) - F.count("done")).alias("pending"), F.count(F.lit(1)).alias("total"))


def orphans(records: DataFrame, live: DataFrame) -> DataFrame:
    """Records of items that are gone; none if no live item is known, which rather means an unreadable library."""
    known = live.select("item_key").distinct()
    gone = records.join(known, "item_key", "left_anti")
    any_live = known.limit(1).select(F.lit(1).alias("__any"))
    return gone.join(F.broadcast(any_live), how="left_semi")


def resolve(refs: DataFrame, works: DataFrame) -> DataFrame:
    """refs(item_key, ref_pos, id) with what works(id, ...) knows; unknown ids stay with nulls."""
    return refs.join(works, "id", "left")


def top_citers(citing: DataFrame, most: int = 100) -> DataFrame:
    """The most cited citing works of each item: citing(item_key, id, cited_by), ties by id.

    Rank limits are pushed below the shuffle, so that a task passes on at most `most` rows of a key.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("item_key").orderBy(F.desc_nulls_last("cited_by"), "id")
    return citing.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_semi")


def restrict(nodes: DataFrame, edges: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cached map for a smaller selection: its owned nodes, edges that touch one, nodes of those edges."""
    owned = nodes.filter("type = 'owned'").join(selection.select(F.col("item_key").alias("id")).distinct(), "id", "left_semi")
    keys = owned.select("id")
    kept = edges.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(
        edges.join(keys.withColumnRenamed("id", "source"), "source", "left_anti").join(keys.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    ends = kept.select(F.col("source").alias("id")).unionByName(kept.select(F.col("target").alias("id"))).unionByName(keys).distinct()
    return nodes.join(ends, "id", "left_semi"), kept


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree of each node; a self-loop counts twice."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def record_report(records: DataFrame) -> DataFrame:
    """One row: mapped records, with and without references, their percent (cut), upper median, mean, greatest number.

    The median comes from a histogram of numbers of references, not from all records in one place.
    """
    from pyspark.sql import Window

    mapped = records.filter(is_mapped()).select(F.coalesce(F.size("references"), F.lit(0)).alias("n"), F.coalesce(F.size("citingWorks"), F.lit(0)).alias("c"))
    counts = mapped.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") > 0).alias("citers"))
    running = counts.withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    cut = lambda part: F.floor(100 * part / F.sum("k")).cast("bigint")
    some = F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0))
    return running.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("mapped"),
        some.alias("with_references"),
        (F.sum("k") - some).alias("without_references"),
        cut(some).alias("with_percent"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"),
        F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 1).alias("mean"),
        F.max("n").alias("most"),
        F.sum("citers").alias("citers_fetched"),
    )


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


def empty_sample(records: DataFrame, most: int = 10) -> DataFrame:
    """The first mapped records without references."""
    return records.filter(is_mapped() & ~is_ready()).orderBy("item_key").limit(most).select("item_key")


#: Selected papers that must cite a work for it to count as a gap; characters of a shown label.
GAP_CITERS, LABEL_CHARS = 2, 32


def gaps(nodes: DataFrame, least: int = GAP_CITERS) -> DataFrame:
    """External works that several selected papers cite."""
    return nodes.filter((F.col("type") == "external") & (F.col("cited_by") >= least))


def shown_labels(nodes: DataFrame, degree: DataFrame, least: int = 2) -> DataFrame:
    """(id, shown): cut labels of owned nodes and of external ones with enough links, else null."""
    rows = nodes.join(degree, "id", "left")
    show = (F.col("type") == "owned") | (F.coalesce("degree", F.lit(0)) >= least)
    return rows.select("id", F.when(show, F.substring("label", 1, LABEL_CHARS)).alias("shown"))


def selections_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two selections share an item; stops at the first."""
    shared = a.select("item_key").join(b.select("item_key").distinct(), "item_key", "left_semi").limit(1)
    return shared.agg((F.count(F.lit(1)) > 0).alias("meet"))


def layer_complete(cover: DataFrame) -> DataFrame:
    """One row: whether nothing of the selection is unmapped."""
    return cover.agg((F.count_if("unmapped") == 0).alias("complete"), F.count_if("unmapped").alias("unmapped"))


def mapped_keys(records: DataFrame) -> DataFrame:
    return records.filter(is_mapped()).select("item_key")


def first_seen(refs: DataFrame) -> DataFrame:
    """(item_key, id, ref_pos): each list's ids where they are met first; blank ids are left out."""
    return refs.filter(X.blank_to_null(F.col("id")).isNotNull()).groupBy("item_key", "id").agg(F.min("ref_pos").alias("ref_pos"))


def lookup_batches(refs: DataFrame, size: int = 50) -> DataFrame:
    """(item_key, id, batch): each list's ids without repeats, in order, in batches of `size`."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item_key").orderBy("ref_pos")) - 1
    return first_seen(refs).select("item_key", "id", F.floor(place / size).cast("int").alias("batch"))


def resolved_lists(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(item_key, references): every list again, in its order, with what works(id, title) knows; unknown ids stay with nulls."""
    rows = resolve(refs, works)
    ordered = F.sort_array(F.collect_list(F.struct("ref_pos", "id", "title")))
    return rows.groupBy("item_key").agg(F.transform(ordered, lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"))).alias("references"))


def output_order(selection: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, ord): owned nodes in the order of the selection, then external ones in the order they are first met."""
    from .timeline import lane_indexes

    owned = selection.join(mapped_keys(records), "item_key").select(F.col("item_key").alias("id"), F.lit("owned").alias("type"), "sel_pos", F.lit(0).alias("ref_pos"))
    met = refs.join(selection.select("item_key", "sel_pos"), "item_key").groupBy("id").agg(F.min(F.struct("sel_pos", "ref_pos")).alias("first"))
    external = met.select("id", F.lit("external").alias("type"), "first.sel_pos", "first.ref_pos")
    n = owned.agg(F.count(F.lit(1)).alias("n"))  # one row
    ranked = lane_indexes(owned.unionByName(external), ["sel_pos", "ref_pos", "id"])
    return ranked.crossJoin(F.broadcast(n)).select("id", (F.col("index") + F.when(F.col("type") == "owned", 0).otherwise(F.col("n"))).alias("ord"))


def uncovered_within(cover: DataFrame, selection: DataFrame) -> DataFrame:
    """What of a smaller selection is unmapped, and what has no DOI."""
    return cover.filter("unmapped").join(selection.select("item_key").distinct(), "item_key", "left_semi").select("item_key", "no_doi")


def overlay(edges: DataFrame, lens: str) -> DataFrame:
    """Edges as the map shows them: direct, external, tagged by the lens ("cite": references, else cited)."""
    return edges.select("source", "target", F.lit(True).alias("direct"), F.lit(True).alias("external"), F.lit("references" if lens == "cite" else "cited").alias("overlay"))


def toggled(selection: DataFrame, toggles: DataFrame) -> DataFrame:
    """(item_key) after toggles(item_key): selected ones that are toggled go, others come; twice is as never."""
    odd = toggles.groupBy("item_key").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1").select("item_key")
    own = selection.select("item_key").distinct()
    return own.join(odd, "item_key", "left_anti").unionByName(odd.join(own, "item_key", "left_anti"))
