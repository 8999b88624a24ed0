"""The driver's tables in the roles of a library: orders are papers, parts are works, events are jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def selection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(paper().alias("item_key"), F.col("o_orderkey").alias("sel_pos"))


def paper(column: str = "o_orderkey"):
    return F.concat(F.lit("o"), F.col(column).cast("string"))


def work(column: str = "l_partkey"):
    return F.concat(F.lit("w"), F.col(column).cast("string"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records without their arrays; these are long tables, see references()."""
    status = F.when(F.col("o_orderstatus") == "F", "mapped").when(F.col("o_orderstatus") == "O", "not_found").otherwise("no_doi")
    return table(spark, d, "orders").select(
        paper().alias("item_key"),
        status.alias("status"),
        F.lit(2).alias("v"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_custkey").alias("cited_by"),
        F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string")).alias("doi"),
    )


def records_with_arrays(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").groupBy(paper("l_orderkey").alias("item_key")).agg(F.collect_list(F.struct(work().alias("id"))).alias("references"))
    return records(spark, d).join(refs, "item_key", "left").withColumn("citingWorks", F.when(F.col("cited_by") % 3 == 0, F.col("references")))


def reference_links(spark: SparkSession, d: str) -> DataFrame:
    """(item_key, ref_pos, id, l_partkey) of mapped records, without what is known of the parts."""
    lines = table(spark, d, "lineitem").select(paper("l_orderkey").alias("item_key"), F.col("l_linenumber").alias("ref_pos"), "l_partkey")
    mapped = records(spark, d).filter("status = 'mapped'").select("item_key")
    return lines.join(mapped, "item_key").select("item_key", "ref_pos", work().alias("id"), "l_partkey")


def references(spark: SparkSession, d: str) -> DataFrame:
    """(item_key, ref_pos, id, ...) of mapped records: lines of orders, with what is known of their parts."""
    works = table(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        (F.col("p_size") + 1970).alias("year"),
        F.lit(None).cast("string").alias("date"),
        F.concat(F.lit("10.2000/"), F.col("p_partkey").cast("string")).alias("doi"),
        F.col("p_size").cast("bigint").alias("cited_by"),
    )
    known = works.filter("p_size <= 40")  # the rest can't be resolved
    return reference_links(spark, d).join(known, F.col("l_partkey") == F.col("p_partkey"), "left").select("item_key", "ref_pos", "id", "title", "year", "date", "doi", "cited_by")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        paper().alias("item_key"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Paper "), F.col("o_orderkey").cast("string"))).alias("title"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string"))).alias("doi"),
    )


def collections(spark: SparkSession, d: str) -> DataFrame:
    """Regions over nations."""
    top = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent"), F.col("r_name").alias("name"))
    return top.unionByName(table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent"), F.col("n_name").alias("name")))


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Papers in the collection of their customer's nation."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1000).cast("bigint").alias("id"))
    return table(spark, d, "orders").join(c, "o_custkey").select("id", paper().alias("item_key"))


def deep_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a binary heap: ten levels and more."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("id"), F.when(p > 0, F.floor((p - 1) / 2)).cast("bigint").alias("parent"), F.col("p_name").alias("name"))


def deep_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("item_key")).distinct()


def jobs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "error", "error").when(kind == "click", "running").otherwise("queued")
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("doc_id"), status.alias("status"), F.col("ts").alias("mtime"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.lit(None).cast("string").alias("error"))


def record_log(spark: SparkSession, d: str) -> DataFrame:
    """Versions of users' records as they arrive, one an event: some are misses, each lists other works, and what a list says of a work differs from version to version."""
    e = F.col("event_id")
    work_no = lambda j: F.pmod(e * 7 + j * j, F.lit(997))

    def entry(j):
        w = work_no(j)
        title = F.when(w % 4 != 0, F.concat(F.lit("Work "), w.cast("string"), F.lit(", as cited "), F.pmod(e, F.lit(3)).cast("string")))
        return F.struct(
            F.when(F.pmod(e + j, F.lit(11)) != 0, F.concat(F.lit("w"), w.cast("string"))).alias("id"),
            title.alias("title"),
            (w % 40 + 1980).cast("int").alias("year"),
            F.lit(None).cast("string").alias("date"),
            F.lit(None).cast("string").alias("doi"),
            (w + F.pmod(e, F.lit(3))).alias("citedBy"),
        )

    lists = F.transform(F.sequence(F.lit(0).cast("bigint"), F.pmod(e, F.lit(6))), entry)
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_key"),
        F.when(F.col("event_type") == "error", "not_found").otherwise("mapped").alias("status"),
        F.lit(2).alias("v"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.pmod(e, F.lit(500)).alias("cited_by"),
        F.lit(None).cast("string").alias("doi"),
        lists.alias("references"),
        F.array().cast(lists_type()).alias("citingWorks"),
        F.col("ts").cast("timestamp").alias("fetchedAt"),
        e,
    )


def lists_type() -> str:
    return "array<struct<id:string,title:string,year:int,date:string,doi:string,citedBy:bigint>>"
