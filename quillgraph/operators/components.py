"""Connected components of an undirected graph, without a round for each step of its diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt, dropped, written

#: Links that a task handles.
TASK_LINKS = 500_000


def _large_star(links: DataFrame) -> DataFrame:
    """links(a, b), a > b: each b replaced by its least smaller neighbour, if it has one."""
    least = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return written(links.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """links(a, b), a > b, distinct: each a and its other smaller neighbours linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return written(links.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node, written: the least id that is reachable.

    Alternating stars link each neighbourhood to its least member until nothing changes. Edges
    (source, target) with an end that isn't a node are ignored; nodes without edges are components
    of their own. Ids are of one orderable type. Shuffles are dealt by the counted edges.
    """
    spark = nodes.sparkSession
    with dealt(spark, edges.count() / TASK_LINKS):
        ids = written(nodes.select("id").distinct())
        known = edges.select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).filter("a <> b")
        now = written(known.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
        seen = None
        while True:
            row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if not row[0] or tuple(row) == seen:
                break
            seen = tuple(row)
            large = _large_star(now)
            dropped(now)
            now = _small_star(large)
            dropped(large)
        labels = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        out = written(ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    dropped(ids, now)
    return out
