"""Connected components of a link table by alternating stars, as DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop_saved, saved


#: Links that a task handles: rounds over few links don't pay for as many tasks as the whole input has.
TASK_LINKS = 250_000


def _join_small(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcasts a written table only when it was counted and is small; else both sides shuffle."""
    small = other.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(other) if small else other, on, how)


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Links every larger (or every smaller) neighbour of a node to the least of its neighbourhood."""
    edges = edges.coalesce(tasks)
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = saved(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).coalesce(tasks))
    joined = _join_small(around, least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = saved(moved.filter("a <> b").distinct().coalesce(tasks))
    drop_saved(edges.sparkSession, least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges(a, b): the least id that it reaches. Written to the shared folder.

    Self-links and repeated links are ignored; rows with a null end are too.
    """
    spark = edges.sparkSession
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, tasks = None, 1
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or not row[0]:
            break
        seen, tasks = tuple(row), math.ceil(row[0] / TASK_LINKS)
        large = _star(now, True, tasks)
        small = _star(large, False, tasks)
        drop_saved(spark, now, large)
        now = small
    labels = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().coalesce(tasks)
    out = saved(labels.unionByName(roots))
    drop_saved(spark, now)
    return out
