"""Years, sizes and timeline places of a map's nodes; shapes of its groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import fnv_unit
from ..storage import few, ship, written


def citation_scale(nodes: DataFrame) -> DataFrame:
    """nodes(id, type, cited_by, global_cited_by) with score and size, relative to all nodes."""
    scored = nodes.withColumn("score", L.citation_score(F.col("global_cited_by"), F.col("cited_by"))).withColumn("value", F.log10(F.col("score") + 1))
    ends = scored.agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row
    return scored.crossJoin(F.broadcast(ends)).withColumn("size", L.scaled(F.col("value"), F.col("low"), F.col("high"), F.col("type") == "owned")).drop("value", "low", "high")


def timeline_years(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, year) of nodes that keep a year: nodes(id, type, year, date), edges(source, target).

    An external work loses its year when a reference is newer than its citing owned paper, or a
    citing work older than what it cites, by whole years, along any edge.
    """
    dated = nodes.select("id", "type", L.effective_year(F.col("type") == "owned", F.col("year"), F.col("date")).alias("y")).filter("y IS NOT NULL")
    s, t = dated.alias("s"), dated.alias("t")
    pairs = edges.join(s, F.col("source") == F.col("s.id")).join(t, F.col("target") == F.col("t.id"))
    newer = (F.col("s.type") == "owned") & (F.col("t.type") == "external") & (F.floor("t.y") > F.floor("s.y"))
    older = (F.col("s.type") == "external") & (F.col("t.type") == "owned") & (F.floor("s.y") < F.floor("t.y"))
    wrong = pairs.filter(newer | older).select(F.when(newer, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()
    return dated.join(wrong, "id", "left_anti").select("id", "type", F.col("y").alias("year"))


def lane_indexes(ordered: DataFrame, by: list[str]) -> DataFrame:
    """ordered with index (from 0) within each type in the order of `by`.

    Ranks come from range partitions, so that a type isn't sorted in one task: a row's index is its
    index in its partition plus the rows of its type in earlier partitions.
    """
    spread = written(ordered.repartitionByRange("type", *by).sortWithinPartitions("type", *by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # one row for each type and partition
    firsts = spread.groupBy("type", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = firsts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("type").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("type").alias("__type"), F.col("__part"), "__first", "__before")
    joined = spread.withColumn("__p", part).join(F.broadcast(before), (F.col("type") == F.col("__type")) & (F.col("__p") == F.col("__part")))
    return joined.withColumn("index", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__p", "__type", "__part", "__first", "__before")


def timeline_positions(nodes: DataFrame, years: DataFrame) -> DataFrame:
    """(id, x, y) of the nodes with a year. Lanes are dealt in the order of year (none first) and id.

    The first owned node stands on the middle line; ids are ordered by code point.
    """
    known = nodes.select("id", "type").join(years.select("id", "year"), "id", "left").withColumn("order", F.coalesce("year", F.lit(0.0)))
    dealt = lane_indexes(known, ["order", "id"])
    owned = F.col("type") == "owned"
    y = F.when(owned & (F.col("index") == 0), F.lit(0)).otherwise(L.lane_offset(F.when(owned, F.col("index") - 1).otherwise(F.col("index"))))
    ends = years.agg(F.min("year").alias("low"), F.max("year").alias("high"))  # one row
    return dealt.filter("year IS NOT NULL").crossJoin(F.broadcast(ends)).select("id", L.timeline_x(F.col("year"), F.col("low"), F.col("high")).alias("x"), y.cast("double").alias("y"))


def visible(nodes: DataFrame, edges: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a year, and edges whose both ends have one."""
    ids = years.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept


def component_shapes(members: DataFrame) -> DataFrame:
    """(component, size, radius) of members(component, value): the radius that its nodes' circles need."""
    r = L.collision_radius(F.col("value"))
    sums = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum(r * r).alias("squares"))
    return sums.select("component", "size", L.component_radius(F.col("squares"), F.col("size")).alias("radius"))


def centroids(members: DataFrame) -> DataFrame:
    """(component, x, y, reach) of members(component, x, y, radius): mean place and covering radius."""
    mean = written(members.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    joined = members.join(few(mean), "component")
    reach = F.max(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) + F.col("radius"))
    return joined.groupBy("component").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), reach.alias("reach"))


def seed_positions(unplaced: DataFrame, placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y): the mean place of each unplaced node's placed neighbours."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("near")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("near")))
    near = placed.select(F.col("id").alias("near"), "x", "y")
    return both.join(unplaced.select("id").distinct(), "id", "left_semi").join(near, "near").groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


#: Radius of a ring of seeds, at least and for each root of its members; how far hashes turn them; distances of jittered nodes.
RING_LEAST, RING_EACH, RING_TURN = 12.0, 3.1, 0.18
JITTER_LEAST, JITTER_SPAN = 8.0, 18.0


def circle_seeds(members: DataFrame, places: DataFrame) -> DataFrame:
    """(id, x, y): unplaced members(component, pos, id) on a ring around places(component, x, y), in the order of pos.

    A lone one stands at the place itself. Ranks come from range partitions, for one component may hold most nodes.
    """
    ranked = lane_indexes(members.select("id", "pos", F.col("component").alias("type")), ["pos", "id"])
    sizes = members.groupBy(F.col("component").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    rows = ranked.join(sizes, "type").join(places.select(F.col("component").alias("type"), F.col("x").alias("cx"), F.col("y").alias("cy")), "type")
    angle = F.col("index") / F.col("n") * 2 * F.pi() + fnv_unit(F.col("id").cast("string")) * RING_TURN
    radius = F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.lit(RING_LEAST), F.sqrt("n") * RING_EACH))
    return rows.select("id", (F.col("cx") + F.cos(angle) * radius).alias("x"), (F.col("cy") + F.sin(angle) * radius).alias("y"))


def jittered(seeds: DataFrame) -> DataFrame:
    """(id, x, y): seeds(id, x, y), each moved by its own hashes, so that nodes with one seed don't fall together."""
    key = F.col("id").cast("string")
    angle, distance = fnv_unit(key) * 2 * F.pi(), JITTER_LEAST + fnv_unit(F.concat(key, F.lit(":distance"))) * JITTER_SPAN
    return seeds.select("id", (F.col("x") + F.cos(angle) * distance).alias("x"), (F.col("y") + F.sin(angle) * distance).alias("y"))


def extremes(points: DataFrame) -> DataFrame:
    """One row: the bounding box of placed points."""
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def cluster_labels(members: DataFrame) -> DataFrame:
    """(cluster, label, points) of members(cluster, pos, label): the first label that isn't empty, by position."""
    named = F.when(F.col("label") != "", F.struct("pos", "label"))
    return members.groupBy("cluster").agg(F.min(named)["label"].alias("label"), F.count(F.lit(1)).alias("points"))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain without collinear points; fewer than three points as they are."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    chains = []
    for run in (points, points[::-1]):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def hulls(points: DataFrame, salts: int = 16) -> DataFrame:
    """(cluster, pos, x, y): each cluster's convex hull. points(cluster, x, y).

    Hulls of salted parts come first, so that no task holds a whole cluster; a hull of hulls is the hull.
    """

    def of(group: pd.DataFrame) -> pd.DataFrame:
        found = _hull(list(zip(group["x"], group["y"], strict=True)))
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "pos": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    ship(points.sparkSession)
    kind = dict(points.dtypes)["cluster"]
    schema = f"cluster {kind}, pos int, x double, y double"
    parts = points.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).groupBy("cluster", "salt").applyInPandas(of, schema)
    return parts.groupBy("cluster").applyInPandas(of, schema)
