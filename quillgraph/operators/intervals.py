"""Forests as intervals: each node's place in a walk of its forest and the size of its subtree.

The walk goes down and up every edge, children in the order of their ids. Its steps form a linked list,
whose places come from pointer doubling: a step takes over the sums of the step it points at, so that a
list of n steps takes log2(n) rounds, whatever the depth, and a table of fixed width. Descendants are
then a range of places, and sums over subtrees are differences of running sums.

Nodes that stand on a cycle or lead into one are in no walk; callers treat these few apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, written, written_in_two

#: Rows that a task of a round handles.
TASK_ROWS = 500_000
#: Places whose running sum is made in one group.
BLOCK = 1 << 16
#: Places whose minima are one array, and arrays up to which they are broadcast (8 MB).
SPAN, SMALL_BLOCKS = 256, 4096


def indexed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, written, with `index` from 0 in the order of `by`: the place within a range partition plus the rows of earlier ones."""
    spread = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # one row a partition
    firsts = spread.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = firsts.select("__part", (F.coalesce(F.sum("__n").over(order), F.lit(0)) - F.col("__first")).alias("__shift"))
    return spread.join(F.broadcast(before), part == F.col("__part")).withColumn("index", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def doubled(start: DataFrame, key: str, following: str, sums: list[str], rounds: int, tasks: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of start(key, following, sums) that reach the end of their list, with sums added up to it, and the tables that hold them.

    A round is one job: it writes the rows that have arrived beside those that go on. The former are
    never written again.
    """
    ended, now = written_in_two(start.coalesce(tasks), F.col(following).isNull())
    done, tables = ended if ended is not None else start.limit(0), [ended] if ended is not None else []
    for _ in range(rounds):
        if now is None:
            break
        reached = now.unionByName(done).select(F.col(key).alias("__key"), F.col(following).alias("__following"), *(F.col(s).alias(f"__{s}") for s in sums))
        joined = now.join(reached, F.col(following) == F.col("__key"))
        step = joined.select(key, F.col("__following").alias(following), *((F.col(s) + F.col(f"__{s}")).alias(s) for s in sums)).coalesce(tasks)
        ended, now = written_in_two(step, F.col(following).isNull())
        if ended is not None:
            done, tables = done.unionByName(ended), [*tables, ended]
    return done, tables


def intervals(nodes: DataFrame) -> DataFrame:
    """(id, enter, size, depth, up) of nodes(id, parent), written: place in the walk from 0, nodes below and itself, depth, the parent's place.

    A node whose parent is missing is a root. Nodes on cycles, below them or leading into them have no row.
    """
    ids = nodes.select("id").distinct()
    live = nodes.select("id", "parent").distinct().join(ids.withColumnRenamed("id", "parent").withColumn("has", F.lit(True)), "parent", "left").select("id", F.when(F.col("has"), F.col("parent")).alias("up"))
    kids = written(indexed(live, ["up", "id"]))
    count = kids.count()
    tasks = max(1, math.ceil(2 * count / TASK_ROWS))
    # the next row is the next sibling if it has the same parent
    after = kids.select((F.col("index") - 1).alias("index"), F.col("up").alias("next_up"), F.lit(True).alias("more"))
    child = kids.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.min("index").alias("child"))
    above = kids.select(F.col("id").alias("up"), F.col("index").alias("up_index"))
    rows = kids.join(after, "index", "left").join(child, "id", "left").join(above, "up", "left")
    sibling = F.coalesce(F.col("more") & F.col("next_up").eqNullSafe(F.col("up")), F.lit(False))
    # step 2i goes down to node i, step 2i + 1 up from it
    down = F.struct((2 * F.col("index")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("index") + 1).alias("following"), F.lit(1).cast("bigint").alias("downs"), F.lit(1).cast("bigint").alias("net"))
    up = F.struct((2 * F.col("index") + 1).alias("step"), F.when(sibling, 2 * F.col("index") + 2).otherwise(2 * F.col("up_index") + 1).alias("following"), F.lit(0).cast("bigint").alias("downs"), F.lit(-1).cast("bigint").alias("net"))
    steps = rows.select(F.explode(F.array(down, up)).alias("s")).select("s.*")
    # a longer list than all steps doesn't end
    done, tables = doubled(steps, "step", "following", ["downs", "net"], math.ceil(math.log2(2 * count + 2)) + 2, tasks)
    # what lies between a node's two steps
    spans = done.groupBy(F.shiftright("step", 1).alias("index")).agg(F.max("downs").alias("from"), F.min("downs").alias("to"), F.max(F.when(F.pmod("step", F.lit(2)) == 0, -F.col("net"))).alias("depth"))
    total = done.agg(F.max("downs").alias("total"))  # one row
    placed = written(spans.join(kids, "index").crossJoin(F.broadcast(total)).select("id", (F.col("total") - F.col("from")).alias("enter"), (F.col("from") - F.col("to")).alias("size"), "depth", F.col("up").alias("up_id")).coalesce(tasks))
    out = written(placed.join(placed.select(F.col("id").alias("up_id"), F.col("enter").alias("up")), "up_id", "left").select("id", "enter", "size", "depth", "up").coalesce(tasks))
    dropped(kids, placed, *tables)
    return out


def range_minima(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(first, last, ...) with `least`, the least v of values(place, v) from first to last; places go from 0 without gaps. Null for an empty range.

    A range is the end of its first block of SPAN places, the start of its last one, and whole blocks
    between them, which are a range of the blocks' minima: log(places) by SPAN passes over the ranges, of
    which all but the first join a table SPAN times as small.
    """
    names = ranges.columns
    rows = ranges.select("*", F.col("first").cast("bigint").alias("__first"), F.col("last").cast("bigint").alias("__last"), F.lit(None).cast("bigint").alias("least"))
    empty = F.col("__first") > F.col("__last")
    of = lambda c: F.floor(F.col(c) / SPAN)
    place = lambda c: (F.pmod(F.col(c), F.lit(SPAN)) + 1).cast("int")
    while True:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"])  # at most SPAN
        blocks = written(values.groupBy(of("place").alias("block")).agg(listed.alias("list")))
        count = blocks.count()
        table = F.broadcast(blocks) if count <= SMALL_BLOCKS else blocks
        kept = [*names, "__first", "__last", "least"]
        head = F.array_min(F.slice("list", place("__first"), F.least(F.lit(SPAN), F.col("__last") - F.col("__first") + 1).cast("int")))
        rows = rows.withColumn("block", of("__first")).join(table, "block", "left").select(*kept, F.when(~empty, head).alias("__head"))
        if count == 1:
            return rows.select(*names, F.least("least", "__head").alias("least"))
        tail = F.array_min(F.slice("list", F.lit(1), place("__last")))
        rows = rows.withColumn("block", of("__last")).join(table, "block", "left").select(
            *names, (of("__first") + 1).alias("__first"), (of("__last") - 1).alias("__last"), F.least("least", "__head", F.when(~empty & (of("__first") < of("__last")), tail)).alias("least")
        )
        values = blocks.select(F.col("block").alias("place"), F.array_min("list").alias("v"))


def common_ancestors(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """(enter, n): how many of pairs(a, b, n), places with a <= b, have each place as lowest common ancestor; pairs in two trees have none.

    It is the least parent of the places after a up to b: they lie below it, and its child above b is one of them.
    """
    if spans.isEmpty():
        return pairs.limit(0).select(F.col("a").alias("enter"), "n")
    parents = spans.select(F.col("enter").alias("place"), F.coalesce("up", F.lit(-1)).alias("v"))
    found = range_minima(parents, pairs.select("a", "n", (F.col("a") + 1).alias("first"), F.col("b").alias("last")))
    return found.select(F.coalesce("least", "a").alias("enter"), "n").filter("enter >= 0").groupBy("enter").agg(F.sum("n").alias("n"))


def running(rows: DataFrame, n: Column) -> DataFrame:
    """rows(enter, ...) with n and `upto`, the sum of n up to each place: sums within blocks of places, and of the blocks before."""
    own = written(rows.withColumn("n", n).withColumn("block", F.floor(F.col("enter") / BLOCK)).withColumn("upto", F.sum("n").over(Window.partitionBy("block").orderBy("enter").rowsBetween(Window.unboundedPreceding, 0))))
    # one row for BLOCK nodes
    blocks = own.groupBy("block").agg(F.sum("n").alias("sum"))
    before = blocks.select("block", F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, "block").withColumn("upto", F.col("upto") + F.col("before")).drop("block", "before")


def subtree_sums(spans: DataFrame, values: DataFrame) -> DataFrame:
    """(enter, total): the sum of values(enter, n) over each subtree."""
    sums = written(running(spans.select("enter", "size").join(values.withColumnRenamed("n", "v"), "enter", "left"), F.coalesce("v", F.lit(0))))
    last = sums.select(F.col("enter").alias("last"), F.col("upto").alias("end"))
    return sums.withColumn("last", F.col("enter") + F.col("size") - 1).join(last, "last").select("enter", (F.col("end") - F.col("upto") + F.col("n")).alias("total"))


def within(spans: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id): each start(id) that has an interval with all nodes of its subtree; a start is cut into blocks of places, which nodes are joined to."""
    own = spans.join(start.select("id").distinct(), "id").select(F.col("id").alias("start"), "enter", "size")
    blocks = own.select("start", "enter", "size", F.explode(F.sequence(F.floor(F.col("enter") / BLOCK), F.floor((F.col("enter") + F.col("size") - 1) / BLOCK))).alias("block"))
    nodes = spans.select("id", F.col("enter").alias("place"), F.floor(F.col("enter") / BLOCK).alias("block"))
    return blocks.join(nodes, "block").filter((F.col("place") >= F.col("enter")) & (F.col("place") < F.col("enter") + F.col("size"))).select("start", "id")


def distinct_in_subtrees(spans: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, n): distinct items in each subtree, of membership(id, item_key).

    An item counts once where it occurs, and once less at the lowest common ancestor of each two
    occurrences that follow one another in the walk: what remains in a subtree is one for each item.
    Neighbours are rows with consecutive numbers, so no item's occurrences meet in one task.
    """
    placed = indexed(membership.select("id", "item_key").distinct().join(spans.select("id", "enter"), "id").select("item_key", "enter"), ["item_key", "enter"])
    before = placed.select((F.col("index") + 1).alias("index"), F.col("item_key").alias("same"), F.col("enter").alias("a"))
    pairs = placed.join(before, "index").filter(F.col("same").eqNullSafe(F.col("item_key"))).groupBy("a", F.col("enter").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    less = common_ancestors(spans, pairs)
    values = placed.groupBy("enter").agg(F.count(F.lit(1)).alias("n")).unionByName(less.select("enter", (-F.col("n")).alias("n"))).groupBy("enter").agg(F.sum("n").alias("n"))
    return subtree_sums(spans, values).join(spans.select("enter", "id"), "enter").select("id", F.col("total").alias("n"))
