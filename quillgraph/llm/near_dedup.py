"""Operator 8, MinHash near-dedup: a multi-index Hamming join of b-bit signatures, confirmed on full sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a node (a digest of the set)
   and a signature: KEY_SLOTS whole minhashes and BITS bits of each of SLOTS minhashes. Equal sets
   are one node; from here on each node stands once.
2. Multi-index: the key slots are cut into CHUNKS chunks; two signatures that differ in at most
   MAX_DISTANCE key slots differ in at most ERRORS slots of some chunk (pigeonhole). For each chunk and
   each choice of ERRORS slots that may differ, the remaining slots make a key. All pairs within
   MAX_DISTANCE are guaranteed to share a key. Nodes that share one are candidates unless their
   signatures' bits differ in more than FAR of SLOTS places. A pair at a similarity of just 0.8 becomes
   a candidate with a probability of 1 - 2.7e-5 (no key: 2.3e-5; beyond FAR: 4e-6), above it with more;
   at 0.5, one pair in eighty that share a key passes. A key of more than RUN nodes is compared in
   cells of two blocks each, so that no task holds it whole and no pair is left out.
3. Components of candidates are families. Within a family, full sets are compared exactly. A large
   family is first pruned: a member of whose shingles too few stand in any other member can't be
   linked. What is left is cut into blocks: each block is compared in itself and with the first block;
   then the members outside the family's largest confirmed component, a stated set of queries, are
   compared with all blocks. So no family is expanded into all pairs, and no link between two
   components is lost.
4. Components of confirmed links give the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow, drop_saved, portions, saved, semi_by_id, slices, table, utf8
from .components import components
from .words import LOWER_BYTES, SPACE, hashes, mix, spans

KEY_SLOTS, CHUNKS, ERRORS = 40, 8, 1
MAX_DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Slots of a signature of which BITS bits are kept, in words of 64 bits; places in which those of
#: candidates may differ (at a similarity of 0.8, 24 differ on average).
SLOTS, BITS, FAR = 160, 2, 46
WORDS = SLOTS * BITS // 64
#: Sets that one block of a large family holds about.
BLOCK = 96
#: Nodes of one key that are compared in one piece (some 60 bytes each).
RUN = 1 << 16

_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2)
_ODD = _RANDOM.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle; none without words."""
    data, offs = utf8(column)
    held: list[np.ndarray] = []
    done = 0

    def of(words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n < width:
            return mix(np.array([(words * _WEIGHT[:n]).sum() + np.uint64(n)], np.uint64)) if n else words
        total = words[: n - width + 1] * _WEIGHT[0]
        for k in range(1, width):
            total = total + words[k : n - width + 1 + k] * _WEIGHT[k]
        return np.unique(mix(total))

    for rows, part, at, _ in slices(data, offs, SPACE):
        part = LOWER_BYTES[part]
        starts, ends = spans(part, at, SPACE)
        h = hashes(part, starts, ends)
        cut = np.searchsorted(starts, at)
        for k, row in enumerate(rows.tolist()):
            while done < row:
                yield of(np.concatenate(held) if held else np.zeros(0, np.uint64))
                held, done = [], done + 1
            held.append(h[cut[k] : cut[k + 1]])
    while done < len(column):
        yield of(np.concatenate(held) if held else np.zeros(0, np.uint64))
        held, done = [], done + 1


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minhash of each slot, mixed down to 32 bits."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] ^ _XOR
        part *= _ODD
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def packed(signatures: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of all slots, as words."""
    low = (signatures & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(signatures), WORDS, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS)), axis=2)


def far_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of places in which packed signatures differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x5555555555555555)).sum(axis=-1)


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: for each chunk, one for each choice of slots that may differ."""
    wide = signatures.astype(np.uint64)
    size = KEY_SLOTS // CHUNKS
    out = []
    for chunk in range(CHUNKS):
        terms = mix(wide[:, chunk * size : (chunk + 1) * size] + _WEIGHT[:size])
        terms *= _WEIGHT[size : 2 * size]
        total = terms.sum(axis=1, dtype=np.uint64)
        for number, free in enumerate(combinations(range(size), ERRORS)):
            rest = total.copy()
            for slot in free:
                rest -= terms[:, slot]
            out.append(mix(rest + np.uint64(1 + chunk * 1000 + number)))
    return np.stack(out, axis=1)


def near_groups(small: np.ndarray, most: int = FAR) -> np.ndarray:
    """Labels of the components of packed signatures within `most` differing places."""
    label = np.full(len(small), -1)
    pending = np.arange(len(small))
    while len(pending):
        root, pending = pending[0], pending[1:]
        label[root] = root
        frontier = [root]
        while frontier and len(pending):
            one = frontier.pop()
            near = far_apart(small[pending], small[one]) <= most
            if near.any():
                found = pending[near]
                label[found] = root
                frontier += found.tolist()
                pending = pending[~near]
    return label


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first n_keys columns, cut so that no run of equal keys crosses two."""
    held: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in range(n_keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        return np.flatnonzero(change) + 1

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(n_keys)):
            yield joined(held)
            held = []
        cut = starts(batch)
        if len(cut):
            yield joined([*held, batch.slice(0, cut[-1])])
            held = [batch.slice(cut[-1])]
        else:
            held.append(batch)
    if held:
        yield joined(held)


def run_bounds(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in range(n_keys):
        column = batch.column(k).to_numpy(zero_copy_only=False)
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as a matrix of bytes."""
    data, offs = utf8(column.cast(pa.large_binary()))
    return data[offs[0] : offs[-1]].reshape(-1, width)


def short_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """runs() by the first column; rows of a run found to be longer than `most` come as they are, marked True."""
    held: list[pa.RecordBatch] = []
    passing = None  # the key of the long run that goes by
    for batch in batches:
        if passing is not None and batch.num_rows:
            keys = batch.column(0).to_numpy()
            head = int(np.argmax(keys != passing)) if (keys != passing).any() else len(keys)
            if head:
                yield batch.slice(0, head), True
            batch, passing = batch.slice(head), passing if head == len(keys) else None
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != keys[0]:
            yield from ((one, False) for one in runs(iter(held), 1))
            held = []
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cut):
            yield from ((one, False) for one in runs(iter([*held, batch.slice(0, cut[-1])]), 1))
            held = []
        held.append(batch.slice(cut[-1] if len(cut) else 0))
        if sum(one.num_rows for one in held) > most:
            passing = held[0].column(0)[0].as_py()
            yield from ((one, True) for one in held)
            held = []
    yield from ((one, False) for one in runs(iter(held), 1))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(_fixed(column, 8 * WORDS)).view(np.uint64)


def _candidate_edges(most: int) -> Callable:
    """Of each key's run of rows (k, id, small), links (a, b) from each set to the first of its candidate
    component. Rows of runs longer than `most` are passed on: k, their id as a, their signature."""

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], ["a", "b", "k", "small"])

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.nulls(batch.num_rows, pa.int64()), batch.column(0), batch.column(2)], ["a", "b", "k", "small"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, long in short_runs(batches, most):
            if long:
                yield passed(batch)
                continue
            bounds = run_bounds(batch, 1)
            lengths = np.diff(bounds)
            if not (lengths > 1).any():
                continue
            ids, small = batch.column(1).to_numpy(), _signatures(batch.column(2))
            follows = np.ones(len(ids), bool)  # row i and i + 1 are of one run
            follows[bounds[1:] - 1] = False
            at = np.flatnonzero(follows)
            near = far_apart(small[at], small[at + 1]) <= FAR
            a, b = [], []
            two = lengths[np.searchsorted(bounds, at, side="right") - 1] == 2
            a.append(ids[at[two & near] + 1])
            b.append(ids[at[two & near]])
            for k in np.flatnonzero(lengths > 2).tolist():
                own = slice(bounds[k], bounds[k + 1])
                if lengths[k] > most:
                    yield passed(batch.slice(bounds[k], lengths[k]))
                    continue
                label = near_groups(small[own])
                linked = np.flatnonzero(label != np.arange(len(label)))
                a.append(ids[own][linked])
                b.append(ids[own][label[linked]])
            yield links(np.concatenate(a), np.concatenate(b))

    return run


def _cell_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell's run of rows (k, i, j, id, small), links from each set to the first of its candidate component."""
    for batch in runs(batches, 3):
        bounds = run_bounds(batch, 3)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = batch.column(3).slice(lo, hi - lo)
            label = near_groups(_signatures(batch.column(4).slice(lo, hi - lo)))
            linked = pa.array(np.flatnonzero(label != np.arange(len(label))))
            yield pa.RecordBatch.from_arrays([ids.take(linked), ids.take(pa.array(label).take(linked))], ["a", "b"])


def _long_run_edges(rows: DataFrame, most: int) -> DataFrame:
    """Links among rows(k, id, small) of keys that many nodes share: each key's nodes are cut into blocks,
    and each pair of blocks is a cell of about `most` nodes. Every pair of nodes meets in a cell."""
    sizes = saved(rows.groupBy("k").agg(F.ceil(2 * F.count(F.lit(1)) / most).cast("int").alias("blocks")))
    placed = rows.join(_counted(sizes), "k").withColumn("own", F.pmod(F.xxhash64("id", F.lit(11)), "blocks").cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "small")
    return arrow(cells.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "id"), _cell_edges, "a bigint, b bigint")


def confirmed(sets: list[np.ndarray], percent: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Labels (place of the first member) of the components of exact links among sets.

    queries: places of the sets that are compared with all; by default every set is.
    """
    n = len(sets)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (sizes.sum() - both):
            link(0, 1)
    else:
        of = np.repeat(np.arange(n, dtype=np.int32), sizes)
        values, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        owners, first = of[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(values)))])
        own = np.concatenate([[0], np.cumsum(sizes)])
        for x in range(n) if queries is None else queries.tolist():
            mine = token[own[x] : own[x + 1]]
            count = first[mine + 1] - first[mine]
            at = np.cumsum(count) - count
            place = np.repeat(first[mine] - at, count) + np.arange(count.sum())
            both = np.bincount(owners[place], minlength=n)
            for y in np.flatnonzero(100 * both >= percent * (sizes + sizes[x] - both)).tolist():
                link(x, y)
    return np.array([find(x) for x in range(n)])


def _confirmed_edges(percent: int, n_keys: int) -> Callable:
    """Links of each run of rows (keys..., id, is_query, shingles) to the first of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, n_keys):
            bounds = run_bounds(batch, n_keys)
            ids = batch.column(n_keys).to_numpy()
            asked = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
            data, offs = utf8(batch.column(n_keys + 2).cast(pa.large_binary()))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(data[offs[i] : offs[i + 1]].tobytes(), np.uint64) for i in range(lo, hi)]
                queries = np.flatnonzero(asked[lo:hi])
                label = confirmed(sets, percent, None if len(queries) == hi - lo else queries)
                linked = np.flatnonzero(label != np.arange(hi - lo))
                a.append(ids[lo:hi][linked])
                b.append(ids[lo:hi][label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _counted(df: DataFrame) -> DataFrame:
    """df for a join's smaller side: broadcast when counted and few."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _possible(sets: DataFrame, percent: int) -> DataFrame:
    """Members of large families of whose shingles at least percent stand in other members too; all of small ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each family's shingles in some thousand members: how many have it, and one of them."""
        for batch in (part for whole in batches for part in portions(whole, 2, 4096, 16 << 20)):
            data, offs = utf8(batch.column(2).cast(pa.large_binary()))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offs) // 8)
            each = pa.table({"shingle": np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.int64), "component": batch.column(0).take(pa.array(rows)), "id": batch.column(1).take(pa.array(rows))})
            found = each.group_by(["component", "shingle"]).aggregate([("id", "count"), ("id", "min")])
            yield from found.rename_columns(["component", "shingle", "n", "id"]).to_batches()

    large = sets.filter("blocks > 1")
    each = arrow(large.select("component", "id", "shingles"), counted, "component bigint, shingle bigint, n bigint, id bigint")
    alone = each.groupBy("component", "shingle").agg(F.sum("n").alias("n"), F.min("id").alias("id")).filter("n = 1")
    lonely = saved(alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone")))
    size = F.octet_length("shingles") / 8
    gone = large.join(_counted(lonely), "id").filter(100 * (size - F.col("alone")) < percent * size).select("id")
    return semi_by_id(sets, saved(gone), "id", "left_anti")


def _links(texts: DataFrame, candidates: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Exact links within candidate components(id, component), enough of them to connect what is linked. texts(id, text)."""
    spark = texts.sparkSession
    sizes = saved(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    members = saved(candidates.join(_counted(sizes), "component"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 3)):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(3), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], ["component", "id", "blocks", "shingles"])

    chosen = texts.join(_counted(members), "id").select("component", "id", "blocks", "text")
    sets = saved(arrow(chosen, to_sets, "component bigint, id bigint, blocks int, shingles binary"))
    large = not sizes.filter("blocks > 1").isEmpty()
    if large:
        pruned = saved(_possible(sets, percent))
        drop_saved(spark, sets)
        sets = pruned
    sets = sets.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    first = sets.withColumn("at", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    first = first.select("component", "at", "id", F.lit(True).alias("asked"), "shingles").repartition("component", "at").sortWithinPartitions("component", "at", "id")
    edges = saved(arrow(first, _confirmed_edges(percent, 2), "a bigint, b bigint"))
    if not large:
        return edges
    # members of large families that are outside their family's largest confirmed component
    known = components(edges)
    placed = sets.filter("blocks > 1").select("component", "id").join(_counted(known.withColumnRenamed("component", "confirmed")), "id", "left")
    placed = saved(placed.withColumn("confirmed", F.coalesce("confirmed", "id")))
    main = placed.groupBy("component", "confirmed").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("confirmed", F.struct("n", F.negative("confirmed"))).alias("main"))
    main = saved(main)
    outside = saved(placed.join(_counted(main), "component").filter("confirmed <> main").select("component", "id"))
    rest = saved(outside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rows")))
    wide = sets.filter("blocks > 1").join(_counted(rest), "component").join(_counted(outside.select("id", F.lit(True).alias("out"))), "id", "left")
    wide = wide.withColumn("row", F.pmod(F.xxhash64("id", F.lit(7)), "rows").cast("int"))
    every = wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select("component", "i", F.col("block").alias("j"), "id", F.lit(False).alias("asked"), "shingles")
    asking = wide.filter("out").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.col("row").alias("i"), "j", "id", F.lit(True).alias("asked"), "shingles")
    grid = every.unionByName(asking).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id", F.desc("asked"))
    return edges.unionByName(saved(arrow(grid, _confirmed_edges(percent, 3), "a bigint, b bigint")))


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """key, n_shingles, component_id, kept, text_hash for every row.

    Words are runs without white space, A-Z lower-cased; a text's set are its distinct shingles of
    `width` words, or all its words if there are fewer. Texts are linked when 100 * intersection >=
    percent * union. component_id is the least key that links reach; kept says that it is the row's
    own. A text without words (null, empty) has no shingles and no links; texts of any length are read
    whole. Keys are integers; every row is a document of its own, also one of several with one key. A
    row without a key isn't linked: its component_id is null. text_hash (of the whole text, null
    without one) tells rows of one key apart. An empty table gives no rows; other columns don't matter.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text")))

    def to_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 2)):
            n, nodes, sigs = [], [], []
            for shingles in shingle_sets(batch.column(2), width):
                n.append(len(shingles))
                if not len(shingles):
                    nodes.append(None)
                    sigs.append(None)
                    continue
                digest = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles + np.uint64(1)))], np.uint64)
                nodes.append(int(mix(digest[:1] + mix(digest[1:] + np.uint64(len(shingles)))).view(np.int64)[0]))
                sig = signature(shingles)
                sigs.append(sig[:KEY_SLOTS].tobytes() + packed(sig[None]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())], ["id", "h", "n", "node", "sig"])

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sigs = _fixed(batch.column(1), 4 * KEY_SLOTS + 8 * WORDS)
                keys = signature_keys(np.ascontiguousarray(sigs[:, : 4 * KEY_SLOTS]).view(np.uint32))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                small = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(sigs[:, 4 * KEY_SLOTS :]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(rows), small.take(rows).cast(pa.binary())], ["k", "id", "small"])

    signed = saved(arrow(docs.select("id", "h", "text"), to_signatures, "id bigint, h bigint, n bigint, node bigint, sig binary"))
    usable = signed.filter("node IS NOT NULL AND id IS NOT NULL")
    nodes = saved(usable.groupBy("node").agg(F.min(F.struct("id", "h", "sig")).alias("first")).select("node", F.col("first.id").alias("rep"), F.col("first.h").alias("h"), F.col("first.sig").alias("sig")))
    keyed = arrow(nodes.select(F.col("node").alias("id"), "sig"), to_keys, "k bigint, id bigint, small binary")
    near = saved(arrow(keyed.repartition("k").sortWithinPartitions("k", "id"), _candidate_edges(run), "a bigint, b bigint, k bigint, small binary"))
    edges = near.filter("k IS NULL").select("a", "b")
    crowded = near.filter("k IS NOT NULL").select("k", F.col("a").alias("id"), "small")
    if not crowded.isEmpty():
        edges = edges.unionByName(_long_run_edges(crowded, run))
    candidates = components(edges)
    drop_saved(docs.sparkSession, near)
    # a text of each candidate
    wanted = saved(candidates.select(F.col("id").alias("node")).join(nodes.drop("sig"), "node").select("node", F.col("rep").alias("id"), "h"))
    texts = docs.join(_counted(wanted), ["id", "h"]).select(F.col("node").alias("id"), "text")
    if not usable.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    found = components(_links(texts, candidates, width, percent, block))
    joined = nodes.select("node", "rep").join(_counted(found), F.col("node") == F.col("id"), "left").select("node", "rep", F.coalesce("component", "node").alias("class"))
    least = saved(joined.join(_counted(found.select("component").distinct()), F.col("class") == F.col("component"), "left_semi").groupBy("class").agg(F.min("rep").alias("component")))
    classes = saved(joined.join(_counted(least), "class", "left").select("node", F.coalesce("component", "rep").alias("component")))
    out = signed.drop("sig").join(classes, "node", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), F.col("h").alias("text_hash"))


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that near_components() keeps, with their columns; rows without a key or words all stay."""
    gone = saved(near_components(docs, text, key, **options).filter(F.col(key).isNotNull() & ~F.col("kept")).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")))
    rows = docs.withColumn("__key", F.col(key).cast("bigint")).withColumn("__hash", F.xxhash64(text))
    return semi_by_id(rows, gone, ["__key", "__hash"], "left_anti").select(docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), width=4).drop("text_hash")
