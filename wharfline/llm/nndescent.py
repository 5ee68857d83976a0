"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent and searched greedily.

Distinct vectors are dealt into bounded blocks around pivots; a node's address is its
block and its slot there. The graph starts from the neighbours inside the parts of a few
such dealings. Each round then joins every node with its neighbours and those that have
it as neighbour: a block asks the blocks of all of them for their vectors, compares the
neighbours of each node with each other, and sends what beats a node's
worst neighbour to that node's block. Rounds end when few neighbours change.
Queries keep a beam of the best nodes found so far. It starts in the block of the nearest
pivot; each round expands its best nodes, asks the blocks of their neighbours for
scores and merges them, until no node of the beam is left to expand.

What travels is packed: one row for each pair of blocks that have something to say.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.llm.common import tidy, tidy_group, written

#: Nodes of a block, about; and pivots that blocks are dealt around, at most: a sample chosen by a hash of the vector.
BLOCK_ROWS = 2048
PIVOTS = 4096
#: Neighbours kept for each node, nodes that have it as neighbour (the best ones), and proposals for a node from one block.
NEIGHBOURS = 32
REVERSE = 32
PROPOSALS = 16
#: Dealings that the graph starts from; rounds at most, and the share of changed neighbours at which they end.
DEALINGS = 4
ROUNDS = 4
SETTLED = 0.02
#: Nodes in a query's beam, and those expanded in a round; queries that share a row of beams, about.
BEAM = 200
WIDTH = 200
SHARD = 256
#: Senders whose messages to one block meet in one task.
SENDERS = 256
#: Nodes whose neighbours are compared at once.
STEP = 64

SLOT = 16
NONE = -1
MESSAGE = "to bigint, sender bigint, slots binary, addresses binary, scores binary"
GRAPH = "block bigint, nodes int, neighbours binary, scores binary, changed bigint"
BEAMS = "shard bigint, dim int, ids binary, vectors binary, beam binary, scores binary, done binary, left_over bigint"


def _bytes(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _read(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _floats(packed: bytes, count: int) -> np.ndarray:
    """``count`` numbers as doubles, packed in four bytes each or in eight."""
    return np.frombuffer(packed, f"<f{len(packed) // count}" if count else "<f8").astype(np.float64)


def _packable(x: np.ndarray) -> np.ndarray:
    """The same numbers in four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


def _each(table: pa.Table, **kinds):
    """The rows of a table as tuples, packed columns as arrays, others (kind None) as plain values."""
    columns = [[v.as_py() if kind is None else _read(v, kind) for v in table.column(c)] for c, kind in kinds.items()]
    return zip(*columns)


def _joined(table: pa.Table, **kinds) -> list[np.ndarray]:
    """Packed columns of all rows end to end."""
    return [np.concatenate([np.zeros(0, kind), *(_read(v, kind) for v in table.column(c))]) for c, kind in kinds.items()]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])) if len(keys) else []


def _first_of_runs(keys: np.ndarray, most: int) -> np.ndarray:
    """Whether each item is among the first ``most`` of its run of equal keys."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) < most


def best_of(slots: np.ndarray, addresses: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best different addresses of each slot, best first, ties to the smaller address."""
    order = np.lexsort((-scores, addresses, slots))
    slots, addresses, scores = slots[order], addresses[order], scores[order]
    new = np.ones(len(slots), bool)
    new[1:] = (slots[1:] != slots[:-1]) | (addresses[1:] != addresses[:-1])
    slots, addresses, scores = slots[new], addresses[new], scores[new]
    order = np.lexsort((addresses, -scores, slots))
    slots, addresses, scores = slots[order], addresses[order], scores[order]
    first = _first_of_runs(slots, most)
    return slots[first], addresses[first], scores[first]


def messages(sender: int, targets: np.ndarray, addresses: np.ndarray, scores: np.ndarray) -> pa.Table:
    """A row for each block of ``targets``: slots there, and an address and a score for each."""
    order = np.argsort(targets, kind="stable")
    targets, addresses, scores = targets[order], addresses[order], scores[order]
    blocks = targets >> SLOT
    runs = _runs(blocks)
    return pa.table(
        [pa.array([int(blocks[a]) for a, _ in runs], pa.int64()), pa.array([sender] * len(runs), pa.int64()), _bytes([(targets[a:b] & ((1 << SLOT) - 1)).astype(np.int32) for a, b in runs]), _bytes([addresses[a:b].astype(np.int64) for a, b in runs]), _bytes([scores[a:b].astype(np.float32) for a, b in runs])],
        ["to", "sender", "slots", "addresses", "scores"],
    )


def nearest_inside(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, row and score of the ``most`` largest inner products of each row with others."""
    n, rows, others, scores = len(x), [], [], []
    most = min(most, n - 1)
    for a in range(0, n if most > 0 else 0, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        rows.append(np.repeat(np.arange(a, a + len(s)), most))
        others.append(top.reshape(-1))
        scores.append(np.take_along_axis(s, top, axis=1).reshape(-1))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty.astype(k), *parts]).astype(k) for parts, k in ((rows, np.int64), (others, np.int64), (scores, np.float32)))


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more component that makes all lengths ``reach``, so that inner products of data order like distances."""
    rest = np.sqrt(np.maximum(reach * reach - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest]).astype(np.float32)


def marks_of(addresses: np.ndarray) -> np.ndarray:
    """Sixteen bits of a hash of each address."""
    return ((addresses.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def compared(hoods: np.ndarray, known: np.ndarray, x: np.ndarray, worst: np.ndarray, marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proposals (address, address, score) from comparing the members of each row of ``hoods`` with each other.

    ``known`` has the sorted addresses that rows of x, worst (score of the worst
    neighbour) and marks (of all neighbours) belong to. A pair counts for a node if it beats its worst neighbour
    and, by its marks, isn't one already; ``most`` proposals a node are kept, the best.
    """
    found = [[], [], []]
    at = np.searchsorted(known, np.where(hoods < 0, known[0], hoods)) if len(known) else hoods
    for a in range(0, len(hoods) if len(known) else 0, STEP):
        there, rows = hoods[a : a + STEP] >= 0, at[a : a + STEP]
        members = x[rows]
        s = members @ members.transpose(0, 2, 1)
        better = there[:, :, None] & there[:, None, :] & (s > worst[rows][:, :, None]) & (rows[:, :, None] != rows[:, None, :])
        i, j, k = np.nonzero(better)
        one, other = rows[i, j], rows[i, k]
        new = (marks[one] != marks_of(known[other])[:, None]).all(axis=1)
        for out, part in zip(found, (one[new], other[new], s[i, j, k][new])):
            out.append(part)
    one, other, scores = (np.concatenate([np.zeros(0, k), *parts]).astype(k) for parts, k in zip(found, (np.int64, np.int64, np.float32)))
    one, other, scores = best_of(one, other, scores, most)
    return known[one], known[other], scores


# --- rows, blocks and the first graph ------------------------------------------


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, dim and vec (packed) of the rows that take part, each id and vector once."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    # Numbers that the table holds in four bytes travel in four.
    single = isinstance(df.schema[embedding].dataType.elementType, T.FloatType)
    fine = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("v", lambda v: v != 0)

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(at) else np.zeros(0))
            values, width = (values.astype(np.float32), 4) if single else (values, 8)
            at = (at - at[0]) * width
            # Buffers of offsets are 32 bits wide; a batch of vectors is far below that.
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
            yield pa.record_batch([batch.column(0), pa.array((np.diff(at) // width).astype(np.int32)), packed], ["id", "dim", "vec"])

    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return rows.mapInArrow(tidy(pack), "id bigint, dim int, vec binary").dropDuplicates(["id", "vec"])


def pivots(nodes: DataFrame, most: int, seed: int) -> dict[int, np.ndarray]:
    """At most ``most`` (and PIVOTS) vectors, by their length; which ones, a hash of vector and seed decides."""
    by_dim: dict[int, list] = {}
    for row in nodes.select("dim", "vec").orderBy(F.xxhash64(F.lit(seed), "vec")).limit(min(most, PIVOTS)).collect():
        by_dim.setdefault(row.dim, []).append(_floats(row.vec, row.dim))
    return {dim: np.stack(rows) for dim, rows in by_dim.items()}


def near_pivot(rows: DataFrame, shared, reach: float | None) -> DataFrame:
    """Adds ``pivot``, the nearest of a broadcast of pivots (-1 where the vector's length has none). ``reach`` lifts data; queries (None) aren't."""

    def nearest(batches):
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.full(batch.num_rows, -1, np.int64)
            for d in np.unique(dims).tolist():
                if (at := shared.value.get(d)) is not None:
                    mine = np.flatnonzero(dims == d)
                    x = np.stack([_floats(v.as_py(), d) for v in batch.column("vec").take(pa.array(mine))])
                    x, at = (x, at) if reach is None else (lifted(x, reach), lifted(at, reach))
                    for a in range(0, len(mine), 1024):
                        out[mine[a : a + 1024]] = np.argmax(x[a : a + 1024] @ at.T, axis=1)
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "pivot"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(nearest), f"{kinds}, pivot bigint")


def part_of(parts: str = "parts") -> Column:
    """A number for pivot, length and one of ``parts`` parts of the pivot's rows, chosen by a hash of the vector."""
    return F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec"), parts).cast("bigint") * F.lit(1 << 12) + F.pmod("dim", F.lit(1 << 12))


def dealt(rows: DataFrame, shared, reach: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``block``, and the number of parts of each pivot. Pivots with more than ``block_rows`` rows are parted by a hash, so a crowded place is no large block."""
    rows = written(near_pivot(rows, shared, reach), "nn-rows")
    # A row for each pivot and length of vectors.
    parts = written(rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts")), "nn-parts")
    return rows.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("block", part_of()).drop("parts", "pivot"), parts


def blocks_of(rows: DataFrame, reach: float) -> DataFrame:
    """A row a block: dim, nodes, vectors, ids (of all nodes end to end) and counts (ids of each node), codes (bytes of the lifted vectors) and scales, and the first graph's neighbours and scores."""

    def build(group: pa.Table) -> pa.Table:
        block, dim = group.column("block")[0].as_py(), group.column("dim")[0].as_py()
        if group.num_rows >> SLOT:
            raise ValueError(f"{group.num_rows} vectors in a block")
        order = sorted(range(group.num_rows), key=group.column("vec").to_pylist().__getitem__)
        group = group.take(pa.array(order))
        x = np.stack([_floats(v.as_py(), dim) for v in group.column("vec")])
        ids = group.column("ids").to_pylist()
        up = lifted(x, reach)
        scale = np.maximum(np.abs(up).max(axis=1), 1e-30) / 127
        one, other, score = nearest_inside(up, NEIGHBOURS)
        neighbours, scores, _ = merged(len(x), None, None, one, (block << SLOT) + other, score)
        row = [_packable(x), np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids], np.int32), np.round(up / scale[:, None]).astype(np.int8), scale.astype(np.float32), neighbours, scores]
        return pa.table([pa.array([block]), pa.array([dim], pa.int32()), pa.array([len(x)], pa.int32()), *[_bytes([c]) for c in row]], ["block", "dim", "nodes", "vectors", "ids", "counts", "codes", "scales", "neighbours", "scores"])

    return rows.groupBy("dim", "block").applyInArrow(tidy_group(build), "block bigint, dim int, nodes int, vectors binary, ids binary, counts binary, codes binary, scales binary, neighbours binary, scores binary")


def merged(nodes: int, neighbours: np.ndarray | None, scores: np.ndarray | None, slots: np.ndarray, addresses: np.ndarray, proposed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The best NEIGHBOURS of each node from its neighbours (nodes by NEIGHBOURS, NONE where missing) and proposals, and how many are new."""
    old = np.zeros(0, np.int64)
    if neighbours is not None:
        have = neighbours.reshape(-1) != NONE
        owner = np.repeat(np.arange(nodes), NEIGHBOURS)[have]
        slots, addresses, proposed = np.concatenate([owner, slots]), np.concatenate([neighbours.reshape(-1)[have], addresses]), np.concatenate([scores.reshape(-1)[have], proposed])
        old = np.sort(neighbours, axis=1)
    slots, addresses, proposed = best_of(slots, addresses, proposed, NEIGHBOURS)
    place = np.arange(len(slots)) - np.searchsorted(slots, slots)
    out, best = np.full((nodes, NEIGHBOURS), NONE, np.int64), np.full((nodes, NEIGHBOURS), -np.inf, np.float32)
    out[slots, place], best[slots, place] = addresses, proposed
    changed = int((out != NONE).sum()) if neighbours is None else int((np.sort(out, axis=1) != old).any(axis=1).sum())
    return out, best, changed


def gathered(sent: DataFrame, most: int) -> DataFrame:
    """Messages of which no block gets more than SENDERS: those of a block that many write to are first cut to the ``most`` best of each slot in groups of senders."""
    if (sent.groupBy("to").count().agg(F.max("count")).first()[0] or 0) <= SENDERS:
        return sent

    def cut(group: pa.Table) -> pa.Table:
        slots, addresses, scores = best_of(*_joined(group, slots=np.int32, addresses=np.int64, scores=np.float32), most)
        to, sender = group.column("to")[0].as_py(), min(group.column("sender").to_pylist())
        return messages(sender, (to << SLOT) + slots.astype(np.int64), addresses, scores)

    # Numbered, so that the groups of a block are even and each round cuts their number by SENDERS.
    place = F.row_number().over(Window.partitionBy("to").orderBy("sender"))
    grouped = sent.withColumn("group", F.floor(place / SENDERS))
    return gathered(written(grouped.groupBy("to", "group").applyInArrow(tidy_group(cut), MESSAGE), "nn-cut"), most)


def meet(blocks: DataFrame, sent: DataFrame, senders: int, work: Callable, schema: str) -> DataFrame:
    """``work`` (block's table, table of messages ``to`` it) for each block that gets messages; a block that many write to is copied for groups of senders.

    ``sender`` tells the groups, of about SENDERS of the ``senders`` there are. Only copies that are needed are made.
    """

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        return work(block, messages)

    groups = -(-senders // SENDERS)
    if groups <= 1:
        return blocks.groupBy("block").cogroup(sent.withColumnRenamed("to", "block").groupBy("block")).applyInArrow(tidy_cogroup(run), schema)
    told = sent.withColumnRenamed("to", "block").withColumn("cell", F.pmod(F.xxhash64("sender"), F.lit(groups)))
    copies = blocks.join(told.select(F.col("block").alias("block"), F.col("cell").alias("cell")).distinct(), "block")
    return copies.groupBy("block", "cell").cogroup(told.groupBy("block", "cell")).applyInArrow(tidy_cogroup(run), schema)


def tidy_cogroup(work: Callable) -> Callable:
    """A function over two tables; gives its memory back."""
    inner = tidy_group(lambda pair: work(*pair))

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return inner((left, right))

    return whole


def merge_into(graph: DataFrame, sent: DataFrame) -> DataFrame:
    """The graph after proposals."""

    def work(own: pa.Table, proposals: pa.Table) -> pa.Table:
        if not own.num_rows:
            raise ValueError("proposals for a block that isn't there")
        (block, nodes, neighbours, scores) = next(_each(own, block=None, nodes=None, neighbours=np.int64, scores=np.float32))
        slots, addresses, proposed = _joined(proposals, slots=np.int32, addresses=np.int64, scores=np.float32)
        out, best, changed = merged(nodes, neighbours.reshape(nodes, -1), scores.reshape(nodes, -1), slots.astype(np.int64), addresses, proposed)
        return pa.table([pa.array([block]), pa.array([nodes], pa.int32()), _bytes([out]), _bytes([best]), pa.array([changed])], ["block", "nodes", "neighbours", "scores", "changed"])

    sent = gathered(sent, NEIGHBOURS).withColumnRenamed("to", "block")
    return written(graph.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(tidy_cogroup(work), GRAPH), "nn-graph")


def first_graph(blocks: DataFrame, reach: float, block_rows: int, nodes: int) -> DataFrame:
    """The graph of neighbours inside the parts of all dealings."""
    graph = blocks.select("block", "nodes", "neighbours", "scores", F.lit(0).cast("bigint").alias("changed"))
    spark, sent = blocks.sparkSession, None

    def rows(batches):
        for batch in batches:
            for block, dim, n, packed in _each(pa.Table.from_batches([batch]), block=None, dim=None, nodes=None, vectors=None):
                x = _packable(_floats(packed, n * dim)).reshape(n, dim)
                yield pa.record_batch([pa.array((block << SLOT) + np.arange(n)), pa.array([dim] * n, pa.int32()), _bytes(list(x))], ["address", "dim", "vec"])

    def inside(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        x = lifted(np.stack([_floats(v.as_py(), dim) for v in group.column("vec")]), reach)
        addresses = group.column("address").to_numpy()
        one, other, score = nearest_inside(x, NEIGHBOURS)
        return messages(group.column("block")[0].as_py(), addresses[one], addresses[other], score)

    flat = blocks.select("block", "dim", "nodes", "vectors").mapInArrow(tidy(rows), "address bigint, dim int, vec binary")
    for seed in range(1, DEALINGS):
        shared = spark.sparkContext.broadcast(pivots(flat, -(-nodes // block_rows), seed))
        parts, _ = dealt(flat, shared, reach, block_rows)
        found = parts.groupBy("dim", "block").applyInArrow(tidy_group(inside), MESSAGE)
        sent = found if sent is None else sent.union(found)
    return graph if sent is None else merge_into(graph, written(sent, "nn-sent"))


# --- NN-descent ----------------------------------------------------------------


def hoods_of(graph: DataFrame) -> DataFrame:
    """A row a block: hoods (node, its neighbours and REVERSE nodes that have it as neighbour; NONE where missing) and ``wants``, the slots of each block that they name."""

    def back(batches):
        for batch in batches:
            for block, n, neighbours, scores in _each(pa.Table.from_batches([batch]), block=None, nodes=None, neighbours=np.int64, scores=np.float32):
                have = neighbours != NONE
                owner = np.repeat(np.arange(n), NEIGHBOURS)[have]
                targets, owners, score = best_of(neighbours[have], (block << SLOT) + owner, scores[have], REVERSE)
                yield from messages(block, targets, owners, score).to_batches()

    def work(own: pa.Table, links: pa.Table) -> pa.Table:
        block, n, neighbours = next(_each(own, block=None, nodes=None, neighbours=np.int64))
        slots, addresses, _ = best_of(*_joined(links, slots=np.int32, addresses=np.int64, scores=np.float32), REVERSE)
        reverse = np.full((n, REVERSE), NONE, np.int64)
        reverse[slots, np.arange(len(slots)) - np.searchsorted(slots, slots)] = addresses
        hood = np.sort(np.column_stack([(block << SLOT) + np.arange(n), neighbours.reshape(n, -1), reverse]), axis=1)
        hood[:, 1:][hood[:, 1:] == hood[:, :-1]] = NONE
        known = np.unique(hood[hood != NONE])
        runs = _runs(known >> SLOT)
        wants = [{"to": int(known[a] >> SLOT), "slots": (known[a:b] & ((1 << SLOT) - 1)).astype(np.int32).tobytes()} for a, b in runs]
        return pa.table([pa.array([block]), pa.array([n], pa.int32()), _bytes([hood]), pa.array([wants], pa.list_(pa.struct([("to", pa.int64()), ("slots", pa.binary())])))], ["block", "nodes", "hoods", "wants"])

    links = gathered(written(graph.mapInArrow(tidy(back), MESSAGE), "nn-links"), REVERSE).withColumnRenamed("to", "block")
    return written(graph.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(tidy_cogroup(work), "block bigint, nodes int, hoods binary, wants array<struct<to: bigint, slots: binary>>"), "nn-hoods")


def descend(blocks: DataFrame, graph: DataFrame, count: int) -> DataFrame:
    """The graph after one round over all neighbours of neighbours."""
    hoods = hoods_of(graph)

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        n, codes, scales, neighbours, scores = next(_each(own, nodes=None, codes=np.int8, scales=np.float32, neighbours=np.int64, scores=np.float32))
        codes, marks, worst = codes.reshape(n, -1), marks_of(neighbours).reshape(n, -1), scores.reshape(n, -1)[:, -1]
        block = own.column("block")[0].as_py()
        rows = [(sender, (block << SLOT) + slots.astype(np.int64), codes[slots], scales[slots], worst[slots], marks[slots]) for sender, slots in _each(asked, sender=None, slots=np.int32)]
        ids, *parts = zip(*rows) if rows else ([], *[[]] * 5)
        return pa.table([pa.array(list(ids), pa.int64()), *[_bytes(list(p)) for p in parts]], ["block", "addresses", "codes", "scales", "worst", "marks"])

    def work(own: pa.Table, answers: pa.Table) -> pa.Table:
        block, n, hoods = next(_each(own, block=None, nodes=None, hoods=np.int64))
        known, codes, scales, worst, marks = _joined(answers, addresses=np.int64, codes=np.int8, scales=np.float32, worst=np.float32, marks=np.uint16)
        order = np.argsort(known)
        x = codes.reshape(len(known), -1)[order].astype(np.float32) * scales[order][:, None]
        return messages(block, *compared(hoods.reshape(n, -1), known[order], x, worst[order], marks.reshape(len(known), -1)[order], PROPOSALS))

    asked = hoods.select(F.col("block").alias("sender"), F.explode("wants").alias("w")).select("w.to", "sender", "w.slots")
    wide = blocks.select("block", "codes", "scales").join(graph.select("block", "nodes", "neighbours", "scores"), "block")
    answers = meet(wide, asked, count, answer, "block bigint, addresses binary, codes binary, scales binary, worst binary, marks binary")
    sent = hoods.select("block", "nodes", "hoods").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_cogroup(work), MESSAGE)
    return merge_into(graph, written(sent, "nn-proposals"))


def index(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS, ids_kept: int = 21) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    """Blocks, graph, parts of pivots and the pivots' broadcast for rows of ``vectors``; of equal vectors the ``ids_kept`` smallest ids are kept."""
    spark = rows.sparkSession
    first = Window.partitionBy("vec", "dim").orderBy("id")
    # A limit on row numbers is applied before rows are sent, so copies of one vector meet as a few rows a task.
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= ids_kept)
    nodes = written(few.groupBy("vec", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nn-nodes")

    def lengths(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([float(np.sqrt((_floats(v.as_py(), d) ** 2).sum())) for v, d in zip(batch.column(0), batch.column(1).to_pylist())], pa.float64())], ["length"])

    count, reach = nodes.select("vec", "dim").mapInArrow(tidy(lengths), "length double").agg(F.count(F.lit(1)), F.max("length")).first()
    reach = reach or 1.0
    shared = spark.sparkContext.broadcast(pivots(nodes, max(1, -(-count // block_rows)), 0))
    dealt_rows, parts = dealt(nodes, shared, reach, block_rows)
    blocks = written(blocks_of(dealt_rows, reach), "nn-blocks")
    number = blocks.count()
    graph = first_graph(blocks, reach, block_rows, count)
    for _ in range(rounds if number > 1 else 0):
        graph = descend(blocks, graph, number)
        if graph.agg(F.sum("changed")).first()[0] <= SETTLED * count:
            break
    return blocks, graph, parts, shared


# --- search --------------------------------------------------------------------


def chosen(beam: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Of each row of a beam, best first, the first WIDTH nodes not expanded yet."""
    open_ = (beam != NONE) & ~done
    return open_ & (np.cumsum(open_, axis=1) <= WIDTH)


def _beams(table: pa.Table):
    for shard, dim, ids, packed, beam, scores, done in _each(table, shard=None, dim=None, ids=np.int64, vectors=None, beam=np.int64, scores=np.float64, done=np.bool_):
        n = len(ids)
        yield shard, dim, ids, _floats(packed, n * dim).reshape(n, dim), beam.reshape(n, -1), scores.reshape(n, -1), done.reshape(n, -1)


def _beam_row(shard: int, dim: int, ids: np.ndarray, x: np.ndarray, beam: np.ndarray, scores: np.ndarray, done: np.ndarray) -> pa.Table:
    left = int(((beam != NONE) & ~done).sum())
    return pa.table([pa.array([shard]), pa.array([dim], pa.int32()), *[_bytes([c]) for c in (ids, _packable(x), beam, scores, done)], pa.array([left])], ["shard", "dim", "ids", "vectors", "beam", "scores", "done", "left_over"])


def _pairs(who: np.ndarray, addresses: np.ndarray, without: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's number and an address, each once, but those of ``without``."""
    known, place = np.unique(addresses, return_inverse=True)
    keys = np.unique(who.astype(np.int64) * max(1, len(known)) + place)
    if without is not None and len(known):
        w, a = without
        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
        same = known[at] == a
        keys = np.setdiff1d(keys, w[same].astype(np.int64) * len(known) + at[same], assume_unique=True)
    return keys // max(1, len(known)), known[keys % max(1, len(known))]


def _by_block(who: np.ndarray, addresses: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, who, slots) of pairs of a query's number and an address."""
    order = np.argsort(addresses, kind="stable")
    who, addresses = who[order].astype(np.int32), addresses[order]
    return [(int(addresses[a] >> SLOT), who[a:b], (addresses[a:b] & ((1 << SLOT) - 1)).astype(np.int32)) for a, b in _runs(addresses >> SLOT)]


def started(blocks: DataFrame, queries: DataFrame, parts: DataFrame, shared) -> DataFrame:
    """A first beam for each query (id, dim, vec): the best nodes of the block that its nearest pivot and its hash lead to. Queries of a length that no node has are left out."""
    home = near_pivot(queries, shared, None).join(F.broadcast(parts), ["dim", "pivot"]).withColumn("to", part_of()).select("to", "id", "vec")
    # A part of a pivot may hold no node of that hash; its queries go to the pivot's first block.
    counts = written(home, "nn-homes")
    sizes = counts.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    asked = counts.join(sizes, "to").withColumn("shard", F.pmod(F.xxhash64("id", "vec"), "shards"))

    def work(own: pa.Table, queries: pa.Table) -> pa.Table:
        block, dim, n, packed = next(_each(own, block=None, dim=None, nodes=None, vectors=None))
        ids = queries.column("id").to_numpy()
        q = np.stack([_floats(v.as_py(), dim) for v in queries.column("vec")])
        scores = q @ _floats(packed, n * dim).reshape(n, dim).T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
        beam, best = np.full((len(q), BEAM), NONE, np.int64), np.full((len(q), BEAM), -np.inf)
        beam[:, : order.shape[1]], best[:, : order.shape[1]] = (block << SLOT) + order, np.take_along_axis(scores, order, axis=1)
        shard = queries.column("shard")[0].as_py()
        return _beam_row((block << SLOT) + shard, dim, ids, q, beam, best, np.zeros(beam.shape, bool))

    asked = asked.withColumnRenamed("to", "block").drop("shards")
    copies = blocks.select("block", "dim", "nodes", "vectors").join(asked.select(F.col("block").alias("block"), F.col("shard").alias("shard")).distinct(), "block")
    return written(copies.groupBy("block", "shard").cogroup(asked.groupBy("block", "shard")).applyInArrow(tidy_cogroup(work), BEAMS), "nn-beams")


def advanced(blocks: DataFrame, hoods: DataFrame, beams: DataFrame, shards: int) -> DataFrame:
    """Beams after their best nodes were expanded."""

    def expand(batches):
        for batch in batches:
            for shard, _, _, _, beam, _, done in _beams(pa.Table.from_batches([batch])):
                who, place = np.nonzero(chosen(beam, done))
                rows = _by_block(who, beam[who, place])
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), _bytes([r[1] for r in rows]), _bytes([r[2] for r in rows])], ["to", "sender", "who", "slots"])

    def links(own: pa.Table, asked: pa.Table) -> pa.Table:
        n, hoods = next(_each(own, nodes=None, hoods=np.int64))
        hoods, out = hoods.reshape(n, -1), []
        for sender, who, slots in _each(asked, sender=None, who=np.int32, slots=np.int32):
            near = hoods[slots].reshape(-1)
            who, near = _pairs(np.repeat(who, hoods.shape[1])[near != NONE], near[near != NONE])
            out.append((sender, who.astype(np.int32), near))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), _bytes([o[1] for o in out]), _bytes([o[2] for o in out])], ["shard", "who", "addresses"])

    def fresh(own: pa.Table, found: pa.Table) -> pa.Table:
        shard, dim, ids, x, beam, scores, _ = next(_beams(own))
        who, addresses = _joined(found, who=np.int32, addresses=np.int64)
        there, place = np.nonzero(beam != NONE)
        rows = []
        for block, who, slots in _by_block(*_pairs(who, addresses, (there, beam[there, place]))):
            own_rows, local = np.unique(who, return_inverse=True)
            rows.append((block, own_rows, local.astype(np.int32), slots, _packable(x[own_rows]), scores[own_rows, -1]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), *[_bytes([r[i] for r in rows]) for i in range(1, 6)]], ["to", "sender", "queries", "who", "slots", "vectors", "worst"])

    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        block, dim, n, packed = next(_each(own, block=None, dim=None, nodes=None, vectors=None))
        x, out = _floats(packed, n * dim).reshape(n, dim), []
        for sender, queries, who, slots, q, worst in _each(asked, sender=None, queries=np.int32, who=np.int32, slots=np.int32, vectors=None, worst=np.float64):
            s = np.einsum("ij,ij->i", _floats(q, len(queries) * dim).reshape(-1, dim)[who], x[slots])
            good = s > worst[who]
            out.append((sender, queries[who[good]], (block << SLOT) + slots[good].astype(np.int64), s[good]))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), *[_bytes([o[i] for o in out]) for i in range(1, 4)]], ["shard", "who", "addresses", "scores"])

    def take(own: pa.Table, found: pa.Table) -> pa.Table:
        shard, dim, ids, x, beam, scores, done = next(_beams(own))
        done = done | chosen(beam, done)
        who, addresses, new = _joined(found, who=np.int32, addresses=np.int64, scores=np.float64)
        there, place = np.nonzero(beam != NONE)
        w, a = np.concatenate([there, who]), np.concatenate([beam[there, place], addresses])
        s, d = np.concatenate([scores[there, place], new]), np.concatenate([done[there, place], np.zeros(len(who), bool)])
        order = np.lexsort((a, -s, w))
        w, a, s, d = w[order], a[order], s[order], d[order]
        first = _first_of_runs(w, BEAM)
        w, a, s, d = w[first], a[first], s[first], d[first]
        at = np.arange(len(w)) - np.searchsorted(w, w)
        beam, scores, done = np.full(beam.shape, NONE, np.int64), np.full(scores.shape, -np.inf), np.zeros(done.shape, bool)
        beam[w, at], scores[w, at], done[w, at] = a, s, d
        return _beam_row(shard, dim, ids, x, beam, scores, done)

    asked = beams.mapInArrow(tidy(expand), "to bigint, sender bigint, who binary, slots binary")
    linked = meet(hoods.select("block", "nodes", "hoods"), asked, shards, links, "shard bigint, who binary, addresses binary")
    wanted = beams.groupBy("shard").cogroup(linked.groupBy("shard")).applyInArrow(tidy_cogroup(fresh), "to bigint, sender bigint, queries binary, who binary, slots binary, vectors binary, worst binary")
    wanted = written(wanted, "nn-wanted")
    scored = meet(blocks.select("block", "dim", "nodes", "vectors").join(wanted.select(F.col("to").alias("block")).distinct(), "block", "left_semi"), wanted, shards, score, "shard bigint, who binary, addresses binary, scores binary")
    return written(beams.groupBy("shard").cogroup(scored.groupBy("shard")).applyInArrow(tidy_cogroup(take), BEAMS), "nn-beams")


def nearest(data: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows of data with the largest inner products found for each row of queries.

    Both have the columns ``vec_id`` and ``embedding``. Rows with a query's own id
    are no candidates; ties go to the smaller id. Vectors null, zero or with null or non-finite
    components, and null ids, take no part; vectors of different lengths don't meet. Rows that repeat
    an id and a vector count once; queries that repeat an id are ranked together. All copies of a vector are one node, which keeps
    as many of their smallest ids as a result can show. An empty table gives an empty result; other columns are
    ignored. Every row is indexed; what is found is approximate, its scores are exact (in doubles) on the original vectors.
    """
    asked = vectors(queries, vec_id, embedding)
    blocks, graph, parts, shared = index(vectors(data, vec_id, embedding), block_rows=block_rows, rounds=rounds, ids_kept=k + 1)
    beams = started(blocks, asked, parts, shared)
    hoods = hoods_of(graph)
    shards, left = beams.agg(F.count(F.lit(1)), F.sum("left_over")).first()
    alone = blocks.limit(2).count() < 2
    while left and not alone:
        beams = advanced(blocks, hoods, beams, shards)
        left = beams.agg(F.sum("left_over")).first()[0]

    def tops(batches):
        for batch in batches:
            for shard, _, ids, _, beam, scores, _ in _beams(pa.Table.from_batches([batch])):
                who, place = np.nonzero(beam[:, : k + 1] != NONE)
                addresses = beam[who, place]
                order = np.argsort(addresses, kind="stable")
                who, place, addresses = who[order], place[order], addresses[order]
                runs = _runs(addresses >> SLOT)
                columns = (ids[who], (addresses & ((1 << SLOT) - 1)).astype(np.int32), scores[who, place])
                yield pa.record_batch([pa.array([int(addresses[a] >> SLOT) for a, _ in runs], pa.int64()), pa.array([shard] * len(runs), pa.int64()), *[_bytes([c[a:b] for a, b in runs]) for c in columns]], ["to", "sender", "queries", "slots", "scores"])

    def named(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, counts = next(_each(own, ids=np.int64, counts=np.int32))
        ends = np.cumsum(counts)
        q, slots, scores = _joined(asked, queries=np.int64, slots=np.int32, scores=np.float64)
        n = counts[slots]
        at = np.repeat(ends[slots] - n - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, found, scores = np.repeat(q, n), ids[at], np.repeat(scores, n)
        other = q != found
        return pa.table([pa.array(q[other]), pa.array(found[other]), pa.array(scores[other])], ["query_id", "vec_id", "score"])

    told = beams.mapInArrow(tidy(tops), "to bigint, sender bigint, queries binary, slots binary, scores binary")
    found = meet(blocks.select("block", "ids", "counts"), told, shards, named, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
