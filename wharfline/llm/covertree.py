"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt into bounded blocks around pivots, so that a block spans a small
part of the space, and a cover tree is built for each block of data and of queries.
Each block of queries is searched against its nearest block of data first;
the kth scores found there seed all further searches, and a pair of blocks whose
largest possible inner product is below the worst of them is never sent.
The other pairs are searched by descending both trees at once: a pair of nodes is
cut off if the largest inner product that its covering radii allow is below the
worst kth score of the query node's group. Each pair yields k rows a query at most,
which are ranked at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import tidy, tidy_group, written

BLOCK_ROWS = 2048
#: Pivots that blocks are dealt around, at most; they are a sample of the data, chosen by a hash of the row.
PIVOTS = 4096
#: Points of a node that isn't parted further, and the factor between the radius of a node and that its children are parted by.
LEAF = 24
#: The same in trees of queries, whose leaves are searched as one group: a group wider than what it looks for prunes nothing.
GROUP = 4
BASE = 1.15
#: Largest magnitude up to which sums of products are exact in doubles.
EXACT = 2.0**52


def _distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


class CoverTree:
    """Nodes in breadth-first order: each has a centre (a row of ``points``), a covering radius, a run of rows, and a run of children.

    A child's centre lies within its parent's radius; the points of a child lie
    within its own; the first child keeps its parent's centre; centres of
    siblings lie farther apart than the radius they were chosen by. Points are reordered so that a node's rows are consecutive.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, arrays: dict[str, np.ndarray] | None = None, leaf: int = LEAF):
        if arrays is not None:
            self.ids, self.points = ids, points
            self.__dict__.update(arrays)
            return
        x = points.astype(np.float64)
        queue = [(np.arange(len(ids)), 0)]
        centres, radii, children, leaves = [], [], [], []
        for members, centre in queue:
            distance = _distance(x[members], x[centre]) if len(members) else np.zeros(0)
            radius = float(distance.max(initial=0.0))
            parted = self._part(x, members, centre, distance, radius / BASE) if len(members) > leaf and radius > 0 else []
            centres.append(centre)
            radii.append(radius)
            children.append((len(queue), len(queue) + len(parted)))
            leaves.append(members if not parted else None)
            queue += parted
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.child_from, self.child_to = (np.array(c) for c in zip(*children))
        size = np.array([0 if m is None else len(m) for m in leaves])
        for i in range(len(size) - 1, -1, -1):
            size[i] += size[self.child_from[i] : self.child_to[i]].sum()
        start = np.zeros(len(size), np.int64)
        for i in range(len(size)):
            a, b = self.child_from[i], self.child_to[i]
            start[a:b] = start[i] + np.cumsum(size[a:b]) - size[a:b]
        self.row_from, self.row_to = start, start + size
        order = np.empty(len(ids), np.int64)
        for s, m in zip(start.tolist(), leaves):
            if m is not None:
                order[s : s + len(m)] = m
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.centre = place[self.centre] if len(ids) else self.centre
        self.ids, self.points = ids[order], points[order]

    @staticmethod
    def _part(x: np.ndarray, members: np.ndarray, centre: int, distance: np.ndarray, reach: float) -> list[tuple[np.ndarray, int]]:
        """Children as (members, centre), the farthest point leading each next one."""
        out = [(members[distance <= reach], centre)]
        far, away = members[distance > reach], distance[distance > reach]
        while len(far):
            lead = far[int(np.argmax(away))]
            d = _distance(x[far], x[lead])
            near = d <= reach
            out.append((far[near], lead))
            far, away = far[~near], np.minimum(away, d)[~near]
        return out

    FIELDS = ("centre", "radius", "child_from", "child_to", "row_from", "row_to")

    def packed(self) -> list[bytes]:
        return [self.ids.tobytes(), self.points.tobytes(), *[getattr(self, f).tobytes() for f in self.FIELDS]]

    @classmethod
    def unpacked(cls, parts: list[bytes], dim: int) -> CoverTree:
        kinds = {f: np.float64 if f == "radius" else np.int64 for f in cls.FIELDS}
        ids = np.frombuffer(parts[0], np.int64)
        points = np.frombuffer(parts[1], np.int64).reshape(len(ids), dim)
        return cls(ids, points, {f: np.frombuffer(p, kinds[f]) for f, p in zip(cls.FIELDS, parts[2:])})


def dual_search(queries: CoverTree, data: CoverTree, k: int, least: np.ndarray | None = None, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, data id and score of the k best of each query; the query's own id is no candidate, ties go to smaller ids.

    ``least`` is a score for each query below which rows are of no use; ``seen`` gets the numbers of pairs of points scored and of all.
    """
    nq = len(queries.ids)
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * max(1, data.points.shape[1]) < EXACT
    kind = np.float64 if exact else np.int64
    qx, dx = queries.points.astype(kind), data.points.astype(kind)
    qf, df = queries.points.astype(np.float64), data.points.astype(np.float64)
    dnorm = np.sqrt((df[data.centre] ** 2).sum(axis=1))
    qnorm = np.sqrt((qf[queries.centre] ** 2).sum(axis=1))
    best = np.full((nq, k), np.iinfo(np.int64).min, np.int64)
    who = np.full((nq, k), np.iinfo(np.int64).max, np.int64)
    floor = np.full(nq, np.iinfo(np.int64).min, np.int64) if least is None else least
    scored = 0

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product that any point of query node q can have with any point of each data node."""
        c = df[data.centre[nodes]] @ qf[queries.centre[q]]
        reach = queries.radius[q] * dnorm[nodes] + data.radius[nodes] * qnorm[q] + queries.radius[q] * data.radius[nodes]
        return c + reach + (np.abs(c) + reach) * 1e-9 + 1e-6

    def leaf(q: int, nodes: np.ndarray) -> None:
        """All pairs of a query leaf with data leaves that survive, best bound first, in blocks."""
        nonlocal scored
        a, b = queries.row_from[q], queries.row_to[q]
        top = bounds(q, nodes)
        order = np.argsort(-top, kind="stable")
        nodes, top = nodes[order], top[order]
        size = data.row_to[nodes] - data.row_from[nodes]
        at, rows_at_once = 0, 32
        while at < len(nodes):
            if b == a or top[at] < worst_of(q):
                break
            to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), rows_at_once)) + at)
            rows_at_once = min(2 * rows_at_once, 1024)
            rows = np.repeat(data.row_from[nodes[at:to]] - np.cumsum(size[at:to]) + size[at:to], size[at:to]) + np.arange(size[at:to].sum())
            score = (qx[a:b] @ dx[rows].T).astype(np.int64)
            ids = data.ids[rows]
            scored += score.size
            hits = (score >= np.maximum(best[a:b, -1], floor[a:b])[:, None]) & (queries.ids[a:b, None] != ids[None, :])
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                s, hit = score[i], hits[i]
                cs, ci = np.concatenate([best[a + i], s[hit]]), np.concatenate([who[a + i], ids[hit]])
                order = np.lexsort((ci, ~cs))[:k]
                best[a + i], who[a + i] = cs[order], ci[order]
            at = to

    def children(nodes: np.ndarray) -> np.ndarray:
        a, count = data.child_from[nodes], data.child_to[nodes] - data.child_from[nodes]
        return np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())

    def worst_of(q: int) -> int:
        a, b = queries.row_from[q], queries.row_to[q]
        return np.maximum(best[a:b, -1], floor[a:b]).min()

    stack = [(0, np.zeros(1, np.int64))] if nq and len(data.ids) else []
    while stack:
        q, nodes = stack.pop()
        nodes = nodes[bounds(q, nodes) >= worst_of(q)]
        inner = data.child_to[nodes] > data.child_from[nodes]
        # The query group's data nodes are opened while they are wider than the group itself.
        while inner.any() and (wide := inner & (data.radius[nodes] >= queries.radius[q])).any():
            opened = children(nodes[wide])
            nodes = np.concatenate([nodes[~wide], opened[bounds(q, opened) >= worst_of(q)]])
            inner = data.child_to[nodes] > data.child_from[nodes]
        if queries.child_from[q] < queries.child_to[q]:
            stack += [(c, nodes) for c in range(queries.child_from[q], queries.child_to[q])]
            continue
        while inner.any():
            opened = children(nodes[inner])
            nodes = np.concatenate([nodes[~inner], opened[bounds(q, opened) >= worst_of(q)]])
            inner = data.child_to[nodes] > data.child_from[nodes]
        leaf(q, nodes)
    if seen is not None:
        seen["scored"], seen["pairs"] = seen.get("scored", 0) + scored, seen.get("pairs", 0) + nq * len(data.ids)
    found = who < np.iinfo(np.int64).max
    found &= best > np.iinfo(np.int64).min
    return np.repeat(queries.ids, k)[found.reshape(-1)], who.reshape(-1)[found.reshape(-1)], best.reshape(-1)[found.reshape(-1)]


def integral(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as array<bigint>; null for vectors null or holding null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("bigint")))


def pivots(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """At most ``most`` (and PIVOTS) rows of (id, v) by length of vector, as doubles; which ones, a hash of the row decides."""
    some = vectors.select("v").orderBy(F.xxhash64("id", "v")).limit(min(most, PIVOTS)).toArrow().column("v").to_pylist()
    by_dim: dict[int, list] = {}
    for v in some:
        by_dim.setdefault(len(v), []).append(v)
    return {dim: np.array(rows, np.float64).reshape(len(rows), dim) for dim, rows in by_dim.items()}


def dealt(vectors: DataFrame, shared, block_rows: int, kind: str) -> DataFrame:
    """(id, v, dim, block): each row goes to its nearest pivot, and the rows of a pivot with more than ``block_rows`` are dealt further by a hash."""

    def nearest(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            out = np.zeros(len(dim), np.int64)
            for d in np.unique(dim).tolist():
                if (at := shared.value.get(d)) is not None and d:
                    rows = np.flatnonzero(dim == d)
                    x = batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
                    for a in range(0, len(rows), 1024):
                        out[rows[a : a + 1024]] = np.argmin((at**2).sum(axis=1) - 2 * (x[a : a + 1024] @ at.T), axis=1)
            yield pa.record_batch([*batch.columns, pa.array(out)], ["id", "v", "dim", "pivot"])

    rows = vectors.select("id", "v", F.size("v").alias("dim")).mapInArrow(tidy(nearest), "id bigint, v array<bigint>, dim int, pivot bigint")
    rows = written(rows, kind)
    parts = rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    block = F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("id", "v"), "parts")
    return rows.join(parts, ["dim", "pivot"]).select("id", "v", "dim", block.alias("block"))


def trees(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """A packed cover tree for each block of (id, v, dim, block): dim, block, tree (array<binary>), and centre (array<double>) and radius of its root."""

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        flat = pa.concat_arrays(group.column("v").chunks)
        dim = group.column("dim")[0].as_py()
        points = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
        tree = CoverTree(ids, np.ascontiguousarray(points), leaf=leaf)
        root = [tree.points[tree.centre[0]].astype(np.float64).tolist()]
        columns = [pa.array([tree.packed()], pa.list_(pa.binary())), pa.array(root, pa.list_(pa.float64())), pa.array([float(tree.radius[0])])]
        return pa.table([group.column("dim").slice(0, 1), group.column("block").slice(0, 1), *columns], ["dim", "block", "tree", "centre", "radius"])

    return rows.groupBy("dim", "block").applyInArrow(tidy_group(build), "dim int, block bigint, tree array<binary>, centre array<double>, radius double")


def block_pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Every pair of a query block and a data block: dim, probe, block, near (inner product of the roots' centres) and bound (of any two points).

    Only centres and radii meet, a copy of each query block for each of some buckets of data blocks.
    """
    salts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = index.select("dim", "block", F.col("centre").alias("c"), F.col("radius").alias("r"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    right = probes.select("dim", F.col("block").alias("probe"), F.col("centre").alias("pc"), F.col("radius").alias("pr"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))

    near = F.aggregate(F.zip_with("c", "pc", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    met = left.withColumn("n", norm(F.col("c"))).join(right.withColumn("pn", norm(F.col("pc"))), ["dim", "salt"]).withColumn("near", near)
    reach = F.col("pr") * F.col("n") + F.col("r") * F.col("pn") + F.col("r") * F.col("pr")
    return met.select("dim", "probe", "block", "near", (F.col("near") + reach + (F.abs("near") + reach) * 1e-9 + 1e-6).alias("bound"))


def _searched(pairs: DataFrame, index: DataFrame, probes: DataFrame, k: int, least: DataFrame | None) -> DataFrame:
    """query_id, vec_id and score over pairs (dim, probe, block); ``least`` has a list of scores for each query block, by its tree's order."""
    asked = probes.select("dim", F.col("block").alias("probe"), F.col("tree").alias("query"))
    asked = asked.withColumn("least", F.lit(None).cast("array<bigint>")) if least is None else asked.join(least, ["dim", "probe"])
    met = pairs.select("dim", "probe", "block").join(index.select("dim", "block", "tree"), ["dim", "block"]).join(asked, ["dim", "probe"])

    def search(pair: pa.Table) -> pa.Table:
        dim, low = pair.column("dim")[0].as_py(), pair.column("least")[0].as_py()
        query, tree = (CoverTree.unpacked(pair.column(c)[0].as_py(), dim) for c in ("query", "tree"))
        return pa.table(list(map(pa.array, dual_search(query, tree, k, None if low is None else np.array(low, np.int64)))), ["query_id", "vec_id", "score"])

    # A pair at a time, however many there are.
    return met.groupBy("dim", "probe", "block").applyInArrow(tidy_group(search), "query_id bigint, vec_id bigint, score bigint")


def top_k(data: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows of data with the largest inner product for each row of queries.

    Both have the columns ``vec_id`` and ``embedding``; components count as
    floor(scale * x). Rows with a query's own id are no candidates; ties go to the smaller
    id; a query with fewer candidates has them all. Vectors null or with null or
    non-finite components, and null ids, take no part; vectors of different
    lengths don't meet. Rows that repeat an id are candidates each; queries that repeat
    one are ranked together. An empty table gives an empty result; other columns are ignored. Blocks hold about ``block_rows``
    rows, however many rows are alike, so no task holds more than one block of
    either side. Scores are exact while they fit a long.
    """
    found, _, _ = search_blocks(data, queries, vec_id=vec_id, embedding=embedding, k=k, scale=scale, block_rows=block_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_blocks(data: DataFrame, queries: DataFrame, *, vec_id: str, embedding: str, k: int, scale: float, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """query_id, vec_id and score of the candidates of all searches, every pair of blocks, and those pairs that were searched."""
    spark = data.sparkSession
    own, asked = (df.select(F.col(vec_id).cast("bigint").alias("id"), integral(F.col(embedding), scale).alias("v")).where("id is not null and v is not null") for df in (data, queries))
    # Blocks of queries are smaller, as narrow ones prune more, but few: each is sent along with all data blocks that it can't rule out.
    built = []
    for kind, df, source, rows, leaf in (("trees", own, data, block_rows, LEAF), ("probes", asked, queries, max(1, block_rows // 8), GROUP)):
        blocks = max(1, -(-source.where(F.col(vec_id).isNotNull()).count() // rows))
        shared = spark.sparkContext.broadcast(pivots(df, blocks))
        built.append(written(trees(dealt(df, shared, rows, f"{kind}-rows"), leaf), kind))
    index, probes = built
    pairs = written(block_pairs(index, probes), "pairs")
    nearest = Window.partitionBy("dim", "probe").orderBy(F.desc("near"), "block")
    first = written(pairs.withColumn("place", F.row_number().over(nearest)).where("place = 1").drop("place"), "first")
    seeds = written(_searched(first, index, probes, k, None), "seeds")

    # The kth score of each query so far, by block of queries in its tree's order.
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reached = seeds.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k).select(F.col("query_id").alias("id"), "score")

    def ids(batches):
        for batch in batches:
            for dim, block, tree in zip(batch.column("dim"), batch.column("block"), batch.column("ids")):
                order = np.frombuffer(tree.as_py(), np.int64)
                yield pa.record_batch([pa.array([dim.as_py()] * len(order), pa.int32()), pa.array([block.as_py()] * len(order), pa.int64()), pa.array(np.arange(len(order))), pa.array(order)], ["dim", "probe", "place", "id"])

    rows = probes.select("dim", "block", F.element_at("tree", 1).alias("ids")).mapInArrow(tidy(ids), "dim int, probe bigint, place bigint, id bigint")
    score = F.coalesce("score", F.lit(np.iinfo(np.int64).min))
    least = rows.join(reached, "id", "left").groupBy("dim", "probe").agg(F.sort_array(F.collect_list(F.struct("place", score.alias("score")))).alias("rows"))
    least = written(least.select("dim", "probe", F.col("rows.score").alias("least"), F.array_min("rows.score").alias("worst")), "least")
    further = pairs.join(least.select("dim", "probe", "worst"), ["dim", "probe"]).where(F.col("bound") >= F.col("worst"))
    further = further.join(first, ["dim", "probe", "block"], "left_anti").select(*pairs.columns)
    further = written(further, "further")
    found = seeds.unionByName(_searched(further, index, probes, k, least.drop("worst")))
    return found, pairs, first.unionByName(further)
