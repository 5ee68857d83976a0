"""Exact n-gram Jaccard join: sets are grouped by what their prefixes share, and each group is joined in a prefix tree.

A document's set holds hashes of its distinct n-word shingles. The stages:

1. Sets. Equal sets become one vertex, so exact copies never multiply.
2. Order. Shingles of many sets come last in one global order (a bounded
   table of the commonest, found by counting in tasks first); the others go by hash.
3. Prefixes. By the prefix-filter lemma two sets x and y that reach the
   threshold share at least min(l(x), l(y)) of their first |x| - a(x) + l(x) shingles,
   a(x) being the overlap that x needs at least. Sets with too few shingles in
   their prefix that any other prefix has drop out.
4. Counts. Of the sets left, all shingles are counted exactly; sets drop out
   unless a(x) of their shingles are in other sets. Two rounds of this leave near copies and
   little else, and the last counts make the final order, rarest first.
   Groups. Sets that share a shingle of their plain prefixes in that order are connected; a
   linked pair always lies within one connected group.
5. Trees. Each group, or each pair of bounded blocks of a large one, is joined
   in a prefix tree of its ordered sets: sets share the overlaps of common
   beginnings, and subtrees that cannot reach the threshold are cut off by the
   lengths that remain. Subtrees already connected to the probing set are
   skipped, which loses no component and keeps groups of near copies linear.
   Where links are counted none is skipped: each pair of sets meets in one pair of
   blocks and is found there, and tasks pass on sums, a row a set.
6. The links found give the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy, tidy_group, written
from wharfline.llm.components import components
from wharfline.llm.text import _ROLE, as_long, mix, shingle_sets, steps, sums

#: Threshold as a fraction: linked if DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Share of a set beyond the plain prefix that prefixes are longer by (l).
EXTRA = 0.09
#: Shingles with a place of their own at the end of the order, at most.
COMMON = 1 << 17
#: Shingles that an exchange bucket is planned for.
BUCKET = 1 << 20
#: Sets and shingles of a block at most (a block holds one set at least).
BLOCK_SETS = 2000
BLOCK_SHINGLES = 1 << 20
STEP = 1 << 19
#: Shingles that a task counts at a time when it looks for common ones; eight arrays of that length are in memory then.
HELD = 3 << 20


def required(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of n needs with any partner: ceil(n * NUM / DEN)."""
    return -(-n * NUM // DEN)


def extra(n: np.ndarray) -> np.ndarray:
    """l: how many common prefix shingles a prefix is long enough for."""
    return (n * EXTRA).astype(np.int64) + 1


def least_shared(n: np.ndarray) -> np.ndarray:
    """What a set of n shares at least, in prefixes, with any partner: l of its smallest possible one."""
    return extra(required(n))


def set_key(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    return mix(sums(mix(values + _ROLE[20]), row) + np.diff(row).astype(np.uint64)), mix(sums(mix(values ^ _ROLE[21]), row) + _ROLE[22])


def document_sets(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, and the set's keys k1 and k2."""

    def run(batches):
        for batch in steps(batches, "text", STEP):
            values, row = shingle_sets(batch.column("text"), n)
            k1, k2 = set_key(values, row)
            yield pa.record_batch([batch.column("doc_id"), batch.column("t"), pa.array(np.diff(row)), as_long(k1), as_long(k2)], ["doc_id", "t", "n_shingles", "k1", "k2"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t")).mapInArrow(tidy(run), "doc_id bigint, t bigint, n_shingles bigint, k1 bigint, k2 bigint")


def _distinct(values: np.ndarray, row: np.ndarray, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and offsets of the non-empty sets of a step that the task hasn't had yet (as far as it remembers)."""
    k1, _ = set_key(values, row)
    size = np.diff(row)
    keep = []
    for i, k in enumerate(k1.tolist()):
        if size[i] and k not in seen:
            seen.add(k)
            keep.append(i)
    if len(seen) > 1 << 18:
        seen.clear()
    at = np.array(keep, np.int64)
    inside = np.repeat(row[at] - np.concatenate([[0], np.cumsum(size[at])[:-1]]) if len(at) else at, size[at]) + np.arange(size[at].sum())
    return k1[at], values[inside], np.concatenate([[0], np.cumsum(size[at])])


def common_shingles(docs: DataFrame, n: int, text: str, least: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON of the commonest shingles over all sets, ascending by hash, and the rank of each in the global order.

    Tasks count their own sets' shingles and pass on those they have at least
    twice; a shingle of many sets is missed in few tasks. The table only shapes the
    order, so a missed one costs time and never a link.
    """

    def run(batches):
        seen: set = set()
        held: list[np.ndarray] = []

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= 2
            keys, counts = keys[many], counts[many]
            for i in range(0, len(keys), 1 << 16):
                yield pa.record_batch([as_long(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], ["shingle", "c"])

        for batch in steps(batches, "text", STEP):
            held.append(_distinct(*shingle_sets(batch.column("text"), n), seen)[1])
            if sum(map(len, held)) > HELD:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "shingle bigint, c bigint").groupBy("shingle").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    counted = written(counted, "common")
    bound, total = least, 0
    for row in counted.groupBy(F.floor(F.log2("c") * 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("top")).orderBy(F.desc("kind")).collect():
        total += row["n"]
        if total > COMMON:
            bound = row["top"] + 1
            break
    table = counted.where(F.col("c") >= bound).toArrow()
    keys, counts = table.column("shingle").to_numpy().view(np.uint64), table.column("c").to_numpy()
    order = np.lexsort((keys, counts))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    by_key = np.argsort(keys)
    return keys[by_key], rank[by_key]


def ordered(values: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each shingle's place in the global order: its hash halved, or, if common, its rank after all of those."""
    rank = _rank(values, common)
    return np.where(rank >= 0, np.uint64(1 << 63) + rank.astype(np.uint64), values >> np.uint64(1))


def prefix_shares(docs: DataFrame, n: int, text: str, common, buckets: int, tasks: int) -> DataFrame:
    """shingle and set (k1) for each shingle that stands in the prefixes of two sets or more."""

    def emit(batches):
        seen: set = set()
        for batch in steps(batches, "text", STEP):
            keys, values, row = _distinct(*shingle_sets(batch.column("text"), n), seen)
            places, owner = [], []
            order = ordered(values, common.value)
            for i, (a, b) in enumerate(zip(row[:-1].tolist(), row[1:].tolist())):
                size = np.int64(b - a)
                length = int(size - required(size) + extra(size))
                places.append(np.sort(order[a:b])[:length])
                owner.append(np.full(len(places[-1]), i, np.uint32))
            if not places:
                continue
            place, who = np.concatenate(places), np.concatenate(owner)
            # A common shingle is shared for sure: it goes to a bucket of its set's own, so no bucket gets a hot one.
            hot = place >= np.uint64(1 << 63)
            own = -1 - (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            bucket = np.where(hot, own[who], ((place >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
            by = np.argsort(bucket, kind="stable")
            bucket, place, who = bucket[by], place[by], who[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                yield _share_rows(bucket[a], place[a:b], keys, who[a:b])

    def meet(group: pa.Table) -> pa.Table:
        place, who = _opened(group)
        by = np.lexsort((who, place))
        place, who = place[by], who[by]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (who[1:] != who[:-1])])
        place, who = place[new], who[new]
        if group.column("bucket")[0].as_py() >= 0:
            same = place[1:] == place[:-1]
            shared = np.zeros(len(place), bool)
            shared[1:] |= same
            shared[:-1] |= same
            place, who = place[shared], who[shared]
        return pa.table({"shingle": as_long(place), "set": as_long(who)})

    packed = docs.select(F.col(text).alias("text")).mapInArrow(tidy(emit), "bucket bigint, places binary, sets binary, owners binary")
    return packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(tidy_group(meet), "shingle bigint, set bigint")


def _share_rows(bucket: int, place: np.ndarray, keys: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
    """Places sorted by set, the sets' keys, and how many places each has (in pieces of at most 65,535)."""
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1])]))
    count = np.diff(np.append(first, len(who)))
    pieces = -(-count // 65535)
    last = count - (pieces - 1) * 65535
    sizes = np.full(pieces.sum(), 65535, np.uint16)
    sizes[np.cumsum(pieces) - 1] = last
    owners = np.repeat(keys[who[first]], pieces)
    return pa.record_batch([pa.array([int(bucket)]), *[pa.array([x.tobytes()], pa.binary()) for x in (place, owners, sizes)]], ["bucket", "places", "sets", "owners"])


class PrefixTree:
    """Sets of ordered numbers as a tree of runs: node i covers the sorted sets low[i] to high[i] (exclusive) and holds the run of numbers after its parent's."""

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: ascending int64 arrays, distinct, sorted as sequences."""
        self.sizes = np.array([len(s) for s in sets])
        shared = [0]
        for x, y in zip(sets, sets[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared.append(int(differ[0]) if len(differ) else m)
        # (depth, low, parent) of open nodes; a leaf per set and an inner node wherever runs part.
        nodes: list[list[int]] = []
        stack: list[int] = []

        def open_node(depth: int, low: int) -> int:
            nodes.append([depth, low, -1, -1])
            return len(nodes) - 1

        root = open_node(0, 0)
        stack.append(root)
        for i, s in enumerate(sets):
            d = shared[i]
            while nodes[stack[-1]][0] > d:
                child = stack.pop()
                nodes[child][2] = i
                if nodes[stack[-1]][0] < d:
                    stack.append(open_node(d, nodes[child][1]))
                nodes[child][3] = stack[-1]
            leaf = open_node(len(s), i)
            nodes[leaf][3] = stack[-1]
            stack.append(leaf)
        while stack:
            child = stack.pop()
            nodes[child][2] = len(sets)
            if stack:
                nodes[child][3] = stack[-1]
        table = np.array(nodes)
        depth, low, high, parent = table.T
        self.count = len(nodes)
        self.low, self.high, self.depth = low, high, depth
        start = np.where(parent >= 0, depth[parent], 0)
        runs = [sets[a][s:d] for a, s, d in zip(low.tolist(), start.tolist(), depth.tolist())]
        self.run_at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        self.runs = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.last = np.array([sets[a][d - 1] if d else -1 for a, d in zip(low.tolist(), depth.tolist())])
        by = np.argsort(parent, kind="stable")
        self.children = by[np.searchsorted(parent[by], 0) :]
        self.child_at = np.searchsorted(parent[self.children], np.arange(self.count + 1))
        self.smallest = np.array([self.sizes[a:b].min() for a, b in zip(low.tolist(), high.tolist())])
        self.largest = np.array([self.sizes[a:b].max() for a, b in zip(low.tolist(), high.tolist())])
        self.ends = np.full(self.count, -1)
        leaves = np.flatnonzero(depth == self.sizes[low])
        self.ends[leaves] = low[leaves]

    def probe(self, x: np.ndarray, present: np.ndarray, unlike: np.ndarray, after: int) -> np.ndarray:
        """The sets after number ``after`` that reach the threshold with x, out of those that ``unlike`` marks by a running count.

        Level by level, nodes carry the overlap of their path with x; a subtree goes on only if
        what is left of x and of its sets could still make up the threshold.
        """
        found = []
        frontier, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        size = len(x)
        while len(frontier):
            a, b = self.child_at[frontier], self.child_at[frontier + 1]
            count = b - a
            nodes = self.children[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]
            carried = np.repeat(overlap, count)
            ok = (self.high[nodes] > after + 1) & (unlike[self.high[nodes]] > unlike[np.maximum(self.low[nodes], after + 1)])
            ok &= (DEN * self.largest[nodes] >= NUM * size) & (DEN * size >= NUM * self.smallest[nodes])
            nodes, carried = nodes[ok], carried[ok]
            if not len(nodes):
                break
            s, e = self.run_at[nodes], self.run_at[nodes + 1]
            length = e - s
            total = np.concatenate([[0], np.cumsum(present[self.runs[np.repeat(s - np.cumsum(length) + length, length) + np.arange(length.sum())]])])
            cut = np.cumsum(length)
            carried = carried + total[cut] - total[cut - length]
            left = np.minimum(size - np.searchsorted(x, self.last[nodes], "right"), self.largest[nodes] - self.depth[nodes])
            # DEN * o >= NUM * (|x| + |y| - o)
            ok = (NUM + DEN) * (carried + left) >= NUM * (size + self.smallest[nodes])
            nodes, carried = nodes[ok], carried[ok]
            done = self.ends[nodes]
            full = (done > after) & ((NUM + DEN) * carried >= NUM * (size + self.sizes[done]))
            found.append(done[full])
            frontier, overlap = nodes, carried
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _grown(shingles: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[int], list[np.ndarray], PrefixTree, np.ndarray]:
    """The order in which the tree holds the given sets, the sets in that order, the tree, and zeros for its numbers."""
    kinds, first, inverse = np.unique(np.concatenate(shingles), return_index=True, return_inverse=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, np.concatenate(counts)[first]))] = np.arange(len(kinds))
    inverse = rank[inverse]
    ends = np.cumsum([len(p) for p in shingles])
    sets = [np.sort(inverse[e - len(p) : e]) for e, p in zip(ends, shingles)]
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    sets = [sets[i] for i in order]
    return order, sets, PrefixTree(sets), np.zeros(len(kinds), np.int64)


def tree_links(shingles: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links, as pairs of numbers of the given sets (distinct uint64 shingles and their counts over all sets), that connect all that any link connects."""
    order, sets, tree, present = _grown(shingles, counts)
    group = np.arange(len(sets))
    links = []
    for i, x in enumerate(sets):
        unlike = np.concatenate([[0], np.cumsum(group != group[i])])
        if unlike[-1] == unlike[i + 1]:
            continue
        present[x] = 1
        for j in tree.probe(x, present, unlike, i).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((order[i], order[j]))
        present[x] = 0
    return links


def counted_links(shingles: list[np.ndarray], counts: list[np.ndarray], rows: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Over all links of the given sets, how many rows each set is linked to, and links that connect all that any link connects.

    ``rows`` says how many rows have each set. With ``side`` only links between sets of different sides are taken.
    """
    order, sets, tree, present = _grown(shingles, counts)
    rows = rows[order]
    side = np.zeros(len(sets), np.int64) if side is None else side[order] + 1
    partners = {s: np.concatenate([[0], np.cumsum(side != s if s else side == s)]) for s in np.unique(side).tolist()}
    group = np.arange(len(sets))
    total, links = np.zeros(len(sets), np.int64), []
    for i, x in enumerate(sets):
        present[x] = 1
        found = tree.probe(x, present, partners[int(side[i])], i)
        if side[i]:
            found = found[side[found] != side[i]]
        present[x] = 0
        total[i] += rows[found].sum()
        total[found] += rows[i]
        for j in found.tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                links.append((order[i], order[j]))
    out = np.empty_like(total)
    out[order] = total
    return out, links


def join_counted(sets: DataFrame) -> DataFrame:
    """a, b and n: connecting links between sets (k1) of each key, and rows without b that say how many rows a is linked to; sets: key, block, k1, rows, shingles and counts (binary)."""

    def join(group: pa.Table) -> pa.Table:
        at = np.unique(group.column("k1").to_numpy(), return_index=True)[1]
        group = group.take(pa.array(at))
        ids = group.column("k1").to_pylist()
        _, low, high = group.column("key")[0].as_py().rsplit(":", 2)
        shingles, counts = ([np.frombuffer(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("shingles", np.uint64), ("counts", np.uint16)))
        # Sets of one block meet each other under the key of that block alone.
        side = group.column("block").to_numpy().astype(np.int64) if low != high else None
        total, links = counted_links(shingles, counts, group.column("rows").to_numpy(), side)
        some = np.flatnonzero(total).tolist()
        a = [ids[i] for i in some] + [ids[i] for i, _ in links]
        b = [None] * len(some) + [ids[j] for _, j in links]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(total[some].tolist() + [0] * len(links), pa.int64())})

    return sets.groupBy("key").applyInArrow(join, "a bigint, b bigint, n bigint")


def join_groups(sets: DataFrame) -> DataFrame:
    """a and b: connecting links between sets (k1) of each key; sets: key, k1, shingles and counts (binary)."""

    def join(group: pa.Table) -> pa.Table:
        first = {k: (x, c) for k, x, c in zip(group.column("k1").to_pylist(), group.column("shingles").to_pylist(), group.column("counts").to_pylist())}
        ids = list(first)
        links = tree_links([np.frombuffer(x, np.uint64) for x, _ in first.values()], [np.frombuffer(c, np.uint16) for _, c in first.values()]) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return sets.groupBy("key").applyInArrow(join, "a bigint, b bigint")


#: Counts from here on stand for the ranks of common shingles, which need no counting.
RANKED = 1 << 15


def counted_sets(members: DataFrame, common, buckets: int, tasks: int) -> DataFrame:
    """k1, shingles and counts (binary, uint16) of the sets of members (k1, shingles) of which enough shingles are in other sets.

    Sets and shingles are dealt to as many buckets each, by hash. Tasks send each bucket of shingles its part
    as packed arrays, and that sends each bucket of sets one packed row with the counts, so rows number the
    square of the buckets or the shingles, whichever is less. A common shingle's count is its rank,
    known to all: it goes to a bucket of its set's own, so no bucket of shingles holds a hot one.
    """

    def home(keys: np.ndarray) -> np.ndarray:
        """The bucket of each set or shingle; it ascends with the key."""
        return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("k1").to_numpy().view(np.uint64)
            parts = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            shingle, who = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x) for x in parts])
            bucket = np.where(_rank(shingle, common.value) >= 0, -1 - home(keys)[who], home(shingle))
            by = np.argsort(bucket, kind="stable")
            bucket, shingle, who = bucket[by], shingle[by], who[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(cut[:-1], cut[1:]):
                yield _share_rows(int(bucket[a]), shingle[a:b], keys, who[a:b])

    def count(group: pa.Table) -> pa.Table:
        shingle, who = _opened(group)
        if group.column("bucket")[0].as_py() >= 0:
            _, back, n = np.unique(shingle, return_inverse=True, return_counts=True)
            n = np.minimum(n, RANKED - 1)[back]
        else:
            keys, rank = common.value
            n = RANKED + _rank(shingle, common.value) * (RANKED - 1) // max(1, len(rank))
        by = np.argsort(who, kind="stable")
        shingle, n = shingle[by], n[by].astype(np.uint16)
        keys, who = np.unique(who[by], return_inverse=True)
        to = home(keys)[who]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])).tolist()
        rows = [_share_rows(to[a], shingle[a:b], keys, who[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_batches(rows).combine_chunks().append_column("counts", pa.array([n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()))

    def gather(group: pa.Table) -> pa.Table:
        shingle, who = _opened(group)
        n = np.concatenate([np.frombuffer(c.as_py(), np.uint16) for c in group.column("counts")])
        by = np.argsort(who, kind="stable")
        shingle, who, n = shingle[by], who[by], n[by]
        cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        enough = sums((n >= 2).astype(np.int64), cut) >= required(np.diff(cut))
        low, high = cut[:-1][enough].tolist(), cut[1:][enough].tolist()
        return pa.table({"k1": as_long(who[low]), "shingles": pa.array([shingle[a:b].tobytes() for a, b in zip(low, high)], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in zip(low, high)], pa.binary())})

    kind = "bucket bigint, places binary, sets binary, owners binary"
    packed = members.select("k1", "shingles").mapInArrow(tidy(emit), kind)
    counts = packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(tidy_group(count), f"{kind}, counts binary")
    return counts.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(tidy_group(gather), "k1 bigint, shingles binary, counts binary")


def _rank(shingle: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rank of each common shingle, -1 for others."""
    keys, rank = common
    if not len(keys):
        return np.full(len(shingle), -1)
    at = np.searchsorted(keys, shingle)
    at[at == len(keys)] = 0
    return np.where(keys[at] == shingle, rank[at], -1)


def _opened(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and sets of packed rows."""
    places, sets = [], []
    for p, k, w in zip(group.column("places"), group.column("sets"), group.column("owners")):
        places.append(np.frombuffer(p.as_py(), np.uint64))
        sets.append(np.repeat(np.frombuffer(k.as_py(), np.uint64), np.frombuffer(w.as_py(), np.uint16)))
    return np.concatenate(places), np.concatenate(sets)


def plain_prefixes(sets: DataFrame) -> DataFrame:
    """shingle and set (k1) for the shared shingles of each set's plain prefix in the order of counts, rarest first."""

    def run(batches):
        for batch in batches:
            out, who = [], []
            for k, x, c in zip(batch.column("k1").to_pylist(), batch.column("shingles").to_pylist(), batch.column("counts").to_pylist()):
                shingle, count = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint16)
                n = np.int64(len(shingle))
                first = np.lexsort((shingle, count))[: n - required(n) + 1]
                out.append(shingle[first][count[first] >= 2])
                who.append(np.full(len(out[-1]), k))
            if out:
                yield pa.record_batch([as_long(np.concatenate(out)), pa.array(np.concatenate(who))], ["shingle", "set"])

    return sets.mapInArrow(tidy(run), "shingle bigint, set bigint")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable over links, for every row of docs.

    Words are lower-cased (A-Z); a text of fewer than n words is one shingle.
    Null and empty texts and texts without words have 0 shingles and their own id as
    component. Rows that repeat an id or a text keep a row each; rows of a null id
    link like any other and get the smallest id of their component, null if it has none. Long texts are
    taken whole. An empty table gives an empty table; other columns are ignored. Shingles and sets are compared by 64-bit hashes.
    """
    return _joined(docs, doc_id, text, n, counting=False).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def jaccard_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """The rows of ``jaccard_components`` with n_links, the number of other rows whose sets reach the threshold with the row's own.

    All links count: those between different texts, once for each row that has the
    other text, and those to rows of the same set. Rows of 0 shingles have no links. Finding all links of a group of near
    copies takes time in proportion to their number; what tasks pass on is a row a set and pair of blocks.
    """
    return _joined(docs, doc_id, text, n, counting=True).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


#: Sets of large groups are dealt by classes of size; linked ones, whose sizes differ by a factor of 4/3 at most, lie in one class or two neighbouring ones.
CLASS = float(np.log(DEN / NUM * 1.005))


def routes(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """k1, block and key for each task that a set goes to; groups: node and root; sizes: k1 and n.

    A group within BLOCK_SETS and BLOCK_SHINGLES is one block. A larger one is dealt into blocks by class of size and hash; each block meets
    itself and the blocks of its own and the neighbouring classes, a pair of blocks under one key.
    """
    sized = groups.join(sizes.select(F.col("k1").alias("node"), "n"), "node").withColumn("class", F.floor(F.log("n") / CLASS))
    per = sized.groupBy("root", "class").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    whole = (F.sum("sets") <= BLOCK_SETS) & (F.sum("total") <= BLOCK_SHINGLES)
    shape = per.groupBy("root").agg(F.collect_list(F.struct("class", blocks)).alias("classes"), whole.alias("whole"))
    placed = sized.join(shape, "root")
    own = F.expr("filter(classes, c -> c.class = class)[0].blocks")
    block = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("class") * (1 << 31) + F.pmod(F.xxhash64("node"), own))
    others = F.expr(f"flatten(transform(filter(classes, c -> abs(c.class - class) <= 1), c -> transform(sequence(0L, c.blocks - 1), b -> c.class * {1 << 31}L + b)))")
    met = placed.select(F.col("node").alias("k1"), "root", block.alias("block"), F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("other"))
    key = F.concat_ws(":", F.col("root").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return met.select("k1", "block", key.alias("key"))


def _joined(docs: DataFrame, doc_id: str, text: str, n: int, counting: bool) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, root (of its component of sets, null for 0 shingles), component and, counting, n_links of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sets = written(document_sets(base, n, "doc_id", "text"), "sets")
    vertices = sets.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("vertex"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    total = vertices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-int(total * 0.4) // BUCKET))
    common = spark.sparkContext.broadcast(common_shingles(base, n, "text"))
    shares = written(prefix_shares(base, n, "text", common, buckets, max(width, min(buckets, 16 * width))), "shares")

    # Sets with enough shared prefix shingles, once more whole.
    size = F.col("n")
    enough = F.floor(F.ceil(size * NUM / DEN) * EXTRA) + 1
    counted = shares.groupBy("set").agg(F.count(F.lit(1)).alias("c"))
    live = counted.join(vertices.groupBy(F.col("k1").alias("set")).agg(F.min("n").alias("n"), F.min("vertex").alias("vertex"), F.sum("rows").alias("rows")), "set").where(F.col("c") >= enough)
    live = written(live.select(F.col("set").alias("k1"), F.col("vertex").alias("doc_id"), "n", "rows"), "live")

    def whole(batches):
        for batch in steps(batches, "text", STEP):
            values, row = shingle_sets(batch.column("text"), n)
            k1, _ = set_key(values, row)
            body = [values[a:b].tobytes() for a, b in zip(row[:-1].tolist(), row[1:].tolist())]
            yield pa.record_batch([as_long(k1), pa.array(body, pa.binary())], ["k1", "shingles"])

    # A set that only rows of a null id have is found among those.
    asked = _only(base, live.select("doc_id").where("doc_id is not null").distinct()).select("text").unionByName(base.where("doc_id is null").select("text"))
    found = asked.mapInArrow(tidy(whole), "k1 bigint, shingles binary")
    members = written(found.join(live.select("k1"), "k1", "left_semi").dropDuplicates(["k1"]), "members")
    for _ in range(2):
        left = members.agg(F.coalesce(F.sum(F.length("shingles") / 8), F.lit(0))).first()[0]
        parts = max(1, -(-int(left) // BUCKET))
        members = written(counted_sets(members, common, parts, max(width, min(parts, 16 * width))), "members")

    # Groups of sets whose plain prefixes meet; each set goes to its group, or to pairs of its group's blocks.
    kept = written(plain_prefixes(members), "prefixes")
    star = kept.groupBy("shingle").agg(F.min("set").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    pairs = kept.join(star, "shingle").select("set", "low").where("set <> low").distinct()
    routed = routes(written(components(pairs, "set", "low"), "groups"), live)
    if counting:
        met = written(join_counted(members.join(routed, "k1").join(live.select("k1", "rows"), "k1")), "links")
        links = met.where("b is not null").select("a", "b")
        others = met.where("b is null").groupBy(F.col("a").alias("k1")).agg(F.sum("n").alias("n_links"))
    else:
        links = join_groups(members.join(routed.drop("block"), "k1"))
    roots = written(components(links, "a", "b"), "roots")
    named = vertices.groupBy(F.col("k1").alias("node")).agg(F.min("vertex").alias("vertex"))
    lowest = roots.join(named, "node").groupBy("root").agg(F.min("vertex").alias("component"))
    told = roots.join(lowest, "root").withColumnRenamed("node", "k1")
    labelled = vertices.join(told, "k1", "left").select("k1", "k2", "rows", F.coalesce("root", "k1").alias("root"), F.coalesce("component", "vertex").alias("component"))
    none = sets.where("n_shingles = 0").withColumns({"root": F.lit(None).cast("long"), "component": F.col("doc_id")})
    columns = ["doc_id", "t", "n_shingles", "root", "component"]
    if counting:
        labelled = labelled.join(others, "k1", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1)
        columns.append("n_links")
        none = none.withColumn("n_links", F.lit(0).cast("long"))
    return sets.where("n_shingles > 0").join(labelled, ["k1", "k2"]).select(*columns).unionByName(none.select(*columns))


def representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """The rows of docs without near copies.

    Of each component one row stays: that of the smallest id, null last, and the smallest hash of its text,
    one of those equal in both. Rows of one id and different texts are judged each by its
    text. Rows of 0 shingles link with nothing and stay all. Other columns stay, whatever their names.
    """
    found = written(_joined(docs, doc_id, text, n, counting=False).where("root is not null").select("doc_id", "t", "root"), "classes")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")).alias("first"))
    judged = found.join(first, "root").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("rows"), F.first(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))).alias("stays"))
    some = written(judged.where("not stays or rows > 1"), "judged")
    i, t = fresh("id"), fresh("text")

    def named(part: DataFrame) -> DataFrame:
        return part.select(F.col("doc_id").alias(i), F.col("t").alias(t))

    def same(right: DataFrame):
        return F.col(doc_id).eqNullSafe(right[i]) & (F.xxhash64(F.col(text)) == right[t])

    all_, twice = named(some), named(some.where("stays"))
    repeated = docs.join(twice, same(twice)).dropDuplicates([i, t]).drop(i, t)
    return docs.join(all_, same(all_), "left_anti").unionByName(repeated)


#: Bits of the filter that keeps rows without a chance out of a join's shuffle.
SIEVE_BITS = 1 << 24


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids``. A bitmap of fixed size, made of the ids' hashes, drops most others before the join."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    words = ids.select(F.floor(place / 64).alias("word"), (place % 64).cast("int").alias("at")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).toArrow()
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sieve = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = (sieve.value[at >> 6] >> (at & 63)) & 1 == 1
            yield batch.filter(pa.array(hit)).select(["doc_id", "text"])

    some = docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(tidy(run), docs.select("doc_id", "text").schema)
    return some.join(ids, "doc_id", "left_semi")
