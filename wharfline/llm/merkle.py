"""Merkle manifest of a dataset: a tree of digests for each source, a tree over their roots, and a proof for each row.

Rows are put in order by ranges, so consecutive ones lie in one task. There,
partial parents gather the digests of their children; a parent whose run is full is
digested and becomes a child of the next level at once. What is left open at
the borders of tasks, and each source's last run of a level, whose length follows from
the number of its rows, is combined by key in further, small rounds. Every parent keeps
its children, and these links are followed from the root down to build the proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import partitions, shared_folder, tidy, written

ARITY = 16
DIGEST = 32
NODE = "tree string, level int, place bigint, slots array<int>, run binary, ids array<bigint>, names array<string>, altered array<binary>, digest binary"
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("slots", pa.list_(pa.int32())), ("run", pa.binary()), ("ids", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("altered", pa.list_(pa.binary())), ("digest", pa.binary())])
#: Rows of a batch that a task hands on.
BATCH = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values one after the other, each as its bytes in UTF-8, a colon and the value, or - if null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_key(name: Column) -> Column:
    """A text that is never null and sorts as null first, then by the bytes of the name."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("-"))


def levels_of(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves; 0 for one leaf."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pow(F.lit(float(ARITY)), k) < size))


def in_order(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves (tree, id, name, leaf, altered) with each one's ``place`` in its tree, by id, name and digest, and the size of each tree.

    Ranges of the order are numbered on their own; only the first tree of a range can
    have begun in an earlier one, so what is added to the numbers is a table of a row a range at most.
    """
    order = ["tree", "id", "name", "leaf", "_tie"]
    # Rows alike in all else are kept apart by where they are stored, so a range never has to hold all copies of a row.
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.select("tree", "id", "name", "leaf", "altered", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            local = []
            for tree in batch.column(0).to_pylist():
                count = count + 1 if tree == last else 0
                last = tree
                local.append(count)
            yield pa.record_batch([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "local"])

    rows = written(ranged.mapInArrow(tidy(number), "tree string, id bigint, name string, leaf binary, altered binary, part int, local bigint"), "merkle-rows")
    counts = rows.groupBy("part", "tree").agg((F.max("local") + 1).alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "merkle-counts")
    shifts = counts.where("before > 0").select("part", "tree", "before")
    placed = rows.join(F.broadcast(shifts), ["part", "tree"], "left").withColumn("place", F.col("local") + F.coalesce("before", F.lit(0)))
    return placed.select("tree", "place", "id", "name", "leaf", "altered"), counts.groupBy("tree").agg(F.sum("n").alias("size"))


class _Open:
    """Partial parents of a task by (level, place): slots taken and what lies in them."""

    def __init__(self):
        self.partial: dict[tuple[str, int, int], dict[int, tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, tree: str, level: int, place: int, slot: int, child: tuple, size: int | None) -> None:
        """A child for a parent; parents whose runs are full are digested, and so on upwards. Without a size only runs of ARITY are known to be full."""
        while True:
            key = (tree, level, place)
            run = self.partial.setdefault(key, {})
            run[slot] = child
            width = -(-size // ARITY ** (level - 1)) if size else None
            if width == 1:
                # The child was the root: no parent, but a single leaf still is its tree.
                del self.partial[key]
                if level == 1:
                    self.rows.append((tree, 0, 0, *self._columns({0: child}), child[0]))
                return
            if len(run) < (ARITY if width is None else min(ARITY, width - ARITY * place)):
                return
            del self.partial[key]
            columns = self._columns(run)
            digest = hashlib.sha256(columns[1].hex().encode()).digest()
            self.rows.append((tree, level, place, *columns, digest))
            child, slot, level, place = (digest, None, None, None), place % ARITY, level + 1, place // ARITY

    @staticmethod
    def _columns(run: dict[int, tuple]) -> tuple:
        slots = sorted(run)
        digests, ids, names, altered = zip(*(run[s] for s in slots))
        return slots, b"".join(digests), list(ids), list(names), list(altered)

    def flush(self, but: str | None = None) -> None:
        """What is open of all trees (but one) goes out as it is."""
        for key in [k for k in self.partial if k[0] != but]:
            self.rows.append((*key, *self._columns(self.partial.pop(key)), None))

    def out(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODE)], schema=_NODE)


def _from_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, last = _Open(), None
    for batch in batches:
        for tree, place, *child in zip(*(batch.column(c).to_pylist() for c in ("tree", "place", "leaf", "id", "name", "altered"))):
            if tree != last:
                held.flush()
                last = tree
            held.add(tree, 1, place // ARITY, place % ARITY, tuple(child), None)
        if len(held.rows) >= BATCH:
            yield held.out()
    held.flush()
    if held.rows:
        yield held.out()


def _from_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, last = _Open(), None
    for batch in batches:
        for tree, level, place, slots, run, ids, names, altered, size in zip(*(batch.column(c).to_pylist() for c in (*_NODE.names[:-1], "size"))):
            if tree != last:
                held.flush()
                last = tree
            for i, slot in enumerate(slots):
                held.add(tree, level, place, slot, (run[DIGEST * i : DIGEST * (i + 1)], ids[i], names[i], altered[i]), size)
        if len(held.rows) >= BATCH:
            yield held.out()
    held.flush()
    if held.rows:
        yield held.out()


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trees over leaves (tree, id, name, leaf, altered), and ``tree``, ``size`` and ``digest`` (its root) of each tree.

    A node has its level (1 above the leaves; 0 for a tree's only leaf), its place, and
    its children's digests end to end (``run``); nodes next to leaves have those leaves' columns. Each round completes all lowest open
    parents at least, so there are no more rounds than levels.
    """
    spark = leaves.sparkSession
    placed, sizes = in_order(leaves)
    sizes = written(sizes, "merkle-sizes")
    folder, rounds = shared_folder(spark, "merkle-nodes"), []

    def complete(rows: DataFrame) -> DataFrame:
        """Writes a round's nodes and gives back those that are open."""
        rounds.append(f"{folder}/{len(rounds)}")
        rows.write.option("compression", "zstd").parquet(rounds[-1])
        return spark.read.schema(NODE).parquet(rounds[-1]).where("digest is null")

    left = complete(placed.mapInArrow(tidy(_from_leaves), NODE))
    while not left.isEmpty():
        # Open parents are few: one a level at each border of a task, and one a level and tree.
        dealt = left.join(sizes, "tree").repartition(partitions(spark), "tree", "level", "place").sortWithinPartitions("tree", "level", "place")
        left = complete(dealt.mapInArrow(tidy(_from_open), NODE))
    # One scan over all rounds, not one a round in every plan.
    nodes = spark.read.schema(NODE).parquet(*rounds).where("digest is not null")
    roots = nodes.where("place = 0").join(sizes, "tree").where(F.col("level") == levels_of(F.col("size")))
    return nodes, written(roots.select("tree", "size", "level", "digest"), "merkle-roots")


def _siblings(run: Column, slot: Column) -> Column:
    """The digests left and right of a slot."""
    end = F.octet_length(run)
    return F.struct(F.substring(run, F.lit(1), slot * DIGEST).alias("left"), F.substring(run, slot * DIGEST + DIGEST + 1, end).alias("right"))


def proofs(nodes: DataFrame, roots: DataFrame, above: DataFrame) -> DataFrame:
    """tree, id, name, leaf, altered and path of each leaf: siblings left and right, from its own level up; ``above`` has a path from each tree's root on."""
    top = roots.agg(F.max("level")).first()[0] or 0
    carried = roots.join(above, "tree").select("tree", "level", F.lit(0).cast("bigint").alias("place"), "path")
    for level in range(top, 1, -1):
        here = nodes.where(F.col("level") == level).select("tree", "place", "run").join(carried.where(F.col("level") == level).select("tree", "place", "path"), ["tree", "place"])
        slots = F.sequence(F.lit(0), (F.octet_length("run") / DIGEST).cast("int") - 1)
        down = here.select("tree", "place", "run", "path", F.explode(slots).alias("slot"))
        down = down.select("tree", F.lit(level - 1).alias("level"), (F.col("place") * ARITY + F.col("slot")).alias("place"), F.concat(F.array(_siblings(F.col("run"), F.col("slot"))), "path").alias("path"))
        carried = carried.where(F.col("level") < level).unionByName(down)
    lowest = nodes.where("level <= 1").join(carried, ["tree", "level", "place"])
    each = lowest.select("tree", "level", "run", "path", F.posexplode(F.arrays_zip("ids", "names", "altered")).alias("slot", "row"))
    leaf = F.substring(F.col("run"), F.col("slot") * DIGEST + 1, F.lit(DIGEST))
    path = F.when(F.col("level") == 0, F.col("path")).otherwise(F.concat(F.array(_siblings(F.col("run"), F.col("slot"))), "path"))
    return each.select("tree", F.col("row.ids").alias("id"), F.col("row.names").alias("name"), leaf.alias("leaf"), F.col("row.altered").alias("altered"), path.alias("path"))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["left"]), _hex(p["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (binary) and the siblings of its path lead to, in hexadecimal."""
    return F.aggregate(path, _hex(leaf), lambda acc, p: F.sha2(F.concat(_hex(p["left"]), acc, _hex(p["right"])), 256))


def manifest(rows: DataFrame, *, key: str, group: str, fields: list[str], altered: dict[str, Column] | None = None) -> tuple[DataFrame, str | None]:
    """``key``, leaf, subroot, root (in hexadecimal), path and altered_leaf of each row, and the root of all.

    A leaf digests ``fields`` in order. Leaves of a group ascend by the key (bigint; null
    first), equal keys by digest; every 16 consecutive nodes make a parent while more than one
    is left. Groups, null first, then by bytes, make the last tree of their roots. ``altered`` gives
    other values for some fields, whose leaf is altered_leaf; null where nothing changes. Repeated rows are leaves each. Nulls in any field
    differ from empty values. An empty table has no rows and the root None; other columns are ignored. Long texts are hashed whole, once
    (twice where altered). A group of any size is spread over tasks by ranges of its order.
    """
    own = leaf_digest(*[F.col(f) for f in fields])
    other = leaf_digest(*[(altered or {}).get(f, F.col(f)) for f in fields]) if altered else F.lit(None).cast("binary")
    leaves = rows.select(tree_key(F.col(group)).alias("tree"), F.col(key).cast("bigint").alias("id"), F.lit(None).cast("string").alias("name"), own.alias("leaf"), other.alias("altered"))
    leaves = written(leaves.withColumn("altered", F.when(F.col("altered") != F.col("leaf"), F.col("altered"))), "merkle-leaves")
    nodes, roots = forest(leaves)
    tops = roots.select(F.lit("").alias("tree"), F.lit(None).cast("bigint").alias("id"), F.col("tree").alias("name"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("altered"))
    upper, whole = forest(tops)
    last = whole.first()
    root = None if last is None else bytes(last["digest"]).hex()
    above = whole.select("tree", F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path"))
    paths = proofs(upper, whole, above).select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot"))
    paths = written(paths, "merkle-paths")
    found = proofs(nodes, roots, paths.select("tree", "path")).join(paths.select("tree", "subroot"), "tree")
    return found.select(F.col("id").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "path", F.col("altered").alias("altered_leaf")), root


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def checked(found: DataFrame) -> DataFrame:
    """The key, leaf, subroot and root in hexadecimal, proof_sha256, folded_root (from the altered leaf, else the leaf, and the siblings of its path) and verified (whether that is the root)."""
    back = folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    found = found.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", back).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.withColumns({c: _hex(F.col(c)) for c in ("leaf", "subroot")}).drop("path", "altered_leaf")
