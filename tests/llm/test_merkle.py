import hashlib
import zlib
from collections import defaultdict

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wharfline.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def up(nodes):
    """The root and, for each node, its path of (left, right) siblings."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, i in zip(paths, where):
            run = i - i % 16
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        level, where = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [i // 16 for i in where]
    return level[0], paths


def fold(leaf, path):
    for left, right in path:
        leaf = h(left, leaf, right)
    return leaf


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    trees = {}
    for source, members in groups.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[source] = (members, *up([leaf_of(r) for r in members]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = up([trees[s][1] for s in order])
    out = []
    for source, upper in zip(order, above):
        members, subroot, paths = trees[source]
        for r, path in zip(members, paths):
            path = path + upper
            other = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                other["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
            back = fold(leaf_of(other), path)
            out.append((r["doc_id"], leaf_of(r), subroot, root, h(*(x + y for x, y in path)), back, back == root))
    return sorted(map(repr, out))


def result(spark, folder):
    return sorted(repr(tuple(r)) for r in queries.queries()["op13_merkle_manifest"](spark, folder).collect())


def test_query_is_the_sql(spark, same_as_sql):
    same_as_sql(queries.queries()["op13_merkle_manifest"](spark, DATA), queries.oracle_sql()["op13_merkle_manifest"])


def test_query_is_the_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = result(spark, DATA)
    assert got == brute(rows) and {r[-6:-1] for r in got} == {" True", "False"}


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert result(spark, f"{tmp_path}/odd") == brute([r.asDict() for r in odd_docs.collect()])
    assert result(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 256, "": 257}, {"a": 5000, **{f"s{i}": 1 + i % 3 for i in range(300)}}])
def test_sizes_of_trees(spark, sizes, tmp_path):
    rows = [(i * 7 % 10007 + 20000 * k, s, "en", None if i % 5 == 0 else i, f"Text {i}") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert result(spark, str(tmp_path)) == brute([r.asDict() for r in df.collect()])


def test_ranges_of_copies(spark):
    """Rows alike in every column are leaves each, in places of their own."""
    df = spark.createDataFrame([(1, "a", "en", 1, "x")] * 400, "doc_id long, source string, lang string, n_chars long, text string")
    found, root = merkle.manifest(df, key="doc_id", group="source", fields=FIELDS)
    got = merkle.checked(found)
    assert got.count() == 400 and got.where("not verified").isEmpty() and got.select("proof_sha256").distinct().count() > 1
    assert root == up([leaf_of(df.first().asDict())] * 400)[0]
    nodes, _ = merkle.forest(df.select(F.lit("=a").alias("tree"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("name"), F.unhex(F.sha2("text", 256)).alias("leaf"), F.lit(None).cast("binary").alias("altered")))
    assert nodes.groupBy("level").count().orderBy("level").collect() == [(1, 25), (2, 2), (3, 1)]
