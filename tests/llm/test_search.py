import numpy as np
from conftest import DATA

from wharfline.llm import covertree, queries


def test_query_is_the_sql(spark, same_as_sql):
    same_as_sql(queries.queries()["op1_cover_tree_topk"](spark, DATA), queries.oracle_sql()["op1_cover_tree_topk"])


def brute(ids, points, i, k):
    scores = points @ points[i]
    return sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist()) if j != ids[i])[:k]


def test_dual_search_is_exact():
    rng = np.random.default_rng(0)
    for dim, n, nq, scale in ((3, 1500, 100, 50), (8, 2000, 200, 100), (64, 300, 30, 40), (0, 20, 5, 1), (2, 400, 50, 2), (4, 600, 60, 1 << 28)):
        points = np.floor(rng.normal(size=(n, dim)) * scale).astype(np.int64)
        ids = rng.permutation(n * 2)[:n].astype(np.int64)
        data, asked = covertree.CoverTree(ids, points), covertree.CoverTree(ids[:nq], points[:nq])
        got = {}
        for q, d, s in zip(*covertree.dual_search(covertree.CoverTree.unpacked(asked.packed(), dim), covertree.CoverTree.unpacked(data.packed(), dim), 5)):
            got.setdefault(q, []).append((-s, d))
        for i in range(nq):
            assert sorted(got[ids[i]]) == brute(ids, points, i, 5)


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(900, 3)) * 100).astype(np.int64)
    tree = covertree.CoverTree(np.arange(900), points)
    assert sorted(tree.ids) == list(range(900)) and len(tree.radius) > 10
    for i in range(len(tree.radius)):
        inside = tree.points[tree.row_from[i] : tree.row_to[i]]
        assert (np.sqrt(((inside - tree.points[tree.centre[i]]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-9).all()
        a, b = tree.child_from[i], tree.child_to[i]
        assert a == b or tree.row_to[b - 1] == tree.row_to[i] and tree.centre[a] == tree.centre[i]


def test_trees_part_the_embeddings():
    import pyarrow.parquet as pq

    vectors = [v for v in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist() if v is not None and len(v) == 64]
    points = np.floor(256 * np.array(vectors[:2000])).astype(np.int64)
    tree = covertree.CoverTree(np.arange(len(points)), points)
    assert len(tree.radius) > 50
    rng = np.random.default_rng(4)
    near = (rng.normal(size=(40, 64))[rng.integers(0, 40, 2000)] * 100 + rng.normal(size=(2000, 64))).astype(np.int64)
    seen = {}
    covertree.dual_search(covertree.CoverTree(np.arange(100), near[:100], leaf=covertree.GROUP), covertree.CoverTree(np.arange(2000), near), 5, None, seen)
    assert seen["pairs"] == 200_000 and seen["scored"] < 100_000


def test_block_pairs_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 40
    points = np.round(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    found, pairs, searched = covertree.search_blocks(df, asked, vec_id="vec_id", embedding="embedding", k=5, scale=1.0, block_rows=100)
    assert 0 < searched.count() < pairs.count() and searched.count() == searched.distinct().count()
    got = {}
    for r in covertree.top_k(df, asked, k=5, scale=1.0, block_rows=100).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    ids, whole = np.arange(1500), points.astype(np.int64)
    assert got and all(sorted(got[i]) == brute(ids, whole, i, 5) for i in range(0, 1500, 20))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [1.0, 0.0], 2), (2, [0.5, float("nan")], 0), (3, None, 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [2.0], 0), (6, [-1.0, 0.0], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    for block in (2, 4096):
        got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id in (0, 1, 5)"), k=2, scale=2.0, block_rows=block).collect()))
        assert got == [(0, 1, 1, 4), (0, 2, 1, 4), (1, 1, 0, 4), (1, 2, 0, 4)]
    assert covertree.top_k(df.limit(0), df.limit(0)).count() == 0
