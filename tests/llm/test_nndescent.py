import numpy as np
import pytest
from conftest import DATA

from wharfline.llm import nndescent, queries

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS score
  FROM v AS q, v AS d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 20
"""


def test_one_block_is_exact(spark, same_as_sql):
    same_as_sql(queries.queries()["op11_nn_descent"](spark, DATA).selectExpr("query_id", "rank", "vec_id", "round(score, 9) AS score"), SQL)


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items()}


def brute(ids, x, q, k):
    scores = x @ x[list(ids).index(q)]
    return sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != q)[:k]


@pytest.mark.parametrize("seed, lengths", [(0, False), (1, True)])
def test_recall_over_blocks(spark, seed, lengths, monkeypatch):
    """Clusters over many blocks, vectors of one or of many lengths; few messages at a time change nothing but the work."""
    monkeypatch.setattr(nndescent, "SENDERS", 3)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(15, 12))[rng.integers(0, 15, 1500)] + rng.normal(size=(1500, 12)) * 0.6
    x = x if lengths else x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(nndescent.nearest(df, df.where("vec_id % 20 = 0"), k=10, block_rows=100).collect())
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, rows in got.items():
        truth = brute(range(1500), x, q, 10)
        assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - x[q] @ x[i]) < 1e-9 for i, s in rows)
        hits += len({i for i, _ in rows} & {i for _, i in truth})
    assert hits >= 0.95 * 10 * len(got)


def test_rounds_improve_the_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = nndescent.vectors(df, "vec_id", "embedding")
    shares = []
    for rounds in (0, 2):
        blocks, graph, _, _ = nndescent.index(rows, block_rows=60, rounds=rounds)
        ids = {(b.block << nndescent.SLOT) + s: i for b in blocks.collect() for s, i in enumerate(np.frombuffer(b.ids, np.int64).tolist())}
        assert sorted(ids.values()) == list(range(1200))
        hits = 0
        for g in graph.collect():
            near = np.frombuffer(g.neighbours, np.int64).reshape(g.nodes, -1)
            for s, row in enumerate(near.tolist()):
                own = ids[(g.block << nndescent.SLOT) + s]
                mine = [ids[a] for a in row if a != nndescent.NONE]
                assert len(set(mine)) == len(mine) and own not in mine
                hits += len(set(mine[:10]) & {i for _, i in brute(range(1200), x, own, 10)})
        shares.append(hits / 12000)
    assert shares[1] > shares[0] and shares[1] > 0.9


def test_kernels():
    rng = np.random.default_rng(4)
    slots, addresses, scores = rng.integers(0, 5, 300), rng.integers(0, 40, 300), rng.normal(size=300)
    s, a, v = nndescent.best_of(slots, addresses, scores, 7)
    for slot in range(5):
        best = {}
        for i in np.flatnonzero(slots == slot):
            best[addresses[i]] = max(best.get(addresses[i], -9), scores[i])
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:7]
        assert list(zip(a[s == slot].tolist(), v[s == slot].tolist())) == want
    who, near = nndescent._pairs(np.array([1, 1, 0, 2]), np.array([9, 9, 5, 1 << 60]), (np.array([0, 2]), np.array([5, 4])))
    assert list(zip(who.tolist(), near.tolist())) == [(1, 9), (2, 1 << 60)]
    up = nndescent.lifted(rng.normal(size=(20, 3)), 5.0)
    assert np.allclose((up**2).sum(axis=1), 25, atol=1e-4)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [1.0, 0.0], 2), (1, [0.0, 2.0], 2), (2, [0.5, float("nan")], 0), (3, None, 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [2.0], 0), (6, [-1.0, 0.0], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, 0.0], 0), (9, [0.0, 0.0], 0), (10, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, nndescent.nearest(df, df.where("vec_id in (0, 5, 9, 3)"), k=3).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 1, 0.0)]
    assert nndescent.nearest(df.limit(0), df.limit(0)).count() == 0 and nndescent.nearest(df, df.limit(0)).count() == 0


def test_many_copies(spark):
    """A third of all rows holds one vector: a node, of whose ids the smallest are found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    rows = [(i, x[i].tolist()) for i in range(400)] + [(1000 + i, [3.0] * 8) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = found(nndescent.nearest(df, df.where("vec_id in (1003, 1700)"), k=5, block_rows=50).collect())
    assert [i for i, _ in got[1003]] == [1000, 1001, 1002, 1004, 1005] and [i for i, _ in got[1700]] == [1000, 1001, 1002, 1003, 1004]
