import collections
import random

import pytest
from conftest import DATA

from wharfline.llm import jaccard, queries
from wharfline.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id, size and component by comparing all sets that share a shingle."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    # Rows of a null id link like any other, by numbers above all ids.
    sets = [(1 << 40 if i is None else i, shingles(t)) for i, t in rows]
    sets = [(i + (at if i == 1 << 40 else 0), x) for at, (i, x) in enumerate(sets)]
    where, names, known = collections.defaultdict(list), {}, []
    for i, s in sets:
        if s in names:
            link(i, names[s])
            continue
        if s:
            names[s] = i
        shared = collections.Counter(j for g in s for j in where[g])
        for j, o in shared.items():
            other, t = known[j]
            if 100 * o >= 75 * (len(s) + len(t) - o):
                link(i, other)
        n = len(known)
        known.append((i, s))
        for g in s:
            where[g].append(n)
    return sorted((i, len(s), find(i)) for i, s in sets if i < 1 << 40)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect() if r.doc_id is not None)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert rows_of(queries.queries()["op5_prefix_tree_jaccard"](spark, DATA)) == brute(rows)


def near_copies(n, seed):
    rnd = random.Random(seed)
    base = [[f"b{k}_{i}" for i in range(rnd.randrange(20, 60))] for k in range(6)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(50)}"
        if rnd.random() < 0.5:
            at = rnd.randrange(len(words))
            words[at:at] = passage[: rnd.randrange(10, 25)]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block, bucket", [(2000, 1 << 20), (7, 300)])
def test_near_copies(spark, monkeypatch, block, bucket):
    """Blocks of a large group, and many small buckets, find the same components as the whole."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rows = near_copies(150, 4)
    assert rows_of(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_tree_against_all_pairs():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(30):
        pool = [rnd.getrandbits(64) for _ in range(40)]
        sets = list({frozenset(rnd.sample(pool, rnd.randrange(1, 30))) for _ in range(40)})
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        seen = collections.Counter(x for s in sets for x in s)
        links = jaccard.tree_links(arrays, [np.array([seen[x] for x in a.tolist()], np.uint16) for a in arrays])

        def classes(pairs):
            root = list(range(len(sets)))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                root[find(a)] = find(b)
            return {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))}

        every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        assert classes(links) == classes(every) and len(links) <= len(sets)


def test_odd_documents(odd_docs, no_docs, texts):
    got = jaccard.jaccard_components(odd_docs)
    assert rows_of(got) == brute([(i, t) for i, t, _ in texts])
    assert sorted((r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is None) == [(0, None), (56, 4)]
    assert jaccard.jaccard_components(no_docs).count() == 0
    kept = jaccard.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 7, 9, 10, 11]


def test_representatives_judge_texts_not_ids(spark):
    words = [f"w{i}" for i in range(40)]
    text, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(f"o{i}" for i in range(30))
    rows = [(1, text, "a"), (7, near, "b"), (7, other, "c"), (None, near, "d"), (None, f"{other} more words", "e"), (8, "", "f"), (8, None, "g"), (9, "x y", "h"), (9, "x y", "h"), (None, "lone null id", "i"), (None, "lone null id", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    for part in (docs, docs.repartition(5)):
        assert sorted(r.t for r in jaccard.representatives(part).collect()) == ["a", "c", "f", "g", "h", "i"]


def test_links_through_a_null_id(spark):
    w = [f"w{i}" for i in range(104)]
    texts = [(1, w[:80]), (None, w[:100]), (2, [*w[20:100], "x"])]
    rows = [(i, " ".join(t)) for i, t in texts]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == brute(rows) == [(1, 76, 1), (2, 77, 1)]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for a, b in edges[:-1] if a != b for n in (a, b)}


def all_links(rows):
    """Of each row, with its id, size and number of other rows linked to it, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    linked = [[x and y and 100 * len(x & y) >= 75 * len(x | y) for _, y in sets] for _, x in sets]
    return sorted(((i, len(s), sum(map(bool, row)) - bool(s)) for (i, s), row in zip(sets, linked)), key=repr)


@pytest.mark.parametrize("block", [2000, 7])
def test_all_links_are_counted(spark, monkeypatch, block):
    """In one block or in many, with copies and rows of a null id."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = near_copies(120, 4)
    rows += [(200 + i, t) for i, t in rows[:10]] + [(None, t) for _, t in rows[:3]] + [(None, " ".join([*rows[0][1].split(), "more"])), (None, None), (300, "")]
    rows += [(400 + i, " ".join(f"y{i}" if k == 4 * i else f"w{k}" for k in range(100))) for i in range(25)]
    got = jaccard.jaccard_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = all_links(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=repr) == want
    assert sum(n for _, _, n in want) > 4 * len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
