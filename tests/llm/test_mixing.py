import collections

from conftest import DATA

from wharfline.llm import mixing, queries


def test_query_is_the_sql(spark, same_as_sql):
    same_as_sql(queries.queries()["op9_source_mix"](spark, DATA), queries.oracle_sql()["op9_source_mix"])


def fill(sizes, cap=3.0, period=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % period + 1 for i, s in enumerate(names)}
    full, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
            open_.remove(s)
    return full


def test_targets_are_the_resharing(spark):
    for sizes in ({"a": 100, "b": 1, "c": 2, None: 50}, {"a": 5, "b": 5, "c": 5}, {"x": 10}, {"a": 0, "b": 9}, {"a": 1000, "B": 3, "ü": 700, "z": 1, "zz": 2, "zzz": 3}):
        docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
        got = {r.source: r.target for r in mixing.mix_sources(docs).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_taken_comes_near_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40 + 1), f"s{i % 3 if i % 2 else 0}") for i in range(6000)], "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs)
    rows = mixed.collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
    assert sorted(rows) == sorted(mixing.mix_sources(docs.repartition(7)).select(*mixed.columns).collect())
    assert mixing.emit(mixed, ["doc_id", "text"]).count() == sum(r.copies for r in rows)


def test_odd_documents(odd_docs, no_docs, texts, monkeypatch):
    got = mixing.mix_sources(odd_docs).collect()
    sizes = collections.Counter()
    for _, t, s in texts:
        sizes[s] += len((t or "").encode().split())
    want = fill(sizes)
    assert len(got) == len(texts)
    for r in got:
        assert (r.size, r.source_size) == (len((r.text or "").encode().split()), sizes[r.source]) and abs(r.target - want[r.source]) < 1e-6
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(odd_docs).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(no_docs).count() == 0
