import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wharfline.llm import lm, queries
from wharfline.llm.text import Words


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def base(rows, train):
    counts = collections.Counter(t for r in rows if train(r) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    bottom = math.log10(n + 0.5 * (v + 1)) if n else math.log10(0.5)
    return [(r[0], len(t := tokens(r[1])), sum(counts[w] > 0 for w in t), n, round(sum(math.log10(counts[w] + 0.5) - bottom for w in t), 6)) for r in rows]


def key(rows):
    return sorted(rows, key=repr)


def test_query_has_the_exact_base(spark):
    got = queries.queries()["op2_bloom_lm"](spark, DATA)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = base(rows, lambda r: zlib.crc32(str(r[0]).encode()) % 5 != 1)
    found = got.collect()
    assert key([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]) == key(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and math.isfinite(r.score) and r.score < 0 for r in found)


def exact(rows, train, mu=100.0):
    """Scores from the quantised counts themselves, without a filter."""
    one, two = collections.Counter(), collections.Counter()
    for r in rows:
        if train(r):
            t = tokens(r[1])
            one.update(t)
            two.update(zip([None, *t], t))
    n, v = sum(one.values()), len(one)

    def middle(c):
        return 1.5 * 2.0 ** (c.bit_length() - 1) - 0.5 if c else 0.0

    def logp(before, word):
        h = middle(one[before if before is not None else b"\n"])
        p1 = (middle(one[word]) + 0.5) / (n + 0.5 * (v + 1))
        return math.log10((min(middle(two[before, word]), h) + mu * p1) / (h + mu))

    return {r[0]: sum(map(logp, [None, *tokens(r[1])], tokens(r[1]))) for r in rows}


def test_score_is_the_brute_force_but_for_false_positives(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = exact([tuple(r) for r in docs.collect()], lambda r: r[0] % 5 != 1)
    off = sorted(abs(r.score / want[r.doc_id] - 1) for r in lm.score(docs, F.col("doc_id") % 5 != 1).collect())
    assert off[len(off) // 2] < 0.005 and off[-1] < 0.1


@pytest.mark.parametrize("options", [{}, {"hot_words": 3}, {"segment_grams": 2000}])
def test_odd_documents(spark, odd_docs, texts, options):
    got = lm.score(odd_docs, F.col("doc_id") % 2 == 1, **options)
    rows = got.collect()
    want = base([(i, t) for i, t, _ in texts], lambda r: r[0] is not None and r[0] % 2 == 1)
    assert key([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]) == key(want)
    # A filter probed where it lies, in one slice or in many, gives the very scores of one that is broadcast.
    for size in (0, 3000):
        assert key(map(tuple, lm.score(odd_docs, F.col("doc_id") % 2 == 1, **options, slice_bytes=size).collect())) == key(map(tuple, rows))


def test_hot_slices_are_copied(spark, odd_docs, monkeypatch):
    rows = lm.score(odd_docs, F.col("doc_id") % 2 == 1).collect()
    monkeypatch.setattr(lm, "PROBED", 1000)
    assert key(map(tuple, lm.score(odd_docs, F.col("doc_id") % 2 == 1, slice_bytes=0).collect())) == key(map(tuple, rows))


def test_no_training(spark, odd_docs, no_docs):
    assert {r.n_known for r in lm.score(odd_docs, F.lit(False)).collect()} == {0}
    assert lm.score(no_docs, F.lit(True)).count() == 0


def test_filter_levels(spark):
    text = " ".join(["a b"] * 40 + ["a c"] * 5 + ["d"])
    learn = spark.createDataFrame([(text,)], "text string")
    parts = {r.segment: r["bits"] for r in lm.build_segments(learn, 3, 2).collect()}
    bloom = lm.Filter(3, 0, {k: bytes(v) for k, v in parts.items()}, 3)
    words = Words(pa.array(["a b c d zzz"])).hash
    assert bloom.level(lm.unigram(words)).tolist()[:4] == [6, 6, 3, 1]
    pairs = lm.bigram(*lm.tokens(pa.array(["a b", "c a"])))
    assert bloom.level(pairs)[1] == 6 and lm.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_frequent_text_scores_higher(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(50)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101]


def test_bigrams_seen_once_count(spark):
    learn = spark.createDataFrame([("one two three four",)], "text string")
    parts = {r.segment: bytes(r["bits"]) for r in lm.build_segments(learn, 1, 1).collect()}
    pairs = lm.bigram(*lm.tokens(pa.array(["one two three four"])))
    assert lm.Filter(1, 0, parts, 1).level(pairs).tolist() == [1] * 5
    docs = spark.createDataFrame([(0, "one two three four"), (1, "one two three four"), (2, "four two one three")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") == 0).collect()}
    assert got[1] > got[2]
