import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from wharfline.llm import labelled, quality, queries, toxicity
from wharfline.llm.text import Words

HELD = {"op4_nb_toxicity": ("toxic", 3, 1, 0.7), "op6_ftrl_quality": ("quality", 5, 0, 0.3)}


@pytest.mark.parametrize("name", sorted(HELD))
def test_query(spark, name):
    label, modulus, rest, threshold = HELD[name]
    got = {r.doc_id: r for r in queries.queries()[name](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert sorted(got) == sorted(r.doc_id for r in docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def planted(n, seed):
    rnd = random.Random(seed)
    bad = ["grobnik", "zarfel", "mudwit"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(["an", "er", "tion", "the", "ou", "in", "st"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(30, 300))]
        toxic = int(rnd.random() < 0.3)
        junk = int(rnd.random() < 0.3)
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        if junk:
            words = [w.upper() + "!!" for w in words] if rnd.random() < 0.5 else [words[0]] * len(words)
        rows.append((i, " ".join(words), toxic, 1 - junk))
    return rows


def test_toxic_words_are_learned(spark):
    rows = planted(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality"), F.col("doc_id") < 600)
    got = {r.doc_id: r.score for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    held = [r for r in rows if r[0] >= 600]
    toxic, clean = ([got[r[0]] for r in held if r[2] == t] for t in (1, 0))
    # 600 texts teach the order, if not yet full certainty.
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) > 0.97
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean) and sum(s >= 0.7 for s in toxic) >= 0.7 * len(toxic)


def test_junk_is_learned(spark):
    rows = planted(900, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    weights = quality.train(df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality"), F.col("doc_id") < 600)
    got = {r.doc_id: r.score for r in quality.score(df.select("doc_id", "text"), weights).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert sum((got[r[0]] >= 0.3) == bool(r[3]) for r in held) / len(held) > 0.97


@pytest.mark.parametrize("module, fit", [(quality, lambda t: quality.fit(t)), (toxicity, lambda t: toxicity.fit(t, rounds=20))])
def test_odd_documents(odd_docs, no_docs, texts, module, fit):
    sample = pa.table({"doc_id": [1, 2, 3, 4], "text": ["", "fine words here", "BAD!! BAD!!", "fine words again"], "label": pa.array([0, 1, 0, 1], pa.int32())})
    model = fit(sample)
    got = module.score(odd_docs, model)
    assert sorted(got.columns) == sorted(odd_docs.columns)
    rows = got.collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1 and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert module.score(no_docs, model).count() == 0
    assert all(0 <= r.score <= 1 for r in module.score(odd_docs, fit(sample.slice(0, 0))).collect())


def test_sample_is_bounded(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(1, 12)] + [(4, 1, 0), (None, 1, 1), (7, None, 1)] + [(i, 1, 1) for i in range(1000, 3000)], "doc_id long, quality int, toxic int")

    def sample(**bounds):
        return labelled.labelled_sample(odd_docs, labels, "quality", F.col("doc_id") != 8, **bounds)

    # Labels without a document take no place in the sample, and long texts are in it, whole.
    got = sample(rows=10, total_bytes=1 << 20)
    assert got.column("doc_id").to_pylist() == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11] and got.column("label").to_pylist() == [1, 0, 1, 1, 1, 0, 1, 1, 0, 1]
    assert max(map(len, got.column("text").to_pylist())) > 200_000
    some = sample(rows=10, total_bytes=1000)
    assert sum(len(t.encode()) for t in some.column("text").to_pylist()) <= 1000 and some.num_rows >= 6
    assert sample(rows=3, total_bytes=1 << 20).num_rows == 3


def test_ftrl_is_the_plain_loop():
    rnd = random.Random(8)
    rows = [(sorted(rnd.sample(range(12), 4)), [rnd.uniform(0.1, 2) for _ in range(4)], rnd.randrange(2), rnd.uniform(0.5, 3)) for _ in range(200)]
    model, z, n = quality.Ftrl(12), [0.0] * 13, [0.0] * 13

    def weight(i):
        return 0.0 if abs(z[i]) <= model.l1 else -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for at, x, label, share in rows:
        model.learn(np.array(at), np.array(x), label, share)
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - label) * v * share
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(13)])


def test_word_grams_are_the_plain_ones():
    texts = ["a b c a b", "", "c a b", "B a", "a b c d"]
    at, row = quality.features(pa.array(texts), 40)
    assert (np.diff(row) == [7 * len(t.split()) for t in texts]).all()
    got = [set(at[a:b].reshape(-1, 7)[:, 2].tolist()) for a, b in zip(row[:-1], row[1:])]
    plain = [{tuple(w[max(0, i - 2) : i + 1]) for i in range(len(w))} for w in (t.split() for t in texts)]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(plain[i] & plain[j])


def test_ratios_are_counted_presence():
    texts = ["Grün GRÜN grau", "grün!", "blau", "", "αβγδε αβγδε", "ÀÉ", "no", "blau grün"]
    label = [1, 1, 0, 0, 1, 0, 0, 1]

    def grams(text):
        s = " " + "".join(" " if c.isascii() and not c.isalnum() else c for c in text.lower()) + " "
        return [s[i : i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)]

    at, row = toxicity.features(pa.array(texts), 40)
    sets = [set(at[a:b].tolist()) for a, b in zip(row[:-1], row[1:])]
    plain = [set(grams(t)) for t in texts]
    assert np.diff(row).tolist() == [len(grams(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])
    names = sorted(set().union(*plain))
    counts = np.array([[sum(g in p for p, y in zip(plain, label) if y == k) for g in names] for k in (0, 1)])
    got = toxicity.ratios(counts, np.array([4, 4]), 1.0)
    assert np.allclose(got, [math.log((counts[1][i] + 1) / 6 / ((counts[0][i] + 1) / 6)) for i in range(len(names))])


def test_model_scales_by_ratios():
    sample = pa.table({"text": ["bad word"] * 6 + ["fine word"] * 6, "label": [1] * 6 + [0] * 6})
    model = toxicity.fit(sample, rounds=50)
    for text, sign in (("bad", 1), ("fine", -1)):
        at, row = toxicity.features(pa.array([text]))
        assert np.sign(model.weight[at]).tolist() == [sign] * len(at)
    # A bucket counts once however often it comes.
    assert model.dots(*toxicity.features(pa.array(["bad bad bad bad"])))[0] == pytest.approx(model.dots(*toxicity.features(pa.array(["bad bad bad"])))[0])


def test_shapes():
    w = Words(pa.array(["Abc Xy!! ABC!! a1b22 c3d4 Ünd Enr"]), quality.SAME)
    s = quality.shapes(w).tolist()
    assert s[0] == s[6] and s[3] == s[4] and s[1] != s[2] and len(set(s)) == 5
