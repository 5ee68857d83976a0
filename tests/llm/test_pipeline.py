import hashlib

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F

from wharfline.llm import quality
from wharfline.llm.common import table


def test_pipeline(spark, tmp_path):
    """Each stage against a plainer version on what the stage before kept."""
    docs = table(spark, DATA, "documents")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = outs[name] = spark.read.parquet(path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(outs[n].columns == corpus_pipeline.COLUMNS for n in names[:-1])

    start = table(spark, DATA, "documents")
    weights = quality.train(start, table(spark, DATA, "labels"), F.lit(True))
    good = {r.doc_id for r in quality.score(start, weights).collect() if r.score >= 0.3}
    assert {r.doc_id for r in outs["quality"].collect()} == good

    from llm.test_jaccard import brute as classes

    rows = [(r.doc_id, r.text) for r in outs["quality"].collect()]
    first = {i for i, _, c in classes(rows) if i == c}
    kept = {r.doc_id: r.text for r in outs["near_copies"].collect()}
    assert set(kept) == first

    from llm.test_pii import brute, brute_added

    added = {}
    for t, a, b, k in brute_added([t or "" for t in kept.values()]):
        added.setdefault(t, {}).setdefault(k, []).append((a, b))

    def spans(text):
        base, more = brute(text), added.get(text or "", {})
        return {k: base.get(k, []) + more.get(k, []) for k in (*base, "secret")}

    masked = {r.doc_id: r.text for r in outs["personal_data"].collect()}
    assert set(masked) == first
    for i, text in kept.items():
        found = spans(text)
        assert (masked[i] == text) == (not any(found.values()))
        assert not any(text[a:b] in masked[i] for k in found for a, b in found[k])
        assert all(f"[{k}]" in masked[i] for k in found if found[k])

    from wharfline.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix_sources(outs["personal_data"]).collect()}
    mixed = outs["mix"].groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {i: c for i, c in copies.items() if c}

    from wharfline.llm import bpe
    import public_tokenizers

    encoder = bpe.TextEncoder(bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    for r in outs["tokens"].collect():
        assert encoder.encode(masked[r.doc_id] or "") == list(r.tokens) and r.n_tokens == len(r.tokens)
    digest = lambda df: sorted(hashlib.md5(str(r).encode()).hexdigest() for r in df.collect())
    assert digest(corpus_pipeline.run(spark, DATA)) == digest(outs["tokens"])


def test_empty_tables(spark, tmp_path):
    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_stages_take_odd_documents(spark, odd_docs, texts):
    """Nulls, empty and long texts, repeated rows and clashing columns, a stage at a time."""
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted(map(repr, texts))

    def out(name):
        got = stages[name](spark, odd_docs, DATA)
        assert got.columns == (corpus_pipeline.COLUMNS if name != "tokens" else ["doc_id", "source", "n_tokens", "tokens"])
        return got.collect()

    # Equal rows are kept or rejected together, and what stays is as it was.
    good = [repr((r.doc_id, r.text, r.source)) for r in out("quality")]
    assert all(good.count(r) in (0, rows.count(r)) for r in set(rows)) and set(good) <= set(rows)

    # Copies of the 60 words, their near copy and the row without an id are one group, the two short texts another, each named by its smallest id; rows without words all stay.
    kept = sorted(repr((r.doc_id, r.text, r.source)) for r in out("near_copies"))
    single = [r for r in rows if not r.startswith(("(5,", "(6,", "(8,")) and not (r.startswith("(None, 'w0"))]
    assert kept == sorted(single)

    masked = out("personal_data")
    assert sorted(repr((r.doc_id, r.source)) for r in masked) == sorted(repr((i, s)) for i, _, s in texts)
    assert [r.text is None for r in masked].count(True) == 2 and all(r.n_chars == len(r.text) for r in masked if r.text is not None)
    assert [r for r in masked if r.doc_id == 10 and "joe@x.example" not in r.text and "[email]" in r.text]

    mixed = [repr((r.doc_id, r.text, r.source)) for r in out("mix")]
    assert set(mixed) <= set(rows) and all(mixed.count(r) <= 3 * rows.count(r) for r in set(rows))

    tokens = out("tokens")
    assert sorted(repr((r.doc_id, r.source)) for r in tokens) == sorted(repr((i, s)) for i, _, s in texts)
    assert all(r.n_tokens == len(r.tokens) for r in tokens) and sum(r.n_tokens == 0 for r in tokens) == 3
