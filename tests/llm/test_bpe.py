import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import DATA

from wharfline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.Vocabulary.load(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    return " ".join(map(str, text))


def test_texts_encode_like_the_library(encoder, library):
    rnd = random.Random(1)
    wild = [chr(i) for i in (*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x1680, 0x180E, 0xFEFF, 0x1F600, 0x4E2D, 0x301, 0x661, 0x2160, 0xAC00, 0x1D7D8)]
    for _ in range(4000):
        text = "".join(rnd.choice(wild) if rnd.random() < 0.4 else rnd.choice(" \n\t abcdeXYZ012'st.,") for _ in range(rnd.randrange(30)))
        assert encoder.decimal(text) == ids(library.encode_ordinary(text))
        assert encoder.decode(encoder.decimal(text)) == text.encode()
    for text in ("<|endoftext|> a", "a" * 5000, "ab" * 3000 + "\n\n  x ", "  ", "\n \n"):
        assert encoder.decimal(text) == ids(library.encode_ordinary(text))


def test_appends_and_edits(encoder):
    v, rnd = encoder.vocabulary, random.Random(2)
    for _ in range(100):
        data = "".join(rnd.choice(["ab", "the", "ing", "aaaa", "qz", "é"]) for _ in range(rnd.randrange(1, 150))).encode()
        grown = bpe.Prefixes(v, data[:5])
        grown.append(data[5:9])
        grown.append(data[9:])
        assert grown.tokens() == bpe.Prefixes(v, data).tokens()
        cut = rnd.randrange(len(data) + 1)
        assert grown.tokens(cut) == bpe.Prefixes(v, data[:cut]).tokens()
        a = rnd.randrange(len(data) + 1)
        b, new = rnd.randrange(a, len(data) + 1), rnd.choice([b"", b"ing", b"x" * 9])
        grown.edit(a, b, new)
        assert bytes(grown.data) == data[:a] + new + data[b:] and grown.tokens() == bpe.Prefixes(v, bytes(grown.data)).tokens()


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    small = bpe.TextEncoder(bpe.Vocabulary.load(PATH), public_tokenizers.PATTERN)
    small.chunks.half = small.pieces.half = 3
    text = " ".join(f"word{i % 11}x{i}" for i in range(300))
    assert small.decimal(text) == ids(library.encode_ordinary(text)) and len(small.chunks.new) <= 3


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.queries()["op8_prefix_bpe"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        t = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(t), hashlib.sha256(ids(t).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_odd_documents(odd_docs, no_docs, texts, library):
    encoded = bpe.encode_column(odd_docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode_column(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((list(r.tokens) for r in rows), key=str) == sorted((library.encode_ordinary(t or "") for _, t, _ in texts), key=str)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows if r.text) and all(len(r.decoded) == 0 for r in rows if not r.text)
    assert bpe.encode_digest(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_depth_first_like_last_tokens_of_all_prefixes(encoder):
    v, rnd = encoder.vocabulary, random.Random(3)
    for _ in range(3000):
        data = "".join(rnd.choice(["ab", "the", "ing", "aaaa", "qz", "é", " ", "0", "Onh", "tion"]) for _ in range(rnd.randrange(1, 40))).encode()
        assert v.encode(data) == v.walk_back(data) == bpe.Prefixes(v, data).tokens()
    assert v.encode(b"ab" * 3000) == v.walk_back(b"ab" * 3000) and v.encode(b"") == []


def test_workers_get_few_rows_at_once(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SHORT", 20)
    rows = [(i, t) for i, t in enumerate(["one two", "é" * 11, "é" * 10, "a longer text of more than twenty bytes", None, ""])]
    encoded = bpe.encode_column(spark.createDataFrame(rows, "doc_id int, text string"), PATH, public_tokenizers.PATTERN, keep=False)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and plan.count("MapInArrow") == 1
    assert {r.doc_id: list(r.tokens) for r in encoded.collect()} == {i: library.encode_ordinary(t or "") for i, t in rows}


def test_a_word_is_remembered_once(library):
    own = bpe.TextEncoder(bpe.Vocabulary.load(PATH), public_tokenizers.PATTERN)
    text = "first oneththe tionentis thaheon"
    assert own.decimal(text) == ids(library.encode_ordinary(text)) and len(own.chunks.new) == 3 and not own.pieces.new
