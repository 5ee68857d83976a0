import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, size long, train boolean, media binary, k1 long, found string, rate double, kind string, email string, _source string, _text string, payload_bytes int, _spans int, digest string, pivot int"
EXTRA = ("x", 0.5, 7, 8, True, bytearray(b"m"), 9, "f", 0.1, "k", "e", "s", "t", 3, 4, "d", 5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, white space and non-ASCII text, and columns that clash with new ones."""
    words = [f"w{i}" for i in range(60)]
    long = " ".join(f"t{i * i % 9973}" for i in range(40_000))
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", None),
        (4, " ".join(words), "en", "b"),
        (5, " ".join(words), None, "b"),
        (5, " ".join(words), None, "b"),
        (6, " ".join([*words[:55], "new", *words[56:]]), "en", "a"),
        (7, "one two", "en", "c"),
        (8, "One  TWO", "en", "c"),
        (None, " ".join(words), "en", None),
        (None, None, None, None),
        (9, long, "en", "b"),
        (10, "mail joe@x.example, call +1 (555) 010-9999 or 10.0.0.1 and 4111 1111 1111 1111.\nünïcödé 🎈 " * 3, "de", "c"),
        (11, "a" * 70_000, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if i is None else i, *EXTRA[1:]) for i, t, lang, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts(odd_docs):
    return [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
