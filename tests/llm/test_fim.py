import hashlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from wharfline.llm import fim, queries


def brute(doc_id, text, units=lambda t: list(t)):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    parts = units(text)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(p) for p in (parts[:a], parts[a:b], parts[b:]))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def words(text):
    out = []
    for i, c in enumerate(text):
        if not out or (c not in " \t\n\v\f\r" and text[i - 1] in " \t\n\v\f\r"):
            out.append("")
        out[-1] += c
    return out


def test_query_is_the_sql(spark, same_as_sql):
    same_as_sql(queries.queries()["op12_fill_in_middle"](spark, DATA), queries.oracle_sql()["op12_fill_in_middle"])


@pytest.mark.parametrize("unit, parts", [("char", list), ("word", words), ("line", lambda t: t.splitlines(keepends=True))])
def test_odd_documents(spark, odd_docs, no_docs, texts, unit, parts):
    marked = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a<P>b", "<<S", "<S", "<M><", "x\n\ny é\n", "\U0001f388" * 50 + "<", "ab", "<S>" * 3] * 9)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in marked.collect()]
    cut = fim.fim(marked, unit=unit)
    got = sorted(map(repr, map(tuple, cut.select("n", "form", "prefix_units", "middle_units", "output").collect())))
    assert got == sorted(repr(brute(i, t, parts)) for i, t in rows)
    back = cut.select("doc_id", fim.restored(cut["output"], cut["form"]).alias("t")).collect()
    assert sorted(repr((r.doc_id, r.t)) for r in back) == sorted(repr((i, t or "")) for i, t in rows)
    assert fim.fim(no_docs).count() == 0
    clash = fim.fim(odd_docs.withColumnRenamed("lang", "form").withColumnRenamed("k1", "output"))
    assert {"form", "output", "score"} <= set(clash.columns) and clash.count() == odd_docs.count()


def test_slices_and_steps(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aé漢🎈 \n<PSM>"), rng.integers(0, 40))) for _ in range(500)] + [None]
    column = pa.array(["skipped", *texts, "skipped"])[1:-1]
    h = [rng.integers(0, 1 << 32, len(texts)) for _ in range(4)]
    whole = [x.to_pylist() for x in fim.fim_batch(column, *h)]
    for i in range(0, len(texts), 50):
        one = [x.to_pylist() for x in fim.fim_batch(column[i : i + 1], *[x[i : i + 1] for x in h])]
        assert [c[0] for c in one] == [c[i] for c in whole]
    assert set(whole[1]) == {"plain", "psm", "spm"}
    assert [len(c) for c in fim.fim_batch(pa.array([], pa.string()), *[x[:0] for x in h])] == [0] * 5
    assert fim.fim_batch(pa.array([None, ""]), *[x[:2] for x in h])[4].to_pylist() == ["", ""]
