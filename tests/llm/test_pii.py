import hashlib
import random
import re

import regex
from conftest import DATA
from pyspark.sql import functions as F

from wharfline.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PLAIN.items()}


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in sorted(spans[k]))


def same(rows):
    for r in rows:
        base = brute(r.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def digests(df):
    found = pii.find_pii(df)
    return found.select("text", *pii.span_digest(found)).collect()


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    same(queries.queries()["op10_bootstrapped_pii"](spark, DATA).join(docs, "doc_id").collect())


def test_tricky_matches(spark):
    rnd = random.Random(5)
    rows = ["a@b.c_d@e.f", "x@y", "@a.b", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.0255", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "+1 (555) 010-9999-", "++12345678", "🎈🎈 joe@x.y 10.0.0.1", "9" * 3000, "a" * 3000 + "@" + "b" * 10]
    rows += ["".join(rnd.choice(["a", "@", ".", "1", "23", "456", " ", "-", "+", "(", ")", "_", "é", "🎈", "4111111111111111"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    same(digests(spark.createDataFrame([(t,) for t in rows], "text string")))


def brute_mentions(text):
    """(start, stop, value, kind) of seeds and candidates."""
    seeds = [(a, b, text[a:b], k) for k, spans in brute(text).items() for a, b in spans]
    seeds += [(m.start(1), m.end(1), m[1], "secret") for m in re.finditer(r"""[=:]\x20{0,2}["']([0-9a-f]{32,128})(?=["'])""", text)]
    out = list(seeds)
    for m in re.finditer("[A-Za-z0-9À-ɏ._@/+%-]+", text):
        value, start = m[0].strip("._@/+%-"), m.start() + len(m[0]) - len(m[0].lstrip("._@/+%-"))
        if re.search("[0-9]", value) and not any(a < start + len(value) and start < b for a, b, _, _ in seeds):
            out.append((start, start + len(value), value, None))
    return out


def brute_patterns(text, start, stop):
    before, after = (re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())) for x in (text[max(0, start - 64) : start], text[stop : stop + 64]))
    word, signs = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]"
    left, two, right = (m[0] if (m := regex.search(p, side)) else None for p, side in ((f"{word}{signs}*$", before), (f"{word}{signs}+{word}{signs}*$", before), (f"^{signs}*{word}", after)))
    return {p for p in (left and "l " + left, two and "ll " + two, right and "r " + right, left and right and "lr " + left + "␟" + right) if p}


def brute_added(texts, support=3, confidence=0.8):
    """The spans that the bootstrap adds: (text, start, stop, kind)."""
    all_of, named = {}, {}
    places = [(t, a, b, v, k, brute_patterns(t, a, b)) for t in set(texts) for a, b, v, k in brute_mentions(t)]
    for _, _, _, v, k, patterns in places:
        if k:
            named.setdefault(v, {})[k] = 1.0
        for p in patterns:
            all_of.setdefault(p, set()).add(v)
    new = {}
    while True:
        trust = {}
        for p, values in all_of.items():
            for k in (*PLAIN, "secret"):
                scores = [named[v][k] for v in values if k in named.get(v, {})]
                if len(scores) >= support and sum(scores) / len(values) >= confidence:
                    trust[p, k] = sum(scores) / len(values)
        found = {}
        for (p, k), c in trust.items():
            for v in all_of[p] - set(named):
                doubts = found.setdefault(v, {})
                doubts[k] = doubts.get(k, 1.0) * max(1 - c, 1e-9)
        best = {v: max((1 - d, k) for k, d in doubts.items()) for v, doubts in found.items()}
        best = {v: (s, k) for v, (s, k) in best.items() if s >= confidence}
        if not best:
            break
        new |= {v: k for v, (_, k) in best.items()}
        named |= {v: {k: s} for v, (s, k) in best.items()}
    return {(t, a, b, "secret" if k else new[v]) for t, a, b, v, k, _ in places if k == "secret" or k is None and v in new}


def planted():
    """Texts whose identifiers stand in telling contexts, one reached only through another that is found first, and clean ones."""
    rnd = random.Random(9)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    out = [f'{rnd.choice(["and", "or", "but"])} token = "{h}" is it' for h in hexes]
    out += [f'then TOKEN = "{h.upper()[:20]}" came', *[f'the key_{i} <{h.upper()[:20]}> opened' for i, h in enumerate(hexes[:1])]] if (h := hexes[0]) else []
    out += [f'my badge AB{i}00{i} shown' for i in range(3)]
    out += [f"write to user{i}@mail.example please, {rnd.choice(['now', 'soon'])}" for i in range(12)]
    out += ["write to user88.mail.example9 please, now", "write to user77(at)mail please", "and then user99.mail.example9 came", "(see user88.mail.example9, and others)"]
    out += [f"see chapter{i}.verse{i} of it" for i in range(20)] + ["version 3 of 2 parts", "Licensed under CC BY-NC 4.0."]
    # A chain: codes before "code" are known from the second pattern on.
    out += [f"ring +1 555 010 10{i:02d} for code" for i in range(40)] + [f"ring K{i}77 for code" for i in range(6)] + [f"lot K{i}77, sealed" for i in range(6)] + ["lot Z9, sealed"]
    return out


def test_bootstrap_is_the_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {(r.text, s.start, s.stop, s.kind) for r in pii.find_pii(docs).collect() for s in r.found}
    assert got == brute_added(texts)
    values = {(t[a:b], k) for t, a, b, k in got}
    assert ("user88.mail.example9", "email") in values and ("K177", "phone") in values and ("Z9", "phone") in values and any(v.isupper() and k == "secret" for v, k in values)
    assert not any("chapter" in v or v in ("3", "2", "4.0") for v, _ in values)


def test_added_spans_of_the_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text is not null").distinct()
    texts = [r.text for r in rows.collect()]
    assert {(r.text, s.start, s.stop, s.kind) for r in pii.find_pii(rows).collect() for s in r.found} == brute_added(texts)


def test_masked_keeps_clashing_columns(spark):
    rows = [(1, "joe@x.example here", "mine", 4, "f", 7), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string, ip int, found string, spans int")
    got = {r.doc_id: tuple(r) for r in pii.masked(docs).collect()}
    assert got == {1: (1, "[email] here", "mine", 4, "f", 7), 2: rows[1]}


def test_odd_documents(odd_docs, no_docs, texts):
    found = pii.find_pii(odd_docs)
    assert found.count() == len(texts) and "score" in found.columns
    same(found.select("text", *pii.span_digest(found)).collect())
    masked = pii.masked(odd_docs)
    assert masked.columns == odd_docs.columns
    by_id = {r.doc_id: r.text for r in masked.collect() if r.doc_id}
    assert by_id[10].startswith("mail [email], call [phone] or [ip] and [card].\nünïcödé 🎈 mail [email]") and by_id[1] is None and by_id[4] == dict((i, t) for i, t, _ in texts)[4]
    assert pii.find_pii(no_docs).count() == 0 and pii.masked(no_docs).count() == 0


def test_native(spark):
    plan = pii.masked(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_luhn(spark):
    rnd = random.Random(3)
    numbers = ["".join(rnd.choice("0123456789") for _ in range(rnd.randrange(1, 20))) for _ in range(200)]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", pii.luhn(F.col("n")).alias("ok")).collect()
    assert all(r.ok == luhn(r.n) for r in got)
