"""Personal data: pattern and checksum spans, widened by bootstrapped contextual extraction.

All of it is DataFrame expressions: regular expressions give the base spans and
seed secrets, whose surroundings become lexical patterns, several an entity; a
bipartite graph of patterns and instances is scored in rounds of joins and
aggregations until nothing new is trusted; instances that high-confidence
patterns find become further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, written

#: Added spans that are broadcast at most (about 32 bytes each); more are joined by shuffle.
BROADCAST_SPANS = 500_000

KINDS = ("email", "ip", "card", "phone")
#: A further kind whose seeds are no base spans: secrets, at first only assigned, quoted hexadecimal strings of a digest's length.
SECRET = "secret"
SEED_SECRET = r"""[=:]\x20{0,2}+["'][0-9a-f]{32,128}+(?=["'])"""

# \G admits a match right where the last one ended; otherwise one may only begin where a run of its first
# class begins. A start inside a run fails whenever the run's own start fails, so the matches are the plain
# pattern's, and possessive loops keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that any match of the kind holds; texts without it skip the search.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Identifier-like words that patterns may reveal: maximal runs of Latin letters, digits and joining signs with a digit in them; the signs at their ends are cut off.
CANDIDATE = r"(?<![A-Za-z0-9\u00C0-\u024F._@/+%-])(?=[A-Za-z\u00C0-\u024F._@/+%-]*+[0-9])[A-Za-z0-9\u00C0-\u024F._@/+%-]++"
#: Code points on either side of a mention in which its patterns lie.
CONTEXT = 64
PAGE = 512

_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, d: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["sum"] + F.when(acc["i"] % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))).cast("int").alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda s: _holds(kind, s["value"])


def _as_mention(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def _as_mark(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))


def _as_text(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _place(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["stop"].alias("stop"))


def located(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, stop, value) in code points, found by matching and, where there are any, splitting at the same pattern."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        return F.struct((start + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["h"])).alias("stop"), x["h"].alias("value")))).cast(_SPAN).alias("out"))

    def walked(hits: Column) -> Column:
        # In runs of about the square root of the matches: growing one array by each match would copy it each time.
        pairs = F.array(F.zip_with(hits, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"))))
        length = F.ceil(F.sqrt(F.size(hits))).cast("int")
        runs = F.transform(pairs, lambda all_: F.transform(F.sequence(F.lit(1), F.size(hits), length), lambda i: F.slice(all_, i, length)))[0]
        none = f"cast(array() as {_SPAN})"
        parts = F.aggregate(
            runs,
            F.expr(f"array(named_struct('at', 0, 'out', {none}))"),
            lambda acc, run: F.concat(acc, F.array(F.aggregate(run, F.struct(F.element_at(acc, -1)["at"].alias("at"), F.expr(none).alias("out")), step))),
        )
        return F.flatten(F.transform(parts, lambda part: part["out"]))

    # The array of one binds the matches to a name, or each use would search the text again.
    bound = F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.transform(bound, lambda hits: F.when(F.size(hits) > 0, walked(hits)).otherwise(F.expr(f"cast(array() as {_SPAN})")))[0]


def base_spans(docs: DataFrame, text: str, inner: str) -> DataFrame:
    """``docs`` with an array of spans in the column of each kind; ``inner`` names a column used on the way."""
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"cast(array() as {_SPAN})")
    digit = body.rlike("[0-9]")
    out = docs.withColumn(inner, digit)
    for kind in KINDS:
        asked = F.contains(body, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        asked = asked & F.col(inner) if kind != "email" else asked
        out = out.withColumn(kind, F.when(asked, F.filter(located(body, PATTERNS[kind]), _keeps(kind))).otherwise(none))
    return out.drop(inner)


def _joined(parts: list[tuple[str, Column]]) -> Column:
    """kind:start:stop of all spans, comma-joined, by kind in the given order, then start."""
    texts = [F.transform(spans, _as_text(kind)) for kind, spans in parts]
    return F.array_join(F.concat(*texts), ",")


def _sides(pages: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """What stands before and after a span, lower-cased, white space as one blank, digits as 0. ``pages`` is the text cut into PAGE code points, so that no lookup walks a long text."""

    def page(i: Column) -> Column:
        return F.coalesce(F.get(pages, i), F.lit(""))

    p, q = (F.floor(x / PAGE).cast("int") for x in (start, stop))
    before = F.right(F.concat(page(p - 1), F.substring(page(p), F.lit(1), start % PAGE)), F.lit(CONTEXT))
    after = F.left(F.concat(F.substring(page(q), stop % PAGE + 1, F.lit(PAGE)), page(q + 1)), F.lit(CONTEXT))
    return tuple(F.regexp_replace(F.regexp_replace(F.lower(side), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0") for side in (before, after))


def patterns_around(pages: Column, start: Column, stop: Column) -> Column:
    """The lexical patterns of a span: the word before it, the two words before it, the word after it, and the words on both sides, each with the signs between."""
    before, after = _sides(pages, start, stop)
    word, signs = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]"
    left, two = F.regexp_extract(before, f"({word}{signs}*)$", 1), F.regexp_extract(before, f"({word}{signs}+{word}{signs}*)$", 1)
    right = F.regexp_extract(after, f"^({signs}*{word})", 1)
    some = [(left != "", F.concat(F.lit("l "), left)), (two != "", F.concat(F.lit("ll "), two)), (right != "", F.concat(F.lit("r "), right)), ((left != "") & (right != ""), F.concat(F.lit("lr "), left, F.lit("␟"), right))]
    return F.array_compact(F.array(*[F.when(there, pattern) for there, pattern in some]))


def _trimmed(signs: str):
    """A span without the signs at its ends."""

    def trim(span: Column) -> Column:
        inner = F.regexp_replace(span["value"], f"^{signs}++|{signs}++$", "")
        start = span["start"] + F.length(span["value"]) - F.length(F.regexp_replace(span["value"], f"^{signs}++", ""))
        return F.struct(start.alias("start"), (start + F.length(inner)).cast("int").alias("stop"), inner.alias("value"))

    return trim


def _unnamed(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), span["value"].alias("value"), F.lit(None).cast("string").alias("kind"))


def _in_context(m: Column) -> Column:
    value = F.when(F.length(m["value"]) <= 64, m["value"]).otherwise(F.md5(m["value"]))
    return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), value.alias("instance"), m["kind"].alias("kind"), patterns_around(F.col("_pages"), m["start"], m["stop"]).alias("patterns"))


def mentions(spotted: DataFrame, key: str, text: str) -> DataFrame:
    """Seeds and candidates of each distinct text: key, start, stop, instance, kind (null for candidates), patterns.

    Spans of ``KINDS`` and secrets of ``SEED_SECRET`` are seeds; candidates overlap none of them. An instance is the value, or its hash if that is longer than 64.
    """
    secrets = F.transform(F.transform(located(F.col("_body"), SEED_SECRET), _trimmed(r"""[=:\x20"']""")), _as_mention(SECRET))
    seeded = spotted.select(key, F.col(text).alias("_body"), *KINDS).withColumn("_seeds", F.concat(*[F.transform(F.col(k), _as_mention(k)) for k in KINDS], secrets))
    free = F.filter(F.transform(located(F.col("_body"), CANDIDATE), _trimmed("[._@/+%-]")), lambda c: ~F.exists("_seeds", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"])))
    paged = seeded.withColumn("_pages", F.regexp_extract_all("_body", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))
    found = paged.select(key, F.transform(F.concat("_seeds", F.transform(free, _unnamed)), _in_context).alias("_all"))
    # Not explode: its inferred filter on the array's size would search every text once more.
    return found.select(key, F.explode_outer("_all").alias("m")).where("m is not null").select(key, "m.*")


def bootstrap(found: DataFrame, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """instance, kind and score of the candidates that patterns reveal.

    The graph has an edge (pattern, instance) wherever the pattern stands around
    the instance; edges are distinct before any join, so a pattern or an
    instance of a third of all rows is one row per partner. Seeds begin with
    score 1. In each round a pattern's confidence for a kind is the score of its
    known instances of that kind over all its instances (support: how many known ones of that
    kind), and an unknown instance's score is 1 minus the product of the doubts of
    its patterns of at least ``min_support`` and ``min_confidence``. Instances that
    reach ``min_confidence`` become known, of their best kind (ties to the larger name); rounds go on until none does, which ends,
    since known ones stay known. An instance with seeds of several kinds is known by all of them.
    """
    edges = written(found.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges")
    fan = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= min_support), "fans")
    known = written(found.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct(), "known")
    fresh_ones = known.limit(0)
    while True:
        weighed = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
        confidence = F.least(F.col("mass") / F.col("all"), F.lit(1.0))
        trusted = weighed.join(fan, "pattern").withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence).select("pattern", "kind", "confidence")
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9))))
        revealed = edges.join(trusted, "pattern").join(known.select("instance").distinct(), "instance", "left_anti").groupBy("instance", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("score"))
        best = revealed.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score").where(F.col("score") >= min_confidence)
        best = written(best, "revealed")
        if best.isEmpty():
            return fresh_ones
        fresh_ones, known = fresh_ones.unionByName(best), known.unionByName(best)


def find_pii(docs: DataFrame, *, text: str = "text", min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """Every row of ``docs`` with the base spans of each kind (columns email, ip, card, phone) and ``found``, the spans that patterns add, secrets' seeds included.

    Spans are arrays of (start, stop, value), or (start, stop, kind, score), in code points, stop exclusive.
    Patterns are gathered from distinct texts, so copies of a document don't
    vote twice, and come back by the text's hash, so null and repeated ids and
    equal texts are all served. Null and empty texts have no spans; an empty
    table gives an empty table. Columns of docs named like the five new ones are
    replaced (``masked`` keeps them); inner columns have names of their own.
    """
    key, digit = fresh("key"), fresh("digit")
    body = F.coalesce(F.col(text), F.lit(""))
    kept = docs.drop(*KINDS, "found") if text not in (*KINDS, "found") else docs.drop(*[c for c in (*KINDS, "found") if c != text])
    kept = kept.withColumn(key, F.xxhash64(body, F.md5(body)))
    # The few texts with digits or addresses, and of each mention in them one row: small tables, read again in each round.
    marked = kept.select(F.col(key).alias("key"), body.alias("body")).where(F.col("body").rlike("[0-9@]"))
    found = written(mentions(base_spans(marked, "body", digit), "key", "body").dropDuplicates(["key", "start", "stop", "kind"]), "mentions")
    new = bootstrap(found, min_support, min_confidence)
    added = found.where("kind is null").drop("kind").join(new, "instance").select("key", "start", "stop", "kind", "score")
    added = added.unionByName(found.where(F.col("kind") == SECRET).select("key", "start", "stop", "kind", F.lit(1.0).alias("score")))
    per_text = written(added.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kind", "score"))).alias("found")), "found")
    size = per_text.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    per_text = per_text.withColumnRenamed("key", key)
    if size <= BROADCAST_SPANS:
        per_text = F.broadcast(per_text)
    spotted = base_spans(kept, text, digit)
    none = F.expr("cast(array() as array<struct<start:int,stop:int,kind:string,score:double>>)")
    return spotted.join(per_text, key, "left").withColumn("found", F.coalesce("found", none)).drop(key)


def span_digest(found: DataFrame) -> list[Column]:
    """The digest columns of a query over ``find_pii``'s output."""
    base = [(k, F.col(k)) for k in KINDS]
    every = [(k, F.sort_array(F.concat(F.transform(F.col(k), _place), F.transform(F.filter("found", _of_kind(k)), _place)))) for k in KINDS]
    every.append((SECRET, F.transform(F.filter("found", _of_kind(SECRET)), _place)))
    return [*[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans")]


def masked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans are merged under the first one's kind.

    Null texts stay null. All other columns come back as they were, whatever their names.
    """
    packed = find_pii(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    spans = F.concat(
        *[F.transform(F.col(k), _as_mark(k)) for k in KINDS],
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))),
    )
    body = F.col("text")
    cut = F.aggregate(
        F.sort_array(F.col("spans")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))),
    )
    marked = packed.withColumn("spans", spans)
    clean = F.when(F.size("spans") > 0, cut).otherwise(body)
    return marked.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
