"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

An n-gram counted c times lies in the filter with each of the levels 1 to
1 + floor(log2 c); its count is found again, quantised, by probing level after
level until one is missing. The filter is cut into segments by the n-gram's hash, each
made in one task from the counts of its n-grams. A filter of bounded size is broadcast to the
workers. A larger one stays where it is, in slices, and the distinct n-grams of each
step of texts travel to the slices and their levels back: two shuffles of packed arrays, whose
size grows with the texts alone. Both ways probe the same bits, so scores agree exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import give_back, tidy, tidy_group, written
from wharfline.llm.text import _ROLE, Words, as_long, mix, steps, sums

#: The sentence end that follows each text's words and counts as a token.
END = mix(np.full(1, 0xE0F, np.uint64))[0]
#: Bits per stored (n-gram, level) pair and hash probes per pair: about 1 false positive in 100.
BITS_PER_ENTRY = 10
PROBES = 5
#: n-grams that a segment is planned for, and bytes of filter that are broadcast at most.
SEGMENT_GRAMS = 1 << 20
SLICE_BYTES = 96 << 20
#: Bytes of a slice that is probed where it is, and n-grams that one task probes it for.
HOME_BYTES = 16 << 20
PROBED = 1 << 22
#: Commonest words whose exact counts are broadcast; the counts of others meet their texts in a shuffle.
HOT_WORDS = 1 << 18
#: Within a segment, n-grams go by so many low bits of their hash: a clash is far rarer than a filter's false positive.
KEY_BYTES = 5
_LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)
#: Words of a step of a task.
STEP = 1 << 19
#: Counted n-grams that a task holds before it passes them on.
HELD = 2 << 20

_LOG10 = np.log(10.0)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each text's words and then the end, and the offsets of the texts."""
    w = Words(column)
    row = w.row + np.arange(len(w.row))
    out = np.empty(row[-1], np.uint64)
    ends = row[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = w.hash
    out[ends] = END
    return out, row


def bigram(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; the start of the text stands before a text's first token."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[row[:-1]] = _ROLE[50]
    return mix(before * _ROLE[1] + words * _ROLE[2] + np.uint64(2)) & ~np.uint64(1)


def unigram(words: np.ndarray) -> np.ndarray:
    """Keys of single words: odd, as those of bigrams are even."""
    return mix(words + _ROLE[51]) | np.uint64(1)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Counter:
    """Counts of keys of one task, merged in blocks."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merge(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """word (its hash) and c, the exact count in all training texts, with the end; tasks count before the shuffle."""

    def count(batches):
        held = _Counter()

        def flush():
            k, c = held.take()
            for i in range(0, len(k), 1 << 16):
                yield pa.record_batch([as_long(k[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], ["word", "c"])

        for batch in steps(batches, "text", STEP):
            held.add(tokens(batch.column("text"))[0])
            if held.held > HELD:
                yield from flush()
        yield from flush()

    return training.select("text").mapInArrow(tidy(count), "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _bits(keys: np.ndarray, level: np.ndarray | int, size: int) -> list[np.ndarray]:
    """The places of (n-gram, level) pairs in a segment of ``size`` bits."""
    h = mix((keys & _LOW) + np.asarray(level).astype(np.uint64) * _ROLE[52])
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32) for i in range(PROBES)]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def build_segments(training: DataFrame, segments: int, tasks: int) -> DataFrame:
    """segment, grams (distinct n-grams in it) and bits (binary): the filter of unigram and bigram counts of the training texts.

    Tasks count their n-grams and send each segment's as packed arrays, so the
    shuffle has few rows, of about 6 bytes an n-gram. A hot n-gram is one entry of each task.
    """

    def count(batches):
        held = _Counter()

        def flush():
            k, c = held.take()
            seg = (k >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
            cut = _runs(seg)
            for a, b in zip(cut[:-1], cut[1:]):
                few = np.minimum(c[a:b], 255).astype(np.uint8)
                yield pa.record_batch([pa.array([int(seg[a])]), pa.array([_packed(k[a:b])], pa.binary()), pa.array([few.tobytes()], pa.binary()), pa.array([c[a:b][few == 255].astype(np.int64).tobytes()], pa.binary())], ["segment", "keys", "few", "many"])

        for batch in steps(batches, "text", STEP):
            words, row = tokens(batch.column("text"))
            held.add(np.concatenate([unigram(words), bigram(words, row)]))
            if held.held > HELD:
                yield from flush()
        yield from flush()

    def build(group: pa.Table) -> pa.Table:
        keys, counts = [], []
        for k, few, many in zip(group.column("keys"), group.column("few"), group.column("many")):
            c = np.frombuffer(few.as_py(), np.uint8).astype(np.int64)
            c[c == 255] = np.frombuffer(many.as_py(), np.int64)
            keys.append(_unpacked(k.as_py()))
            counts.append(c)
        k, c = _merge(np.concatenate(keys), np.concatenate(counts))
        top = levels(c)
        size = int(-(-int(top.sum()) * BITS_PER_ENTRY // 64) * 64)
        bits = np.zeros(size, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            for at in _bits(k[top >= level], level, size):
                bits[at.astype(np.int64)] = True
        body = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"segment": group.column("segment").slice(0, 1), "grams": pa.array([len(k)]), "bits": pa.array([body], pa.binary())})

    packed = training.select("text").mapInArrow(tidy(count), "segment bigint, keys binary, few binary, many binary")
    return packed.repartition(tasks, "segment").groupBy("segment").applyInArrow(tidy_group(build), "segment bigint, grams bigint, bits binary")


class Filter:
    """Segments first to last (exclusive) of ``segments`` in all, end to end."""

    def __init__(self, segments: int, first: int, parts: dict[int, bytes], last: int):
        self.segments, self.first, self.last = segments, first, last
        blocks = [np.frombuffer(parts.get(s, b""), np.uint8) for s in range(first, last)]
        self.sizes = np.array([8 * len(b) for b in blocks], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bits = np.concatenate([*blocks, np.zeros(1, np.uint8)])

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram: probes of level after level until one is missing. 0 for n-grams of other slices."""
        seg = ((keys >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64) - self.first
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero((seg >= 0) & (seg < self.last - self.first))
        live = live[self.sizes[seg[live]] > 0]
        level = 1
        while len(live):
            k, s = keys[live], seg[live]
            size, start = self.sizes[s], self.starts[s]
            ok = np.arange(len(live))
            h = mix((k & _LOW) + np.full(1, level, np.uint64) * _ROLE[52])
            a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
            for i in range(PROBES):
                at = (((a[ok] + np.uint64(i) * b[ok]) & np.uint64(0xFFFFFFFF)) * size[ok] >> np.uint64(32)).astype(np.int64) + start[ok]
                ok = ok[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            live = live[ok]
            out[live] = level
            level += 1
        return out


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    return np.where(level > 0, (1.5 * 2.0 ** (level.astype(np.float64) - 1) - 0.5), 0.0)


def log10_prob(uni: np.ndarray, bi: np.ndarray, before: np.ndarray, total: int, kinds: int, mu: float) -> np.ndarray:
    """log10 of the smoothed probability of each token: bigram counts over their history's, with the smoothed unigram probability as ``mu`` further counts."""
    p1 = (expected(uni) + 0.5) / (total + 0.5 * (kinds + 1))
    h = expected(before)
    b = np.minimum(expected(bi), h)
    return np.log(((b + mu * p1) / (h + mu)).clip(1e-300)) / _LOG10


def score(docs: DataFrame, training: Column, *, doc_id: str = "doc_id", text: str = "text", mu: float = 100.0, slice_bytes: int = SLICE_BYTES, hot_words: int = HOT_WORDS, segment_grams: int = SEGMENT_GRAMS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text.

    The base is the add-half unigram score with exact counts; the score comes
    from the filter. Rows for which ``training`` isn't true are scored only.
    Null texts count as empty and are the end alone. Repeated ids and texts
    keep a row each; a null id doesn't train. Without training rows N and V are 0, and
    every token has probability one, unseen alone. An empty table gives an empty table; other columns are ignored.
    The score is the sum of the tokens' smoothed conditional probabilities (see ``log10_prob``). Counts are quantised and
    a filter has false positives, so those of one history sum to about one, not exactly, and another
    number of segments may move a score by a few per cent.
    Exact counts of the ``hot_words`` commonest words are broadcast, which bounds that table and
    leaves no frequent word to the shuffle; rarer words' hashes meet their counts there.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    learn = base.where("train")
    counts = written(word_counts(learn), "words")
    n, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot = counts.where(F.col("c") >= _threshold(counts, hot_words)).toArrow()
    key, value = hot.column("word").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(key)
    common = spark.sparkContext.broadcast((key[order], value[order]))

    segments = max(1, -(-int(n) // segment_grams))
    tasks = max(1, min(segments, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = written(build_segments(learn, segments, tasks), "filter")
    size = parts.agg(F.coalesce(F.max(F.length("bits")), F.lit(1))).first()[0]
    denominator = float(np.log10(int(n) + 0.5 * (int(kinds) + 1)))

    def finish(ids: pa.Array, words: np.ndarray, row: np.ndarray, uni: np.ndarray, bi: np.ndarray) -> pa.RecordBatch:
        keys, values = common.value
        before = np.empty_like(uni)
        before[1:] = uni[:-1]
        # A text's first token follows the start, which is as frequent as the end.
        before[row[:-1]] = uni[row[1:] - 1]
        value = sums(log10_prob(uni, bi, before, n, kinds, mu), row)
        one, back = np.unique(words, return_inverse=True)
        at = np.searchsorted(keys, one)
        at[at == len(keys)] = 0
        seen = keys[at] == one if len(keys) else np.zeros(len(one), bool)
        c = np.where(seen, values[at], 0) if len(keys) else np.zeros(len(one), np.int64)
        known = sums(seen[back].astype(np.int64), row)
        part = sums(np.where(seen, np.log10(c + 0.5), 0.0)[back], row)
        # Words that aren't hot: for each text and word, how often.
        rare = np.flatnonzero(~seen[back])
        owner, word = np.searchsorted(row, rare, "right") - 1, words[rare]
        order = np.lexsort((word, owner))
        owner, word = owner[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])) if len(rare) else rare
        times = np.diff(np.append(first, len(rare)))
        places = pa.array(np.searchsorted(owner[first], np.arange(len(row))), pa.int32())
        lists = [pa.ListArray.from_arrays(places, x) for x in (as_long(word[first]), pa.array(times))]
        return pa.record_batch([ids, pa.array(np.diff(row)), pa.array(known), pa.array(part), pa.array(value), *lists], ["doc_id", "n_tokens", "known", "part", "score", "rare", "times"])

    fields = "doc_id bigint, n_tokens bigint, known bigint, part double, score double, rare array<bigint>, times array<bigint>"
    whole = parts.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    if whole <= slice_bytes:
        held = _send(spark, parts, segments)

        def run(batches):
            for batch in steps(batches, "text", STEP):
                words, row = tokens(batch.column("text"))
                one, back = np.unique(words, return_inverse=True)
                yield finish(batch.column("doc_id"), words, row, held.value.level(unigram(one))[back], held.value.level(bigram(words, row)))

        scored = base.mapInArrow(tidy(run), fields)
    else:
        scored = _probed(base, parts, segments, max(1, min(HOME_BYTES, slice_bytes) // size), finish, fields)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    probes = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("tf"))
    met = probes.join(counts, "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("gain"))
    out = scored.drop("rare", "times").join(met, "row", "left")
    unseen = (F.col("n_tokens") - F.col("known")) * F.log10(F.lit(0.5))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("part") + unseen + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        "score",
    )


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach, from a histogram of quarter powers of two."""
    kind = F.floor(F.log2("c") * 4).cast("int").alias("kind")
    total = 0
    for row in counts.groupBy(kind).agg(F.count(F.lit(1)).alias("words"), F.max("c").alias("top")).orderBy(F.desc("kind")).collect():
        total += row["words"]
        if total > most:
            return row["top"] + 1
    return 1


def _send(spark, parts: DataFrame, segments: int):
    """The whole filter, broadcast. It reaches the driver a slice at a time and is filled in place, so that neither JVM nor Python holds it twice."""
    sizes = parts.select("segment", F.length("bits").alias("n")).toArrow()
    lengths = np.zeros(segments, np.int64)
    lengths[sizes.column("segment").to_numpy()] = sizes.column("n").to_numpy()
    bloom = Filter(segments, 0, {}, segments)
    bloom.sizes = (8 * lengths).astype(np.uint64)
    bloom.starts = np.concatenate([[0], np.cumsum(8 * lengths)])
    bloom.bits = np.zeros(int(lengths.sum()) + 1, np.uint8)
    per = max(1, HOME_BYTES // max(1, int(lengths.max(initial=0))))
    for first in range(0, segments, per):
        rows = parts.where(F.col("segment").between(first, first + per - 1)).select("segment", "bits").toArrow()
        for segment, bits in zip(rows.column("segment").to_pylist(), rows.column("bits")):
            at = int(bloom.starts[segment]) // 8
            bloom.bits[at : at + lengths[segment]] = np.frombuffer(bits.as_buffer(), np.uint8)
        del rows
    give_back()
    return spark.sparkContext.broadcast(bloom)


def _kinds(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a step, ascending, and so by segment."""
    return np.unique(np.concatenate([unigram(np.unique(words)), bigram(words, row)]))


def _probed(base: DataFrame, parts: DataFrame, segments: int, per: int, finish, fields: str) -> DataFrame:
    """The rows that ``finish`` makes of each step of texts, whose n-grams are probed in the slices of ``per`` segments that hold them.

    A step's tokens are written as hashes once. A slice that more than PROBED n-grams come to, as those of hot
    ones do, is copied to as many tasks as it takes.
    """

    def cut(batches):
        for batch in steps(batches, "text", STEP):
            words, row = tokens(batch.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            yield pa.record_batch([batch.column("row").slice(0, 1), ids, *[pa.array([x.tobytes()], pa.binary()) for x in (row.astype(np.int64), words)]], ["step", "ids", "row", "words"])

    numbered = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = written(numbered.mapInArrow(tidy(cut), "step bigint, ids array<bigint>, row binary, words binary"), "steps")

    def opened(words, row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(words.as_py(), np.uint64), np.frombuffer(row.as_py(), np.int64)

    def ask(batches):
        for batch in batches:
            for step, row, words in zip(batch.column("step"), batch.column("row"), batch.column("words")):
                keys = _kinds(*opened(words, row))
                home = ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) // per
                runs = _runs(home)
                packed = pa.array([keys[a:b].tobytes() for a, b in zip(runs[:-1], runs[1:])], pa.binary())
                yield pa.record_batch([pa.array([step.as_py()] * len(packed)), pa.array(home[runs[:-1]]), packed], ["step", "home", "keys"])

    asked = written(chunks.select("step", "row", "words").mapInArrow(tidy(ask), "step bigint, home bigint, keys binary"), "asked")
    copies = asked.groupBy("home").agg(F.ceil(F.sum(F.length("keys")) / (8 * PROBED)).alias("copies"))
    left = asked.join(copies, "home").select("step", "home", "keys", F.pmod(F.xxhash64("step"), "copies").alias("copy"))
    homes = parts.select(F.floor(F.col("segment") / per).alias("home"), "segment", "bits").join(copies, "home")
    right = homes.select("home", "segment", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))

    def probe(keys: pa.Table, bits: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return pa.table({"step": pa.array([], pa.int64()), "home": pa.array([], pa.int64()), "levels": pa.array([], pa.binary())})
        home = keys.column("home")[0].as_py()
        bloom = Filter(segments, home * per, dict(zip(bits.column("segment").to_pylist(), bits.column("bits").to_pylist())), min(segments, (home + 1) * per))
        levels = [bloom.level(np.frombuffer(k.as_py(), np.uint64)).tobytes() for k in keys.column("keys")]
        return pa.table({"step": keys.column("step"), "home": keys.column("home"), "levels": pa.array(levels, pa.binary())})

    told = left.groupBy("home", "copy").cogroup(right.groupBy("home", "copy")).applyInArrow(probe, "step bigint, home bigint, levels binary")

    def conclude(step: pa.Table, answers: pa.Table) -> pa.Table:
        words, row = opened(step.column("words")[0], step.column("row")[0])
        keys = _kinds(words, row)
        level = np.frombuffer(b"".join(answers.sort_by("home").column("levels").to_pylist()), np.uint8)
        uni, bi = (level[np.searchsorted(keys, x)] for x in (unigram(words), bigram(words, row)))
        return pa.Table.from_batches([finish(step.column("ids").combine_chunks().flatten(), words, row, uni, bi)])

    return chunks.groupBy("step").cogroup(written(told, "levels").groupBy("step")).applyInArrow(conclude, fields)
