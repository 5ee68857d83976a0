"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy
from wharfline.llm.labelled import balance, labelled_sample
from wharfline.llm.text import mix, raw, steps

ORDERS = (4, 5, 6)
BITS = 21
#: Text bytes of a step.
STEP = 1 << 18

#: White space and punctuation of ASCII count as one character, so that a word's edges look alike.
_FOLD = np.arange(128, dtype=np.uint64)
_FOLD[:48] = _FOLD[58:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case, by Unicode; bytes that are no UTF-8 become replacement characters."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return pa.array([(v or b"").decode(errors="replace").lower() for v in column.cast(pa.binary()).to_pylist()])


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (code point) of the texts, end to end, and the offsets of the texts."""
    data, at = raw(lowered(column))
    begins = (data & 0xC0) != 0x80
    begins[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(data)))
    code = data[start].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] |= data[start[more] + k].astype(np.uint64) << np.uint64(8 * k)
    ascii_ = code < 128
    code[ascii_] = _FOLD[code[ascii_].astype(np.int64)]
    return code, np.searchsorted(start, at)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each text's character n-grams of all orders, end to end, and the offsets of the texts.

    Each text stands between two spaces. Texts shorter than an order have no n-gram of it.
    """
    code, at = characters(column)
    n = len(at) - 1
    ends = at + 2 * np.arange(n + 1)
    base = np.full(len(code) + 2 * n, 32, np.uint64)
    inner = np.ones(len(base), bool)
    inner[ends[:-1]] = inner[ends[1:] - 1] = False
    base[inner] = code
    total = len(base)
    left = ends[1:].repeat(np.diff(ends)) - np.arange(total)
    h = np.zeros(total, np.uint64)
    found = np.zeros((total, len(ORDERS)), np.int64)
    valid = np.zeros((total, len(ORDERS)), bool)
    mul = np.uint64(0x9E3779B97F4A7C13)
    for k in range(max(ORDERS)):
        h[: total - k] = h[: total - k] * mul + base[k:]
        if k + 1 in ORDERS:
            j = ORDERS.index(k + 1)
            found[:, j] = (mix(h + np.uint64(k + 1)) >> np.uint64(64 - bits)).astype(np.int64)
            valid[:, j] = left >= k + 1
    kept = found[valid]
    return kept, np.concatenate([[0], np.cumsum(valid.sum(axis=1))])[ends]


class Model:
    """``weight`` per bucket, the linear weight times the naive Bayes ratio, and ``bias``."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def dots(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The dot product of each text's set of buckets: a bucket counts once however often it comes."""
        w = self.weight[at]
        hit = np.flatnonzero(w)
        owner = np.searchsorted(row, hit, "right") - 1
        key = np.unique(owner * len(self.weight) + at[hit])
        return np.bincount(key // len(self.weight), self.weight[key % len(self.weight)], len(row) - 1) + self.bias


def ratios(counts: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """Naive Bayes log-count ratios of presence: counts of texts by label and bucket, n texts by label."""
    rate = [(counts[k] + alpha) / (n[k] + 2 * alpha) for k in (0, 1)]
    return np.log(rate[1] / rate[0])


def fit(sample: pa.Table, bits: int = BITS, *, keep: int = 1 << 15, least: int = 3, tiny: float = 1e-3, alpha: float = 1.0, l2: float = 2e-4, rounds: int = 300, most: float = 3.0) -> Model:
    """Naive Bayes log-count ratios of bucket presence, then logistic regression on chosen buckets, each scaled by its ratio.

    Of the buckets that ``least`` texts of the sample have, the ``keep`` whose ratio is surest (most
    standard errors from 0) are chosen; weights below ``tiny`` become 0. Rows of the rarer label weigh more, ``most`` at most.
    These bounds are the model's, not the corpus's: each text is scored by all its n-grams.
    """
    size, labels = 1 << bits, sample.column("label").to_numpy()
    counts = np.zeros((2, size), np.int32)
    sets = []
    parts = [p for b in sample.select(["text"]).to_batches() for p in steps([b], limit=STEP)]
    for part in parts:
        at, row = features(part.column("text"), bits)
        for a, b in zip(row[:-1], row[1:]):
            one = np.unique(at[a:b]).astype(np.int32)
            counts[labels[len(sets)], one] += 1
            sets.append(one)
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    ratio = ratios(counts, n, alpha)
    sure = np.abs(ratio) / np.sqrt(1 / (counts[1] + alpha) + 1 / (counts[0] + alpha)) * (counts.sum(axis=0) >= least)
    chosen = np.sort(np.argpartition(sure, -keep)[-keep:]) if keep < size else np.arange(size)
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    hits = [p[p >= 0] for p in (place[s] for s in sets)]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in hits])
    col = np.concatenate(hits) if hits else np.zeros(0, np.int32)
    r = ratio[chosen]
    x = r[col]
    y = labels.astype(np.float64)
    w, bias = np.zeros(len(chosen)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    weigh = balance(labels, most)
    weigh = weigh / max(weigh.sum(), 1e-9)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        dot = np.bincount(row, x * w[col], len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(dot, -35, 35))) - y) * weigh
        grad = np.bincount(col, x * g[row], len(w)) + l2 * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        bias -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    weight = np.zeros(size, np.float32)
    weight[chosen] = w * r
    weight[np.abs(weight) < tiny] = 0
    return Model(weight, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``out``, in place of a column of that name; other columns stay, whatever their names.

    Null texts count as empty; an empty text gets the bias's probability; long texts are scored whole. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != out]
    frame = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body := fresh("text")))
    bits = int(np.log2(len(model.weight)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in steps(batches, body, STEP):
            dot = model.dots(*features(batch.column(body), bits))
            yield pa.record_batch([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [*kept, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(tidy(run), f"{kinds}`{out}` double")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, rows: int = 6000, total_bytes: int = 16 << 20) -> Model:
    """A model of a bounded sample of the labelled rows that ``allowed`` admits; see ``labelled_sample`` for the bounds."""
    return fit(labelled_sample(docs, labels, "toxic", allowed, rows=rows, total_bytes=total_bytes))
