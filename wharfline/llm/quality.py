"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader, scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy
from wharfline.llm.labelled import balance, labelled_sample
from wharfline.llm.text import _ROLE, SAME, Words, mix, steps, sums

BITS = 18
#: Byte classes of a word's shape: small letters (all bytes beyond ASCII too), capitals, digits; any other byte is a class of its own.
_CLASS = SAME.copy()
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def shapes(w: Words) -> np.ndarray:
    """A hash for the shape of each word: its byte classes with runs written once, so that "Ab12!!" and "Xyz7!" agree."""
    kind = _CLASS[w.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[w.start] = True
    # Only the bytes that begin a run inside a word count, each with its rank among the word's runs.
    size = w.end - w.start
    inside = np.arange(size.sum()) + np.repeat(w.start - np.cumsum(size) + size, size)
    run = np.cumsum(first)
    rank = run[inside] - np.repeat(run[w.start], size)
    value = np.zeros(len(kind), np.uint64)
    value[inside] = np.where(first[inside], mix((rank.astype(np.uint64) << np.uint64(8)) + kind[inside].astype(np.uint64) + np.uint64(1)), np.uint64(0))
    total = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[w.end] - total[w.start])


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each text's word n-grams, end to end, and the offsets of the texts.

    Per word: the n-grams of one, two and three words that end with it, the
    same of the words' shapes, and whether it repeats one of the two words before
    it. Before the first words stands nothing, which makes n-grams of its own.
    """
    w = Words(column, SAME)
    n = len(w)
    owner = w.owner()
    same1, same2 = np.zeros(n, bool), np.zeros(n, bool)
    same1[1:] = owner[1:] == owner[:-1]
    same2[2:] = owner[2:] == owner[:-2]
    columns = []
    for role, one in ((12, w.hash), (13, shapes(w))):
        before, before2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:] = np.where(same1[1:], one[:-1], np.uint64(0))
        before2[2:] = np.where(same2[2:], one[:-2], np.uint64(0))
        two = mix(one * _ROLE[role + 4] + before * _ROLE[11])
        columns += [mix(one + _ROLE[role]), two, mix(two + before2 * _ROLE[14])]
    again = np.zeros(n, np.uint64)
    again[1:] += np.where(same1[1:] & (w.hash[1:] == w.hash[:-1]), np.uint64(1), np.uint64(0))
    again[2:] += np.where(same2[2:] & (w.hash[2:] == w.hash[:-2]), np.uint64(2), np.uint64(0))
    columns.append(mix(again + _ROLE[15]))
    return (np.stack(columns, axis=1).reshape(-1) >> np.uint64(64 - bits)).astype(np.int64), w.row * len(columns)


def unit(counts: np.ndarray) -> np.ndarray:
    """What a dot product is divided by for a text of so many features: their number, 1 at least."""
    return np.maximum(counts, 1).astype(np.float64)


class Ftrl:
    """Logistic regression under follow-the-regularised-leader with per-coordinate rates; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


SCALE = 20.0


def fit(sample: pa.Table, bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Weights of the buckets and the bias, from columns text and label; the mean label alone where there are no texts of both labels."""
    model = Ftrl(1 << bits)
    labels = sample.column("label").to_numpy()
    rows = []
    for batch in sample.select(["text"]).to_batches():
        for part in steps([batch]):
            at, ends = features(part.column("text"), bits)
            for a, b in zip(ends[:-1], ends[1:]):
                key, count = np.unique(at[a:b], return_counts=True)
                rows.append((np.append(key, 1 << bits), np.append(count * (SCALE / unit(b - a)), 1.0)))
    weight = balance(labels, 5.0)
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], labels[i], weight[i])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``out``, in place of a column of that name; other columns stay, whatever their names.

    Null texts count as empty; an empty text gets the bias's probability; long texts are scored whole. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != out]
    frame = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body := fresh("text")))
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = shared.value
        for batch in steps(batches, body):
            at, row = features(batch.column(body), bits)
            dot = sums(w[at].astype(np.float64), row) * SCALE / unit(np.diff(row)) + w[-1]
            yield pa.record_batch([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [*kept, out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(tidy(run), f"{kinds}`{out}` double")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, *, rows: int = 4000, total_bytes: int = 24 << 20) -> np.ndarray:
    """Weights from a bounded sample of the labelled rows that ``allowed`` admits; see ``labelled_sample`` for the bounds."""
    return fit(labelled_sample(docs, labels, "quality", allowed, rows=rows, total_bytes=total_bytes))
