"""Words and n-grams of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which is the
same as the character class ``[^\\x20\\x09-\\x0D]+`` because UTF-8 continuation
bytes never fall into that range. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of a task holds as arrays; a longer single text is hashed in pieces of this size.
STEP_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C13)
_INV = np.uint64(pow(int(_MUL), -1, 2**64))
_ROLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _POW[:] = [_powers(_MUL, size), _powers(_INV, size)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + _ROLE[salt])


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``limit`` bytes of ``column``, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column end to end, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


class Words:
    """The words of a text column: ``hash`` per word and ``row``, the n + 1 offsets of each row's words."""

    def __init__(self, column: pa.Array, table: np.ndarray = LOWER):
        self.data, self.at = raw(column)
        data, at = self.data, self.at
        n = len(data)
        if n:
            full = ~_SPACE[data]
            cut = np.zeros(n + 1, bool)
            cut[at] = True
            begins = full.copy()
            begins[1:] &= ~full[:-1] | cut[1:n]
            ends = full.copy()
            ends[:-1] &= ~full[1:] | cut[1:n]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.row = np.searchsorted(self.start, at)
        self.hash = spans(data, self.start, self.end, table)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def owner(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), self.counts)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """A hash for each byte span; equal bytes (after ``table``) give equal hashes wherever they stand. Spans ascend and don't overlap."""
    out = np.empty(len(start), np.uint64)
    values = _BYTE[table]
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + STEP_BYTES, "right")))
        if to == at + 1 and end[at] - low > STEP_BYTES:
            out[at] = _long(data[low : end[at]], values)
        else:
            s, e = start[at:to] - low, end[at:to] - low
            up, down = _tables(int(e[-1]) + 1)
            part = data[low : low + e[-1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out + (end - start).astype(np.uint64) * _ROLE[0])


def _long(part: np.ndarray, values: np.ndarray) -> np.uint64:
    """A span longer than a step: its pieces' polynomials, each shifted by its place."""
    up, _ = _tables(STEP_BYTES + 1)
    total, place = np.zeros(1, np.uint64), 1
    for i in range(0, len(part), STEP_BYTES):
        piece = part[i : i + STEP_BYTES]
        total += (values[piece] * up[: len(piece)]).sum(dtype=np.uint64) * np.uint64(place)
        place = place * pow(int(_MUL), len(piece), 2**64) % 2**64
    return total[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row, without regard to rows: element i covers words i to i + n - 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _ROLE[1 + k]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of n-word shingles as ascending hashes, end to end, and the offsets of the rows.

    A row of fewer than n words has its whole word sequence as its one shingle; a row without words has none.
    """
    w = Words(column)
    all_grams = grams(w.hash, n)
    parts = []
    for a, b in zip(w.row[:-1].tolist(), w.row[1:].tolist()):
        if b - a >= n:
            parts.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            parts.append(grams(w.hash[a:b], b - a) + _ROLE[40])
        else:
            parts.append(np.zeros(0, np.uint64))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def sums(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of each row's values, 0 for a row without any."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[row[1:]] - total[row[:-1]]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
