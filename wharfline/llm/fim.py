"""Fill-in-middle transformation: texts cut in three and put in an order that lets a model see both ends first.

The cuts of all texts of a step are found together, over the Arrow buffer that
holds them end to end: a table gives the class of each byte, a second one tells
from the classes of adjacent bytes where a unit begins, cumulative sums that start
anew at each document number the units, and one binary search finds all cuts.
The pieces between cuts are then an Arrow array over the same buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy
from wharfline.llm.text import raw, steps

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Text bytes cut in one step; a longer text is a step of its own.
STEP = 1 << 22
OUT = ["n", "form", "prefix_units", "middle_units", "output"]

_LETTER, _REST, _SPACE, _LINE = range(4)
_CLASS = np.full(256, _LETTER, np.uint8)
_CLASS[0x80:0xC0] = _REST
_CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_CLASS[0x0A] = _LINE


def _begins(*pairs: tuple[int, int]) -> np.ndarray:
    out = np.zeros((4, 4), bool)
    for before, here in pairs:
        out[before, here] = True
    return out


#: Where a unit begins, by the classes of the byte before and the byte itself. Words keep the white space after them, lines their line end.
UNITS = {
    "char": _begins(*[(a, b) for a in range(4) for b in (_LETTER, _SPACE, _LINE)]),
    "word": _begins((_SPACE, _LETTER), (_LINE, _LETTER)),
    "line": _begins(*[(_LINE, b) for b in (_LETTER, _SPACE, _LINE)]),
}


def unit_counts(data: np.ndarray, at: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray]:
    """Units begun up to each byte of ``data`` (included), and those of all documents before each of the n + 1 offsets ``at``; a document that has bytes begins a unit."""
    kind = _CLASS[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = UNITS[unit][kind[:-1], kind[1:]]
    starts[at[:-1][np.diff(at) > 0]] = True
    total = np.cumsum(starts, dtype=np.int32)
    return total, np.concatenate([np.zeros(1, np.int32), total])[at]


def cut_places(total: np.ndarray, before: np.ndarray, at: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte where unit ``units[i]`` of document i begins, or the document's end if it has no more."""
    return np.minimum(np.searchsorted(total, before[:-1] + units.astype(np.int32), "right"), at[1:])


def _joined(pieces: pa.Array, order: tuple[int, int, int]) -> pa.Array:
    """Mark and piece, thrice; ``order`` names the pieces (prefix 0, middle 1, suffix 2)."""
    mark = {0: MARKS[0], 1: MARKS[2], 2: MARKS[1]}
    parts = [x for k in order for x in (pa.scalar(mark[k], pa.large_string()), pieces.take(pa.array(np.arange(k, len(pieces), 3))))]
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))


def fim_batch(text: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray, *, unit: str = "char", keep_plain: int = 10, spm: int = 20) -> list[pa.Array]:
    """OUT for a column of texts and four draws a row: units, form, prefix and middle units (null if plain) and output. Null texts count as empty."""
    data, at = raw(text)
    total, before = unit_counts(data, at, unit)
    n = np.diff(before).astype(np.int64)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    whole = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    marked = np.zeros(len(n), bool)
    for m in MARKS:
        marked |= pc.match_substring(whole, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= 100 - keep_plain)
    first, second = cut_places(total, before, at, low), cut_places(total, before, at, high)
    edges = np.column_stack([at[:-1], first, second]).reshape(-1)
    pieces = pa.Array.from_buffers(pa.large_string(), 3 * len(n), [None, pa.py_buffer(np.append(edges, at[-1:]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    suffix_first = h4 % 100 < spm
    rows = [np.flatnonzero(m) for m in (plain, ~plain & suffix_first, ~plain & ~suffix_first)]
    outputs = [whole.take(pa.array(rows[0]))]
    for at_rows, order in ((rows[1], (2, 0, 1)), (rows[2], (0, 2, 1))):
        outputs.append(_joined(pieces.take(pa.array((3 * at_rows[:, None] + np.arange(3)).reshape(-1))), order))
    place = np.empty(len(n), np.int64)
    place[np.concatenate(rows)] = np.arange(len(n))
    output = pa.concat_arrays(outputs).take(pa.array(place))
    form = pa.array(np.array(["psm", "spm", "plain"])[np.where(plain, 2, suffix_first.astype(int))])
    return [pa.array(n), form, pa.array(low, mask=plain), pa.array(high - low, mask=plain), output]


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit integers from the sha256 of the seed, a colon and the key's text; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fim(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, unit: str = "char", seed: int = 1, keep_plain: int = 10, spm: int = 20) -> DataFrame:
    """Columns ``keep`` (all but the text, by default) with the units n of each whole text, its form, prefix_units, middle_units and output.

    A text is cut at two of its n + 1 unit borders (``unit``: char, word or line), drawn
    from a hash of ``seed`` and the key, so reruns and copies of a row agree. Of every 100
    texts ``keep_plain`` stay plain, as do empty ones and those that hold a mark; of
    every 100 others ``spm`` put the suffix first. A null text counts as empty, a null key
    as the empty key; long texts are cut whole; equal keys draw alike; an empty table gives an empty table.
    Kept columns named like new ones are replaced. Cuts of plain texts are null.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != text and c not in OUT]
    body, draw = fresh("text"), [fresh(f"h{i}") for i in range(4)]

    def build(batches):
        for batch in steps(batches, body, STEP):
            h = [batch.column(d).to_numpy() for d in draw]
            found = fim_batch(batch.column(body), *h, unit=unit, keep_plain=keep_plain, spm=spm)
            yield pa.record_batch([*batch.columns[: len(kept)], *found[:-1], found[-1].cast(pa.string())], [*kept, *OUT])

    frame = docs.select(*kept, F.col(text).alias(body), *[h.alias(d) for h, d in zip(draws(F.col(key), seed), draw)])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[: len(kept)])
    return frame.mapInArrow(tidy(build), kinds + "n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form; null if either is null or the output lacks the form's marks.

    A cut text holds no mark, so the first ones found are those that were put in.
    """
    psm = F.split(output, "<[PSM]>", -1)
    back = F.when(form == "psm", F.concat(psm[1], psm[3], psm[2])).when(form == "spm", F.concat(psm[2], psm[3], psm[1]))
    return F.when(form == "plain", output).when(F.size(psm) == 4, back)
