"""SQL dumps as other programs write them: read in parallel from any byte, cut into statements, tokens and rows.

A dump comes as pieces cut anywhere. Which bytes are code, quoted or comment depends on all
bytes before, so each piece is first turned into a function from the state before it to the
state after it; these functions are composed by a prefix scan over blocks of pieces, and
each piece then knows the state it begins in. Statements that lie inside a piece never
leave its task; those across pieces are put together by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.operators.extract import running_sums
from wharfline.operators.shared import written

#: Pieces of a block of the scan, and bytes that lines of a file are joined up to.
BLOCK = 1024
PIECE_BYTES = 1 << 16
#: Bytes that pieces of a block are joined up to.
PACKED_BYTES = 1 << 19
#: Bytes whose functions are composed at once.
CHUNK = 1 << 15
#: Longest statement that is read; longer ones are refused.
STATEMENT_BYTES = 5 << 20
#: Bytes of text that a Python task turns into objects at once.
SLICE_BYTES = 1 << 20

# --- the automaton -----------------------------------------------------------

#: A backslash escapes in strings, not in names; -- begins a comment before white space or a control character only; /*! and /*M! begin code.
STATES = ("code", "single", "single_escape", "double", "double_escape", "name", "dash", "dashes", "line", "slash", "open", "open_m", "block", "block_star")
_S = {name: i for i, name in enumerate(STATES)}


def _transitions() -> np.ndarray:
    """The state after each byte, by byte and state before."""
    code = {"'": "single", '"': "double", "`": "name", "#": "line", "-": "dash", "/": "slash"}
    blank = {chr(c): "line" for c in range(33)} | {"\n": "code"}
    # State: where it goes at certain bytes, and at all others (None: as code does).
    rules = {
        "code": (code, "code"),
        "single": ({"\\": "single_escape", "'": "code"}, "single"),
        "single_escape": ({}, "single"),
        "double": ({"\\": "double_escape", '"': "code"}, "double"),
        "double_escape": ({}, "double"),
        "name": ({"`": "code"}, "name"),
        "dash": ({"-": "dashes"}, None),
        "dashes": (blank | {"-": "dashes"}, None),
        "line": ({"\n": "code"}, "line"),
        "slash": ({"*": "open"}, None),
        "open": ({"!": "code", "M": "open_m", "*": "block_star"}, "block"),
        "open_m": ({"!": "code", "*": "block_star"}, "block"),
        "block": ({"*": "block_star"}, "block"),
        "block_star": ({"/": "code", "*": "block_star"}, "block"),
    }
    out = np.empty((256, len(STATES)), np.uint8)
    for state, (special, other) in rules.items():
        for byte in range(256):
            c = chr(byte)
            out[byte, _S[state]] = _S[special.get(c) or (other if other else code.get(c, "code"))]
    return out


_STEP = _transitions()
_SAME = np.arange(len(STATES), dtype=np.uint8)
#: States in which a semicolon ends a statement.
_ENDS = np.isin(_SAME, [_S[s] for s in ("code", "dash", "dashes", "slash")])


#: Bytes of their own effect. All others have that of the first of them: after one, a second changes no state.
_SPECIAL = np.isin(np.arange(256), np.frombuffer(b"'\"`\\#-/*!M\n", np.uint8))


def _kept(codes: np.ndarray) -> np.ndarray:
    """Which bytes can change the state: special ones, those after them, and the first."""
    special = _SPECIAL[codes]
    keep = special.copy()
    keep[1:] |= special[:-1]
    keep[:1] = True
    return keep


def _levels(codes: np.ndarray) -> list[np.ndarray]:
    """Functions of single bytes, of pairs, of fours, and so on up to all, each as the states after it by the state before."""
    levels = [_STEP[codes]]
    while len(levels[-1]) > 1:
        now = levels[-1]
        if len(now) % 2:
            now = levels[-1] = np.concatenate([now, _SAME[None, :]])
        rows = np.arange(len(now) // 2)[:, None] * len(STATES)
        levels.append(now[1::2].reshape(-1)[rows + now[0::2]])
    return levels


def _chunks(body: bytes) -> list[np.ndarray]:
    return [np.frombuffer(body[a : a + CHUNK], np.uint8) for a in range(0, len(body), CHUNK)]


def step_of(body: bytes) -> np.ndarray:
    """The state after ``body`` for each state before it."""
    now = _SAME
    for chunk in _chunks(body):
        now = _levels(chunk[_kept(chunk)])[-1][0][now]
    return now


def states_before(body: bytes, state: int) -> np.ndarray:
    """The state before each byte, beginning in ``state``."""
    found = [np.zeros(0, np.uint8)]
    for chunk in _chunks(body):
        keep = _kept(chunk)
        codes, now = chunk[keep], np.array([state], np.uint8)
        for level in reversed(_levels(codes)[:-1]):
            now = now[: len(level) // 2]
            out = np.empty(len(level), np.uint8)
            out[0::2] = now
            out[1::2] = level[0::2][np.arange(len(now)), now]
            now = out
        now = now[: len(codes)]
        after = _STEP[codes, now]
        out = after[np.cumsum(keep) - 1]
        out[keep] = now
        found.append(out)
        state = after[-1]
    return np.concatenate(found)


# --- pieces --------------------------------------------------------------------


def cut(parts: DataFrame, size: int) -> DataFrame:
    """dump, piece and body (binary) of ``size`` bytes each from parts (dump, at, body binary), ``at`` the offset of a part in its dump. Parts of no bytes and nulls add nothing."""
    some = parts.where("dump is not null and octet_length(body) > 0").withColumn("_n", F.octet_length("body").cast("bigint"))
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("_n") - 1) / size)
    each = some.select("dump", "at", "body", F.explode(F.sequence(first, last)).alias("piece"))
    begin = F.greatest(F.lit(0), F.col("piece") * size - F.col("at"))
    end = (F.col("piece") + 1) * size - F.col("at")
    held = each.select("dump", "piece", "at", F.substring("body", (begin + 1).cast("int"), (end - begin).cast("int")).alias("body"))
    return held.groupBy("dump", "piece").agg(_concat(F.collect_list(F.struct("at", "body")), "body").alias("body"))


def _concat(parts: Column, body: str) -> Column:
    """Binary fields of structs, in the structs' order, end to end."""
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p[body].cast("string")), "").cast("binary")


def read_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """dump (the file), piece and body of text files of any size: each task joins the lines of its part of a file up to PIECE_BYTES.

    A piece is numbered by the place where its part of the file begins and the lines
    before it there, which are never more than the part's bytes; so numbers ascend along the file and no row is sent. A file's end counts as a line's end.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, line, first, held, size = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part[0]]), pa.array([part[1] + first], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["dump", "piece", "body"])

        for batch in batches:
            for name, start, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, start) != part or size >= PIECE_BYTES:
                    if held:
                        yield out()
                    line = line if (name, start) == part else 0
                    part, first, held, size = (name, start), line, [], 0
                held += [body, b"\n"]
                size += len(body) + 1
                line += 1
        if held:
            yield out()

    lines = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("body"))
    return lines.mapInArrow(join, "dump string, piece bigint, body binary")


# --- the scan ------------------------------------------------------------------


def entry_states(steps: DataFrame) -> DataFrame:
    """dump, piece and state: the state that each piece begins in, from steps (dump, piece, step array<int>).

    Blocks of pieces are composed in a task each, and the blocks' own functions by
    the same scan, until a dump is one block.
    """

    def compose(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        now, before = _SAME.astype(np.int32), []
        for step in group.column("step").to_pylist():
            before.append(now.tolist())
            now = np.array(step, np.int32)[now]
        total = [None] * (group.num_rows - 1) + [now.tolist()]
        kind = pa.list_(pa.int32())
        return pa.table([group.column("dump"), group.column("block"), group.column("piece"), pa.array(before, kind), pa.array(total, kind)], ["dump", "block", "piece", "before", "total"])

    blocks = steps.withColumn("block", F.floor(F.col("piece") / BLOCK))
    known = written(blocks.groupBy("dump", "block").applyInArrow(compose, "dump string, block bigint, piece bigint, before array<int>, total array<int>"), "dump-states")
    ends = known.where("total is not null").select("dump", F.col("block").alias("piece"), F.col("total").alias("step"))
    if (ends.groupBy("dump").count().agg(F.max("count")).first()[0] or 0) <= 1:
        return known.select("dump", "piece", F.get("before", F.lit(_S["code"])).alias("state"))
    entered = entry_states(ends).select("dump", F.col("piece").alias("block"), F.col("state").alias("entered"))
    return known.join(entered, ["dump", "block"]).select("dump", "piece", F.get("before", F.col("entered")).alias("state"))


def statements(pieces: DataFrame, any_length: bool = False) -> DataFrame:
    """dump, number (from 0), at, bytes, closed and body of each statement of pieces (dump, piece, body), its semicolon included.

    What stands between statements belongs to the one after it. What comes after the last semicolon is a row
    that isn't closed. A statement beyond STATEMENT_BYTES has a null body, unless they may have ``any_length``. Pieces are numbered in
    order, with or without gaps; null dumps and bodies are left out, an empty table gives none.
    """
    pieces = pieces.where("dump is not null and body is not null").select("dump", "piece", "body")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None

        def out() -> pa.RecordBatch:
            body = b"".join(held)
            return pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([body], pa.binary()), pa.array([step_of(body).astype(np.int32).tolist()], pa.list_(pa.int32()))], ["dump", "piece", "body", "step"])

        # Pieces of a block that come one after the other become one.
        for batch in in_slices(batches, "body"):
            for dump, piece, body in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (size + len(body) > PACKED_BYTES or (dump, piece // BLOCK) != (at[0], at[1] // BLOCK)):
                    yield out()
                    held, size = [], 0
                if not held:
                    at = (dump, piece)
                held.append(body)
                size += len(body)
        if held:
            yield out()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "body"):
            rows = []
            for dump, piece, body, state in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.flatnonzero((np.frombuffer(body, np.uint8) == 0x3B) & _ENDS[states_before(body, state)]) + 1
                edges = [0, *ends.tolist()] + ([len(body)] if not len(ends) or ends[-1] < len(body) else [])
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append((dump, piece, k, a, body[a:b], 0 < k < len(ends), k < len(ends), len(ends) if k == 0 else 0, len(body) if k == 0 else 0))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 9
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["dump", "piece", "k", "from", "body", "whole", "closed", "ends", "size"])

    # Bodies are sent once, to their blocks, and lie there in few large pieces; what is told of these is small.
    blocks = pieces.withColumn("_block", F.floor(F.col("piece") / BLOCK)).repartition("dump", "_block").sortWithinPartitions("dump", "piece").select("dump", "piece", "body")
    packed = written(blocks.mapInArrow(pack, "dump string, piece bigint, body binary, step array<int>"), "dump-pieces")
    entered = entry_states(packed.select("dump", "piece", "step"))
    parts = packed.select("dump", "piece", "body").join(entered, ["dump", "piece"]).mapInArrow(split, "dump string, piece bigint, k int, from int, body binary, whole boolean, closed boolean, ends bigint, size bigint")
    parts = written(parts, "dump-parts")
    places = written(running_sums(parts.where("k = 0").select("dump", "piece", "ends", "size"), ["dump"], "piece", ["ends", "size"], BLOCK).select("dump", "piece", "ends_before", "size_before"), "dump-places")
    placed = parts.join(places, ["dump", "piece"])
    placed = placed.select("dump", (F.col("ends_before") + F.col("k")).alias("number"), (F.col("size_before") + F.col("from")).alias("at"), "body", "whole", "closed")
    n = F.octet_length("body").cast("bigint")
    fit = lambda size: F.lit(True) if any_length else size <= STATEMENT_BYTES
    whole = placed.where("whole").select("dump", "number", "at", n.alias("bytes"), "closed", F.when(fit(n), F.col("body")).alias("body"))
    # Only what crosses pieces is sent; sizes are summed before bodies meet.
    crossing = placed.where("not whole")
    sizes = crossing.groupBy("dump", "number").agg(F.min("at").alias("first"), F.sum(n).alias("bytes"), F.max("closed").alias("closed"))
    fits = crossing if any_length else crossing.join(sizes.where(fit(F.col("bytes"))).select("dump", "number"), ["dump", "number"])
    joined = fits.groupBy("dump", "number").agg(_concat(F.collect_list(F.struct("at", "body")), "body").alias("body"))
    stitched = sizes.join(joined, ["dump", "number"], "left").select("dump", "number", F.col("first").alias("at"), "bytes", "closed", "body")
    return whole.unionByName(stitched)


# --- tokens --------------------------------------------------------------------

_SPACES = rb"[ \t\r\n\x0b\x0c]+"
_TOKEN = re.compile(
    rb"(?:" + _SPACES + rb")?+(?:"
    rb"(?P<comment>\#[^\n]*\n?|--(?=[\x00-\x20]|\Z)[^\n]*\n?|/\*(?!!|M!)[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z))"
    rb"|(?P<vopen>/\*M?![0-9]*)"
    rb"|(?P<str>'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|\"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+\")"
    rb"|(?P<id>`(?:[^`]|``)+`)"
    rb"|(?P<word>[A-Za-z0-9_$\x80-\xff]+)"
    rb"|(?P<end>;)"
    rb"|(?P<p>.)"
    rb"|\Z)",
    re.S,
)
TOKEN = "array<struct<kind: string, from: int, to: int, value: binary>>"


def tokens_of(body: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, from, to, value) of a statement's tokens: str, id (value: the name), word, p, vopen, vclose, end, comment; "bad" for what no statement may hold: a quote never closed, a versioned comment inside another or open at the end."""
    out, versioned, at, closed = [], False, 0, True
    while closed:
        closed = False
        for m in _TOKEN.finditer(body, at):
            kind = m.lastgroup
            if kind is None:
                break
            value = m[kind]
            to = m.end()
            at = to - len(value)
            if kind == "p":
                if value == b"*" and versioned and body[to : to + 1] == b"/":
                    # The next token begins after the slash.
                    out.append(("vclose", at, to + 1, b"*/"))
                    versioned, closed, at = False, True, to + 1
                    break
                if value in (b"'", b'"', b"`"):
                    kind = "bad"
            elif kind == "id":
                value = value[1:-1].replace(b"``", b"`")
            elif kind == "vopen":
                kind, versioned = ("bad" if versioned else kind), True
            elif kind == "end" and versioned or kind == "comment" and value[:2] == b"/*" and (len(value) < 4 or value[-2:] != b"*/"):
                kind = "bad"
            out.append((kind, at, to, value))
    return out


#: Kinds of tokens by number, as ``lexed`` tells them; a blank is none.
KINDS = ("comment", "vopen", "vclose", "str", "id", "word", "p", "end", "bad", "blank")
K = {kind: i for i, kind in enumerate(KINDS)}
#: Code with its quoted names, up to another quote or what may begin or end a comment; and what stands between these, each a token of _TOKEN.
_PIECE = re.compile(
    rb"(?:[^'\"`#\-/*]++|`(?:[^`]++|``)+`)++|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|\"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+\""
    rb"|\#[^\n]*\n?|--(?=[\x00-\x20]|\Z)[^\n]*\n?|/\*(?!!|M!)[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)"
    rb"|/\*M?![0-9]*|\*/|.",
    re.S,
)
#: The kind of a token of more than one byte, by its first byte.
_LONG = np.full(256, K["p"], np.uint8)
_LONG[[c for c in range(256) if chr(c).isalnum() and c < 128 or c in b"_$" or c >= 128]] = K["word"]
for _bytes, _kind in ((b" \t\r\n\x0b\x0c", "blank"), (b"'\"", "str"), (b"`", "id"), (b"#-/", "comment"), (b"*", "vclose"), (b";", "end")):
    _LONG[list(_bytes)] = K[_kind]
#: The same for single bytes; those that are a token each in code, and what ends code.
_SHORT = _LONG.copy()
_SHORT[list(b"'\"`")], _SHORT[list(b"-/*")] = K["bad"], K["p"]
_SINGLE = (_SHORT == K["p"]) | (_SHORT == K["end"])
_TURNS = np.isin(np.arange(len(KINDS)), [K["vopen"], K["vclose"], K["end"]])
_PLAIN = ~np.isin(np.arange(256), list(b"'\"`#-/*"))


def bytes_at(values: pa.Array, where: np.ndarray, place: int = 0) -> np.ndarray:
    """The byte at ``place`` of each of the values numbered ``where``; 0 where they are shorter."""
    edges = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    if not len(data):
        return np.zeros(len(where), np.uint8)
    at = edges[:-1][where] + place
    return np.where(at < edges[1:][where], data[np.minimum(at, len(data) - 1)], 0)


def lexed(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The tokens that ``tokens_of`` finds in each body, as columns: the body's number, the kind's (K), from, to and value.

    One pattern cuts the bodies into code and what isn't, and code is cut into tokens, and kinds are told, for all bodies at once; bodies in which comments aren't closed as usual are read by ``tokens_of``.
    """
    cut = _PIECE.findall
    data = b"".join(b for b in bodies if b)
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32), pa.array([], pa.binary())
    sizes = np.fromiter(map(len, chain.from_iterable(cut(b) for b in bodies if b)), np.int64)
    codes = np.frombuffer(data, np.uint8)
    pieces = np.cumsum(sizes) - sizes
    # In code a token begins where the kind of bytes changes, and with each byte that is one by itself; every second quote of a name ends it or is doubled.
    byte, tick = codes[pieces], codes == 0x60
    code = np.repeat(_PLAIN[byte] | (byte == 0x60) & (sizes > 1), sizes)
    tick &= code
    named = (np.cumsum(tick, dtype=np.int32) & 1).astype(bool) | tick
    short = np.where(named, K["id"], _SHORT[codes])
    begins = code & _SINGLE[codes] & ~named
    begins[1:] |= code[1:] & (short[1:] != short[:-1])
    begins[pieces] = True
    edges = np.append(np.flatnonzero(begins), len(codes)).astype(np.int32)
    size, byte = np.diff(edges), codes[edges[:-1]]
    value = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    ends = np.cumsum([len(b or b"") for b in bodies])
    row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(edges[:-1], ends), prepend=0))
    start = edges[:-1] - np.append(0, ends)[row]
    kind = np.where(size > 1, _LONG[byte], _SHORT[byte])
    block = np.flatnonzero((byte == 0x2F) & (size > 1))
    third = bytes_at(value, block, 2)
    opens = (third == 0x21) | (third == 0x4D) & (bytes_at(value, block, 3) == 0x21)
    kind[block[opens]] = K["vopen"]
    # Open comments, and versioned ones that aren't opened and closed by turns before the end.
    block = block[~opens]
    odd = [row[block[(size[block] < 4) | (bytes_at(value, block, size[block] - 1) != 0x2F) | (bytes_at(value, block, size[block] - 2) != 0x2A)]]]
    turn = np.flatnonzero(_TURNS[kind])
    if len(turn):
        steps = np.cumsum((kind[turn] == K["vopen"]).astype(np.int32) - (kind[turn] == K["vclose"]))
        begin = np.searchsorted(row[turn], row[turn])
        depth = steps - np.where(begin > 0, steps[begin - 1], 0)
        odd.append(row[turn[(depth < 0) | (depth > 1) | (depth == 1) & (kind[turn] == K["end"])]])
    odd = np.unique(np.concatenate(odd))
    keep = kind != K["blank"]
    # Values are the bytes that are left when blanks, a name's own quotes and the second of its doubled ones go.
    left, width = ~(code & (short == K["blank"])), size.copy()
    names = np.flatnonzero(kind == K["id"])
    left[edges[names]] = left[edges[names + 1] - 1] = False
    doubled = np.flatnonzero(tick & left)[1::2]
    left[doubled] = False
    width[names] -= 2
    np.subtract.at(width, np.searchsorted(edges, doubled, "right") - 1, 1)
    if len(odd):
        keep &= ~np.isin(row, odd)
        for i in odd.tolist():
            left[ends[i] - len(bodies[i]) : ends[i]] = False
    keep = np.flatnonzero(keep)
    offsets = np.append(0, np.cumsum(width[keep])).astype(np.int32)
    value = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(codes[left])])
    row, kind, start, end = row[keep], kind[keep], start[keep], (start + size)[keep]
    if len(odd):
        # Their tokens come at the end, and all are put in order by body.
        more = [(i, K[k], a, b, v) for i in odd.tolist() for k, a, b, v in tokens_of(bodies[i])]
        columns = list(zip(*more)) or [()] * 5
        row, kind, start, end = (np.concatenate([x, np.array(c, x.dtype)]) for x, c in zip((row, kind, start, end), columns))
        value = pa.concat_arrays([value, pa.array(columns[4], pa.binary())])
        order = np.argsort(row, kind="stable")
        row, kind, start, end, value = row[order], kind[order], start[order], end[order], value.take(pa.array(order))
    return row, kind, start.astype(np.int32), end.astype(np.int32), value


def in_slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` (bytes or text) has up to ``most`` (SLICE_BYTES) bytes after its first row, so that a task holds few rows as Python objects."""
    most = most or SLICE_BYTES
    for batch in batches:
        slot = np.cumsum(pc.binary_length(batch.column(column)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) + 64) // most
        edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def tokens(found: DataFrame) -> DataFrame:
    """The statements with ``tokens`` (TOKEN), in order; null for a null body."""
    kept = [c for c in found.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "body"):
            bodies = batch.column("body").to_pylist()
            row, kind, start, end, value = lexed(bodies)
            ends = np.searchsorted(row, np.arange(len(bodies) + 1)).tolist()
            # A null list is a null offset.
            offsets = pa.array([None if b is None else e for b, e in zip(bodies, ends)] + [ends[-1]], pa.int32())
            fields = [pa.array(KINDS).take(pa.array(kind)), pa.array(start), pa.array(end), value]
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["kind", "from", "to", "value"]))], [*kept, "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*kept).schema.fields)
    return found.select(*kept).mapInArrow(run, f"{kinds}, tokens {TOKEN}")


# --- statements judged -----------------------------------------------------------

#: The session lines a dump may begin with.
PREAMBLE = re.compile(rb"/\*!40101 SET NAMES [A-Za-z0-9_]+ \*/|/\*!40101 SET SQL_MODE='NO_AUTO_VALUE_ON_ZERO' \*/|/\*!40014 SET FOREIGN_KEY_CHECKS=0 \*/")
_BETWEEN = re.compile(rb"(?:" + _SPACES + rb"|--(?:[\x00-\x09\x0b-\x20][^\n]*)?(?:\n|\Z))*")
#: The same with comments of every kind.
_COMMENTS = re.compile(rb"(?:" + _SPACES + rb"|--(?:[\x00-\x09\x0b-\x20][^\n]*)?(?:\n|\Z)|\#[^\n]*(?:\n|\Z)|/\*(?!!|M!)[^*]*+(?:\*(?!/)[^*]*+)*+\*/)*")
_NAME = rb"`((?:[^`]|``)+)`"
_GAP = rb"[ \t\r\n\x0b\x0c]*"
_HEAD = re.compile(rb"INSERT" + _SPACES + rb"INTO" + _SPACES + _NAME + _GAP + rb"\(" + _GAP + rb"(" + _NAME + rb"(?:" + _GAP + rb"," + _GAP + _NAME + rb")*)" + _GAP + rb"\)" + _GAP + rb"VALUES" + _SPACES)
_DROP = re.compile(rb"DROP" + _SPACES + rb"TABLE" + _SPACES + rb"IF" + _SPACES + rb"EXISTS" + _SPACES + _NAME + _GAP + rb";\Z")
_CREATE = re.compile(rb"(?i:CREATE" + _SPACES + rb"TABLE)" + _SPACES + _NAME)
_ONE_NAME = {b"DROP": (_DROP, "drops something other than one table if it exists"), b"CREATE": (_CREATE, "no CREATE TABLE with a quoted name")}
_VALUE = re.compile(rb"NULL|-?(?:[0-9]+|[0-9]*\.[0-9]+)(?:[eE][-+]?[0-9]+)?(?![-+.0-9eE])|[xX]'[0-9a-fA-F]*'|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'", re.S)
_MARK = re.compile(_GAP + rb"([(),;])" + _GAP)
_ESCAPED = {b"0": b"\0", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"Z": b"\x1a"}
JUDGED = "kind string, table string, columns array<string>, rows array<array<binary>>, n_rows bigint, reason string"


def value_of(token: bytes) -> bytes | None:
    """A literal's value in bytes; numbers as written."""
    if token == b"NULL":
        return None
    if token[:1] in b"xX":
        return bytes.fromhex(token[2:-1].decode())
    if token[:1] == b"'":
        return re.sub(rb"\\(.)|''", lambda m: b"'" if m[1] is None else _ESCAPED.get(m[1], m[1]), token[1:-1], flags=re.S)
    return token


def _rows(body: bytes, at: int, width: int) -> tuple[list[list[bytes | None]], str | None]:
    """The rows of literals from ``at`` up to the semicolon, or why they can't be read."""
    rows = []
    while True:
        mark = _MARK.match(body, at)
        if not mark or mark[1] != b"(":
            return [], "something other than a row of values"
        at, row = mark.end(), []
        while True:
            value = _VALUE.match(body, at)
            mark = value and _MARK.match(body, value.end())
            if not mark or mark[1] not in b",)":
                return [], "something other than literal values"
            row.append(value_of(value[0]))
            at = mark.end()
            if mark[1] == b")":
                break
        if len(row) != width:
            return [], f"a row of {len(row)} values for {width} columns"
        rows.append(row)
        mark = _MARK.match(body, at)
        if mark and mark[1] == b";":
            return rows, None
        if not mark or mark[1] != b",":
            return [], "something after its rows"
        at = mark.end()


def judged(body: bytes | None, closed: bool, comments: bool = False) -> tuple:
    """kind (set, drop, create, insert, refused, or null for no statement), table, columns, rows, their number, and the reason of a refusal; ``closed`` tells whether the semicolon was found, ``comments`` whether other comments than -- may stand before a statement."""

    def refused(why: str) -> tuple:
        return "refused", None, None, None, None, why

    if body is None:
        return refused("too long to be read")
    body = body[(_COMMENTS if comments else _BETWEEN).match(body).end() :]
    if not body:
        return (None,) * 6
    if not closed:
        return refused("ends inside a statement")
    if body[:3] == b"/*!":
        return ("set", None, None, None, None, None) if PREAMBLE.fullmatch(body[:-1]) else refused("a versioned comment that is no session line")
    word = re.match(rb"[A-Za-z]*", body)[0].upper()
    if word == b"INSERT":
        if not (head := _HEAD.match(body)):
            return refused("no INSERT with a quoted name and a list of quoted columns")
        names = [name.replace(b"``", b"`").decode("utf-8", "replace") for name in re.findall(_NAME, head[0])]
        rows, why = _rows(body, head.end(), len(names) - 1)
        return refused(why) if why else ("insert", names[0], names[1:], rows, len(rows), None)
    if word in _ONE_NAME:
        pattern, why = _ONE_NAME[word]
        m = pattern.match(body)
        return (word.decode().lower(), m[1].replace(b"``", b"`").decode("utf-8", "replace"), None, None, None, None) if m else refused(why)
    return refused("a kind that is not read" + (f": {word.decode()}" if 0 < len(word) <= 20 else ""))


def read(found: DataFrame, comments: bool = False) -> DataFrame:
    """The statements with JUDGED, each on its own; what is no statement (blanks and -- comments at the end) is left out.

    Between statements only white space and -- comments may stand, or, with ``comments``, comments of every kind; a comment inside a statement that isn't a definition refuses it.
    Columns named like new ones are replaced.
    """
    kept = [f for f in found.schema.fields if f.name not in ("kind", "table", "columns", "rows", "n_rows", "reason")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.binary())), pa.int64(), pa.string()]
        for batch in in_slices(batches, "body"):
            rows = [judged(b, c, comments) for b, c in zip(batch.column("body").to_pylist(), batch.column("closed").to_pylist())]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([*batch.columns, *[pa.array(list(c), t) for c, t in zip(columns, types)]], [*[f.name for f in kept], "kind", "table", "columns", "rows", "n_rows", "reason"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return found.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, f"{kinds}, {JUDGED}").where("kind is not null")


def in_context(judged: DataFrame) -> DataFrame:
    """The judged statements after the rules that need others: session lines come first and are three at most, one DROP a dump, and one table, whose columns every INSERT lists as the dump's first one does. Those that break a rule become "refused"."""
    # A row a dump; the few session lines and drops are numbered on their own.
    firsts = judged.groupBy("dump").agg(
        F.min(F.when(F.col("kind") != "set", F.col("number"))).alias("_other"),
        F.min(F.when(F.col("kind") == "insert", F.struct("number", "columns"))).alias("_insert"),
        F.min(F.when(F.col("kind").isin("create", "drop", "insert"), F.struct("number", "table"))).alias("_named"),
    )
    place = F.row_number().over(Window.partitionBy("dump", "kind").orderBy("number"))
    few = judged.where(F.col("kind").isin("set", "drop")).select("dump", "number", place.alias("_place"))
    all_ = judged.join(firsts, "dump").join(few, ["dump", "number"], "left")
    kind = F.col("kind")
    reason = (
        F.when(kind == "refused", F.col("reason"))
        .when((kind == "set") & (F.col("number") > F.col("_other")), "a session line after other statements")
        .when((kind == "set") & (F.col("_place") > 3), "more than 3 session lines")
        .when(kind.isin("create", "drop", "insert") & (F.col("table") != F.col("_named.table")), "another table")
        .when((kind == "drop") & (F.col("_place") > 1), "drops the table more than once")
        .when((kind == "insert") & (F.col("columns") != F.col("_insert.columns")), "other columns than the first rows have")
    )
    return all_.withColumn("reason", reason).withColumn("kind", F.when(reason.isNotNull(), "refused").otherwise(kind)).select(*judged.columns)


def inserted(judged: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of all INSERTs as ``schema``, columns by name; columns that a statement doesn't list are null. Binary columns stay bytes, text is UTF-8."""
    each = judged.where("kind = 'insert'").select("columns", F.explode("rows").alias("row"))
    value = {f.name: F.get("row", (F.array_position("columns", F.lit(f.name)) - 1).cast("int")) for f in schema.fields}
    return each.select(*[(value[f.name] if isinstance(f.dataType, T.BinaryType) else F.decode(value[f.name], "UTF-8").cast(f.dataType)).alias(f.name) for f in schema.fields])
