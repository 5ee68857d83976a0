"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of the
prefix's encoding. The table of these last tokens, grown byte by byte, gives the
encoding of any prefix by walking back, appends without touching what is
there, and re-encodes near an edit from the edit's place on.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, tidy
from wharfline.llm.text import steps

#: Entries of each half of a worker's memory of encoded chunks or pieces; it bounds memory and changes no result.
REMEMBERED = 400_000
#: The same for workers that encode for one task only, beside what other stages of a job left there.
REMEMBERED_ONCE = 100_000
#: UTF-8 bytes of a text that a worker gets with up to 99 others; longer ones go to it in Arrow batches, which Spark bounds by bytes.
SHORT = 1 << 16
#: Text bytes of a step of a task.
STEP = 1 << 20
#: Bytes of a piece that is encoded depth first.
DEEPEST = 1 << 10


class Memory:
    """Two dictionaries in turn: as the new one is full, it becomes the old one, whose entries that are asked for again move on."""

    def __init__(self, half: int = REMEMBERED):
        self.half, self.new, self.old = half, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.new) >= self.half:
            self.new, self.old = {}, self.new
        self.new[key] = value
        return value


class Vocabulary:
    """Tokens by rank, with the merges that BPE would make.

    ``ranks`` maps each token's bytes to its rank, all single bytes included.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.lengths = {r: len(t) for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.seams: dict[int, bool] = {}
        # The tokens as a tree of dictionaries by byte; at -1 a node's own token, or -1.
        self.tree: dict = {-1: -1}
        for t, r in ranks.items():
            node = self.tree
            for b in t:
                node = node.setdefault(b, {-1: -1})
            node[-1] = r

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges last to make ``token``; None for one that it doesn't merge."""
        if token not in self._parts:
            tokens = [self.ranks[bytes([b])] for b in self.bytes[token]]
            while len(tokens) > 2:
                best = min(((r, i) for i in range(len(tokens) - 1) if (r := self.ranks.get(self.bytes[tokens[i]] + self.bytes[tokens[i + 1]])) is not None and r < token), default=None)
                if best is None:
                    break
                tokens[best[1] : best[1] + 2] = [best[0]]
            self._parts[token] = (tokens[0], tokens[1]) if len(tokens) == 2 else None
        return self._parts[token]

    def alone(self, token: int) -> bool:
        """Whether the bytes of ``token`` encode to it."""
        return len(self.bytes[token]) == 1 or self.parts(token) is not None

    def seam(self, left: int, right: int) -> bool:
        """Whether ``left`` (-1: nothing) then ``right`` is the encoding of their joined bytes; remembered in ``seams``."""
        if len(self.seams) >= 4 * REMEMBERED:
            self.seams.clear()
        value = self.seams[left << 32 | right] = self.alone(right) if left < 0 else self.fits(left, right)
        return value

    def fits(self, left: int, right: int) -> bool:
        """The same, worked out: no merge across the seam comes up as both are taken apart."""
        # The seam's neighbours are followed back in time: the side made later is undone first.
        bound = float("inf")
        while True:
            merged = self.ranks.get(self.bytes[left] + self.bytes[right])
            if merged is not None and merged < bound:
                return False
            a = self.parts(left) if len(self.bytes[left]) > 1 else None
            b = self.parts(right) if len(self.bytes[right]) > 1 else None
            if a is None and b is None:
                return True
            # Of equal ranks the left place is merged first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
                # A seam pair of this rank would stand right of the merge and come after it.
            else:
                bound, right = right + 1, b[0]
                # A seam pair of this rank would stand left of the merge and come before it.

    def extend(self, near: bytes, last: list[int], data: bytes) -> None:
        """Grows ``last``, the last token of each prefix, by the prefixes that end in ``data``; ``near`` are the bytes before it, as many as a token can have.

        From each place on, the token tree is followed as far as it goes; a
        prefix that has its last token needs no other.
        """
        base = len(last) - len(near)
        window = near + data
        last += [-1] * len(data)
        size, root, seen = len(window), self.tree, self.seams
        left = last[base - 1] if base else -1
        for begin in range(size):
            node = root
            shifted = left << 32
            for end in range(begin, size):
                node = node.get(window[end])
                if node is None:
                    break
                token = node[-1]
                if token >= 0 and last[base + end] < 0:
                    fits = seen.get(shifted | token)
                    if fits is None:
                        fits = self.seam(left, token)
                    if fits:
                        last[base + end] = token
            left = last[base + begin]

    def encode(self, data: bytes) -> list[int]:
        """The encoding of ``data``. Of its prefixes only those are visited that the longest tokens lead to, and others where these lead nowhere.

        Tokens that fit pair by pair are the encoding, as it is unique; so a prefix once reached needs no other way to it.
        """
        if len(data) > DEEPEST:
            return self.walk_back(data)
        size, root, seen, lengths = len(data), self.tree, self.seams, self.lengths
        reached, out, others = bytearray(size + 1), [], []
        at, left = 0, -1
        while at < size:
            node, found = root, []
            for b in data[at : at + self.longest]:
                node = node.get(b)
                if node is None:
                    break
                if (token := node[-1]) >= 0:
                    found.append(token)
            while True:
                if not found:
                    # Nothing fits from here on: the token before was none of the encoding's.
                    found = others.pop()
                    at -= lengths[out.pop()]
                    left = out[-1] if out else -1
                    continue
                token = found.pop()
                end = at + lengths[token]
                if not reached[end]:
                    fits = seen.get(left << 32 | token)
                    if fits or fits is None and self.seam(left, token):
                        break
            reached[end] = 1
            at, left = end, token
            out.append(token)
            others.append(found)
        return out

    def walk_back(self, data: bytes) -> list[int]:
        """The same from the last tokens of all prefixes, which takes less memory for long data."""
        last: list[int] = []
        self.extend(b"", last, data)
        out, at = [], len(data)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes[token])
        return out[::-1]


class Prefixes:
    """A byte string with the last token of each prefix. ``tokens()`` is its encoding; appends and edits keep what lies before them."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        near = bytes(self.data[-self.vocabulary.longest :])
        self.data += data
        self.vocabulary.extend(near, self.last, data)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Bytes start to stop become ``new``. Prefixes before the edit stay; after it, the old last tokens serve again once as many bytes as the longest token has agree."""
        tail, old, run = bytes(self.data[stop:]), self.last[stop:], 0
        del self.data[start:], self.last[start:]
        self.append(new)
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            run = run + 1 if self.last[-1] == old[i] else 0
            if run >= self.vocabulary.longest:
                self.data += tail[i + 1 :]
                self.last += old[i + 1 :]
                break

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes, of all by default."""
        out, at, lengths = [], len(self.data) if size is None else size, self.vocabulary.bytes
        while at:
            out.append(self.last[at - 1])
            at -= len(lengths[out[-1]])
        return out[::-1]


class TextEncoder:
    """Encodes texts as the vocabulary's library would: each match of ``pattern`` by itself.

    A place before a space that follows a character other than white space ends a match
    under any pattern of the known kind (a match holds a space at its start only, or is
    white space), so texts are cut there, and the encodings of the chunks are remembered.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, half: int = REMEMBERED):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.pieces, self.chunks = Memory(half // 2), Memory(half)
        self.texts = {str(r): t for r, t in vocabulary.bytes.items()}

    def piece(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            known = self._tokens(piece)
            if len(piece) <= 64:
                self.pieces.put(piece, known)
        return known

    def _tokens(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else self.vocabulary.encode(data)

    def encode(self, text: str) -> list[int]:
        return [t for p in self.find(text) for t in self.piece(p)]

    def _chunk(self, chunk: str) -> str:
        found = self.find(chunk)
        # A chunk of one piece is remembered as a chunk, so not as a piece besides.
        ids = self._tokens(found[0]) if len(found) == 1 else [t for p in found for t in self.piece(p)]
        return " ".join(map(str, ids))

    def decimal(self, text: str) -> str:
        """The ids as decimal numbers joined by spaces."""
        if _odd(text):
            return " ".join([self._known(c) for c in _CUT.split(text) if c])
        first, *rest = text.split(" ")
        got = list(map(self.chunks.new.get, rest))
        if None in got:
            got = [self._known(" " + p) if value is None else value for p, value in zip(rest, got)]
        return " ".join([self._chunk(first), *got])

    def _known(self, chunk: str) -> str:
        """The chunk's ids; those of a chunk that begins with a space are remembered under what follows it."""
        key = chunk[1:]
        if chunk[0] != " " or not 0 < len(key) <= 64:
            return self._chunk(chunk)
        value = self.chunks.get(key)
        return self.chunks.put(key, self._chunk(chunk)) if value is None else value

    def decode(self, decimal: str) -> bytes:
        return b"".join(map(self.texts.__getitem__, decimal.split(" "))) if decimal else b""


_CUT = regex.compile(r"(?<=\S)(?= )")
#: White space by any of its definitions, and beyond ASCII.
_BLANKS = [chr(c) + " " for c in (*range(9, 14), *range(28, 33))]
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


def _odd(text: str) -> bool:
    """Whether a space may stand at either end or after white space, where splitting at spaces isn't cutting."""
    return not text or text[0] == " " or text[-1] == " " or any(b in text for b in _BLANKS) or not text.isascii() and any(w in text for w in _WIDE)


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(Vocabulary.load(path), pattern)
    return _ENCODERS[path, pattern]


def map_texts(docs: DataFrame, text: str, make: Callable[[list[str]], list[pa.Array]], fields: str, names: list[str]) -> DataFrame:
    """All columns of docs but those named like new ones, with the columns that ``make`` gives for the texts (null: empty) of a step."""
    kept, body = [c for c in docs.columns if c not in names], fresh("text")
    frame = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body))

    def run(batches):
        for batch in steps(batches, body, STEP):
            yield pa.record_batch([*batch.columns[:-1], *make(batch.column(body).to_pylist())], [*kept, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(tidy(run), kinds + fields)


def encode_column(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with ``tokens``, the ids of each text as array<int>. A null or empty text has none; long texts are encoded whole.

    Texts of up to SHORT bytes go to a worker a hundred at a time, as an Arrow batch of 10,000 is copied several times beside the
    encoder; longer ones, for which docs is read once more, in Arrow batches. Workers keep the encoder for their later tasks unless
    ``keep`` is false, which leaves its memory to other stages.
    """
    held: list[TextEncoder] = []

    def ids(body: str | None) -> list[int]:
        if not held:
            # A task has its own copy of the list, so what isn't kept goes with it.
            held.append(_encoder(path, pattern) if keep else TextEncoder(Vocabulary.load(path), pattern, REMEMBERED_ONCE))
        found = held[0].decimal(body or "")
        return list(map(int, found.split(" "))) if found else []

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array([ids(t) for t in texts], pa.list_(pa.int32()))]

    short = F.coalesce(F.octet_length(F.col(text)) <= SHORT, F.lit(True))
    kept = [c for c in docs.columns if c != "tokens"]
    some = docs.where(short).select(*kept, F.udf(ids, "array<int>", useArrow=False)(F.col(text)).alias("tokens"))
    return some.unionByName(map_texts(docs.where(~short), text, make, "tokens array<int>", ["tokens"]))


def decode_column(docs: DataFrame, path: str, pattern: str, *, tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``decoded``, the bytes of each row's ids as binary; null ids give null. An unknown id raises KeyError."""
    kept = [c for c in docs.columns if c != "decoded"]
    at = kept.index(tokens)

    def run(batches):
        words = _encoder(path, pattern).vocabulary.bytes
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([None if ids is None else b"".join([words[i] for i in ids]) for ids in batch.column(at).to_pylist()], pa.binary())], [*kept, "decoded"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(tidy(run), kinds + "decoded binary")


def encode_digest(docs: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the ids decoded again).

    The ids of a step are never held as lists of all texts, so long texts and hot
    rows stay cheap. Null and empty texts have 0 tokens and the hashes of nothing.
    """

    def make(texts: list[str]) -> list[pa.Array]:
        encoder, rows = _encoder(path, pattern), []
        for t in texts:
            ids = encoder.decimal(t)
            rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
        return [pa.array(list(c), k) for c, k in zip(zip(*rows), [pa.int64(), pa.string(), pa.string()])]

    return map_texts(docs, text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"])
