"""Table definitions read from their tokens, and rewritten for other names.

A batch's tokens are columns: running sums over them give the depth of
parentheses and number the items, an item is a range of tokens, and its facts are found for all
items of the batch at once. Nothing is shuffled, and tokens needn't leave the task that finds them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.sqltext import NAME_BYTES, identifier
from wharfline.sources import foreign

#: Engines that a table may use; words that no table option may hold; words that begin an index.
ENGINES = ("innodb", "myisam", "aria", "memory", "heap", "csv", "blackhole", "rocksdb", "tokudb")
NO_OPTIONS = ("DIRECTORY", "CONNECTION", "UNION", "SELECT", "LIKE", "AS", "IGNORE", "REPLACE")
INDEX_WORDS = ("KEY", "INDEX", "UNIQUE", "FULLTEXT", "SPATIAL")
#: Hexadecimal digits of the hash that ends a shortened name.
HASH_DIGITS = 7
#: Statements whose tokens are columns at once, where they come as tokens.
ROWS = 1000
#: What is told of a definition, with its type.
FACTS = {
    "table": "string", "columns": "array<string>", "generated": "array<string>", "primary_key": "array<string>", "foreign_keys": "array<struct<name: string, columns: array<string>, references: string, referenced: array<string>>>", "checks": "array<string>", "engine": "string", "auto_increment": "string",
    "collations": "array<struct<name: string, at: string>>", "reason": "string", "places": "array<struct<what: string, name: string, at: string, from: int, to: int>>", "start": "int",
}

#: Numbers of what stands before the list of items and after it, and the tokens before it.
HEAD, OPTIONS, HEAD_TOKENS = -1, 1 << 30, 4
#: What an item is.
KINDS = ("head", "options", "column", "index", "primary", "check", "foreign", "unique", "other")
_IS = {kind: i for i, kind in enumerate(KINDS)}
#: Words that tell something, by number.
_WORDS = tuple(dict.fromkeys(("CREATE", "TABLE", "COLLATE", "REFERENCES", "AS", "GENERATED", "CONSTRAINT", "ENGINE", "TYPE", "AUTO_INCREMENT", "PRIMARY", "CHECK", "FOREIGN", *INDEX_WORDS, *NO_OPTIONS, *(e.upper() for e in ENGINES))))
_WORD = {w: i for i, w in enumerate(_WORDS)}
#: Reasons against an item, then against a statement, by number and in the order in which they are looked for; _OPTION and _ENGINE end with a word.
_REASONS = (
    None, "no CREATE TABLE with a quoted name and a list", "the list isn't closed", "an item that is neither a column nor a key", "a column with REFERENCES of its own", "a foreign key without a name", "a foreign key without a table", "a foreign key to another database",
    "a foreign key whose columns don't match", "a primary key without columns", "an item of another kind", "COLLATE without a name", "the option ", "the engine ", "AUTO_INCREMENT without a number", "a column defined twice", "two primary keys", "no columns",
)
_OPTION, _ENGINE, _LAST = 12, 13, 14


def _text(values: pa.Array, where: np.ndarray, none: str | None = None) -> pa.Array:
    """The values at places as text; ``none`` where a place is -1."""
    taken = values.take(pa.array(where, mask=where < 0)).cast(pa.string())
    return taken if none is None else pc.fill_null(taken, none)


def _among(n: int, some: Iterable[int]) -> np.ndarray:
    """Which of n numbers are among some; the last is none, for -1."""
    out = np.zeros(n + 1, bool)
    out[list(some)] = True
    return out


def _lists(owners: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of n owners from values in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), values)


def facts_of(n: int, row: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, value: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which of n statements are a CREATE, and the FACTS of these (nothing if there are none), from the tokens of all as columns (see sources.foreign.lexed).

    Every step is done for all tokens or all items at once: a token's depth of parentheses and the number of its item are running sums,
    an item is a range of tokens, and what it tells stands at places in it that are found by the words there. Places beyond an item are -1, where the columns end with no token.
    """
    C = foreign.K

    def padded(x: np.ndarray, none: int) -> np.ndarray:
        return np.concatenate([x, np.array([none], x.dtype)])

    keep = _among(len(C), (C[k] for k in C if k not in ("comment", "vopen", "vclose", "end", "blank")))[kind]
    firsts = np.flatnonzero(keep)
    firsts = firsts[np.diff(row[firsts], prepend=-1) != 0]
    creates = np.zeros(n, bool)
    if len(firsts):
        creates[row[firsts]] = pc.equal(pc.ascii_upper(value.take(pa.array(firsts)).cast(pa.string(), safe=False)), "CREATE").to_numpy(zero_copy_only=False) & (kind[firsts] == C["word"])
    keep &= creates[row]
    # Where the values of tokens are.
    held = np.flatnonzero(keep)
    row, kind, start, end = (np.cumsum(creates) - 1)[row[keep]], kind[keep], start[keep], end[keep]
    n = int(creates.sum())
    if not n:
        return creates, {}
    words = np.flatnonzero(kind == C["word"])
    word = np.full(len(row), -1)
    word[words] = pc.fill_null(pc.index_in(pc.ascii_upper(value.take(pa.array(held[words])).cast(pa.string(), safe=False)), pa.array(_WORDS)), -1).to_numpy(zero_copy_only=False)
    mark = np.where(kind == C["p"], foreign.bytes_at(value, held), 0)
    first = np.searchsorted(row, np.arange(n))
    i = np.arange(len(row)) - first[row]

    def summed(x: np.ndarray) -> np.ndarray:
        """Sums up to each token, from its statement's first on."""
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[1:] - sums[first][row]

    closes = mark == ord(")")
    d = summed((mark == ord("(")).astype(np.int32) - closes)
    # The parenthesis that closes the list of items, and the commas between them.
    close = np.full(n, OPTIONS)
    ends = np.flatnonzero(closes & (d == 0))[::-1]
    close[row[ends]] = i[ends]
    comma = (mark == ord(",")) & (d == 1) & (i >= HEAD_TOKENS) & (i < close[row])
    item = np.where(i < HEAD_TOKENS, HEAD, np.where(i > close[row], OPTIONS, summed(comma)))
    keep = ~comma & (i != close[row])
    row, item = row[keep], item[keep]
    kind, word, mark, d, start, end, held = (padded(x[keep], none) for x, none in ((kind, C["blank"]), (word, -1), (mark, 0), (d, 0), (start, 0), (end, 0), (held, -1)))
    text = lambda where, none=None: _text(value, held[where], none)
    is_ = lambda *names: _among(len(_WORDS), (_WORD[w] for w in names))[word]

    # Items as ranges of tokens.
    begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-2) != 0))
    size = np.diff(begin, append=len(row))
    owner, of = row[begin], np.repeat(np.arange(len(begin)), size)
    within = np.arange(len(row)) - begin[of]
    some = np.zeros(len(begin), bool)

    def at(k: np.ndarray | int) -> np.ndarray:
        """The k-th token of each item, from 0."""
        return np.where((k >= 0) & (k < size), begin + k, -1)

    def after(t: np.ndarray, k: int) -> np.ndarray:
        """The k-th token after tokens of an item."""
        return np.where(within[t] + k < size[of[t]], t + k, -1)

    def found(those: np.ndarray) -> np.ndarray:
        """The place of the first token of each item among those, -1 if there is none."""
        place, which = np.full(len(begin), -1), np.flatnonzero(those[:-1])[::-1]
        place[of[which]] = within[which]
        return place

    own = d == 1
    reference, generated, option = found(is_("REFERENCES") & own), found(is_("AS", "GENERATED") & own), found(is_(*NO_OPTIONS))
    one, two = at(0), at(1)
    constraint = word[one] == _WORD["CONSTRAINT"]
    named = constraint & (kind[two] == C["id"])
    key = np.where(named, 2, np.where(constraint, 1, 0))
    key_word, next_word = word[at(key)], word[at(key + 1)]
    starts = lambda w: (constraint | (word[one] == _WORD[w])) & (key_word == _WORD[w])
    number = item[begin]
    choices = [number == HEAD, number == OPTIONS, kind[one] == C["id"], is_(*INDEX_WORDS)[one], starts("PRIMARY"), starts("CHECK"), key_word == _WORD["FOREIGN"], constraint & (key_word == _WORD["UNIQUE"])]
    what = np.select(choices, range(8), 8)
    head, options, column, primary, check, keys = (what == _IS[k] for k in ("head", "options", "column", "primary", "check", "foreign"))
    name = at(2)

    # Quoted names directly inside an item's parentheses.
    ids = (kind[:-1] == C["id"]) & (d[:-1] == 2)
    left, right = np.flatnonzero(ids & keys[of] & (within < reference[of])), np.flatnonzero(ids & keys[of] & (within > reference[of]))
    in_primary = np.flatnonzero(ids & primary[of])
    n_left, n_right, n_primary = (np.bincount(of[x], minlength=len(begin)) for x in (left, right, in_primary))
    target, beyond = at(reference + 1), at(reference + 2)

    # Names after COLLATE, and perhaps =.
    holds = column | check | options | (what == _IS["index"])
    c = np.flatnonzero(is_("COLLATE")[:-1] & holds[of])
    there = np.where(mark[after(c, 1)] == ord("="), after(c, 2), after(c, 1))
    called = np.where(_among(len(C), (C["str"], C["word"], C["id"]))[kind[there]], there, -1)
    collation = text(called)
    quoted = kind[called] == C["str"]
    if quoted.any():
        raw = collation.filter(pa.array(quoted))
        inner = pc.utf8_slice_codeunits(raw, 1, -1)
        inner = pc.if_else(pc.starts_with(raw, "'"), pc.replace_substring(inner, "''", "'"), pc.replace_substring(inner, '""', '"'))
        collation = pc.replace_with_mask(collation, pa.array(quoted), inner)
    nested = d[c] > np.where(options[of[c]], 0, 1)
    places_at = pc.if_else(pa.array(column[of[c]] & ~nested), pc.binary_join_element_wise("column:", text(one[of[c]]), ""), pa.array(["check", "table", "expression"]).take(pa.array(np.where(check[of[c]], 0, np.where(options[of[c]], 1, 2)))))
    lost = some.copy()
    lost[of[c[called < 0]]] = True

    # Of an option: the token after it, or the one after =.
    settings = {}
    for setting, names in (("engine", ("ENGINE", "TYPE")), ("auto", ("AUTO_INCREMENT",))):
        here = np.where(options, found(is_(*names)), -1)
        equals = (here >= 0) & (mark[at(here + 1)] == ord("="))
        settings[setting] = np.where(here >= 0, np.where(equals, at(here + 2), at(here + 1)), -1), (here >= 0) & ~(equals & (at(here + 2) < 0))
    (engine, has_engine), (auto, has_auto) = settings["engine"], settings["auto"]
    fine_auto = some.copy()
    which = np.flatnonzero(has_auto & (kind[auto] == C["word"]))
    fine_auto[which] = pc.match_substring_regex(text(auto[which]), "\\A[0-9]{1,20}\\z").to_numpy(zero_copy_only=False)

    bad = np.select([
        head & ((size < HEAD_TOKENS) | (word[two] != _WORD["TABLE"]) | (kind[name] != C["id"]) | (mark[at(3)] != ord("("))),
        head & (close[owner] == OPTIONS),
        ~head & ~options & (kind[one] != C["id"]) & (kind[one] != C["word"]),
        column & (reference >= 0),
        keys & ~named,
        keys & ((next_word != _WORD["KEY"]) | (reference < 0) | (kind[target] != C["id"])),
        keys & (mark[beyond] == ord(".")),
        keys & ((n_left == 0) | (n_left != n_right)),
        primary & ((next_word != _WORD["KEY"]) | (n_primary == 0)),
        what == _IS["other"],
        lost,
        options & (option >= 0),
        has_engine & ~is_(*(e.upper() for e in ENGINES))[engine],
        has_auto & ~fine_auto,
    ], range(1, _LAST + 1), 0)
    # The first reason of a statement, then those of its items together.
    which = np.flatnonzero(bad)[::-1]
    reason, by = np.zeros(n, np.int64), np.full(n, -1)
    reason[owner[which]], by[owner[which]] = bad[which], which
    cols, primaries = np.flatnonzero(column), np.flatnonzero(primary)
    column_names = text(one[cols])
    codes = column_names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    pairs = np.sort(owner[cols] * (len(cols) + 1) + codes)
    twice = np.zeros(n, bool)
    twice[pairs[1:][pairs[1:] == pairs[:-1]] // (len(cols) + 1)] = True
    n_cols, n_primaries = (np.bincount(owner[x], minlength=n) for x in (cols, primaries))
    reason = np.where(reason > 0, reason, np.select([twice, n_primaries > 1, n_cols == 0], range(_LAST + 1, _LAST + 4), 0))
    ending = np.where(reason == _OPTION, at(option)[by], np.where(reason == _ENGINE, engine[by], -1))
    ended = text(ending, "")
    ended = pc.if_else(pa.array(reason == _OPTION), pc.utf8_upper(ended), ended)

    # Places in the order of items; an item's own names come before its collations.
    inner_checks = np.flatnonzero(is_("CONSTRAINT")[:-1] & own[:-1] & column[of])
    inner_checks = after(inner_checks, 1)[kind[after(inner_checks, 1)] == C["id"]]
    heads, foreigns, checks = np.flatnonzero(head), np.flatnonzero(keys), np.flatnonzero(check & named)
    parts = [(heads, name[heads], "table"), (foreigns, two[foreigns], "foreign"), (foreigns, target[foreigns], "references"), (checks, two[checks], "check"), (of[inner_checks], inner_checks, "check"), (of[c], there, "collation")]
    items, tokens = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    whats = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((np.arange(len(items)), whats, items))
    sorted_, owned, what_ = pa.array(order), owner[items[order]], whats[order]
    texts = pa.concat_arrays([text(tokens[: len(items) - len(c)]), collation]).take(sorted_)
    ats = pa.concat_arrays([pa.nulls(len(items) - len(c), pa.string()), places_at]).take(sorted_)
    none = tokens[order] < 0
    places = pa.StructArray.from_arrays([pa.array([p[2] for p in parts]).take(pa.array(what_)), texts, ats, *[pa.array(x[tokens[order]], pa.int32(), mask=none) for x in (start, end)]], ["what", "name", "at", "from", "to"])
    is_check, is_collation = np.isin(what_, (3, 4)), what_ == 5

    key_columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k[foreigns])]), pa.int32()), text(x)) for k, x in ((n_left, left), (n_right, right))]
    foreign_keys = pa.StructArray.from_arrays([text(two[foreigns]), key_columns[0], text(target[foreigns]), key_columns[1]], ["name", "columns", "references", "referenced"])
    first_primary = some.copy()
    first_primary[primaries[np.diff(owner[primaries], prepend=-1) != 0]] = True
    in_first = in_primary[first_primary[of[in_primary]]]
    made, last = np.flatnonzero(column & (generated >= 0)), np.full(n, -1)
    last[owner[options]] = np.flatnonzero(options)
    option_text = lambda x: text(np.where(last >= 0, x[last], -1), "")
    return creates, {
        "table": text(name[heads]), "columns": _lists(owner[cols], n, column_names), "generated": _lists(owner[made], n, text(one[made])), "primary_key": _lists(row[in_first], n, text(in_first)),
        "foreign_keys": _lists(owner[foreigns], n, foreign_keys), "checks": _lists(owned[is_check], n, texts.filter(pa.array(is_check))), "engine": option_text(engine), "auto_increment": option_text(auto),
        "collations": _lists(owned[is_collation], n, pa.StructArray.from_arrays([x.filter(pa.array(is_collation)) for x in (texts, ats)], ["name", "at"])), "reason": pc.binary_join_element_wise(pa.array(_REASONS).take(pa.array(reason)), ended, ""),
        "places": _lists(owned, n, places), "start": pa.array(start[one[heads]], pa.int32()),
    }


def facts(found: DataFrame, keys: list[str], told: list[str] | None = None) -> DataFrame:
    """``keys`` and FACTS (or those ``told``) of each CREATE TABLE among statements with ``tokens`` or, where these are no column, ``body`` (see sources.foreign); the rest is left out.

    columns has all in order, generated those that INSERTs can't fill, foreign_keys structs of
    name, columns, references and referenced, collations structs of name and at (table, column:<name>, expression
    or check). reason tells why a definition isn't one to be run, in the order in which its parts are read; facts are then what could be read.
    places has byte ranges of names, for ``rewritten``; start is where CREATE begins. Keys are any columns, carried along; statements
    without tokens are left out; an empty table gives an empty one.
    """
    told, lexes = told or list(FACTS), "tokens" not in found.columns
    held = found.select(*keys, F.col("body" if lexes else "tokens").alias("_read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = foreign.in_slices(batches, len(keys)) if lexes else (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS))
        for part in parts:
            read = part.columns[-1]
            if lexes:
                columns = foreign.lexed(read.to_pylist())
            else:
                kind, start, end, value = read.flatten().flatten()
                kind = pc.fill_null(pc.index_in(kind, pa.array(foreign.KINDS)), foreign.K["bad"])
                columns = np.repeat(np.arange(len(read)), pc.fill_null(pc.list_value_length(read), 0).to_numpy(zero_copy_only=False)), *(x.to_numpy(zero_copy_only=False) for x in (kind, start, end)), value
            creates, out = facts_of(len(read), *columns)
            if not out:
                continue
            mask = pa.array(creates)
            yield pa.record_batch([*[x.filter(mask) for x in part.columns[:-1]], *[out[k] for k in told]], [*keys, *told])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]], *[f"`{k}` {FACTS[k]}" for k in told]])
    return held.mapInArrow(run, kinds)


# --- other names -----------------------------------------------------------------


def constraint_name(name: Column, kind: str, table: Column, temporary: Column, final: Column, mark: str, number: Column, most: int = NAME_BYTES) -> Column:
    """A name for a constraint that no other table of the database has.

    A name of the server's own form (the table's, _, the kind, _ and a number) keeps its end after the
    temporary name if both it and the final name have room for it; any other gets ``mark``, the table's number in
    base 36 and _ before it, cut without splitting a character and ended by _ and digits of its hash where that is longer than ``most`` bytes.
    """
    end = F.substring(name, F.length(table) + 1, F.length(name))
    own = name.startswith(table) & end.rlike(rf"\A_{kind}_[1-9][0-9]*\z") & (F.octet_length(F.concat(temporary, end)) <= most) & (F.octet_length(F.concat(final, end)) <= most)
    front = F.concat(F.lit(mark), F.lower(F.conv(number.cast("string"), 10, 36)), F.lit("_"))
    room = F.lit(most - HASH_DIGITS - 1) - F.octet_length(front)
    fits = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda n: F.octet_length(F.substring(name, F.lit(1), n)) <= room))
    cut = F.concat(front, F.substring(name, F.lit(1), fits), F.lit("_"), F.substring(F.sha2(name, 256), 1, HASH_DIGITS))
    return F.when(own, F.concat(temporary, end)).when(F.octet_length(F.concat(front, name)) <= most, F.concat(front, name)).otherwise(cut)


def edited(body: Column, edits: Column) -> Column:
    """A text in bytes after edits (structs from, to and text, whose byte ranges don't overlap), applied from the last to the first."""


    def whole(sorted_: Column) -> Column:
        # Pieces between edits are found at once, so the work doesn't grow with their number times the text's length.
        before = F.transform(sorted_, lambda e, i: F.concat(F.substring(body, F.coalesce(F.get(sorted_, i - 1)["to"], F.lit(0)) + 1, e["from"] - F.coalesce(F.get(sorted_, i - 1)["to"], F.lit(0))).cast("string"), e["text"]))
        rest = F.substring(body, F.coalesce(F.get(sorted_, F.size(sorted_) - 1)["to"], F.lit(0)) + 1, F.octet_length(body)).cast("string")
        return F.concat(F.array_join(before, ""), rest)

    # As the only element of an array the edits are made and sorted once, not again for each use in each element.
    return F.get(F.transform(F.array(F.sort_array(edits)), whole), F.lit(0))


def rewritten(known: DataFrame, *, mark: str, temporary: str = "temporary", final: str = "final", number: str = "number", references: str | None = None, collations: dict[str, str] | None = None) -> DataFrame:
    """Adds ``sql``, the definition for the table's temporary name, and ``constraints`` (structs kind, name and new) to facts with ``body``.

    Names of the table, of named constraints and of referenced tables change (``references``: a column with a map from a table to the name to
    refer to; others stay), and collations by ``collations`` (names in lower case); every other byte stays. Null where a reason stands against the definition.
    """
    t, f, n, table = (F.col(c) for c in (temporary, final, number, "table"))

    def new(p: Column) -> Column:
        other = F.coalesce(F.element_at(F.col(references), p["name"]), p["name"]) if references else p["name"]
        written_ = F.when(p["what"] == "table", t).when(p["what"] == "foreign", constraint_name(p["name"], "ibfk", table, t, f, mark, n)).when(p["what"] == "check", constraint_name(p["name"], "chk", table, t, f, mark, n)).when(p["what"] == "references", other)
        fixed = F.create_map(*[F.lit(x) for pair in (collations or {"": ""}).items() for x in pair])
        return F.when(p["what"] == "collation", F.element_at(fixed, F.lower(p["name"]))).otherwise(identifier(written_))

    edits = F.transform("places", lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"), new(p).alias("text")))
    edits = F.filter(edits, lambda e: e["text"].isNotNull())
    # Up to the semicolon; what stands before CREATE goes.
    start = F.col("start")
    moved = F.transform(edits, lambda e: F.struct((e["from"] - start).alias("from"), (e["to"] - start).alias("to"), e["text"].alias("text")))
    own = F.substring(F.col("body"), start + 1, F.octet_length("body") - start - 1)
    named = F.filter("places", lambda p: p["what"].isin("foreign", "check"))
    constraints = F.transform(named, lambda p: F.struct(p["what"].alias("kind"), p["name"].alias("name"), F.when(p["what"] == "foreign", constraint_name(p["name"], "ibfk", table, t, f, mark, n)).otherwise(constraint_name(p["name"], "chk", table, t, f, mark, n)).alias("new")))
    fine = F.col("reason").isNull()
    return known.withColumn("sql", F.when(fine, edited(own, moved))).withColumn("constraints", F.when(fine, constraints))
