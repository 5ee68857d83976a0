"""SQL text as column expressions: literals, identifiers, statements and generated names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.sizes import kind_of

#: What a quoted literal escapes, backslash first, as the others bring backslashes in.
ESCAPES = (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z"))
PLAIN_NUMBER = r"\A-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"
#: Hexadecimal digits that end a generated name.
GENERATED_DIGITS = 12
#: Bytes of an identifier at most.
NAME_BYTES = 64


def quoted(text: Column) -> Column:
    out = text
    for raw, escaped in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit("'"), out, F.lit("'"))


def hex_literal(value: Column) -> Column:
    """X'..' in lower case, or '' for nothing."""
    return F.when(F.octet_length(value) == 0, F.lit("''")).otherwise(F.concat(F.lit("X'"), F.lower(F.hex(value)), F.lit("'")))


def identifier(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def literal(value: Column, kind: str, hex_all: bool = False) -> Column:
    """A value as SQL text: NULL, a bare number where it is a plain one, hexadecimal for binary (or for all of a charset whose quoting isn't safe), else quoted."""
    if kind == "binary":
        out = hex_literal(value)
    else:
        text = value.cast("string")
        words = hex_literal(text.cast("binary")) if hex_all else quoted(text)
        out = F.when(text.rlike(PLAIN_NUMBER), text).otherwise(words) if kind == "numeric" else words
    return F.when(value.isNull(), F.lit("NULL")).otherwise(out)


def row_tuple(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row of df as (a,b,...)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.concat(F.lit("("), F.concat_ws(",", *[literal(F.col(f.name), kind_of(f.dataType)) for f in fields]), F.lit(")"))


def insert_head(table: str, columns: list[str]) -> str:
    def name(x: str) -> str:
        return "`" + x.replace("`", "``") + "`"

    return f"INSERT INTO {name(table)} ({', '.join(map(name, columns))}) VALUES"


def like_prefix(prefix: str, mark: str = "!") -> str:
    """A LIKE pattern, to be used with ESCAPE ``mark``, for names that begin with ``prefix``."""
    return "".join(mark + c if c in (mark, "%", "_") else c for c in prefix) + "%"


def starts_like(column: str, prefix: str) -> Column:
    pattern = like_prefix(prefix).replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"{column} LIKE '{pattern}' ESCAPE '!'")


def chunk_path(table: Column, chunk: Column) -> Column:
    return F.format_string("database/%s.%04d.sql", table, chunk)


def swapped_prefix(name: Column, old: str, new: str) -> Column:
    """The name under the new prefix; unchanged if it isn't under the old one."""
    return F.when(name.startswith(old), F.concat(F.lit(new), F.substring(name, F.lit(len(old) + 1), F.length(name)))).otherwise(name)


def generated_name(kind: str, job: Column, table: Column, size: int = GENERATED_DIGITS) -> Column:
    """A short name for a table of a job that no other table has: kind, job, and hex digits of a hash of both."""
    return F.concat(F.lit(kind), job.cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", job.cast("string"), table), 256), 1, size))


def bounded_name(name: Column, limit: int = NAME_BYTES, digits: int = 7) -> Column:
    """The name, or, if longer than ``limit`` bytes, as many of its first characters as fit before _ and hex digits of its hash; no character is split."""
    room = limit - digits - 1
    fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(room)), lambda n: F.octet_length(F.substring(name, F.lit(1), n)) <= room))
    return F.when(F.octet_length(name) <= limit, name).otherwise(F.concat(F.substring(name, F.lit(1), fits), F.lit("_"), F.substring(F.sha2(name, 256), 1, digits)))


def own_name(name: Column, kinds: list[str], tables: list[str], size: int = GENERATED_DIGITS) -> Column:
    """Whether a table is a job's own: a name that ``generated_name`` makes for one of ``kinds``, or one of ``tables`` in any case, alone or after a prefix of letters, digits and underscores. Null isn't."""
    kind = F.regexp_extract(name, rf"\A(.*?)[0-9]+_[0-9a-f]{{{size}}}\z", 1)
    generated = kind.isin(*kinds) & (kind != "") if kinds else F.lit(False)
    low = F.lower(name)
    named = reduce(lambda a, b: a | b, [low.endswith(t.lower()) & F.substring(low, F.lit(1), F.length(low) - len(t)).rlike(r"\A[a-z0-9_]*\z") for t in tables], F.lit(False))
    return F.coalesce(generated | named, F.lit(False))


def table_kind(name: Column, prefix: str, once: list[str], each_site: list[str]) -> Column:
    """The counted table that a name is: the prefix and one of ``once``, or the prefix, perhaps a site's number and an underscore, and one of ``each_site``; "" if none."""
    rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    parts = F.split(rest, "_", 2)
    number = F.get(parts, F.lit(0)).rlike(r"\A[0-9]+\z") & (F.size(parts) == 2)
    table = F.when(number, F.get(parts, F.lit(1))).otherwise(rest)
    known = F.when(table.isin(*each_site), table).when(~number & rest.isin(*once), rest)
    return F.coalesce(F.when(name.startswith(prefix), known), F.lit(""))


def statement_bytes(packet: Column, share: float = 0.5, least: int = 4096, most: int = 1 << 20) -> Column:
    """The longest statement for a server's packet size."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(packet * share))).cast("long")


def key_hex(key: Column) -> Column:
    """A text key's UTF-8 as hexadecimal digits, which no collation changes on the way."""
    return F.hex(F.encode(key, "UTF-8"))


def key_from_hex(digits: Column) -> Column:
    return F.decode(F.unhex(digits), "UTF-8")


def key_json(values: list[Column]) -> Column:
    """A row's key as a JSON array of texts; a value (in bytes) that isn't UTF-8 is an object whose h has its hexadecimal digits. Null for a key with a null."""
    parts = []
    for value in values:
        text = value.cast("binary").cast("string")
        quoted_text = F.to_json(F.array(F.when(F.is_valid_utf8(text), text)))
        digits = F.concat(F.lit('{"h":"'), F.lower(F.hex(value.cast("binary"))), F.lit('"}'))
        parts.append(F.when(F.is_valid_utf8(text), F.substring(quoted_text, F.lit(2), F.length(quoted_text) - 2)).when(value.isNotNull(), digits))
    inner = reduce(lambda a, b: F.concat(a, F.lit(","), b), parts)
    return F.concat(F.lit("["), inner, F.lit("]"))


def key_from_json(key: Column, size: int) -> list[Column]:
    """The ``size`` values, in bytes, of a key that ``key_json`` made; null where the text is no such array."""
    known = F.try_parse_json(key)
    out = []
    for i in range(size):
        digits = F.try_variant_get(known, f"$[{i}].h", "string")
        out.append(F.coalesce(F.unhex(digits), F.encode(F.when(digits.isNull(), F.try_variant_get(known, f"$[{i}]", "string")), "UTF-8")))
    return out
