"""Byte sizes of values and rows as they would be written to a dump."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the estimate: bytes of a NULL, of the quotes and separator of a value, of a row's brackets, and the ratios (numerator, denominator) of escaping text and of hexadecimal.
NULL_BYTES, VALUE_BYTES, ROW_BYTES = 5, 4, 2
TEXT_RATIO, HEX_RATIO = (11, 10), (22, 10)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.BooleanType)


def kind_of(data_type: T.DataType) -> str:
    """numeric, binary or text: how a column's values are written."""
    return "binary" if isinstance(data_type, T.BinaryType) else "numeric" if isinstance(data_type, NUMERIC) else "text"


def ceil_div(value: Column, divisor: int) -> Column:
    """The quotient of non-negative longs, rounded up without doubles."""
    up = value + (divisor - 1)
    return ((up - up % divisor) / divisor).cast("long")


def value_estimate(column: Column, kind: str) -> Column:
    """Estimated bytes of one value in an INSERT."""
    num, den = HEX_RATIO if kind == "binary" else TEXT_RATIO
    size = F.octet_length(column if kind == "binary" else column.cast("string")).cast("long")
    return F.when(column.isNull(), F.lit(NULL_BYTES).cast("long")).otherwise(ceil_div(size * num, den) + VALUE_BYTES)


def row_estimate(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Estimated bytes of a row of df, over all columns by default."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return reduce(lambda a, b: a + b, [value_estimate(F.col(f.name), kind_of(f.dataType)) for f in fields], F.lit(ROW_BYTES).cast("long"))


def oversize(df: DataFrame, limit: int, columns: list[str] | None = None) -> Column:
    """Whether a row would exceed ``limit`` bytes."""
    return row_estimate(df, columns) > limit


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def look_ahead(rows: Column, size: Column, target: int, low: int = 50, high: int = 5000) -> Column:
    """Rows to fetch next: the target's worth at the average size so far, within bounds; ``low`` where nothing was read."""
    return F.when((rows > 0) & (size > 0), clamp(F.floor(F.lit(target) * rows / size), low, high)).otherwise(F.lit(low)).cast("long")


def level(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step, in order, whose bound the value is below."""
    first, *rest = steps
    out = F.when(value < first[0], F.lit(first[1]))
    for bound, name in rest:
        out = out.when(value < bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))
