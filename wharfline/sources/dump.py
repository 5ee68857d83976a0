"""SQL text dumps: tables as files of INSERT statements, and back.

Each task writes its sorted range of rows as one chunk of lines: a header, statements of
bounded size, a marker with the last key after each, and an end line. Reading
splits chunks into lines, so files of any number are read by as many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.functions.sqltext import insert_head, row_tuple
from wharfline.sources.foreign import in_slices, judged

STATEMENT_BYTES = 1 << 20


def dump_lines(df: DataFrame, table: str, keys: list[str], *, chunks: int, statement_bytes: int = STATEMENT_BYTES) -> DataFrame:
    """chunk, line_no and line of a dump of df in key order, ``chunks`` ranges of keys."""
    head = insert_head(table, df.columns)
    ranged = df.select(F.struct(*keys).alias("_key"), F.to_json(F.struct(*keys)).alias("_mark"), row_tuple(df).alias("_row")).repartitionByRange(chunks, "_key").sortWithinPartitions("_key")
    ranged = ranged.select(F.spark_partition_id().alias("chunk"), "_mark", "_row")

    def run(batches):
        lines, held, size, chunk, mark, number = [], [], 0, None, None, 0

        def flush():
            nonlocal held, size
            if held:
                lines.append(f"{head} {','.join(held)};")
                lines.append(f"-- batch {mark}")
            held, size = [], 0

        def out():
            nonlocal lines, number
            n = len(lines)
            batch = pa.record_batch([pa.array([chunk] * n, pa.int32()), pa.array(range(number, number + n), pa.int32()), pa.array(lines)], ["chunk", "line_no", "line"])
            lines, number = [], number + n
            return batch

        for batch in in_slices(batches, "_row"):
            for c, m, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk is None:
                    chunk = c
                    lines.append(f"-- dump of {table}, chunk {chunk}")
                n = len(row.encode()) + 1
                if held and size + n > statement_bytes:
                    flush()
                held.append(row)
                size += n
                mark = m
            # Lines may be as long as a statement: a slice's go on at once.
            if lines:
                yield out()
        if chunk is not None:
            flush()
            lines.append(f"-- end {mark}")
            yield out()

    return ranged.mapInArrow(run, "chunk int, line_no int, line string")


def write_dump(df: DataFrame, path: str, table: str, keys: list[str], *, chunks: int) -> None:
    """One text file a chunk; a failed task leaves none behind."""
    dump_lines(df, table, keys, chunks=chunks).sortWithinPartitions("chunk", "line_no").select("line").write.text(path)


def parse_lines(lines: DataFrame, schema: T.StructType, line: str = "line") -> DataFrame:
    """The rows that the statements of dump lines insert, as ``schema``, by the place of a value; binary columns come from hexadecimal.

    A line is blank, a -- comment, or one whole INSERT of literals; any other, and a row of another width, raises
    ValueError, so that a dump of another make isn't read in part (``foreign`` reads those). A null line is none.
    """
    n = len(schema.fields)

    def run(batches):
        for batch in in_slices(batches, 0):
            rows = []
            for text in batch.column(0).to_pylist():
                kind, _, columns, found, _, why = judged(None if text is None else text.encode(), True) if text else (None,) * 6
                if kind not in (None, "insert"):
                    raise ValueError(f"{why or kind}: {text[:200]}")
                if found and len(columns) != n:
                    raise ValueError(f"{len(columns)} values for {n} columns: {text[:200]}")
                rows += found or []
            if rows:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*rows)], [f"c{i}" for i in range(n)])

    read = lines.select(line).mapInArrow(run, ", ".join(f"c{i} binary" for i in range(n)))
    return read.select(*[(F.col(f"c{i}") if isinstance(f.dataType, T.BinaryType) else F.decode(f"c{i}", "UTF-8").cast(f.dataType)).alias(f.name) for i, f in enumerate(schema.fields)])


def read_dump(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_lines(spark.read.text(path).select(F.col("value").alias("line")), schema)


def dump_bound(spark: SparkSession, path: str, key_schema: str) -> DataFrame:
    """The last key of a dump, from its end lines."""
    marks = spark.read.text(path).where(F.col("value").startswith("-- end ")).select(F.from_json(F.expr("substring(value, 8)"), key_schema).alias("k"))
    return marks.agg(F.max("k").alias("k")).select("k.*")
