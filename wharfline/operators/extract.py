"""Bounded extraction of tables: key pages, snapshot bounds, batches, chunks and size checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.sizes import oversize, row_estimate
from wharfline.operators.shared import written

Key = dict[str, object]


def _lexicographic(key: Key, last: Column, strict) -> Column:
    """(k1 > a) or (k1 = a and ((k2 > b) or ...)), ending in ``last``."""
    columns = list(key)
    out = last
    for name in reversed(columns):
        out = strict(F.col(name), F.lit(key[name])) | ((F.col(name) == F.lit(key[name])) & out)
    return out


def after_key(key: Key) -> Column:
    """Rows beyond a key. The leading column's plain range comes along, since only that reaches the files' statistics."""
    first, value = next(iter(key.items()))
    return (F.col(first) >= F.lit(value)) & _lexicographic(key, F.lit(False), lambda a, b: a > b)


def up_to_key(key: Key) -> Column:
    first, value = next(iter(key.items()))
    return (F.col(first) <= F.lit(value)) & _lexicographic(key, F.lit(True), lambda a, b: a < b)


def key_page(df: DataFrame, keys: list[str], *, after: Key | None = None, bound: Key | None = None, limit: int | None = None) -> DataFrame:
    """The next rows by key: beyond ``after``, up to ``bound``."""
    out = df
    if after:
        out = out.where(after_key(after))
    if bound:
        out = out.where(up_to_key(bound))
    out = out.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def snapshot_bound(df: DataFrame, keys: list[str]) -> DataFrame:
    """The largest key, one row: what a growing table is read up to."""
    return df.agg(F.max(F.struct(*keys)).alias("k")).select("k.*")


def keyless_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of a table without a key, by all columns."""
    return df.orderBy(*df.columns).offset(offset).limit(limit)


def without_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows but those with one of the values, byte by byte; NULL stays."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(values)) if values else df


def range_counts(df: DataFrame, key: str, width: int) -> DataFrame:
    """range_id, first_key, last_key and n of the key ranges of ``width`` numbers."""
    return df.groupBy(F.floor(F.col(key) / width).alias("range_id")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n"))


def size_profile(df: DataFrame, limit: int) -> DataFrame:
    """rows, bytes, largest and oversize (count) of the row-size estimate."""
    sized = df.select(row_estimate(df).alias("e"))
    return sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("e").alias("bytes"), F.max("e").alias("largest"), F.count_if(F.col("e") > limit).alias("oversize"))


def sample_windows(df: DataFrame, key: str, *, windows: int = 8, rows: int = 5000) -> DataFrame:
    """window_no and the first ``rows`` rows from each of ``windows`` evenly spaced keys on, up to the next window. Keys are whole numbers."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn("window_no", F.lit(0)).limit(0)
    span = int(high) - int(low) + 1
    starts = sorted({int(low) + span * i // windows for i in range(windows)})
    parts = [
        df.where((F.col(key) >= a) & (F.col(key) < b)).orderBy(key).limit(rows).withColumn("window_no", F.lit(i))
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], int(high) + 1]))
    ]
    return reduce(DataFrame.unionByName, parts)


def stored_size(df: DataFrame) -> tuple[int, int] | None:
    """Rows and bytes of the files that df reads, from their listing and footers, no column read; None if df isn't a plain read of files."""
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"))
    except AnalysisException:
        return None
    n, size = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n, size


def size_check(df: DataFrame, key: str | None, limit: int, *, exact_bytes: int = 256 << 20, exact_rows: int = 200_000, windows: int = 8, rows: int = 5000) -> DataFrame:
    """mode, n and likely: how many rows are oversize. Exact up to the bounds on bytes and rows; beyond them a sample, which counts nothing (NULL) and only says whether it met one.

    Which one is decided by what the files' listing and footers tell, so a large table is never measured; a df that isn't a plain read of files is, by the estimate.
    """
    n, size = stored_size(df) or df.select(row_estimate(df).alias("e")).agg(F.count(F.lit(1)), F.coalesce(F.sum("e"), F.lit(0))).first()
    if n <= exact_rows and size <= exact_bytes or key is None:
        return df.agg(F.lit("exact").alias("mode"), F.count_if(oversize(df, limit)).alias("n"), (F.count_if(oversize(df, limit)) > 0).alias("likely"))
    sample = sample_windows(df, key, windows=windows, rows=rows)
    return sample.agg(F.lit("sampled").alias("mode"), F.lit(None).cast("long").alias("n"), (F.count_if(oversize(df, limit)) > 0).alias("likely"))


def greedy_groups(df: DataFrame, section: list[str], order: list[str], size: str, target: int, *, rows: int = 5000, crossing: bool = True, out: str = "batch") -> DataFrame:
    """df with the number of each row's batch within its section, in ``order``.

    With ``crossing`` a batch takes rows until its sizes reach ``target``, the row that
    crosses it included; without, a row that would exceed the target begins the next. A batch has ``rows`` rows at most.

    A sum that starts anew at data-dependent places is no window function, so each
    section is folded in one task, which holds it: give a table's key ranges, not the
    table. Every row comes back once; null keys form sections and come last in order, rows of
    equal keys follow each other in no given order, null sizes count as 0. A column named like ``out`` is replaced.
    """
    kept = df.drop(out)

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        number, held, count, found = 0, 0, 0, []
        for n in group.column(size).to_pylist():
            n = n or 0
            if count and (count >= rows or held >= target if crossing else count >= rows or held + n > target):
                number, held, count = number + 1, 0, 0
            found.append(number)
            held, count = held + n, count + 1
        return group.append_column(out, pa.array(found, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.groupBy(*section).applyInArrow(fold, f"{kinds}, `{out}` bigint")


def batch_summary(batched: DataFrame, section: list[str], order: str, size: str, batch: str = "batch") -> DataFrame:
    """First and last key, rows and bytes of each batch."""
    return batched.groupBy(*section, batch).agg(F.min(order).alias("first_key"), F.max(order).alias("last_key"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def page(df: DataFrame, order: list[Column], number: int, per_page: int, longest: int = 50) -> DataFrame:
    """A page (from 1) of a listing."""
    size = max(1, min(per_page, longest))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def tail(df: DataFrame, order: str, line: str, *, lines: int = 50, size: int = 16384) -> DataFrame:
    """The last lines of a log, at most so many and so many bytes, in order."""
    last = df.orderBy(F.desc(order)).limit(lines).withColumn("_held", F.sum(F.octet_length(line) + 1).over(Window.orderBy(F.desc(order))))
    return last.where(F.col("_held") <= size).drop("_held").orderBy(order)


def exists(df: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def probe(df: DataFrame) -> DataFrame:
    """One row, found: none, one or many. Reads no further than the second row."""
    n = F.count(F.lit(1))
    return df.limit(2).agg(F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("found"))


def with_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows with one of the values, byte by byte."""
    return df.where(F.col(column).isin(values)) if values else df.limit(0)


def without_oversize(df: DataFrame, limit: int) -> DataFrame:
    """The rows that a limit on a row's estimated size lets through."""
    return df.where(~oversize(df, limit))


def numbered(df: DataFrame, order: list[str], bucket: Column, out: str = "ordinal") -> DataFrame:
    """df with each row's number, from 1, in ``order`` (nulls first; rows of equal keys follow each other in no given order).

    ``bucket`` must not fall along the order. Rows are counted by it; the counts, one row a bucket,
    give the buckets' offsets, and rows are put in order only within a bucket: choose buckets that fit a task each. A column named like ``out`` is replaced.
    """
    kept = df.drop(out)
    held = kept.select(F.struct("*").alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], bucket.alias("bucket"))
    counts = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("bucket").alias("at"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*[f"k{i}" for i in range(len(order))]))
    placed = held.withColumn("place", place).join(offsets, F.col("bucket").eqNullSafe(F.col("at")))
    return placed.select("row.*", (F.col("place") + F.col("before")).alias(out))


def boundaries(df: DataFrame, key: str, every: int, bucket: Column) -> DataFrame:
    """range_no (from 1) and upper: every N-th key, up to which a range of ``every`` rows goes. Rows after the last belong to no range."""
    n = F.col("n")
    return numbered(df.select(key), [key], bucket, "n").where(n % every == 0).select((n / every).cast("long").alias("range_no"), F.col(key).alias("upper"))


def bounded_delete(df: DataFrame, key: str, where: Column, limit: int = 500) -> DataFrame:
    """The rows left when the first ``limit`` by key of those that match go. Keys are unique; rows of a null key stay."""
    gone = df.where(where & F.col(key).isNotNull()).select(key).orderBy(key).limit(limit)
    return df.join(F.broadcast(gone), key, "left_anti").select(*df.columns)


def found_up_to(df: DataFrame, key: str, cap: int) -> DataFrame:
    """key and over: the first ``cap`` distinct keys, and whether there are more. Gaps between ids cost nothing, since nothing walks them."""
    first = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(cap + 1)
    n = first.withColumn("n", F.row_number().over(Window.orderBy(key)))
    return n.select(key, "n", (F.max("n").over(Window.partitionBy()) > cap).alias("over")).where(F.col("n") <= cap).select(key, "over")


def running_sums(df: DataFrame, group: list[str], order: str, columns: list[str], block: int = 1024) -> DataFrame:
    """Adds ``<column>_before`` and ``<column>_total``: sums of earlier rows (by ``order``, an integer that is unique and not null in its group), and of all rows of the group.

    Rows are summed in blocks of ``block`` numbers and the blocks' sums after them, so no task orders a whole group. Null group values are a group; null values count as 0.
    """
    at = F.floor(F.col(order) / block)
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    held = df.withColumn("_block", at)
    blocks = held.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    blocks = blocks.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_block").alias("_at"), *[F.coalesce(F.sum(f"_{c}").over(across), F.lit(0)).alias(f"_{c}_before") for c in columns], *[F.coalesce(F.sum(f"_{c}").over(Window.partitionBy(*group)), F.lit(0)).alias(f"_{c}_total") for c in columns])
    held = held.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    same = F.col("_block") == F.col("_at")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return held.join(blocks, same).select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"_{c}_before")).alias(f"{c}_before") for c in columns], *[F.col(f"_{c}_total").alias(f"{c}_total") for c in columns])


# --- batches of long sections ---------------------------------------------------

#: Rows of a block in which batches are followed by one task.
BATCH_BLOCK = 1 << 16


def positions(df: DataFrame, section: list[str], order: list[str], out: str = "position") -> DataFrame:
    """df, written, with each row's number from 0 in its section, in ``order`` (nulls first; ties in a fixed but arbitrary order).

    Rows are dealt by ranges of section and order; the numbers in a range come from its own order, and what is added
    is counted by range and section, so no task orders a whole section.
    """
    keys = [*section, *order]
    tie = "_tie"
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "positions")
    counts = rows.groupBy("_part", *section).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*section).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(section)], "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(section)], F.col("_part") == F.col("_p"))
    return rows.join(counts, same).select(*[c for c in df.columns if c != out], (F.col("_at") - F.col("_first") + F.col("_before")).alias(out))


def _next_starts(rows: DataFrame, target: int, most: int, crossing: bool) -> DataFrame:
    """g, position and next: where the batch after one that begins at a row begins, for every row (g, position, n, n_before).

    The row that a batch ends with is the one whose own sum passes the batch's first sum plus the target.
    A row stands in all buckets of ``target`` that its sum runs through, so it is found in one bucket, by order.
    """
    begin, end = F.col("n_before"), F.col("n_before") + F.col("n")
    spans = F.explode(F.expr(f"sequence(n_before div {target}, (n_before + n) div {target})"))
    held = rows.where("n > 0").select("g", spans.alias("bucket"), end.alias("value"), F.col("position").alias("row"), F.lit(None).cast("bigint").alias("position"))
    # With crossing, the first sum at or above the wanted one ends the batch; without, the first one above it begins the next.
    asked = rows.select("g", F.expr(f"(n_before + {target}) div {target}").alias("bucket"), (begin + target).alias("value"), F.lit(None).cast("bigint").alias("row"), "position")
    first_kind = F.col("row").isNull() if crossing else F.col("row").isNotNull()
    after = Window.partitionBy("g", "bucket").orderBy("value", F.when(first_kind, 0).otherwise(1)).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = held.unionByName(asked).withColumn("hit", F.first("row", ignorenulls=True).over(after)).where("position is not null")
    hit = F.col("hit") + 1 if crossing else F.when(F.col("hit").isNotNull(), F.greatest(F.col("hit"), F.col("position") + 1))
    return found.select("g", "position", F.least(F.coalesce(hit, F.lit(1 << 62)), F.col("position") + most).alias("next"))


def greedy_groups_wide(df: DataFrame, section: list[str], order: list[str], size: str, target: int, *, rows: int = 5000, crossing: bool = True, out: str = "batch", block: int = BATCH_BLOCK) -> DataFrame:
    """What ``greedy_groups`` gives, for sections of any length: no task holds more than a block of a section.

    Sums come from blocks; where a batch that begins at a row would end is found for every row by order within a bucket of sums.
    Inside a block, following these from any row leads to the first batch beyond it; only rows that can be
    reached from another block matter, and of those the ones on the way from the section's first row are found by doubling: each round a
    row knows where twice as many blocks lead. Each block is then followed once from where it is entered. Only numbers travel, not rows.
    Sizes are whole numbers of 0 or more, null counts as 0; rows of equal keys follow each other in a fixed order; null sections are sections.
    """
    kept = df.drop(out)
    placed = positions(kept, section, order, "_position")
    placed = placed.withColumn("_g", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in section]) if section else F.lit(0).cast("bigint"))
    small = placed.select(F.col("_g").alias("g"), F.col("_position").alias("position"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n"))
    ahead = written(_next_starts(running_sums(small, ["g"], "position", ["n"]), target, rows, crossing).withColumn("block", F.floor(F.col("position") / block)), "batch-next")

    def leave(group: pa.Table) -> pa.Table:
        order_ = np.argsort(group.column("position").to_numpy())
        at, to = group.column("position").to_numpy()[order_], group.column("next").to_numpy()[order_]
        out_, first, last = to.copy(), int(at[0]), int(at[-1])
        inside = np.flatnonzero(to <= last)
        for i in inside[::-1].tolist():
            out_[i] = out_[to[i] - first]
        return pa.table([group.column("g"), pa.array(at), pa.array(out_)], ["g", "position", "leaves"])

    exits = written(ahead.groupBy("g", "block").applyInArrow(leave, "g bigint, position bigint, leaves bigint"), "batch-exits")
    # Rows where some block is entered; all chains run over them.
    doors = exits.select("g", F.col("leaves").alias("position")).union(exits.select("g", F.lit(0).cast("bigint").alias("position"))).distinct()
    jump = written(exits.join(doors, ["g", "position"]).select("g", "position", F.col("leaves").alias("to")), "batch-jump")
    entered = jump.where("position = 0").select("g", "position")
    while True:
        more = entered.join(jump, ["g", "position"]).select("g", F.col("to").alias("position")).join(jump.select("g", "position"), ["g", "position"], "left_semi")
        grown = written(entered.union(more).distinct(), "batch-entered")
        onward = jump.select("g", F.col("position").alias("to"), F.col("to").alias("further"))
        longer = jump.join(onward, ["g", "to"])
        if longer.isEmpty():
            entered = grown
            break
        # Entered rows reach as far as all jumps so far; each jump now goes twice as far.
        jump = written(jump.join(onward, ["g", "to"], "left").select("g", "position", F.coalesce("further", "to").alias("to")), "batch-jump")
        entered = grown

    def follow(key: tuple, group: pa.Table, doors_: pa.Table) -> pa.Table:
        order_ = np.argsort(group.column("position").to_numpy())
        at, to = group.column("position").to_numpy()[order_], group.column("next").to_numpy()[order_]
        starts = np.zeros(len(at), np.int64)
        i = min(doors_.column("position").to_pylist(), default=None)
        while i is not None and i <= at[-1]:
            starts[i - at[0]] = 1
            i = int(to[i - at[0]])
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(at), pa.array(starts)], ["g", "position", "start"])

    ways = entered.withColumn("block", F.floor(F.col("position") / block))
    marks = ahead.groupBy("g", "block").cogroup(ways.groupBy("g", "block")).applyInArrow(follow, "g bigint, position bigint, start bigint")
    numbers = running_sums(written(marks, "batch-starts"), ["g"], "position", ["start"]).select(F.col("g").alias("_g"), F.col("position").alias("_position"), (F.col("start_before") + F.col("start") - 1).alias(out))
    return placed.join(numbers, ["_g", "_position"]).select(*kept.columns, out)
