"""Mixing sources to target weights: repetition rates per source, then floor(rate) copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import fresh, word_count, written

#: A source table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Sources at most: their sums, one row each, are ordered in one task.
MOST_SOURCES = 10_000_000


def targets(sizes: DataFrame, source: str, size: str, weight: Column, cap: float) -> DataFrame:
    """One row per source with its ``source_size`` and ``target``.

    Targets share the total of all sizes by ``weight`` (a column over the row
    number ``place`` of the sources by code point, null last) and stop at
    ``cap`` times the source's size; the excess goes to the others by weight
    until none is above. That fixed point is found in one ordered pass: sources
    fill up in the order of cap / weight, so with those before a source full
    and the rest sharing what is left, it is full exactly if its cap is at most its share.

    Only the sources' sums, one row each, meet in the ordered windows, in one task.
    """
    per_source = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    ranked = per_source.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight.cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("level", F.col("left") / F.col("rest"))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
        .withColumn("share", F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "place", "level"))).over(every))
    )
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("share.level") * F.col("weight"))
    return filled.select(source, "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", words: str | None = None, period: int = 3, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``size`` counts the words of the text. Sources weigh 1, 2, ... ``period``,
    repeating. ``copies`` is floor(rate), plus 1 if the hash of seed and id,
    as a fraction of 2^32, is below the rate's fraction; ``taken`` is copies
    times size. Reruns agree, and copies never exceed ceil(``cap``).

    ``words`` names a column of sizes, if they are known. A hot source only adds to its own sum, which tasks pre-aggregate; no text
    is shuffled. Null texts and empty texts have size 0 and take nothing. A null
    source is a source of its own. Rows that repeat an id get equal draws, null
    ids hash as empty text. An empty table gives an empty table. A source of
    size 0 has target 0 and rate 0. Columns of docs named like the six new ones are replaced; inner
    columns have names of their own. More than MOST_SOURCES sources raise ValueError.
    """
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    size = word_count(F.col(text)) if words is None else F.coalesce(F.col(words), F.lit(0))
    kept = docs.withColumn(measured := fresh("size"), size).withColumn(name := fresh("source"), F.col(source)).withColumn(drawn := fresh("id"), F.col(doc_id))
    kept = kept.drop(*new).withColumnRenamed(measured, "size")
    weight = (F.col("place") - 1) % period + 1
    # Sums of the sources are worked out once, by the count, and read by the join.
    aims = written(targets(kept.select(F.col(name), "size"), name, "size", weight, cap), "targets")
    sources = aims.count()
    if sources > MOST_SOURCES:
        raise ValueError(f"{sources} sources, more than {MOST_SOURCES}")
    aims = aims.withColumnRenamed(name, other := fresh("source"))
    if sources <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(drawn).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = kept.join(aims, F.col(name).eqNullSafe(F.col(other)), "left").drop(name, other).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("copies", copies.cast("long")).drop(drawn).withColumn("taken", F.col("copies") * F.col("size"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says."""
    return mixed.where(F.col("copies") > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy := fresh("copy"))).drop(copy)
