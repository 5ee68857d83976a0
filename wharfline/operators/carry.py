"""Keys and rows carried between tables: renames, copies, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.sqltext import starts_like


def rename_keys(df: DataFrame, key: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """df with old keys under their new names, and name and n of what made way.

    One pass over rows that don't change stands for rename, clear, rename: a row
    under an old key takes its new one, even if that is an old key too; any other row under a new key goes.
    """
    known = df.sparkSession.createDataFrame(list(mapping.items()) or [(None, None)], "old string, new string")
    old = F.create_map([F.lit(x) for pair in mapping.items() for x in pair]) if mapping else F.create_map(F.lit(""), F.lit(""))
    renamed = old[F.col(key)]
    news = known.select(F.col("new").alias(key)).where(F.col(key).isNotNull()).distinct()
    stay = df.where(renamed.isNull())
    kept = stay.join(F.broadcast(news), key, "left_anti").select(*df.columns)
    cleared = stay.join(F.broadcast(news), key).groupBy(F.col(key).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(df.where(renamed.isNotNull()).withColumn(key, renamed)), cleared


def copy_outcomes(df: DataFrame, owner: str, key: str, old: str, new: str, known: list[str], *, longest: int = 255) -> DataFrame:
    """owner, key, copy and outcome of rows under the old prefix that aren't known keys: too_long, existing (the owner has that name) or copied."""
    named = df.where(F.col(key).startswith(old) & ~F.col(key).isin(known)).select(owner, key, F.concat(F.lit(new), F.expr(f"substring({key}, {len(old) + 1})")).alias("copy"))
    have = df.select(owner, F.col(key).alias("copy"), F.lit(True).alias("there")).distinct()
    outcome = F.when(F.octet_length("copy") > longest, "too_long").when(F.col("there"), "existing").otherwise("copied")
    return named.join(have, [owner, "copy"], "left").select(owner, key, "copy", outcome.alias("outcome"))


def copied_rows(df: DataFrame, outcomes: DataFrame, owner: str, key: str) -> DataFrame:
    """df with a row more for each copied key."""
    made = df.join(outcomes.where("outcome = 'copied'").select(owner, key, "copy").distinct(), [owner, key]).withColumn(key, F.col("copy")).select(*df.columns)
    return df.unionByName(made)


def named_under(df: DataFrame, key: str, prefix: str, first: int = 50) -> DataFrame:
    """n and the first names, by bytes, of rows named after a prefix."""
    hit = df.where(starts_like(key, prefix))
    ranked = hit.select(key).distinct().orderBy(key).limit(first).agg(F.sort_array(F.collect_list(key)).alias("names"))
    return hit.agg(F.count(F.lit(1)).alias("n")).join(ranked)


def carry(live: DataFrame, restored: DataFrame, name: str, own: DataFrame) -> DataFrame:
    """The restored rows with the live rows of own names in place of theirs."""
    keep = restored.join(own.select(name), name, "left_anti")
    return keep.select(*restored.columns).unionByName(live.join(own.select(name), name, "left_semi").select(*restored.columns))


def carry_back(live: DataFrame, old: DataFrame, name: str, row_id: str, own: DataFrame, excluded: list[str]) -> DataFrame:
    """Own names as they now are in live: old rows of own names go, excluded ones are neither written nor removed, of repeated names the last row by id stays."""
    mine = own.select(name).where(~F.col(name).isin(excluded)) if excluded else own.select(name)
    return carry(prune_older(live, name, row_id), old, name, mine)


def names_above(df: DataFrame, own: DataFrame, name: str, row_id: str, bound: int) -> DataFrame:
    """The own names that df has with an id above ``bound``, each once. Null names and ids are none."""
    return df.where(F.col(row_id) > bound).select(name).join(own.select(name), name, "left_semi").distinct()


def not_carried(live: DataFrame, old: DataFrame, own: DataFrame, name: str, row_id: str, bound: int) -> DataFrame:
    """Own names of live that didn't come into old with an id above those it had (``bound``): while there is one, old rows must not go."""
    wanted = live.select(name).join(own.select(name), name, "left_semi").distinct()
    return wanted.join(names_above(old, own, name, row_id, bound), name, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of, or beside, its own."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def prune_older(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """Of rows that share a name the one with the largest id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(row_id)))).where("_n = 1").drop("_n")


def names_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def names_union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def names_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_semi")


def self_copies(df: DataFrame, key: str, copies: DataFrame) -> DataFrame:
    """df with further rows: for each of ``copies`` (new, source) the row of that key under the new one. A source that isn't there brings none."""
    pairs = copies.select(F.col("new").alias("_new"), F.col("source").alias("_source"))
    made = df.join(pairs, F.col(key) == F.col("_source")).select(*[F.col("_new").alias(c) if c == key else F.col(c) for c in df.columns])
    return df.unionByName(made)
