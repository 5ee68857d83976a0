"""The order in which tables bound by foreign keys can be dropped."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.operators.shared import written

# Hops of one job; as many joins are planned at once.
HOPS = 4


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names; where that is unset, a local session gets one of its machine, any other raises ValueError."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wharfline-"))
    return df.checkpoint()


def kept_tables(tables: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """name and by: tables that must stay, since a table outside the set, or one that stays, refers to them.

    Each round looks only from the tables the last one found and is checkpointed (spark.checkpoint.dir), so no round repeats those before it.
    """
    names = tables.select("name").distinct()
    outside = edges.join(names.select(F.col("name").alias("child")), "child", "left_anti")
    new = settled(outside.select(F.col("parent").alias("name"), F.col("child").alias("by")).join(names, "name").groupBy("name").agg(F.min("by").alias("by")))
    kept = new
    for _ in range(rounds):
        if new.isEmpty():
            return kept
        more = edges.join(new.select(F.col("name").alias("child")), "child").select(F.col("parent").alias("name"), F.col("child").alias("by")).join(names, "name").join(kept.select("name"), "name", "left_anti")
        new = settled(more.groupBy("name").agg(F.min("by").alias("by")))
        kept = kept.unionByName(new)
    raise RuntimeError("kept tables not settled")


def kept_by(kept: DataFrame, tables: DataFrame, edges: DataFrame) -> DataFrame:
    """name and by: all that refers to a kept table and stays, one row each."""
    names, stays = tables.select(F.col("name").alias("child")).distinct(), kept.select(F.col("name").alias("child"))
    links = edges.join(kept.select(F.col("name").alias("parent")), "parent").where("child <> parent")
    outside = links.join(names, "child", "left_anti").unionByName(links.join(stays, "child"))
    return outside.select(F.col("parent").alias("name"), F.col("child").alias("by")).distinct()


def _hops(links: DataFrame, step: Callable[[Column], Column] = lambda value: value, *, smallest: bool = False) -> DataFrame:
    """links (child, parent, value: the child's) after HOPS hops: in each a child takes the largest (or smallest) of its own value and what its own children offer, their values after ``step``; old is the value one hop before.

    Nothing is written between: a hop shuffles offers, one a parent, to the links, whose shuffle by child serves all hops. Nulls offer nothing.
    """
    best, better = (F.min, F.least) if smallest else (F.max, F.greatest)
    # Filters that a later hop would add are there from the first, so that all read one shuffle.
    base = links.select("child", "parent", "value").where("child is not null and parent is not null")
    now = base.withColumn("old", F.lit(None).cast(base.schema["value"].dataType))
    for _ in range(HOPS):
        offers = now.where("value is not null").groupBy(F.col("parent").alias("child")).agg(best(step(F.col("value"))).alias("offer"), best(step(F.col("old"))).alias("before"))
        # Offers, a row each, are what is looked up, so that links aren't sorted in every hop.
        now = base.join(offers.hint("shuffle_hash"), "child", "left").select("child", "parent", better("value", "offer").alias("value"), better("value", "before").alias("old"))
    return now


def _spread(links: DataFrame, step: Callable[[Column], Column] = lambda value: value, *, smallest: bool = False) -> DataFrame:
    """links (child, parent, value) once no value changes any more, see ``_hops``; written after HOPS hops each."""
    while True:
        changed = ~F.col("value").eqNullSafe(F.col("old"))
        links = written(_hops(links, step, smallest=smallest).select("child", "parent", "value", changed.alias("changed")), "graph-values")
        if links.where("changed").isEmpty():
            return links.drop("changed")


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("parent").alias("child"), F.col("child").alias("parent"), *(c for c in links.columns if c not in ("child", "parent")))


def _endless(links: DataFrame) -> DataFrame:
    """links (child, parent) without those whose child can't be reached by walks of any length."""
    while True:
        walks = written(_hops(links.withColumn("value", F.lit(0)), lambda value: value + 1).select("child", "parent", "value"), "graph-walks")
        links = walks.where(F.col("value") == HOPS).select("child", "parent")
        # If a child of the others were left, the longest walk to it would pass a child one link short of HOPS.
        if walks.where(F.col("value") == HOPS - 1).isEmpty():
            return links


def strong_groups(edges: DataFrame) -> DataFrame:
    """name and first of every table in a circle of edges (child, parent): the smallest name of those that refer to each other, directly or not.

    Edges that can't lie in a circle are taken away until none is left to take. Then each table gets the
    smallest name that leads to it, and, backwards among tables of one such name, what leads to that name is its circle;
    circles found go, and the rest is searched again. Rounds are joins, written every few; names of tables in no circle are left out.
    Edges may repeat; those with nulls and from a table to itself are none.
    """
    left, groups = edges.select("child", "parent").where("child <> parent"), None
    while True:
        # A link of a circle starts where others end and ends where others start.
        left = _turned(_endless(_turned(_endless(left))))
        if left.isEmpty():
            break
        colour = _spread(left.withColumn("value", F.col("child")), smallest=True)
        # Every parent that is left is a child, too.
        own = colour.groupBy(F.col("child").alias("parent")).agg(F.min("value").alias("colour"))
        ends = colour.join(own, "parent").where("value = colour")
        # Backwards, from the names that are their own colour.
        back = _spread(written(_turned(ends).withColumn("value", F.when(F.col("child") == F.col("colour"), F.col("colour"))).select("child", "parent", "value"), "graph-back"))
        found = written(back.where("value is not null").select(F.col("child").alias("name"), F.col("value").alias("first")).distinct(), "graph-circles")
        groups = found if groups is None else groups.unionByName(found)
        gone = found.select("name")
        rest = colour.join(gone.withColumnRenamed("name", "child"), "child", "left_anti").join(gone.withColumnRenamed("name", "parent"), "parent", "left_anti")
        left = written(rest.select("child", "parent"), "graph-edges")
        if left.isEmpty():
            break
    if groups is None:
        return edges.select(F.col("child").alias("name"), F.col("child").alias("first")).limit(0)
    return groups


def drop_order(tables: DataFrame, edges: DataFrame, *, fold: bool = False) -> DataFrame:
    """round (from 1), first, name and together: which tables can be dropped when, kept ones (see ``kept_tables``) left out.

    Children go before their parents; tables that refer to each other in a circle go in one statement, with checks off
    (``together``), named by their first. Statements of a round go by that name, in bytes. A round takes all that no remaining table outside a statement
    refers to, so there are as many as the longest chain. With ``fold`` names that differ in case only are one, the first of them.
    Nulls are no names; repeated names and edges count once; an empty table gives an empty result.
    """
    key = (lambda c: F.lower(c)) if fold else (lambda c: F.col(c))
    names = tables.where("name is not null").select(key("name").alias("key"), F.col("name").alias("written"))
    names = names.groupBy("key").agg(F.min("written").alias("written")) if fold else names.distinct()
    names = written(names.withColumn("id", F.monotonically_increasing_id()), "graph-names")
    ends = edges.where("child is not null and parent is not null").select(key("child").alias("child"), key("parent").alias("parent")).where("child <> parent")
    ids = ends.join(names.select(F.col("key").alias("parent"), F.col("id").alias("p")), "parent").join(names.select(F.col("key").alias("child"), F.col("id").alias("c")), "child", "left")
    # All tables outside that refer to a table are one to it, below 0.
    links = ids.select(F.coalesce("c", -1 - F.col("p")).alias("child"), F.col("p").alias("parent")).distinct()
    links = _spread(written(links.withColumn("value", F.when(F.col("child") < 0, 1)), "graph-links"))
    kept = written(links.where("value is not null").select("parent").distinct(), "graph-kept")
    links = written(links.where("value is null").join(kept, "parent", "left_anti").select("child", "parent"), "graph-free")
    circles = written(strong_groups(links).select(F.col("name").alias("id"), F.col("first").alias("statement")), "graph-groups")
    between = links.join(circles.select(F.col("id").alias("child"), F.col("statement").alias("c")), "child", "left").join(circles.select(F.col("id").alias("parent"), F.col("statement").alias("p")), "parent", "left")
    between = between.select(F.coalesce("c", "child").alias("child"), F.coalesce("p", "parent").alias("parent")).where("child <> parent").distinct()
    between = _spread(written(between.withColumn("value", F.lit(1)), "graph-between"), lambda value: value + 1)
    rounds = between.groupBy(F.col("parent").alias("statement")).agg((F.max("value") + 1).alias("round"))
    firsts = circles.join(names, "id").groupBy("statement").agg(F.min("written").alias("first"))
    together = circles.join(firsts.join(rounds, "statement", "left"), "statement").select("id", "first", F.coalesce("round", F.lit(1)).alias("with"))
    free = names.join(kept.withColumnRenamed("parent", "id"), "id", "left_anti").join(together, "id", "left").join(rounds.withColumnRenamed("statement", "id"), "id", "left")
    return free.select(F.coalesce("with", "round", F.lit(1)).alias("round"), F.coalesce("first", "written").alias("first"), F.col("written").alias("name"), F.col("first").isNotNull().alias("together"))
