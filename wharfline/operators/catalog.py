"""Sets of table names: whose they are, what moves, and the state of a planned swap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.sizes import row_estimate
from wharfline.functions.sqltext import NAME_BYTES, generated_name, own_name, swapped_prefix

#: Tables that every installation has, and the names of its tables per site and as a whole.
MARKERS = ("posts", "postmeta", "options", "comments", "terms", "term_taxonomy", "term_relationships")
SITE_TABLES = ("posts", "postmeta", "comments", "commentmeta", "terms", "termmeta", "term_taxonomy", "term_relationships", "options", "links")
GLOBAL_TABLES = ("users", "usermeta", "blogs", "blogmeta", "signups", "site", "sitemeta", "registration_log", "sitecategories")


def core_name(rest: Column) -> Column:
    """Whether a name without its prefix is a core table's, a sub-site's included."""
    site = "|".join(SITE_TABLES)
    return rest.isin(*SITE_TABLES, *GLOBAL_TABLES) | rest.rlike(rf"^[1-9][0-9]*_({site})$")


def subsite(name: Column, prefix: str) -> Column:
    site = "|".join(SITE_TABLES)
    return name.startswith(prefix) & F.substring(name, F.lit(len(prefix) + 1), F.length(name)).rlike(rf"^[1-9][0-9]*_({site})$")


def complete_prefixes(names: DataFrame, name: str, prefix: str, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """candidate: longer prefixes under which all markers stand (relational division)."""
    text = F.col(name)
    hit = [F.when(text.endswith(m), F.struct(F.substring(text, F.lit(1), F.length(text) - len(m)).alias("candidate"), F.lit(m).alias("marker"))) for m in markers]
    pairs = names.select(F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("p")).select("p.*")
    return pairs.where(F.length("candidate") > len(prefix)).groupBy("candidate").agg(F.count_distinct("marker").alias("n")).where(F.col("n") == len(markers)).select("candidate")


def claims(names: DataFrame, candidates: DataFrame, name: str) -> DataFrame:
    """name and the shortest candidate under which its rest is a core name.

    The prefix join is an equality: each name brings all its own prefixes, as many as it has characters.
    """
    text = F.col(name)
    prefixes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))
    own = names.where(F.length(text) > 0).select(name, F.explode(prefixes).alias("candidate"))
    rest = F.expr(f"substring({name}, length(candidate) + 1)")
    met = own.join(candidates, "candidate").where(core_name(rest))
    return met.groupBy(name).agg(F.min_by("candidate", F.length("candidate")).alias("candidate"))


def foreign_tables(tables: DataFrame, name: str, prefix: str, multisite: bool, core: list[str] | None = None) -> DataFrame:
    """candidate, name and fate (excluded or kept) of the tables of other installations under the prefix.

    Excluded are core tables, each under the shortest prefix that claims it; kept
    are the others under a prefix that excludes something, named once, under the shortest one.
    """
    text = F.col(name)
    open_ = tables.select(name).distinct().where(text.startswith(prefix))
    if core:
        open_ = open_.where(~text.isin(core))
    if multisite:
        open_ = open_.where(~subsite(text, prefix))
    excluded = claims(open_, complete_prefixes(open_, name, prefix), name)
    groups = excluded.select("candidate").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))
    others = open_.join(excluded.select(name), name, "left_anti").select(name, F.explode(prefixes).alias("candidate"))
    kept = others.join(groups, "candidate").groupBy(name).agg(F.min_by("candidate", F.length("candidate")).alias("candidate"))
    return excluded.withColumn("fate", F.lit("excluded")).unionByName(kept.withColumn("fate", F.lit("kept"))).select("candidate", name, "fate")


def table_moves(live: DataFrame, incoming: DataFrame, name: str, prefix: str, multisite: bool = False) -> DataFrame:
    """name and fate of the live tables that the backup doesn't bring: move if they are this site's, else report."""
    theirs = foreign_tables(live, name, prefix, multisite).select(name).withColumn("theirs", F.lit(True))
    rest = live.select(name).distinct().join(incoming.select(name), name, "left_anti").join(theirs, name, "left")
    mine = F.col(name).startswith(prefix) & F.col("theirs").isNull()
    return rest.select(name, F.when(mine, "move").otherwise("report").alias("fate"))


def incoming_judgement(live: DataFrame, finals: DataFrame, name: str, prefix: str, core: list[str], *, multisite: bool = False, shared: list[str] | None = None) -> DataFrame:
    """name and verdict of restored names that a neighbour has a say in: shared, neighbour or uncertain."""
    fates = foreign_tables(live, name, prefix, multisite).select(name, "fate")
    own = F.col(name).isin(core)
    both = (own & (F.col("fate") == "excluded")) | F.col(name).isin(shared or [])
    verdict = F.when(both, "shared").when(~own & (F.col("fate") == "excluded"), "neighbour").when(~own & (F.col("fate") == "kept"), "uncertain")
    return finals.select(name).distinct().join(fates, name, "left").select(name, verdict.alias("verdict")).where("verdict is not null")


def restore_plan(names: DataFrame, name: str, old: str, new: str, job: int, *, excluded: list[str] | None = None, longest: int = NAME_BYTES) -> DataFrame:
    """name, final (under the new prefix), temporary, clash (whether another name ends up there too), and reason, why a table isn't restored.

    A table is left out if it is ``excluded`` or a job's own; a plan can't run with one of another prefix, with
    a final name longer than ``longest`` bytes, or with two that end up under one name or share a temporary one (clash, shared), cases aside. Null: nothing stands against it.
    """
    name_ = F.col(name)
    planned = names.select(name, swapped_prefix(name_, old, new).alias("final"), generated_name("wt", F.lit(job), name_).alias("temporary"))
    planned = planned.withColumn("clash", F.count(F.lit(1)).over(Window.partitionBy(F.lower("final"))) > 1)
    first = F.when(name_.isin(excluded or []), "excluded").when(own_name(name_, ["wt"], []), "own").when(~name_.startswith(old), "another prefix").when(F.octet_length("final") > longest, "too long")
    planned = planned.withColumn("reason", first)
    both = {c: F.count(F.when(F.col("reason").isNull(), 1)).over(Window.partitionBy(F.lower(c))) > 1 for c in ("final", "temporary")}
    planned = planned.withColumns({"_final": both["final"], "_temporary": both["temporary"]})
    reason = F.coalesce("reason", F.when(F.col("_final"), "clash").when(F.col("_temporary"), "shared"))
    return planned.withColumn("reason", reason).drop("_final", "_temporary")


def missing_tables(names: DataFrame, name: str, sites: DataFrame, needed: list[str]) -> DataFrame:
    """prefix and missing: the tables that a restored site (``sites``: prefix) needs and that aren't among the names."""
    wanted = sites.select("prefix", F.explode(F.array(*map(F.lit, needed))).alias("table")).select("prefix", F.concat("prefix", "table").alias("missing"))
    return wanted.join(names.select(F.col(name).alias("missing")), "missing", "left_anti").select("prefix", "missing")


def swap_states(plan: DataFrame, there: DataFrame) -> DataFrame:
    """The plan (kind, live, stage, old, had_live) with l, s and o, which of its names are there, and state: before, after or neither."""
    names = there.select(F.col("name").alias("n")).distinct()
    out = plan
    for column, flag in (("live", "l"), ("stage", "s"), ("old", "o")):
        out = out.join(names.select(F.col("n").alias(column), F.lit(True).alias(flag)), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    l, s, o, had = (F.col(c) for c in ("l", "s", "o", "had_live"))
    move = F.when(l & ~o, "before").when(~l & o, "after")
    swap = F.when(s & ~o & (l == had), "before").when(~s & l & (o == had), "after")
    return out.withColumn("state", F.coalesce(F.when(F.col("kind") == "move", move).otherwise(swap), F.lit("neither")))


def committed(states: DataFrame) -> DataFrame:
    """One row: whether every entry is swapped."""
    return states.agg(F.coalesce(F.bool_and(F.col("state") == "after"), F.lit(True)).alias("committed"))


def rollback_renames(states: DataFrame, stray: Column) -> DataFrame:
    """seq, step, source and target: the renames that put each entry back, by what is there; none where that is no evidence."""

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("source"), b.alias("target"))

    live, stage, old = (F.col(c) for c in ("live", "stage", "old"))
    l, s, o, had = (F.col(c) for c in ("l", "s", "o", "had_live"))
    none = F.array().cast("array<struct<source:string,target:string>>")
    back, aside = pair(old, live), pair(live, stray)
    move = F.when(~o, none).when(l, F.array(aside, back)).otherwise(F.array(back))
    swap = (
        F.when(~s & l & had & ~o, none)
        .when(~s & l & had & o, F.array(pair(live, stage), back))
        .when(~s & l, F.array(pair(live, stage)))
        .when(o & ~l, F.array(back))
        .when(s & o & l, F.array(aside, back))
        .otherwise(none)
    )
    steps = F.when(F.col("kind") == "move", move).otherwise(swap)
    return states.select("seq", F.posexplode(steps)).select("seq", F.col("pos").alias("step"), "col.source", "col.target")


def key_conflicts(edges: DataFrame, moved: DataFrame, swapped: DataFrame) -> DataFrame:
    """Foreign keys (child, parent) across the border of a swap: one end in it, the other a live table that stays. side names the end that stays."""
    inside = moved.select("name").unionByName(swapped.select("name")).distinct()
    c, p = inside.select(F.col("name").alias("child"), F.lit(True).alias("c")), inside.select(F.col("name").alias("parent"), F.lit(True).alias("p"))
    found = edges.join(c, "child", "left").join(p, "parent", "left")
    return found.where(F.col("c").isNull() != F.col("p").isNull()).select("child", "parent", F.when(F.col("c").isNull(), "child").otherwise("parent").alias("side"))


def first_known(wanted: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """name and choice: itself if known, else its first known candidate (name, candidate, rank), else null."""
    have = known.select("name").distinct()
    best = candidates.join(have.select(F.col("name").alias("candidate")), "candidate").groupBy("name").agg(F.min_by("candidate", "rank").alias("other"))
    itself = have.withColumn("self", F.col("name"))
    return wanted.select("name").join(itself, "name", "left").join(best, "name", "left").select("name", F.coalesce("self", "other").alias("choice"))


def neighbours_by_keys(keys: DataFrame, key: str, prefixes: DataFrame) -> DataFrame:
    """neighbour: prefixes of keys ending in capabilities that aren't among the known ones."""
    found = keys.where(F.col(key).endswith("capabilities")).select(F.expr(f"substring({key}, 1, length({key}) - 12)").alias("neighbour")).where("neighbour <> ''").distinct()
    return found.join(prefixes.select(F.col("prefix").alias("neighbour")), "neighbour", "left_anti")


def copy_kind(previous: Column, current: Column, previous_there: Column) -> Column:
    """What a changed directory means: deployment (two releases side by side), moved (the old one is gone), clone (it is still there), or same."""
    release = r"^(.*/)?releases/[^/]+/?$"
    parent = F.regexp_replace(F.regexp_replace(previous, "/+$", ""), "/[^/]*$", "")
    siblings = parent == F.regexp_replace(F.regexp_replace(current, "/+$", ""), "/[^/]*$", "")
    same = F.regexp_replace(previous, "/+$", "") == F.regexp_replace(current, "/+$", "")
    return F.when(same, "same").when(siblings & previous.rlike(release) & current.rlike(release), "deployment").when(~previous_there, "moved").otherwise("clone")


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """t, position (from 1) and name of every column of the tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, n, c) for t, df in tables.items() for n, c in enumerate(df.columns, 1)], "t string, position int, name string")


def missing_columns(described: DataFrame, expected: DataFrame) -> DataFrame:
    """t and name of expected columns (t, name) that a described table hasn't, in any case of letters."""
    have = described.select("t", F.lower("name").alias("_n"))
    return expected.withColumn("_n", F.lower("name")).join(have, ["t", "_n"], "left_anti").select("t", "name")


def listed(spark, prefix: str) -> DataFrame:
    """name of the session's tables and views under a prefix, in the prefix's own case."""
    every = spark.sql("SHOW TABLES").select(F.col("tableName").alias("name"))
    return every.where(F.col("name").startswith(prefix))


def statistics(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """name, rows, bytes and average bytes of each named table; zeros for one that isn't there."""
    spark = next(iter(tables.values())).sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    held = [df.select(row_estimate(df).alias("e")).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("e"), F.lit(0)).alias("bytes")) for n, df in tables.items() if n in names]
    if not held:
        return wanted.select("name", *[F.lit(0).cast("long").alias(c) for c in ("rows", "bytes", "average")])
    both = wanted.join(reduce(DataFrame.unionByName, held), "name", "left").fillna(0, ["rows", "bytes"])
    return both.select("name", "rows", "bytes", F.when(F.col("rows") > 0, F.floor(F.col("bytes") / F.col("rows"))).otherwise(0).cast("long").alias("average"))


def reference_edges(described: DataFrame) -> DataFrame:
    """child, column and parent: columns named x_<stem>key of a table whose name begins with the stem and whose first column ends in the same."""
    stem = F.regexp_extract("name", "_([a-z]+)key$", 1)
    columns = described.withColumn("stem", stem).where("stem <> ''")
    parents = columns.where((F.col("position") == 1) & F.col("t").startswith(F.col("stem"))).select(F.col("t").alias("parent"), "stem")
    return columns.join(parents, "stem").where("t <> parent").select(F.col("t").alias("child"), F.col("name").alias("column"), "parent")


def planned(tables: DataFrame, excluded: DataFrame, skipped: DataFrame) -> DataFrame:
    """name and fate of a backup's tables: excluded, else the reason of ``skipped`` (name, reason), else planned. Names are unique in each."""
    out = excluded.select("name", F.lit("excluded").alias("_out"))
    return tables.select("name").join(out, "name", "left").join(skipped.select("name", "reason"), "name", "left").select("name", F.coalesce("_out", "reason", F.lit("planned")).alias("fate"))


def definition_problems(definitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """t, c and problem of chunks (t, c, columns, creates) against definitions (t, columns).

    "undefined" without a definition, "not created" where a table's first chunk doesn't create it, "created again" where
    a later one does, "columns" where the lists differ in names or order. A chunk's columns may be null, as it names none.
    """
    known = definitions.select("t", F.col("columns").alias("_want"), F.lit(True).alias("_known"))
    problem = (
        F.when(F.col("_known").isNull(), "undefined")
        .when((F.col("c") == 1) & ~F.col("creates"), "not created")
        .when((F.col("c") > 1) & F.col("creates"), "created again")
        .when(F.col("columns") != F.col("_want"), "columns")
    )
    return chunks.join(known, "t", "left").select("t", "c", problem.alias("problem")).where("problem is not null")


RENAME_HEAD = len("RENAME TABLE ")


def rename_bytes(live: Column, stage: Column, aside: Column, had: Column) -> Column:
    """Bytes of a table's part in a statement of renames: the live table aside if it was there, and the staged one in, each with a comma and a space. Names hold no quotes."""
    pair = lambda a, b: F.octet_length(a) + F.octet_length(b) + len("`` TO ``") + 2
    return (pair(stage, live) + F.when(had, pair(live, aside)).otherwise(0)).cast("long")
