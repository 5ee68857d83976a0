"""File inventories: totals, heavy directories, clashing names, free space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.functions.paths import excluded, heavy_root, problem, with_path_key


def totals(files: DataFrame, path: str, size: str, globs: list[str]) -> DataFrame:
    """files, bytes, excluded, invalid and directories of an inventory."""
    out = excluded(F.col(path), globs)
    bad = problem(F.col(path)).isNotNull()
    return files.agg(
        F.count_if(~out & ~bad).alias("files"),
        F.coalesce(F.sum(F.when(~out & ~bad, F.col(size))), F.lit(0)).alias("bytes"),
        F.count_if(out).alias("excluded"),
        F.count_if(bad & ~out).alias("invalid"),
        F.count_distinct(F.when(~out & ~bad, F.regexp_extract(path, "^(.*)/[^/]*$", 1))).alias("directories"),
    )


def scan_totals(files: DataFrame, path: str, size: str, kind: str, readable: str, globs: list[str], *, largest: int, volume: int, heavy: int) -> DataFrame:
    """One row of what a scan found: files, bytes and directories taken, and what was left out or is worth a word.

    ``kind`` is file, dir, link or special. Of each entry the first that holds counts: excluded (a glob), links, special,
    bad_names (paths that can't be stored), unreadable; files beyond ``largest`` bytes are too_large, those beyond ``volume`` are taken and count
    in over_volume as well. collisions are names that fall together where case doesn't count, heavy the directories of a heavy kind of ``heavy`` bytes or more, invalid_patterns globs
    that are empty or climb. Null kinds count as special, null sizes as 0. Names and directories are counted after they were made distinct in their tasks.
    """
    p, k, n = F.col(path), F.col(kind), F.coalesce(F.col(size), F.lit(0))
    usable = [g for g in globs if g.strip("/ ") and ".." not in g.split("/")]
    state = (
        F.when(excluded(p, usable) if usable else F.lit(False), "excluded").when(k == "link", "links").when(~F.coalesce(k.isin("file", "dir"), F.lit(False)), "special")
        .when(problem(p).isNotNull(), "bad_names").when(~F.coalesce(F.col(readable), F.lit(False)), "unreadable").when((k == "file") & (n > largest), "too_large").when(k == "file", "files").otherwise("directories")
    )
    told = files.select(p.alias("p"), n.alias("n"), state.alias("state"))
    of = ("files", "directories", "excluded", "links", "special", "unreadable", "bad_names", "too_large")
    counts = told.agg(*[F.count_if(F.col("state") == s).alias(s) for s in of], F.coalesce(F.sum(F.when(F.col("state") == "files", F.col("n"))), F.lit(0)).alias("bytes"), F.count_if((F.col("state") == "files") & (F.col("n") > volume)).alias("over_volume"))
    taken = told.where("state in ('files', 'directories')")
    clashes = taken.select(F.lower("p").alias("low"), "p").distinct().groupBy("low").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("collisions"))
    big = heavy_directories(taken, "p", "n", heavy).agg(F.count(F.lit(1)).alias("heavy"))
    return counts.crossJoin(F.broadcast(clashes)).crossJoin(F.broadcast(big)).withColumn("invalid_patterns", F.lit(len(globs) - len(usable)).cast("long"))


def heavy_directories(files: DataFrame, path: str, size: str, least: int = 50 << 20) -> DataFrame:
    """directory and bytes of the outermost heavy directories of at least so many bytes, heaviest first."""
    found = files.select(heavy_root(F.col(path)).alias("directory"), F.col(size).alias("b")).where("directory is not null")
    return found.groupBy("directory").agg(F.sum("b").alias("bytes")).where(F.col("bytes") >= least).orderBy(F.desc("bytes"), "directory")


def collisions(names: DataFrame, name: str, key: Column | None = None) -> DataFrame:
    """folded key and the names, sorted, that share it."""
    keyed = with_path_key(names.select(F.col(name).alias("n")), "n", "key") if key is None else names.select(key.alias("key"), F.col(name).alias("n"))
    grouped = keyed.distinct().groupBy("key").agg(F.sort_array(F.collect_list("n")).alias("names"))
    return grouped.where(F.size("names") > 1)


def clashes(files: DataFrame, path: str, *, fold: bool = True) -> DataFrame:
    """key, files and directories of keys that two files, or a file and a directory, would share.

    Every file brings the directories above it; two directories of one key are one. A directory
    key's rows are reduced in their tasks, so a directory of a third of all files is no hot group.
    """
    rows = files.select(F.col(path).alias("p"))
    rows = with_path_key(rows, "p", "k").select("k") if fold else rows.select(F.col("p").alias("k"))
    depth = F.size(F.split("k", "/"))
    above = F.when(depth > 1, F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.array_join(F.slice(F.split("k", "/"), F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    marks = rows.select("k", F.lit(1).alias("f"), F.lit(0).alias("d")).unionByName(rows.select(F.explode(above).alias("k"), F.lit(0).alias("f"), F.lit(1).alias("d")))
    found = marks.groupBy("k").agg(F.sum("f").alias("files"), F.max("d").alias("directories"))
    return found.where("files > 1 or (files = 1 and directories = 1)").select(F.col("k").alias("key"), "files", "directories")


def space_needed(staged: DataFrame, volume: str, size: str, free: DataFrame) -> DataFrame:
    """volume, needed (bytes and 5 % or 100 MiB more), free, and enough, for each volume."""
    need = staged.groupBy(volume).agg(F.sum(size).alias("b")).select(volume, (F.col("b") + F.greatest(F.ceil(F.col("b") * 5 / 100), F.lit(100 << 20))).cast("long").alias("needed"))
    return need.join(free, volume, "left").withColumn("enough", F.col("free") >= F.col("needed"))


def directories(files: DataFrame, path: str) -> DataFrame:
    """directory and files (n below it) of every directory above a path, each once; a path without / has none."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return files.select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def byte_order(files: DataFrame, path: str) -> DataFrame:
    """The listing in byte order of its paths, the same on every file system."""
    return files.orderBy(F.col(path).cast("binary"))
