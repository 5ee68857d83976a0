"""Sidecar files of an archive: indexes of JSON lines, the manifest, and the list of files below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATABASE_INDEX = "t string, c int, p string, b long, h string"
FILES_INDEX = "p string, b long, m long, h string, hc array<string>"
MANIFEST = "version int, site map<string,string>, database struct<exported:long,tables:array<struct<name:string,rows:long,bytes:long,chunks:long,sha256:string>>>, files struct<bytes:long,count:long>"


def read_index(spark: SparkSession, path: str, schema: str = DATABASE_INDEX) -> DataFrame:
    """Lines of an index; unknown keys are ignored, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("error").json(path)


def append_once(index: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The index with further lines, of which such as it already has are dropped: a replayed append changes nothing."""
    return index.unionByName(lines.join(index.select(*keys), keys, "left_anti").select(*index.columns))


def parse_manifest(documents: DataFrame, column: str = "manifest") -> DataFrame:
    """The manifest as columns, and problem: why it isn't one, or null."""
    read = documents.select(F.from_json(column, MANIFEST).alias("m"), F.octet_length(column).alias("size"))
    tables = F.col("m.database.tables")
    problem = (
        F.when(F.col("size") > 4 << 20, "size")
        .when(F.col("m.version").isNull() | (F.col("m.version") != 1), "version")
        .when(F.exists(tables, lambda t: ~t["sha256"].rlike(r"\A[0-9a-f]{64}\z") | (t["bytes"] < 0) | (t["chunks"] < 0)), "table")
    )
    return read.select("m.*", problem.alias("problem"))


def read_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """p, b and m (path below the folder, bytes, seconds) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(F.substring_index(path, folder.rstrip("/") + "/", -1).alias("p"), F.col("length").alias("b"), F.unix_timestamp("modificationTime").alias("m"))
