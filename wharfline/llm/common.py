"""What several operators share: reading tables, row counts by task, and tables in the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share.

    Without that setting a local session gets a folder of its machine; any other
    raises ValueError, since its executors could not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/wharfline-checkpoints"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: it cuts lineage and outlives executors."""
    path = shared_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands freed memory back to the system. Python workers outlive their tasks and would keep their peak beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # A system without that call keeps the memory.


def tidy(run):
    """A function over a task's batches that gives its memory back at the end."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def tidy_group(work):
    """A function over a group's table that gives its memory back."""

    def whole(group):
        out = work(group)
        give_back()
        return out

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")
