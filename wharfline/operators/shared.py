"""Tables that cut a long lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read again, so that no later step repeats those before it.

    Where that setting is empty a local session gets a folder of its machine; any other raises ValueError.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/wharfline-tables"
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
