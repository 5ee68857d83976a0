"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, rows: int, total_bytes: int, seed: int = 7) -> pa.Table:
    """At most ``rows`` labelled texts of ``total_bytes`` bytes in all, as an Arrow table (doc_id, text, label) by id.

    The sample is drawn from the labelled ids that docs has and that ``allowed``, a condition on
    doc_id, admits: the first ``rows`` by a hash of the id. Texts are whole; in that order those that
    would exceed ``total_bytes`` are passed over, so what reaches the driver is bounded
    whatever the size of the tables. Labels other than 0 and 1 and null ids are left out; of repeated ids
    in docs, the smallest text counts, in labels, the largest label; null texts count as empty. Other columns are ignored.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    admitted = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    ids = admitted.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = written(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")
    sizes = found.select("doc_id", F.octet_length("text").cast("long").alias("n"), order.alias("at")).toArrow().sort_by([("at", "ascending"), ("doc_id", "ascending")])
    over, left = [], total_bytes
    for i, n in zip(sizes.column("doc_id").to_pylist(), sizes.column("n").to_pylist()):
        if n > left:
            over.append(i)
        else:
            left -= n
    return found.where(~F.col("doc_id").isin(over) if over else F.lit(True)).select("doc_id", "text", "label").toArrow().sort_by("doc_id")


def balance(labels: np.ndarray, most: float) -> np.ndarray:
    """Weights that give both labels half of the total, at most ``most`` a row."""
    share = labels.mean() if len(labels) else 0.5
    return np.where(labels == 1, min(0.5 / max(share, 1e-3), most), min(0.5 / max(1 - share, 1e-3), most))
