"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality filter, near-duplicate removal, masking of personal data, mixing to
source weights, tokens. Every stage works on all that the one before kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.llm import bpe, jaccard, mixing, pii, quality
from wharfline.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a bounded sample of all labelled rows, doesn't reject (score 0.3 or more).

    A null text counts as empty and is scored like one; equal texts score alike, however often a row comes; whole texts
    are scored. Nulls in other columns stay; columns beyond COLUMNS are dropped; an empty table gives an empty one.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs.select(*COLUMNS), weights, out="_score").where("_score >= 0.3").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.75).

    The one with the smallest id stays (see jaccard.representatives for ties and null ids). Documents without words, null texts among
    them, are near to nothing and all stay, repeated ones too; texts are compared whole; columns beyond COLUMNS are dropped.
    """
    return jaccard.representatives(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the new text.

    A null text stays null and keeps its n_chars; an empty one stays empty. Repeated rows are masked alike; null ids and
    nulls in other columns stay; whole texts are searched; columns beyond COLUMNS are dropped.
    """
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for.

    A null source is a source; the draw is by the id, so rows that repeat an id are taken alike, null ids too. A document without words
    counts nothing towards its source's size and comes as often as its source's rate asks; nulls in other columns stay; columns beyond COLUMNS are dropped.
    """
    return mixing.emit(mixing.mix_sources(docs.select(*COLUMNS)), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of every document.

    A null or empty text has no tokens; long texts are encoded whole; every row gives one, repeated rows and null ids too; other columns are dropped.
    """
    encoded = bpe.encode_column(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return encoded.select("doc_id", "source", F.size("tokens").alias("n_tokens"), "tokens")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mix", mix_to_weights),
    ("tokens", tokenize),
]

#: Classifier, tree join and tokens have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
