"""Content hashes, CRC-32 of joined pieces, and stable ids."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.operators.extract import running_sums


def list_hash(hashes: Column) -> Column:
    """SHA-256 of the concatenated hexadecimal hashes of an ordered array."""
    return F.sha2(F.array_join(hashes, ""), 256)


def content_hash(chunks: DataFrame, key: str, ordinal: str, data: str) -> DataFrame:
    """key, bytes, hash and chunk hashes of values kept in ordered chunks: the plain SHA-256 of one chunk, or the hash of the list of more."""
    one = chunks.select(key, ordinal, F.sha2(F.col(data), 256).alias("h"), F.octet_length(data).cast("long").alias("b"))
    listed = one.groupBy(key).agg(F.sum("b").alias("bytes"), F.sort_array(F.collect_list(F.struct(ordinal, "h"))).alias("l"))
    hashes = F.transform("l", lambda x: x["h"])
    return listed.select(key, "bytes", F.when(F.size("l") == 1, F.col("l")[0]["h"]).otherwise(list_hash(hashes)).alias("hash"), F.when(F.size("l") > 1, hashes).alias("chunk_hashes"))


def text_chunks(text: Column, size: int) -> Column:
    """A text cut into pieces of ``size`` characters as an array, in one pass; one empty piece for an empty text, null for null."""
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def question_id(parts: Column, names: Column) -> Column:
    """A stable id of key parts and a set of names: order and repeats of the names don't count."""
    joined = F.array_join(F.transform(F.array_sort(F.array_distinct(names)), lambda v: F.lower(F.hex(v.cast("binary")))), ",")
    return F.sha2(F.concat_ws(";", F.array_join(parts, ";"), joined), 256)


def position_mark(step: Column, cursor: Column) -> Column:
    return F.md5(F.concat(step, F.lit("|"), F.coalesce(cursor, F.lit(""))))


#: Fixed value: the polynomial of CRC-32, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320
#: Powers of two of lengths that a checksum can be moved by: up to 2^48 bytes.
LENGTH_BITS = 48


@functools.cache
def _moves() -> np.ndarray:
    """For each power of two of zero bytes and each byte of a checksum: what its 256 values become behind so many zeros."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    now = basis
    for _ in range(8):
        now = (now >> np.uint32(1)) ^ np.where(now & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    out = np.zeros((LENGTH_BITS, 4, 256), np.uint32)
    for k in range(LENGTH_BITS):
        for byte in range(4):
            for bit in range(8):
                out[k, byte] ^= np.where(np.arange(256) >> bit & 1, now[8 * byte + bit], 0).astype(np.uint32)
        now = _applied(out[k], now)
    return out


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc_moved(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What CRC-32 checksums add to that of a longer text, so many bytes of which follow: all rows at once, a step for each bit of a length."""
    crc = crc.astype(np.uint32)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        crc = np.where(zeros >> k & 1, _applied(_moves()[k], crc), crc)
    return crc


def crc_of_chunks(chunks: DataFrame, key: str, ordinal: str, data: str) -> DataFrame:
    """key, bytes and crc of values kept in chunks numbered by ``ordinal`` (an integer, unique in its value).

    Checksums are linear: each chunk's, moved past the bytes that follow it, is its share, and shares are joined by
    exclusive or, in any order and from any number of tasks. The bytes that follow come from sums by blocks
    of chunks, so a value of many chunks isn't one task's. Null data counts as no bytes; a null key is a value of its own.
    """
    parts = chunks.select(F.col(key).alias("key"), F.col(ordinal).cast("long").alias("at"), F.coalesce(F.crc32(F.col(data).cast("binary")), F.lit(0)).alias("crc"), F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("n"))
    placed = running_sums(parts, ["key"], "at", ["n"])

    @F.pandas_udf("bigint")
    def moved(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_moved(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    shares = placed.select("key", "n", moved("crc", F.col("n_total") - F.col("n_before") - F.col("n")).alias("share"))
    return shares.groupBy("key").agg(F.sum("n").alias("bytes"), F.bit_xor("share").alias("crc")).withColumnRenamed("key", key)


def name_bucket(slot: Column, name: Column, buckets: int) -> Column:
    """The bucket of a name in a slot by the first byte of their SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", slot.cast("string"), name)), 1, 2), 16, 10).cast("int") % buckets
