"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, kept in range by cycle walking.

Row r of n (in doc_id order) goes to place p = permute(r): shard p mod k, slot p div k. Nothing is stored: shard and slot
of a row, and the row in a slot (`row_in_slot`), follow from n, k and the seed alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import corpus, ordering, shuffle_width, with_id_bucket

ROUNDS = 4
#: Multipliers of the round function: two odd 32-bit numbers with well spread bits.
MIX = (0x9E3779B1, 0x85EBCA77)
LOW = np.uint64(0xFFFFFFFF)


def round_keys(seed: int) -> list[int]:
    """One 32-bit key for each round."""
    return [((seed + 1) * MIX[0] + (i + 1) * MIX[1]) & 0xFFFFFFFF for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of each half, so that both halves together can number n rows."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _mixed(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    y = ((x ^ np.uint64(key)) * np.uint64(MIX[0])) & LOW
    y = ((y ^ (y >> np.uint64(15))) * np.uint64(MIX[1])) & LOW
    return (y ^ (y >> np.uint64(13))) & mask


def _network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> b, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return (left << b) | right


def _network_back(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> b, x & mask
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return (left << b) | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    bits, keys = half_bits(n), round_keys(seed)
    out = step(np.asarray(x).astype(np.uint64), bits, keys)
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far], bits, keys)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each row number; a permutation of 0..n-1. The domain is under 4n, so a walk takes about four steps."""
    return _walk(rows, n, seed, _network)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    return _walk(places, n, seed, _network_back)


def row_in_slot(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that the given slot of the given shard holds."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law), row_number.

    Rows are numbered by doc_id; equal doc_ids by checksum and size, and rows equal in all of these are interchangeable.
    A missing doc_id comes first; a missing text has no bytes. Shard sizes differ by one row at most, slots have no gaps.
    Copies of a text are rows of their own and may land anywhere: keeping them together would break the law of equal
    counts. Numbering takes the rows of each id bucket by a window; the driver sees one count per bucket.
    """
    spark = docs.sparkSession
    rows = corpus(docs)
    buckets = 4 * shuffle_width(spark)
    numbered = with_id_bucket(rows, buckets)
    counts = dict(numbered.groupBy("bucket").count().collect())
    total = sum(counts.values())
    before = np.zeros(max(counts, default=0) + 2, dtype=np.int64)
    for b, c in counts.items():
        before[b + 1] = c
    before = np.cumsum(before)

    @F.pandas_udf("struct<row_number:bigint,place:bigint>")
    def placed(bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = before[bucket.to_numpy()] + rank.to_numpy() - 1
        return pd.DataFrame({"row_number": row, "place": permute(row, total, seed)})

    order = Window.partitionBy("bucket").orderBy(ordering(F.col("doc_id")), F.col("doc_id").isNotNull(), "text_crc32", "size")
    narrow = numbered.select("doc_id", "bucket", (F.octet_length("text").cast("bigint") + 1).alias("size"),
                             F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    at = narrow.withColumn("rank", F.row_number().over(order)).withColumn("at", placed("bucket", "rank"))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                     (F.col("at.place") % shards).cast("int").alias("shard"),
                     F.expr(f"at.place div {shards}").alias("slot"),
                     F.lit(None).cast("int").alias("grown_shard"), F.col("at.row_number").alias("row_number"))
