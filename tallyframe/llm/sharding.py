"""Reproducible shuffling into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of
from tallyframe.operators.quantiles import global_rank

ROUNDS = 4
# Multipliers of a 64-bit mixing function.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Image of each number under a permutation of [0, total).

    A balanced Feistel network permutes the smallest even-bit domain that holds
    ``total``; images outside the range walk along their cycle until they are inside,
    fewer than four steps on average. Any image can be computed by itself.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS + 1))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & mask)
        x = (left << shift) | right
        out[walking] = x
        walking = walking[x >= total]
    return out.astype(np.int64)


def permuted(number: Column, total: int, seed: int) -> Column:
    @F.arrow_udf("bigint")
    def image(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(permute(batch.to_numpy(zero_copy_only=False), total, seed))

    return image(number)


def shuffle_into_shards(docs: DataFrame, id_col: str, text_col: str, shards: int = 16, seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, row, shard, slot): every row at its place in a seeded shuffle.

    Rows are numbered by (id, crc32 of the text, size), NULL ids first; rows equal in
    all three are interchangeable, so repeated rows fill neighbouring numbers. The
    permuted number p gives shard p mod ``shards`` and slot p div ``shards``: shard
    counts differ by at most one and slots have no gaps. size is the UTF-8 bytes of
    the text plus 1; a NULL text has no bytes. Only ids, sizes and checksums are
    shuffled, never texts. An empty table gives no rows.
    """
    text = F.encode(text_of(text_col), "UTF-8")
    small = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered = global_rank(small, [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "row")
    total = numbered.count()
    placed = numbered.withColumn("row", F.col("row") - 1).withColumn("place", permuted(F.col("row"), total, seed))
    return placed.select(
        "id", "size", "text_crc32", "row",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {int(shards)}").alias("slot"),
    )
