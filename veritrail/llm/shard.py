"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of their key, by a range sort and the running sum of the partitions' counts, so
no task ever holds more than its partition.  A keyed Feistel network permutes the smallest even-width power of two that
holds N; values that fall outside 0..N-1 are permuted again until they fall inside, which is a permutation of 0..N-1.
Row p of the shuffle goes to shard p mod S, slot p div S: counts are at most one apart, slots have no gaps, and both
directions are computable from a row number alone.

The law is `rows`: rows of equal texts, the groups that a copy's checksum tells, are dealt like any others and scatter
over all shards, as the permutation knows row numbers only; the checksum returned keeps them together for who wants it.

Cases: null texts count as empty, and null keys come first; a long text counts its whole length, and is never moved, only
its size and checksum are; rows alike in key, size and checksum are interchangeable, and repeated rows have places of
their own; an empty table gives no rows; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, mix

ROUNDS = 6


def _width(n: int) -> int:
    """Bits of a Feistel half."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _feistel(x: np.ndarray, bits: int, keys) -> np.ndarray:
    mask = U64((1 << bits) - 1)
    left, right = x >> U64(bits), x & mask
    for k in keys:
        left, right = right, left ^ (mix(right + k) & mask)
    return (left << U64(bits)) | right


def _unfeistel(x: np.ndarray, bits: int, keys) -> np.ndarray:
    mask = U64((1 << bits) - 1)
    left, right = x >> U64(bits), x & mask
    for k in keys[::-1]:
        left, right = right ^ (mix(left + k) & mask), left
    return (left << U64(bits)) | right


def _walk(step, x: np.ndarray, n: int, seed: int) -> np.ndarray:
    bits, keys = _width(n), _keys(seed)
    out = step(x.astype(np.uint64), bits, keys)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = step(out[far], bits, keys)
    return out.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Position in the shuffle of row numbers below n."""
    return _walk(_feistel, x, n, seed)


def unpermute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row number of positions in the shuffle."""
    return _walk(_unfeistel, x, n, seed)


def row_numbers(df: DataFrame, order: list[str], scratch: Scratch, name: str = "row_number") -> tuple[DataFrame, int]:
    """The rows with their global numbers from 0 in the given order, and their count."""
    tie = F.monotonically_increasing_id()  # so that rows alike can be dealt to several partitions
    sorted_rows = df.withColumn("tie", tie).orderBy(*order, "tie")
    rows = scratch.keep(sorted_rows.select(*df.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "sorted")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"), "n")  # a row for each partition
    total = offsets.agg(F.sum("n")).first()[0] or 0
    return rows.join(F.broadcast(offsets.drop("n")), "part").select(*df.columns, (F.col("before") + F.col("at")).alias(name)), total


def assign(df: DataFrame, shards: int, scratch: Scratch, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard and row_number of every row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = df.select(key, (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows, n = row_numbers(narrow, [key, "size", "text_crc32"], scratch)

    @F.pandas_udf("long")
    def position(x):
        import pandas as pd

        return pd.Series(permute(x.to_numpy(), n, seed))

    p = F.col("position")
    return rows.withColumn("position", position("row_number")).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
