"""A memo of embeddings: only texts that are not yet known are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cache_key, token_bucket


def read_through(texts: DataFrame, memo: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, as_of=None, ttl_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(texts with vector, new rows of the memo).

    texts: id, text; memo: key, vector, cached_at; embed: text to text, vector, on distinct misses only.  With as_of,
    entries older than the time to live count as misses.
    """
    keyed = texts.withColumn("key", cache_key(F.lit(model), F.col("text")))
    fresh = memo if as_of is None else memo.where(F.col("cached_at") > as_of - F.expr(f"INTERVAL {ttl_days} DAYS"))
    misses = keyed.where("text is not null").select("key", "text").distinct().join(fresh.select("key"), "key", "left_anti")
    new = misses.join(embed(misses.select("text")), "text").select("key", "vector")
    known = fresh.select("key", "vector").unionByName(new)
    return keyed.join(known, "key", "left").drop("key"), new


def bag_of_words(texts: DataFrame, size: int = 768) -> DataFrame:
    """A deterministic stand-in for an embedding model: counts of hashed tokens.  text to text, vector."""
    tokens = texts.select("text", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("token"))
    counts = tokens.groupBy("text", token_bucket(F.col("token"), size).alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    filled = counts.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    zero = F.array_repeat(F.lit(0.0), size)
    return texts.distinct().join(filled, "text", "left").select("text", F.when(F.col("m").isNull(), zero).otherwise(vector).alias("vector"))
