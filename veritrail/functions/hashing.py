"""Keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def email_hash(email: Column) -> Column:
    """Null for a blank address."""
    plain = F.lower(F.trim(email))
    return F.when(plain != "", F.sha2(plain, 256))


def salted_key(name: Column, salt: str) -> Column:
    if not salt:
        raise ValueError("an empty salt would make keys guessable")
    return F.concat(F.lit("h:"), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 32))


def canonical_key(name: Column, known: Column, salt: str) -> Column:
    """The name itself if the vocabulary knows it, else a salted digest."""
    return F.when(known, name).otherwise(salted_key(name, salt))


def cache_key(model: Column, text: Column) -> Column:
    return F.concat(F.lit("emb:v1:"), model, F.lit(":"), F.sha2(F.concat(model, F.lit("\n"), text), 256))


def token_bucket(token: Column, buckets: int = 768) -> Column:
    """The first eight bytes of a token's SHA-1 as an unsigned number, modulo the buckets."""
    digest = F.sha1(token)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return F.pmod(F.pmod(high, F.lit(buckets)) * ((1 << 32) % buckets) + F.pmod(low, F.lit(buckets)), F.lit(buckets)).cast("int")


def lock_id(kind: Column, entity: Column) -> Column:
    """The low 32 bits of a digest as a signed number: a run key for one entity."""
    low = F.conv(F.substring(F.sha2(F.concat(kind, F.lit(":"), entity), 256), 57, 8), 16, 10).cast("long")
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")
