"""The thin queries op1 to op10: each applies its operator to its whole table and derives the result's columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed, ngram_join, pii, quality, secret_scan, shard, toxicity, warc
from .common import Scratch, crc_mod, small_batches, table

SHARDS = 40
#: The tables are synthetic; real data want a key of their own, from a store of secrets.
DEMO_KEY = "veritrail-demo-key"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    records = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_join.similar_texts(docs).select("doc_id", "class_id", "n_links")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embed.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS, Scratch(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    tagged = toxicity.tag(docs, toxicity.train(docs, labels))
    return tagged.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_path()))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "item_id", F.col("start").alias("first_word"), F.col("end").alias("end_word"), F.round("agree", 6).alias("agree"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.summary(pii.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), DEMO_KEY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_ngram_join, op3_sharding, op4_embedding_dedup, op5_toxicity, op6_quality, op7_bpe, op8_secrets, op9_decontaminate, op10_pii)}
def _secret_sql() -> str:
    """Spans by the rules' expressions: what a text holds between matches tells where they stand."""
    rules = []
    for i, r in enumerate(secret_scan.RULES):
        prefix = re.sub(r"\((?!\?)", "(?:", r.prefix)
        pattern = f"{f'(?i:{prefix})' if r.either_case else prefix}({r.tail}+)".replace("'", "''")
        rules.append(f"('{r.kind}', {i}, '{pattern}', {r.least})")
    one = "kind || ':' || a || ':' || (a + n)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k(kind, ord, pattern, least) AS (VALUES {", ".join(rules)}),
m AS (SELECT doc_id, kind, ord, least, regexp_extract_all(t, pattern) AS ms, regexp_extract_all(t, pattern, 1) AS tails, string_split_regex(t, pattern) AS ps FROM d, k),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS nth FROM m),
s AS (SELECT doc_id, kind, ord, length(ms[nth]) AS n, CAST(list_sum(list_transform(ps[1:nth], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:nth - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM i WHERE length(tails[nth]) >= least),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg({one}, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg({one}, ',' ORDER BY a, ord) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


#: A CRC by bytes, the row numbers, and the rounds of the network one by one, again from the start while a value is too large.
SHARD_SQL = f"""WITH RECURSIVE c8 AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM c8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM c8 WHERE k = 8),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: CAST('0x' || x AS UBIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, size, CAST(xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[CAST(1 + (xor(a, x) & 255) AS INT)]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM b, tab),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM d),
p AS (SELECT count(*) AS n, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) AS w FROM d),
key AS (SELECT j, MIX(((j::UHUGEINT * 11400714819323198485 + 17) % 18446744073709551616)::UBIGINT) AS key FROM range(1, {shard.ROUNDS + 1}) t(j)),
f AS (SELECT row_number AS id, 0 AS j, (row_number >> w)::UBIGINT AS l, (row_number & ((1 << w) - 1))::UBIGINT AS r FROM o, p
  UNION ALL SELECT id, CASE WHEN f.j = {shard.ROUNDS} THEN 0 ELSE f.j + 1 END, CASE WHEN f.j = {shard.ROUNDS} THEN l ELSE r END,
    CASE WHEN f.j = {shard.ROUNDS} THEN r ELSE xor(l, MIX(((r::UHUGEINT + key.key) % 18446744073709551616)::UBIGINT) & ((1 << w) - 1)::UBIGINT) END
  FROM f CROSS JOIN p LEFT JOIN key ON key.j = f.j + 1 WHERE f.j < {shard.ROUNDS} OR (l << w) + r >= n),
q AS (SELECT id, ((l << w) + r)::BIGINT AS position FROM f, p WHERE j = {shard.ROUNDS} AND (l << w) + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position % {SHARDS} AS INT) AS shard, position // {SHARDS} AS slot, NULL::INT AS grown_shard, row_number FROM o JOIN q ON q.id = o.row_number"""


def _shard_sql() -> str:
    """The SQL with the 64-bit finaliser written out for MIX(x); products are taken in 128 bits."""
    times = lambda x, c: f"((({x})::UHUGEINT * {c}) % 18446744073709551616)::UBIGINT"
    out = SHARD_SQL
    while (at := out.find("MIX(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        step = out[at + 4 : end - 1]
        for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931)):
            step = times(f"xor({step}, {step} >> {shift})", factor)
        out = out[:at] + f"xor({step}, {step} >> 31)" + out[end:]
    return out


#: For what SQL can say; the others are held against brute force in tests.
ORACLES: dict[str, str] = {
    "op3_sharding": _shard_sql(),
    "op8_secrets": _secret_sql(),
    "op1_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d""",
    "op2_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(k.links), 0) AS n_links FROM r LEFT JOIN k ON k.a = r.a GROUP BY 1""",
    "op4_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, count(*) AS links FROM l GROUP BY 1)
SELECT r.a AS vec_id, coalesce(any_value(k.links), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN k ON k.a = r.a GROUP BY r.a""",
}
