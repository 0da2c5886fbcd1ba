"""The corpus pipeline: quality, near duplicates, decontamination, secrets, and token ids.

Each stage works on all rows its predecessor kept, written as Parquet and read again.  All stages but the last return
the columns of documents, whatever these are called and however many there are.

Cases, for every stage: a null text counts as empty and stays null, an empty text as it is; long texts are read whole;
repeated rows are treated alike (near_copies keeps one of them, if they have words); an empty table passes as an empty one.
What ties and each stage's own cases give is said with the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from veritrail.llm.common import Scratch, crc_mod, small_batches, table
from veritrail.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  It learns from labels whose crc32 of the id is not 0 modulo 5.

    A score equal to the threshold stays; empty texts have a score as any other; without labels nothing can be told, and
    the constant score, one half, lets all documents stay.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by word 5-gram similarity of 0.8 or more, that with the smallest id stays.

    Rows that share the smallest id and the text are told apart by their other columns; texts without words all stay.
    """
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; texts without words overlap nothing, an empty benchmark takes nothing."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, those that overlap by one; no document goes."""
    small_batches(spark)
    return secret_scan.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of every text, none for an empty one; equal rows have equal ids and all stay."""
    small_batches(spark)
    return bpe.encode(docs, tokenizer_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]

#: Trees, MinHash bands and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # nothing reads it any more
        before = name
    return docs
