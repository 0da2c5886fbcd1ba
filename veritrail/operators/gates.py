"""Gates of ranking quality over stored lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import collapse
from ..weights import DEFAULT, Weights
from .matching import borne_out


def verification_rate(quotes: DataFrame, chunks: DataFrame, w: Weights = DEFAULT) -> DataFrame:
    """surfaced, verified and rate (1 if nothing is surfaced): quotes with a citation that match a cited chunk.

    quotes: row_id, resume_id, evidence, evidence_chunk_ids; chunks: resume_id, id, text.
    """
    shown = quotes.where((F.col("evidence") != "") & (F.size("evidence_chunk_ids") > 0))
    cited = shown.select("row_id", "resume_id", "evidence", F.posexplode(F.array_distinct("evidence_chunk_ids")).alias("at", "id"))
    good = borne_out(cited, chunks, w=replace(w, evidence_min_quote_chars=0)).where("good").select("row_id").distinct().withColumn("good", F.lit(True))
    out = shown.select("row_id").join(good, "row_id", "left").agg(F.count("*").alias("surfaced"), F.count("good").alias("verified"))
    return out.withColumn("rate", F.coalesce(F.try_divide("verified", "surfaced"), F.lit(1.0)))


def completeness_in_top(entries: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """Whether each list's first k all reach a completeness.  entries: key, rank, score_evidence."""
    return entries.where(F.col("rank") <= k).groupBy(key).agg(F.count(F.when(F.col("score_evidence") >= least, 1)).alias("good"), F.count("*").alias("n")).withColumn("passes", F.col("good") == F.col("n"))


def recalled_anchors(gold: DataFrame, quotes: DataFrame) -> DataFrame:
    """Anchors that some stored quote of their résumé holds: found, wanted, rate.  gold: resume_id, anchor."""
    hay = quotes.groupBy("resume_id").agg(F.collect_list(collapse(F.lower("evidence"))).alias("said"))
    needle = collapse(F.lower("anchor"))
    hit = F.exists("said", lambda q: F.contains(q, needle))
    out = gold.join(hay, "resume_id", "left").agg(F.count(F.when(F.coalesce(hit, F.lit(False)), 1)).alias("found"), F.count("*").alias("wanted"))
    return out.withColumn("rate", F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)))


def must_not_surface(entries: DataFrame, banned: DataFrame, key: str, id: str, k: int) -> DataFrame:
    """Rows among the first k that must not stand there."""
    return entries.where(F.col("rank") <= k).join(banned.select(id), id, "left_semi").select(key, id, "rank")


def exposed(texts: DataFrame, people: DataFrame) -> DataFrame:
    """Texts that show a marker of their own candidate: name, address, or a phone number's digits.  texts: resume_id, at,
    text; people: resume_id, name, email, phone."""
    both = texts.join(people, "resume_id")
    low, digits = F.lower("text"), F.regexp_replace("text", r"[ .()+-]", "")
    phone = F.regexp_replace("phone", r"\D", "")
    shown = lambda c: F.coalesce((F.trim(c) != "") & F.contains(low, F.lower(c)), F.lit(False))
    hit = shown("name") | shown("email") | F.coalesce((F.length(phone) >= 7) & F.contains(digits, phone), F.lit(False))
    return both.where(hit).select("resume_id", "at")
