"""Flat and nested exports of a shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import csv_safe
from . import redaction

NO_EVIDENCE = "(no evidence generated)"


def safe(df: DataFrame) -> DataFrame:
    """Every string column guarded against being run as a formula; numbers stay."""
    return df.select(*[csv_safe(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def gap_summary(contributions: Column) -> dict[str, Column]:
    """Counts and joined names of matched and missing skills; implied experience counts as matched."""
    missing = F.filter(contributions, lambda c: F.coalesce(c["reason"] == "missing", F.lit(False)))
    matched = F.filter(contributions, lambda c: ~F.coalesce(c["reason"] == "missing", F.lit(False)))
    names = lambda a: F.array_join(F.transform(a, lambda c: c["skill"]), "; ")
    return {"matched_count": F.size(matched), "missing_count": F.size(missing), "matched_skills": names(matched), "missing_skills": names(missing)}


def coverage(requirements: Column) -> dict[str, Column]:
    """Counts by status and the completeness to four places; the bars are those of the export, not the weights'."""
    count = lambda f: F.size(F.filter(requirements, f))
    met = count(lambda r: (r["status"] == "met") & (r["confidence"] >= 0.7))
    partial, n = count(lambda r: r["status"] == "partial"), F.size(requirements)
    return {
        "met_count": count(lambda r: r["status"] == "met"),
        "partial_count": partial,
        "missing_requirement_count": count(lambda r: r["status"] == "missing"),
        "completeness": F.when(n > 0, F.round((met + 0.5 * partial) / n, 4)).otherwise(0.0),
    }


def evidence_rows(entries: DataFrame, keep: list[str], requirements: str = "requirements") -> DataFrame:
    """A row per candidate and requirement; candidates without one have a row that says so."""
    rows = entries.select(*keep, F.posexplode_outer(requirements).alias("at", "r"))
    return rows.select(*keep, F.col("at"), F.coalesce("r.requirement", F.lit(NO_EVIDENCE)).alias("requirement"), F.coalesce("r.status", F.lit("")).alias("status"), F.coalesce("r.evidence", F.lit("")).alias("evidence"), "r.confidence")


def shortlist_rows(entries: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    """Entries of live résumés with their job and résumé, by rank."""
    alive = resumes.where("withdrawn_at is null")
    return entries.join(jobs, "job_id").join(alive, "resume_id")


#: The columns of the flat exports, in their order.
CSV_COLUMNS = (
    "rank", "candidate_name", "candidate_email", "candidate_phone", "resume_file", "job_title", "job_department", "score_final", "must_have_missing", "skills_missing",
    "skills_matched_count", "skills_total", "must_have_count", "score_structured", "score_evidence_completeness", "score_motivation", "skill", "experience", "education", "seniority", "vector",
    "requirement_count", "requirements_met", "requirements_partial", "requirements_missing", "evidence_summary", "skills_matched", "generated_at", "pipeline_version", "resume_id",
)
EVIDENCE_COLUMNS = ("rank", "candidate_name", "resume_file", "job_title", "requirement", "status", "confidence", "quote", "evidence_chunk_ids", "evidence_context")


def masked(rows: DataFrame, reveal: bool, regions: tuple[str, ...] = ()) -> DataFrame:
    """Export rows (with parsed, evidence, rank, candidate_name, -_email, -_phone, original_filename) ready to be written.

    Citations are resolved first, while the parse and the real name are there; then, unless they are revealed, quotes and
    their sources are redacted with the real name, the name becomes the rank's pseudonym, address and number are blank
    and the file's name is masked.  The parse goes in either case.
    """
    rows, hide = redaction.hider(rows, "parsed", F.col("candidate_name"), regions)
    evidence = F.col("evidence")
    out = rows.withColumn("evidence", redaction.with_sources(evidence, F.col("__texts")) if reveal else redaction.with_sources(redaction.blind_evidence(evidence, hide), F.col("__texts"), hide))
    if not reveal:
        out = out.withColumns({"candidate_name": redaction.pseudonym(F.col("rank")), "candidate_email": F.lit(""), "candidate_phone": F.lit(""), "original_filename": redaction.masked_filename(F.col("original_filename"))})
    return out.drop("parsed", *redaction.HELPERS)


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")


def candidates_table(rows: DataFrame) -> DataFrame:
    """A row per candidate with the columns of CSV_COLUMNS.  rows: what masked() gives, with breakdown (scores and
    contributions), git_sha, generated_at, job_title and job_department."""
    scores, evidence = F.col("breakdown"), F.col("evidence")
    contributions = scores["contributions"]
    gaps, cover = gap_summary(contributions), coverage(evidence["requirements"])
    must = F.filter(contributions, lambda c: F.coalesce(c["is_must_have"], F.lit(False)))
    missed = F.filter(must, lambda c: F.coalesce(c["reason"] == "missing", F.lit(False)))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    value = {
        "rank": F.col("rank"), "candidate_name": blank("candidate_name"), "candidate_email": blank("candidate_email"), "candidate_phone": blank("candidate_phone"), "resume_file": blank("original_filename"),
        "job_title": blank("job_title"), "job_department": blank("job_department"), "score_final": F.round("score_final", 4), "must_have_missing": F.array_join(F.transform(missed, lambda c: c["skill"]), "; "),
        "skills_missing": gaps["missing_skills"], "skills_matched_count": gaps["matched_count"], "skills_total": gaps["matched_count"] + gaps["missing_count"], "must_have_count": F.size(must),
        "score_evidence_completeness": cover["completeness"], "score_structured": scores["structured"], "score_motivation": scores["motivation"],
        "requirement_count": cover["met_count"] + cover["partial_count"] + cover["missing_requirement_count"], "requirements_met": cover["met_count"], "requirements_partial": cover["partial_count"],
        "requirements_missing": cover["missing_requirement_count"], "evidence_summary": _one_line(evidence["overall_summary"]), "skills_matched": gaps["matched_skills"],
        "generated_at": F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), "pipeline_version": F.substring(blank("git_sha"), 1, 12), "resume_id": F.col("resume_id").cast("string"),
    }
    value |= {k: scores[k] for k in ("skill", "experience", "education", "seniority", "vector")}
    return rows.select(*[value[c].alias(c) for c in CSV_COLUMNS])


def evidence_table(rows: DataFrame) -> DataFrame:
    """A row per candidate and requirement with the columns of EVIDENCE_COLUMNS, in the requirements' order; a candidate
    without any has one row that says so."""
    each = rows.select("rank", "candidate_name", "original_filename", "job_title", F.posexplode_outer("evidence.requirements").alias("at", "r"))
    text = lambda c: F.when(F.col("at").isNotNull(), F.coalesce(c, F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return each.select(
        "rank", blank("candidate_name").alias("candidate_name"), blank("original_filename").alias("resume_file"), blank("job_title").alias("job_title"), F.when(F.col("at").isNull(), NO_EVIDENCE).otherwise(text(F.col("r.requirement"))).alias("requirement"),
        text(F.col("r.status")).alias("status"), F.col("r.confidence").alias("confidence"), F.when(F.col("at").isNotNull(), _one_line(F.col("r.evidence"))).alias("quote"),
        text(F.array_join("r.evidence_chunk_ids", "; ")).alias("evidence_chunk_ids"), F.when(F.col("at").isNotNull(), _one_line(F.col("r.source_context"))).alias("evidence_context"),
    )


def nested(rows: DataFrame) -> DataFrame:
    """A JSON document per row, nested fields as they are; nulls are written."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    safe(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def folded(breakdown: Column, **more: Column) -> Column:
    """A breakdown struct with further fields."""
    for k, v in more.items():
        breakdown = breakdown.withField(k, v)
    return breakdown


def unfolded(text: Column, numbers: tuple[str, ...], flags: tuple[str, ...]) -> list[Column]:
    """Fields of a breakdown in JSON: unreadable numbers and whatever is no strict boolean are null."""
    out = [F.get_json_object(text, f"$.{k}").try_cast("double").alias(k) for k in numbers]
    for k in flags:
        raw = F.variant_get(F.try_parse_json(text), f"$.{k}", "variant")
        value = F.get_json_object(text, f"$.{k}")
        out.append(F.when(F.schema_of_variant(raw) == "BOOLEAN", value == "true").alias(k))
    return out
