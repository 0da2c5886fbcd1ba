"""Explicit schemas of the tables and nested documents, and predicates in place of constraints.

Parquet tables have no CHECK or UNIQUE.  `checks` gives a condition per rule, `violations` counts what breaks it, and
`duplicates` lists keys that stand more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B, TS, BIN = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.BinaryType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CHUNK = struct(id=S, section=S, page=I, text=S)
SKILL = struct(name=S, years=I, last_used_year=I, evidence_chunk_ids=T.ArrayType(S), categories=T.ArrayType(S))
ROLE = struct(company=S, title=S, start=S, end=S, is_current=B, bullets=T.ArrayType(struct(text=S, chunk_id=S)))
STUDY = struct(degree=S, institution=S, field=S, year=I)
CANDIDATE = struct(name=S, email=S, phone=S, location=S)
REQUIREMENT_NAME = struct(name=S, min_years=I)
JOB_DOCUMENT = struct(
    title=S, required_skills=T.ArrayType(REQUIREMENT_NAME), nice_to_have_skills=T.ArrayType(REQUIREMENT_NAME), min_years_experience=I,
    education=struct(min_level=S, fields=T.ArrayType(S)), location=S, remote_policy=S, responsibilities=T.ArrayType(S),
)
RESUME_DOCUMENT = struct(
    candidate=CANDIDATE, summary=S, total_years_experience=I, skills=T.ArrayType(SKILL), experience=T.ArrayType(ROLE), education=T.ArrayType(STUDY),
    chunks=T.ArrayType(CHUNK), cover_letter_chunks=T.ArrayType(CHUNK), degraded=B, degradation_reason=S,
)
REQUIREMENT = struct(requirement=S, status=S, evidence=S, evidence_chunk_ids=T.ArrayType(S), confidence=D)
THEME = struct(theme=S, evidence=S, evidence_chunk_ids=T.ArrayType(S), confidence=D)
EVIDENCE = struct(requirements=T.ArrayType(REQUIREMENT), overall_summary=S, cover_letter_presence=S, cover_letter_evidence=T.ArrayType(THEME), overall_motivation=S)
CONTRIBUTION = struct(skill=S, score=D, years=I, recency=D, ontology_weight=D, is_must_have=B, reason=S)

TABLES = {
    "jobs": struct(id=S, title=S, status=S, description=S, description_parsed=JOB_DOCUMENT, min_years=I, retention_days=I, blind_review=B, shortlist_top_percent=I, shortlist_state=S, shortlist_state_at=TS, created_at=TS),
    "resumes": struct(id=S, job_id=S, status=S, original_filename=S, sha256=S, file_size_bytes=L, parsed=RESUME_DOCUMENT, candidate_name=BIN, candidate_email=BIN, email_hash=S, withdrawn_at=TS, withdrawal_reason=S, created_at=TS),
    "shortlist_entries": struct(job_id=S, resume_id=S, rank=I, score_final=D, score_structured=D, score_breakdown=S, evidence=EVIDENCE, created_at=TS),
    "reverse_match_entries": struct(resume_id=S, job_id=S, rank=I, score_final=D, score_structured=D, score_evidence=D, evidence=EVIDENCE, created_at=TS),
    "outbox": struct(id=L, aggregate=S, aggregate_id=S, event_type=S, payload=S, created_at=TS, delivered_at=TS, delivery_attempts=I, last_error=S),
    "reveal_audit": struct(id=L, resume_id=S, user_id=S, revealed_at=TS),
    "users": struct(id=S, cas_username=S, display_name=S, email=S, role=S, created_at=TS),
    "audit_log": struct(id=L, occurred_at=TS, actor_kind=S, user_id=S, service=S, action=S, entity=S, entity_id=S, details=S),
    "sessions": struct(id=S, user_id=S, created_at=TS, expires_at=TS, revoked_at=TS),
    "job_assignees": struct(job_id=S, user_id=S, assigned_by=S, assigned_at=TS),
}
KEYS = {
    "jobs": ["id"], "resumes": ["id"], "shortlist_entries": ["job_id", "resume_id"], "reverse_match_entries": ["resume_id", "job_id"], "outbox": ["id"],
    "users": ["id"], "audit_log": ["id"], "sessions": ["id"], "job_assignees": ["job_id", "user_id"],
}

JOB_STATUS = ("draft", "open", "closed", "archived")
RESUME_STATUS = ("uploaded", "parsing", "parsed", "failed")


def checks(table: str) -> dict[str, Column]:
    """Rules of a table by name; a null passes, as in SQL."""
    c = F.col
    return {
        "jobs": {
            "status": c("status").isin(*JOB_STATUS),
            "retention": c("retention_days").between(30, 730),
            "top_percent": c("shortlist_top_percent").between(1, 100),
            "state": c("shortlist_state").isin("awaiting_llm", "ranking"),
        },
        "resumes": {"status": c("status").isin(*RESUME_STATUS), "size": c("file_size_bytes") >= 0},
        "shortlist_entries": {"rank": c("rank") > 0, "score": c("score_final").between(0, 1), "evidence": c("evidence").isNotNull()},
        "audit_log": {"one_actor": (c("user_id").isNotNull() != c("service").isNotNull()) & (c("actor_kind") == F.when(c("user_id").isNotNull(), "user").otherwise("service"))},
    }.get(table, {})


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per rule: how many rows break it."""
    counts = df.agg(*[F.count(F.when(~r, 1)).alias(k) for k, r in rules.items()])
    return counts.unpivot([], list(rules), "rule", "broken") if rules else df.sparkSession.createDataFrame([], "rule string, broken long")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")
