"""Withdrawal and reinstatement: a guarded change, with its audit rows and events derived from the rows it changed.

Two tables cannot be written in one transaction.  The events are derived from the state they announce, and their
consumers replace by key, so writing them again does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import guarded_update, latest


def withdraw(resumes: DataFrame, ids: DataFrame, as_of: Column, user: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(résumés, audit rows, events).  ids: resume_id, reason.  Rows that are withdrawn already stay, without audit or
    event; unknown ids change nothing."""
    wanted = ids.groupBy("resume_id").agg(F.first("reason").alias("__reason"), F.lit(True).alias("__asked"))
    both = resumes.join(wanted, "resume_id", "left")
    done = guarded_update(both, F.col("__asked") & F.col("withdrawn_at").isNull(), {"withdrawn_at": as_of, "withdrawal_reason": F.col("__reason")})
    changed = done.where("applied")
    details = F.when(F.coalesce("withdrawal_reason", F.lit("")) != "", F.to_json(F.struct(F.col("withdrawal_reason").alias("reason"))))
    audit = changed.select(as_of.alias("occurred_at"), F.lit("user").alias("actor_kind"), F.lit(user).alias("user_id"), F.lit("withdraw_resume").alias("action"), F.col("resume_id").alias("entity_id"), details.alias("details"))
    events = changed.select(F.lit("resume").alias("aggregate"), F.col("resume_id").alias("aggregate_id"), F.lit("resume.withdrawn").alias("event_type"), F.lit("{}").alias("payload"), as_of.alias("created_at"))
    return done.select(*resumes.columns), audit, events


def reinstate(resumes: DataFrame, ids: DataFrame, outbox: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(résumés, events).  The event is the last delivered payload as it was; a résumé that never had one has no event."""
    wanted = ids.select("resume_id", F.lit(True).alias("__asked")).distinct()
    done = guarded_update(resumes.join(wanted, "resume_id", "left"), F.col("__asked") & F.col("withdrawn_at").isNotNull(), {"withdrawn_at": F.lit(None).cast("timestamp"), "withdrawal_reason": F.lit(None).cast("string")})
    sent = latest(outbox.where("delivered_at is not null and event_type = 'resume.parsed'"), ["aggregate_id"], [F.desc("delivered_at"), F.desc("id")])
    events = sent.join(done.where("applied").select(F.col("resume_id").alias("aggregate_id")), "aggregate_id", "left_semi")
    return done.select(*resumes.columns), events.select("aggregate", "aggregate_id", "event_type", "payload", as_of.alias("created_at"))


def projectable(parses: DataFrame, current: DataFrame) -> DataFrame:
    """Parses whose result may be announced: the résumé is still being parsed, is not withdrawn, and the parse is not
    degraded; stale results fall away."""
    live = current.where("status = 'parsing' and withdrawn_at is null").select("resume_id")
    return parses.where(~F.coalesce("degraded", F.lit(False))).join(live, "resume_id", "left_semi")


def folded_breakdown(scores: Column, motivation: Column, evaluated: Column, discriminating: Column) -> Column:
    """A stored breakdown with the fields that have no column of their own."""
    return F.to_json(scores.withField("motivation", motivation).withField("evidence_evaluated", evaluated).withField("vector_discriminating", discriminating))


def outcomes(requests: DataFrame, current: DataFrame, key: str, allowed: tuple[str, ...], terminal: tuple[str, ...]) -> DataFrame:
    """Adds outcome to requests about rows: missing if there is none, withdrawn, already_done in a terminal status, not_ready
    in any other that is not allowed, else proceed.  current: key, status, withdrawn_at."""
    both = requests.join(current.select(key, "status", "withdrawn_at", F.lit(True).alias("__there")), key, "left")
    ready = F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    done = F.coalesce(F.col("status").isin(*terminal), F.lit(False))
    outcome = F.when(F.col("__there").isNull(), "missing").when(F.col("withdrawn_at").isNotNull(), "withdrawn").when(ready, "proceed").when(done, "already_done").otherwise("not_ready")
    return both.withColumn("outcome", outcome).drop("__there")
