"""Who may see what: reveals, actors, health findings and encrypted columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import email_hash
from ..functions.strings import masked_filename
from ..sources.tables import kept


def is_blind(blind: Column, reveal: Column) -> Column:
    """Blind unless revealed; an unknown flag is blind."""
    return F.coalesce(blind, F.lit(True)) & ~F.coalesce(reveal, F.lit(False))


def resume_list(resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Résumé rows with the name gone and the filename masked where the job is reviewed blind."""
    out = resumes.join(jobs.select("job_id", "blind_review"), "job_id")
    hidden = is_blind(F.col("blind_review"), F.lit(False))
    return out.withColumn("candidate_name", F.when(~hidden, F.col("candidate_name"))).withColumn("filename", F.when(hidden, masked_filename(F.col("filename"))).otherwise(F.col("filename")))


def encrypted(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """Columns encrypted under the key; nulls stay null, and the address's digest is kept beside."""
    out = df.withColumn("email_hash", email_hash(F.col("email"))) if "email" in df.columns else df
    return out.withColumns({c: F.aes_encrypt(F.col(c), key, F.lit("GCM")) for c in columns})


def decrypted(df: DataFrame, columns: list[str], key: Column) -> DataFrame:
    """What the key does not open is null."""
    return df.withColumns({c: F.try_aes_decrypt(F.col(c), key, F.lit("GCM")).cast("string") for c in columns})


def actor(user: Column, service: Column) -> Column:
    """kind, user and service of an actor; null unless exactly one is given."""
    one = user.isNotNull() != service.isNotNull()
    return F.when(one, F.struct(F.when(user.isNotNull(), "user").otherwise("service").alias("kind"), user.alias("user_id"), service.alias("service")))


def audited(rows: DataFrame, action: str, actor_id: str, at: Column) -> DataFrame:
    """Audit rows of a read, one for each row that was shown; a blocked read shows none and writes none."""
    return rows.select(at.alias("occurred_at"), F.lit("user").alias("actor_kind"), F.lit(actor_id).alias("user_id"), F.lit(None).cast("string").alias("service"), F.lit(action).alias("action"), F.col("entity_id").cast("string").alias("entity_id"))


def revealable(log: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Audit rows whose details may be shown in full: listed actions, and details that are a non-empty JSON object."""
    raw = F.try_parse_json("details")
    is_object = F.schema_of_variant(raw).startswith("OBJECT<")
    return log.where(F.col("action").isin(*actions) & F.coalesce(is_object & (F.schema_of_variant(raw) != "OBJECT<>"), F.lit(False)))


def appended(log: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """An append-only log with new rows, numbered on from its largest id; nothing that stands is changed.

    Numbers follow the rows' own order column `at`, nulls last; they are found by counting partitions, so no task sorts all
    rows.  The sorted rows are written to the shared folder first: sorted twice, they need not be cut at the same places.
    """
    last = log.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    tie = F.monotonically_increasing_id()  # so that rows alike can be dealt to several partitions
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = rows.withColumn("__tie", tie).orderBy(F.asc_nulls_last("at"), "__tie").drop("__tie")
    sorted_rows = kept(ordered.select("*", F.spark_partition_id().alias("__part"), nth.alias("__nth")), "appended")
    counts = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row for each partition
    numbered = sorted_rows.join(F.broadcast(offsets), "__part")
    return log.unionByName(numbered.withColumn(key, F.lit(last) + 1 + F.col("__before") + F.col("__nth")).select(*log.columns))


def revealed(asked: DataFrame, resumes: DataFrame, assignees: DataFrame, enabled: bool, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that are shown, audit rows) of reveals that were asked for.  asked: user_id, resume_id, role.

    The gate comes first, then the scope: admins and recruiters see all, a hiring manager the résumés of jobs assigned to
    them, others none.  A reveal that is blocked shows nothing and writes nothing.
    """
    gate = asked.where(F.lit(enabled) & F.col("role").isin("admin", "recruiter", "hiring_manager"))
    both = gate.join(resumes.select("resume_id", "job_id", "candidate_name"), "resume_id")
    wide = both.where("role <> 'hiring_manager'")
    own = both.where("role = 'hiring_manager'").join(assignees, ["job_id", "user_id"], "left_semi")
    shown = wide.unionByName(own.select(*wide.columns))
    audit = shown.select(as_of.alias("occurred_at"), F.lit("user").alias("actor_kind"), "user_id", F.lit("reveal_candidate").alias("action"), F.col("resume_id").alias("entity_id"))
    return shown, audit


def findings(**checks: DataFrame) -> DataFrame:
    """Health findings: check, n, severity; each check is a one-row count n with its severity where n > 0."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("severity")).otherwise(0).alias("severity"))
        out = row if out is None else out.unionByName(row)
    return out


def exit_code(found: DataFrame) -> DataFrame:
    return found.agg(F.max("severity").alias("exit_code"), F.sum(F.when(F.col("severity") > 0, 1).otherwise(0)).cast("long").alias("failing"))
