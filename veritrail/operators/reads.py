"""Reads of résumés, shortlists and reverse matches, blind or clear, and the small decodings that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import masked_filename, pseudonym
from .governance import is_blind
from .redaction import blind_evidence, blind_resumes, hider, with_sources
from .relational import live, scoped


def has_cover_letter(blob_key: Column, text: Column) -> Column:
    return blob_key.isNotNull() | text.isNotNull()


def cover_letter(blob_text: Column, blob_key: Column, pasted: Column) -> Column:
    """The text of a cover letter: that of the file if there is one, even if it could not be read, else the pasted one;
    what cannot be read counts as empty."""
    return F.coalesce(F.when(F.coalesce(blob_key, F.lit("")) != "", blob_text).otherwise(pasted), F.lit(""))


def document(raw: Column, schema: str) -> Column:
    """A parsed document in JSON, decoded; what is no JSON object decodes to a document without fields."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT<"), F.lit(False))
    return F.from_json(F.when(whole, raw).otherwise("{}"), schema)


def typed_jobs(rows: DataFrame) -> DataFrame:
    """Rows of jobs with a flag that is never null: a job is reviewed blind unless it says otherwise."""
    return rows.withColumn("blind_review", F.coalesce("blind_review", F.lit(True)))


def stamped(entries: DataFrame, model_gen: str, model_emb: str, git_sha: str | None, as_of: Column, weights: dict[str, float]) -> DataFrame:
    """Entries with the stamp of the run that made them, one for all."""
    sha = F.lit(git_sha).cast("string")
    stamp = F.struct(F.lit(model_gen).alias("model_gen"), F.lit(model_emb).alias("model_emb"), sha.alias("git_sha"), as_of.alias("generated_at"), F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]).alias("weights"))
    return entries.withColumn("pipeline_meta", stamp)


def run_state(jobs: DataFrame, ids: DataFrame, state: str | None, reason: str | None, as_of: Column) -> DataFrame:
    """Sets the run state of the jobs named, with its reason and time; a null state clears all three.  Others stay."""
    asked = jobs.join(ids.select("job_id").distinct().withColumn("__asked", F.lit(True)), "job_id", "left")
    new = {"shortlist_state": F.lit(state).cast("string"), "shortlist_state_reason": F.lit(reason if state else None).cast("string"), "shortlist_state_at": as_of if state else F.lit(None).cast("timestamp")}
    return asked.withColumns({k: F.when(F.col("__asked"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("__asked")


def resume_read(resumes: DataFrame, jobs: DataFrame, reveal: Column, regions: tuple[str, ...] = (), assignees: DataFrame | None = None, user: str | None = None) -> DataFrame:
    """Single reads of résumés: blind where the job is reviewed blind and nothing is revealed.

    resumes: resume_id, job_id, original_filename, parsed, cover_letter_text; jobs: job_id, blind_review.  A blind read has
    no identity, no cover letter, a masked file name and the blinded parse.  With a user, only résumés of jobs they are
    assigned to are found.
    """
    rows = resumes if assignees is None else scoped(resumes, assignees, "job_id", user)
    rows = rows.join(jobs.select("job_id", "blind_review"), "job_id").withColumn("blinded", is_blind(F.col("blind_review"), reveal))
    blind = F.col("blinded")
    rows = blind_resumes(rows, "parsed", "__blind", regions)
    shown = F.when(blind, F.col("__blind")).otherwise(F.col("parsed"))
    return rows.select(
        "resume_id", "job_id", F.when(blind, masked_filename(F.col("original_filename"))).otherwise(F.col("original_filename")).alias("original_filename"),
        shown.alias("parsed"), F.when(~blind, F.col("cover_letter_text")).alias("cover_letter_text"), "blinded",
    )


def entries_read(entries: DataFrame, resumes: DataFrame, jobs: DataFrame, regions: tuple[str, ...] = (), assignees: DataFrame | None = None, user: str | None = None) -> DataFrame:
    """Shortlist entries as they are listed: those of withdrawn résumés are left out; where the job is reviewed blind, quotes
    and their sources are redacted, the label is the rank's pseudonym, and blinded is set.

    entries: job_id, resume_id, rank, evidence; resumes: resume_id, parsed, withdrawn_at.  With a user, only entries of jobs
    they are assigned to are found.
    """
    rows = entries if assignees is None else scoped(entries, assignees, "job_id", user)
    alive = resumes.where("withdrawn_at is null").select("resume_id", "parsed")
    rows = rows.join(alive, "resume_id").join(jobs.select("job_id", "blind_review"), "job_id").withColumn("blinded", is_blind(F.col("blind_review"), F.lit(False)))
    evidence = F.col("evidence")
    rows, hide = hider(rows, "parsed", None, regions)
    blind = with_sources(blind_evidence(evidence, hide), F.col("__texts"), hide)
    clear = evidence.withField("requirements", F.transform(evidence["requirements"], lambda r: r.withField("source_context", F.lit(None).cast("string"))))
    shown = F.when(F.col("blinded"), blind).otherwise(clear)
    return rows.select("job_id", "resume_id", "rank", shown.alias("evidence"), F.when(F.col("blinded"), pseudonym(F.col("rank"))).alias("display_label"), "blinded")


def reverse_read(resumes: DataFrame, matches: DataFrame, jobs: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """A row per résumé: its jobs by rank, with title and department; stamp and time are those of the first.

    A résumé without matches, or withdrawn, has no entries and null stamp and time.  matches: resume_id, job_id, rank,
    score_final, pipeline_version, generated_at.
    """
    shown = live(matches, withdrawn, "resume_id").join(jobs.select("job_id", "title", "department"), "job_id")
    one = F.struct("rank", "job_id", "title", "department", "score_final")
    first = lambda c: F.min_by(c, F.struct("rank", "job_id")).alias(c)
    listed = shown.groupBy("resume_id").agg(F.array_sort(F.collect_list(one)).alias("entries"), first("pipeline_version"), first("generated_at"))
    none = F.from_json(F.lit("[]"), listed.schema["entries"].dataType.simpleString())
    out = resumes.select("resume_id").join(listed, "resume_id", "left")
    return out.withColumn("entries", F.coalesce("entries", none))
