"""The ranking of pairs of jobs and résumés, from recalled pairs to final places, for all jobs (or résumés) in one plan.

Forward and reverse ranking differ in what a list is: a job's résumés or a résumé's jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.strings import level_rank, strip
from ..functions.vectors import cosine
from ..weights import DEFAULT, Weights
from . import documents, matching, ranking, skills as skill_ops
from .recall import normalised, within_pools

PAIR = ["job_id", "resume_id"]
Embedder = Callable[[DataFrame], DataFrame]


def title_likeness(pairs: DataFrame, embed: Embedder) -> DataFrame:
    """job_title, title and cos of every distinct pair of titles; each title is embedded once."""
    both = pairs.where((strip(F.col("title")) != "") & F.col("job_title").isNotNull()).select("job_title", "title").distinct()
    texts = both.select(F.explode(F.array("job_title", "title")).alias("text")).distinct()
    vectors = embed(texts)
    own = vectors.select(F.col("text").alias("title"), F.col("vector").alias("a"))
    asked = vectors.select(F.col("text").alias("job_title"), F.col("vector").alias("b"))
    return both.join(own, "title").join(asked, "job_title").select("job_title", "title", cosine(F.col("a"), F.col("b")).alias("cos"))


def education_scores(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, w: Weights = DEFAULT) -> DataFrame:
    """job_id, resume_id and education.  jobs: job_id, min_level, fields; resumes: resume_id, studies (array<struct<degree,
    field>>).  The highest readable degree counts, and a field counts if its own degree reaches the level asked for."""
    rows = matching.education_rows(F.col("studies"))
    both = pairs.join(jobs.select("job_id", "min_level", "fields"), "job_id").join(resumes.select("resume_id", rows.alias("studies")), "resume_id")
    need = F.coalesce(level_rank(F.col("min_level")), F.lit(0))
    asked = F.coalesce(F.size("fields"), F.lit(0)) > 0
    degrees = both.where(asked).select("job_id", "resume_id", need.alias("need"), F.explode("studies").alias("d")).select("job_id", "resume_id", "need", "d.rank", "d.field")
    wanted = jobs.select("job_id", F.explode("fields").alias("field"))
    matched = matching.field_matches(degrees, wanted, w).withColumn("field_match", F.lit(True))
    out = both.join(matched, PAIR, "left")
    score = scoring.education(matching.best_rank(F.col("studies")), F.col("min_level"), asked, F.coalesce("field_match", F.lit(False)), w)
    return out.select("job_id", "resume_id", score.alias("education"))


def structured_scores(pool: DataFrame, jobs: DataFrame, resumes: DataFrame, requires: DataFrame, has_skill: DataFrame, families: DataFrame, embed: Embedder, today_year: int, excluded: tuple[str, ...] = (), w: Weights = DEFAULT) -> DataFrame:
    """Adds skill_score, contributions, experience, education, seniority (null without a title) and structured to recalled
    pairs (job_id, resume_id, vec_norm).

    jobs: job_id, title, min_years, min_level, fields; resumes: resume_id, total_years, title, studies.
    """
    pairs = pool.select(*PAIR)
    both = pairs.join(jobs.select("job_id", F.col("title").alias("job_title"), "min_years"), "job_id").join(resumes.select("resume_id", "total_years", "title"), "resume_id")
    senior = both.select(*PAIR, scoring.is_senior(F.col("total_years"), F.col("min_years"), w).alias("senior"))
    rows = matching.requirement_rows(pairs, requires, has_skill, families, excluded)
    scored = matching.skill_scores(rows, senior, today_year, w).select(*PAIR, "skill_score", "contributions")
    out = pool.join(both, PAIR).join(scored, PAIR, "left").join(education_scores(pairs, jobs, resumes, w), PAIR)
    out = out.join(title_likeness(both, embed), ["job_title", "title"], "left")
    seniority = F.when(F.col("cos").isNotNull(), scoring.seniority(F.col("cos"), w))
    out = out.withColumns({"skill_score": F.coalesce("skill_score", F.lit(0.0)), "experience": scoring.experience(F.col("total_years"), F.col("min_years"), w), "seniority": seniority})
    structured = scoring.structured(F.col("skill_score"), F.col("experience"), F.col("education"), F.coalesce("seniority", F.lit(0.0)), F.col("vec_norm"), w)
    return out.withColumn("structured", structured).drop("job_title", "title", "cos", "total_years", "min_years")


def evidence_scores(claims: DataFrame, themes: DataFrame, chunks: DataFrame, w: Weights = DEFAULT) -> DataFrame:
    """job_id, resume_id, requirements (verified), evidence and motivation.

    claims: job_id, resume_id, at, requirement, status, evidence, evidence_chunk_ids, confidence; themes: resume_id, at,
    theme, evidence, evidence_chunk_ids, confidence; chunks: resume_id, id, text, those of the cover letter among them.
    Quotes are verified before anything counts; a theme counts for every job of its résumé.
    """
    name = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    told = matching.verified(claims.withColumn("row_id", name("job_id", "resume_id", "at")), chunks, w=w)
    one = F.struct("at", "requirement", "status", "evidence", "evidence_chunk_ids", "confidence")
    listed = told.groupBy(*PAIR).agg(F.array_sort(F.collect_list(one)).alias("requirements"))
    letters = matching.verified(themes.withColumn("row_id", name("resume_id", "at")), chunks, w=w)
    letters = letters.groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("at", "confidence", "evidence_chunk_ids"))).alias("themes"))
    out = listed.join(letters, "resume_id", "left")
    motivated = F.when(F.col("themes").isNull(), 0.0).otherwise(scoring.motivation(F.col("themes"), w))
    return out.select(*PAIR, "requirements", scoring.completeness(F.col("requirements"), w).alias("evidence"), motivated.alias("motivation"))


def ordered(key: str) -> list[Column]:
    """Places within a list before evidence: by structured score, then likeness, then id."""
    return [F.desc(F.round("structured", 9)), F.desc(F.round("vec_norm", 9)), F.col("resume_id" if key == "job_id" else "job_id")]


def ranked(scored: DataFrame, key: str, evidence_k: int, evidence: Callable[[DataFrame], DataFrame], reverse: bool = False, w: Weights = DEFAULT) -> DataFrame:
    """Adds evidence_evaluated, requirements, evidence, motivation, final and rank.  key: what has a list, job_id or resume_id.

    Evidence is sought for each list's first evidence_k only; it is 0, not assessed, for the others.  A reverse list counts
    no motivation.  evidence: from pairs to what evidence_scores() gives.
    """
    marked = ranking.evaluated(scored, key, evidence_k, ordered(key))
    found = evidence(marked.where("evidence_evaluated").select(*PAIR))
    out = marked.join(found, PAIR, "left").withColumns({"evidence": F.coalesce("evidence", F.lit(0.0)), "motivation": F.coalesce("motivation", F.lit(0.0))})
    final = scoring.final(F.col("structured"), F.col("evidence"), None if reverse else F.col("motivation"), w)
    out = out.withColumn("final", final)
    return ranking.ranked(out, key, [F.desc(F.round("final", 9)), *ordered(key)])


def rank_documents(jobs: DataFrame, resumes: DataFrame, aliases: DataFrame, terms: list[str], families: DataFrame, embed: Embedder, today_year: int, excluded: tuple[str, ...] = (), coarse_k: int = 50, evidence_k: int = 15, w: Weights = DEFAULT, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Rankings of parsed documents, with the deterministic stand-ins for models: every step from the documents on.

    jobs: job_id, doc (schemas.JOB_DOCUMENT), min_years; resumes: resume_id, job_id, doc (schemas.RESUME_DOCUMENT);
    aliases: alias, canonical; families: skill, family.  A requirement cites the first chunk that names its skill, a cover
    letter its first chunk as its motivation.  What is embedded is without identity.  keep: writes and rereads what is
    used more than once (sources.tables.kept).
    """
    from .redaction import embedding_safe

    view = jobs.select("job_id", documents.job_view(F.col("doc"), F.col("min_years")).alias("v"), documents.job_text(F.col("doc")).alias("text"))
    who = F.col("doc.candidate")
    summary = embedding_safe(documents.resume_text(F.col("doc")), who["name"], who["email"], who["phone"], who["location"])
    people = resumes.select("resume_id", "job_id", "doc", summary.alias("text"))
    vectors = keep(embed(view.select("text").unionByName(people.select("text")).distinct()), "vectors")
    job_vectors = view.join(vectors, "text").select("job_id", F.col("vector").alias("job_vector"))
    pool = people.select("resume_id", "job_id", "text").join(vectors, "text").select("job_id", "resume_id", "vector")
    recalled = keep(normalised(within_pools(job_vectors, pool, coarse_k)).select(*PAIR, "vec_norm", "discriminating"), "recalled")

    asked = view.select("job_id", F.posexplode(F.concat(F.transform("v.required", lambda s: F.struct(F.lit(True).alias("must"), s["name"].alias("name"), s["min_years"].alias("min_years"))), F.transform("v.nice", lambda s: F.struct(F.lit(False).alias("must"), s["name"].alias("name"), s["min_years"].alias("min_years"))))).alias("at", "s"))
    asked = keep(skill_ops.normalised(asked.select("job_id", "at", "s.must", "s.name", "s.min_years"), aliases), "asked")
    requires = asked.where("must and skill <> ''").groupBy("job_id", "skill").agg(F.min_by("min_years", "at").alias("min_years")).withColumn("is_must_have", F.lit(True))
    held = people.select("resume_id", F.posexplode("doc.skills").alias("at", "s")).select("resume_id", "at", "s.name", "s.years", "s.last_used_year")
    held = skill_ops.normalised(held, aliases).where("skill <> ''")
    first = F.min(F.struct("at", "years", "last_used_year")).alias("x")
    has_skill = keep(held.groupBy("resume_id", "skill").agg(first).select("resume_id", "skill", "x.years", "x.last_used_year"), "has_skill")

    job_rows = view.select("job_id", "v.title", "v.min_years", "v.min_level", "v.fields")
    resume_rows = people.select("resume_id", F.col("doc.total_years_experience").alias("total_years"), documents.recent_title(F.col("doc.experience")).alias("title"), F.col("doc.education").alias("studies"))
    scored = keep(structured_scores(recalled, job_rows, resume_rows, requires, has_skill, families, embed, today_year, excluded, w), "scored")

    own = people.select("resume_id", F.posexplode("doc.chunks").alias("at", "c")).select("resume_id", "at", "c.id", "c.text")
    cover = people.select("resume_id", F.posexplode("doc.cover_letter_chunks").alias("at", "c")).select("resume_id", "at", "c.id", "c.text")
    keyed = own.withColumn("chunk", F.concat_ws("/", F.col("resume_id").cast("string"), F.col("at").cast("string")))
    named = keyed.join(skill_ops.scanned(keyed, "chunk", "text", aliases, terms), "chunk").select("resume_id", "id", "at", "text", "skills")
    themes = cover.where("at = 0").select("resume_id", F.lit(0).alias("at"), F.lit("motivation").alias("theme"), F.col("text").alias("evidence"), F.array("id").alias("evidence_chunk_ids"), F.lit(0.9).alias("confidence"))

    def evidence(pairs: DataFrame) -> DataFrame:
        wanted = pairs.join(asked.select("job_id", "at", F.col("name").alias("requirement"), "skill"), "job_id")
        claims = matching.extracted(wanted, named)
        return evidence_scores(claims, themes, own.unionByName(cover).select("resume_id", "id", "text"), w)

    return ranked(scored, "job_id", evidence_k, evidence, w=w)
