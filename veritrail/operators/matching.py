"""Skill edges, structured scores, evidence and the final ranking, for all jobs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.fuzzy import partial_ratio_reaches
from ..functions.strings import collapse, degree_level, level_rank, strip, strip_controls
from ..weights import DEFAULT, Weights


def requirement_rows(candidates: DataFrame, requires: DataFrame, has_skill: DataFrame, families: DataFrame, excluded: tuple[str, ...] = (), family_credit: float = 0.5, classified: DataFrame | None = None) -> DataFrame:
    """A row for every candidate and requirement: skill, min_years, is_must_have, years, last_used_year, ontology_weight.

    candidates: job_id, resume_id; requires: job_id, skill, min_years, is_must_have; has_skill: resume_id, skill, years,
    last_used_year; families: skill, family.  The weight is 1 for the skill itself, the family's credit if the candidate
    has another skill of a family of the requirement that is not excluded, else 0.  The overlap of families is an
    equi-join on single families, so no pair of arrays is ever compared.  classified, if given, holds families (skill,
    family) that a classifier found: they count for the candidate's skills, never for the requirement's.
    """
    allowed = lambda df: df.where(~F.col("family").isin(*excluded)) if excluded else df
    usable = allowed(families)
    offered_families = usable if classified is None else usable.select("skill", "family").unionByName(allowed(classified).select("skill", "family")).distinct()
    none = F.lit(None).cast("string")
    keys = F.explode(F.array(F.struct(F.col("skill").alias("own"), none.alias("shared")), F.struct(none.alias("own"), F.col("family").alias("shared"))))
    key = F.coalesce(F.concat(F.lit("skill:"), F.col("k.own")), F.concat(F.lit("family:"), F.col("k.shared"))).alias("key")
    # either side offers a row for the skill itself and one for each family, so one join finds both kinds of match
    offered = has_skill.select("resume_id", "skill", "years", "last_used_year").join(offered_families, "skill", "left").withColumn("k", keys).where("k.own is not null or k.shared is not null")
    offered = offered.select("resume_id", key, F.when(F.col("k.own").isNotNull(), F.struct("years", "last_used_year")).alias("held"))
    wanted = candidates.join(requires, "job_id").join(usable, "skill", "left").withColumn("k", keys).where("k.own is not null or k.shared is not null")
    wanted = wanted.select("job_id", "resume_id", "skill", "min_years", "is_must_have", key)
    met = wanted.join(offered.withColumn("met", F.lit(True)), ["resume_id", "key"], "left")
    rows = met.groupBy("job_id", "resume_id", "skill", "min_years", "is_must_have").agg(F.max("held").alias("held"), F.max("met").alias("met"))
    weight = F.when(F.col("held").isNotNull(), 1.0).when(F.col("met"), family_credit).otherwise(0.0)
    return rows.select("job_id", "resume_id", "skill", "min_years", F.coalesce("is_must_have", F.lit(True)).alias("is_must_have"), "held.years", "held.last_used_year", weight.alias("ontology_weight"))


def skill_scores(rows: DataFrame, senior: DataFrame, today_year: int, w: Weights = DEFAULT) -> DataFrame:
    """job_id, resume_id, skill_score, must, missing and the contributions in order of skill.

    senior: job_id, resume_id, senior.  A miss is a requirement without ontology weight, whatever its score.
    """
    scored = rows.withColumn("score", scoring.skill_score(F.col("years"), F.col("min_years"), F.col("last_used_year"), F.col("ontology_weight"), today_year, w))
    miss = F.col("ontology_weight") == 0
    reason = F.when(miss, "missing").when(F.col("ontology_weight") < 1, "ontology-fallback")
    recency = F.when(~miss, scoring.recency(F.col("last_used_year"), today_year, w))
    one = F.struct("skill", "score", F.when(~miss, F.greatest(F.lit(0), F.col("years"))).alias("years"), recency.alias("recency"), F.when(~miss, F.col("ontology_weight")).alias("ontology_weight"), "is_must_have", reason.alias("reason"))
    grouped = scored.groupBy("job_id", "resume_id").agg(
        F.avg("score").alias("mean"),
        F.count(F.when(F.col("is_must_have"), 1)).alias("must"),
        F.count(F.when(F.col("is_must_have") & miss, 1)).alias("missing"),
        F.array_sort(F.collect_list(one)).alias("contributions"),
    )
    out = grouped.join(senior, ["job_id", "resume_id"], "left").withColumn("senior", F.coalesce("senior", F.lit(False)))
    relieved = F.col("senior") & F.coalesce(1 - F.try_divide("missing", "must") >= w.implied_min_coverage, F.lit(False))
    marked = F.transform("contributions", lambda c: F.when(relieved & c["is_must_have"] & (c["reason"] == "missing"), c.withField("reason", F.lit("implied-experience"))).otherwise(c))
    score = F.col("mean") * scoring.miss_multiplier(F.col("must"), F.col("missing"), F.col("senior"), w)
    return out.select("job_id", "resume_id", score.alias("skill_score"), "must", "missing", marked.alias("contributions"))


def unsmeared(skills: DataFrame, least: int = 6) -> DataFrame:
    """Nulls the years that so many skills of one résumé share that they cannot be the skills' own."""
    same = F.count("years").over(Window.partitionBy("resume_id", "years"))
    return skills.withColumn("years", F.when(same < least, F.col("years")))


def merged_skills(mentions: DataFrame) -> DataFrame:
    """One row per résumé and skill; each field is the first that is not null, by arrival.  mentions: ..., at."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c)
    return mentions.groupBy("resume_id", "skill").agg(first("years"), first("last_used_year"), F.min("at").alias("at"))


def borne_out(cited: DataFrame, chunks: DataFrame, quote: str = "evidence", w: Weights = DEFAULT) -> DataFrame:
    """row_id, at, id and good of every citation of a known chunk: whether the chunk holds the quote.

    cited: row_id, resume_id, the quote, at, id; chunks: resume_id, id, text.  Texts are shuffled once, to meet their
    citations.  Exact spans are told natively; the others reach Python, where pairs that repeat in a batch count once.
    """
    known = cited.join(chunks.select("resume_id", "id", "text"), ["resume_id", "id"])
    plain = lambda c: collapse(strip_controls(F.lower(strip(F.col(c)))))
    known = known.select("row_id", "at", "id", plain(quote).alias("needle"), plain("text").alias("hay"))
    fits = (F.length("needle") >= w.evidence_min_quote_chars) & (F.length("needle") <= F.length("hay"))
    exact = F.contains("hay", "needle")
    ask = fits & ~exact
    close = partial_ratio_reaches(F.when(ask, F.col("needle")), F.when(ask, F.col("hay")), w.evidence_verify_fuzz)
    return known.select("row_id", "at", "id", F.coalesce(fits & (exact | F.coalesce(close, F.lit(False))), F.lit(False)).alias("good"))


def verified(requirements: DataFrame, chunks: DataFrame, quote: str = "evidence", w: Weights = DEFAULT) -> DataFrame:
    """Requirements whose quote is no span of a cited chunk lose it.

    requirements: row_id (unique), status, evidence, evidence_chunk_ids, confidence, resume_id and others; chunks:
    resume_id, id, text.  Citations of unknown chunks are dropped.  A quote must have the least length, be no longer
    than the chunk, and reach the bar of fuzzy similarity, both sides scrubbed and collapsed.  A met requirement that
    loses its quote becomes missing, a partial one stays, and confidence falls to 0.3 at most.  Rows without a quote stay
    as they are.
    """
    cited = requirements.where(F.size("evidence_chunk_ids") > 0).select("row_id", "resume_id", quote, F.posexplode("evidence_chunk_ids").alias("at", "id"))
    told = borne_out(cited, chunks, quote, w)
    good = F.max("good")
    told = told.groupBy("row_id").agg(good.alias("good"), F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("good_ids"))
    out = requirements.join(told, "row_id", "left")
    has_quote = F.coalesce(F.col(quote) != "", F.lit(False))
    loses = has_quote & ~F.coalesce("good", F.lit(False))
    changed = {
        "evidence_chunk_ids": F.coalesce("good_ids", F.array().cast("array<string>")),
        quote: F.when(loses, "").otherwise(F.col(quote)),
        "confidence": F.when(loses, F.least(F.col("confidence"), F.lit(0.3))).otherwise(F.col("confidence")),
    }
    if "status" in requirements.columns:
        changed["status"] = F.when(loses & (F.col("status") == "met"), "missing").otherwise(F.col("status"))
    return out.withColumns(changed).select(*requirements.columns)


#: Caps of evidence when it is taken in; quotes that are longer are dropped, never cut.
QUOTE_CHARS, REQUIREMENT_CHARS, MOST_IDS, MOST_REQUIREMENTS, OVERALL_CHARS, SCRUBBED = 2000, 500, 8, 64, 1000, 0.3


def taken_in(evidence: Column) -> Column:
    """Evidence (schemas.EVIDENCE) within its caps and without invisible characters.

    Lists are cut to 64 rows before anything else is looked at, names of requirements and overall texts to their length,
    citations to 8.  An overlong quote goes whole: its met requirement becomes missing, confidence falls to 0.3 at most.
    """
    clean = lambda c: strip_controls(c)

    def one(r: Column, requirement: bool) -> Column:
        long = F.coalesce(F.length(r["evidence"]) > QUOTE_CHARS, F.lit(False))  # of the scrubbed quote
        r = r.withField("evidence", F.when(long, "").otherwise(r["evidence"])).withField("evidence_chunk_ids", F.slice(r["evidence_chunk_ids"], 1, MOST_IDS))
        r = r.withField("confidence", F.when(long, F.least(r["confidence"], F.lit(SCRUBBED))).otherwise(r["confidence"]))
        if not requirement:
            return r.withField("theme", clean(r["theme"]))
        r = r.withField("requirement", F.substring(clean(r["requirement"]), 1, REQUIREMENT_CHARS))
        return r.withField("status", F.when(long & (r["status"] == "met"), "missing").otherwise(r["status"]))

    first = lambda c: F.slice(evidence[c], 1, MOST_REQUIREMENTS)
    scrubbed = lambda c: F.transform(first(c), lambda r: r.withField("evidence", clean(r["evidence"])))
    out = evidence.withField("requirements", F.transform(scrubbed("requirements"), lambda r: one(r, True)))
    out = out.withField("cover_letter_evidence", F.transform(scrubbed("cover_letter_evidence"), lambda r: one(r, False)))
    for c in ("overall_summary", "overall_motivation"):
        out = out.withField(c, F.substring(clean(evidence[c]), 1, OVERALL_CHARS))
    return out


def education_rows(studies: Column) -> Column:
    """The readable level's rank and the field of every degree of a parsed résumé, in their order: positions are kept."""
    return F.transform(studies, lambda e: F.struct(level_rank(degree_level(e["degree"])).alias("rank"), e["field"].alias("field")))


def best_rank(rows: Column) -> Column:
    """The highest rank of the readable degrees, null without one."""
    return F.array_max(F.transform(rows, lambda e: e["rank"]))


def zipped(levels: Column, fields: Column) -> Column:
    """Levels and fields position by position; what one of them lacks at its end is null."""
    return F.transform(F.arrays_zip(levels.alias("level"), fields.alias("field")), lambda x: F.struct(x["level"].alias("level"), x["field"].alias("field")))


def field_matches(degrees: DataFrame, wanted: DataFrame, w: Weights = DEFAULT) -> DataFrame:
    """job_id, resume_id of the pairs some degree of which is in a field that the job asks for, by fuzzy likeness.

    degrees: job_id, resume_id, field, rank (of the level, readable ones only count), need; wanted: job_id, field.  Pairs of
    fields are scored once each, however many candidates and jobs they belong to.
    """
    from ..functions.fuzzy import token_set_ratio_column
    from ..functions.strings import normal_field

    met = degrees.where((F.col("rank") >= F.col("need")) & F.col("field").isNotNull()).select("job_id", "resume_id", normal_field(F.col("field")).alias("own"))
    asked = met.join(wanted.select("job_id", normal_field(F.col("field")).alias("asked")), "job_id").where("own <> '' and asked <> ''")
    pairs = asked.select("own", "asked").distinct()
    close = pairs.where(token_set_ratio_column(F.col("own"), F.col("asked")) >= w.education_field_fuzz)
    return asked.join(close, ["own", "asked"], "left_semi").select("job_id", "resume_id").distinct()


def attached(entries: DataFrame, evidence: DataFrame, key: list[str], name: str = "evidence") -> DataFrame:
    """Entries with their evidence; those without have null, which is not the same as empty evidence."""
    return entries.join(evidence.select(*key, name), key, "left")


def extracted(requirements: DataFrame, chunk_skills: DataFrame, confidence: float = 0.9) -> DataFrame:
    """A deterministic extractor: each requirement cites the résumé's first chunk that names the skill.

    requirements: resume_id, requirement, skill, and others, which stay; chunk_skills: resume_id, id, at, text, skills
    (array).
    """
    named = chunk_skills.select("resume_id", F.explode("skills").alias("skill"), F.struct("at", "id", "text").alias("c")).groupBy("resume_id", "skill").agg(F.min("c").alias("c"))
    out = requirements.join(named, ["resume_id", "skill"], "left")
    found = F.col("c").isNotNull()
    return out.select(
        *[c for c in requirements.columns if c != "skill"], F.when(found, "met").otherwise("missing").alias("status"), F.coalesce("c.text", F.lit("")).alias("evidence"),
        F.when(found, F.array("c.id")).otherwise(F.array().cast("array<string>")).alias("evidence_chunk_ids"), F.when(found, confidence).otherwise(0.0).alias("confidence"),
    )


def explanation(entry: Column, w: Weights = DEFAULT) -> Column:
    """weight, score and contribution of every part; a part that was not recorded contributes null."""
    parts = {"skill": w.skill, "experience": w.experience, "education": w.education, "seniority": w.seniority, "vector": w.vector}
    return F.array(*[F.struct(F.lit(k).alias("part"), F.lit(v).alias("weight"), entry[k].alias("score"), (entry[k] * v).alias("contribution")) for k, v in parts.items()])
