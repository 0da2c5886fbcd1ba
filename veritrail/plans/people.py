"""Parsed résumés, their blind reads, exports and embeddings' inputs.

Customers play candidates, nations jobs.  A résumé's texts are put together from the customer's key, so the SQL beside a
query says what must come out from how the texts were made, not by redacting them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, export, governance, graph, reads, redaction
from ..operators.redaction import embedding_safe, scrubbed_names
from .registry import query, table

REGIONS = ("Texas", "France")
#: The parts of a candidate, in the dialect that both engines share; `pick` stands for the choice from a list by position.
FIRST = "element_at(array('Ann', 'Bob', 'Cyd', 'Dee', 'Eve'), cast(1 + k % 5 as int))"
PARTS = {
    "first": FIRST,
    "name": f"concat({FIRST}, ' Q', k)",
    "email": f"concat(lower({FIRST}), '.', k, '@mail.example')",
    "phone": "concat('+1 416 555 ', lpad(cast(k % 10000 as string), 4, '0'))",
    "place": "case k % 4 when 0 then 'Austin, Texas' when 1 then 'Toronto' when 2 then 'Paris, France' end",
    "co1": "concat('Acme ', k % 7)",
    "co2": "case k % 3 when 0 then 'Acme' when 1 then 'Globex' else concat('Acme ', k % 7) end",
    "school": "case when k % 11 = 0 then 'Globex' else concat('Tech ', k % 4) end",
}
DOC = """named_struct(
 'candidate', named_struct('name', name, 'email', email, 'phone', phone, 'location', place),
 'summary', concat(name, ' led ', co1, ' near ', co2, ', then in Paris, France; write to ', email, ' or call ', phone, ', 2002-2007.'),
 'total_years_experience', cast(k % 30 as int),
 'skills', array(named_struct('name', 'python', 'years', cast(k % 9 as int), 'last_used_year', 2000, 'evidence_chunk_ids', array('c_002', 'c_002', 'zz'), 'categories', cast(null as array<string>)),
   named_struct('name', name, 'years', 1, 'last_used_year', 2000, 'evidence_chunk_ids', array(cast(null as string)), 'categories', cast(null as array<string>))),
 'experience', array(
   named_struct('company', co1, 'title', 'Plant lead', 'start', '2001', 'end', '2004', 'is_current', false, 'bullets', array(named_struct('text', concat('Grew ', co1, ' with ', first), 'chunk_id', 'c_002'))),
   named_struct('company', co2, 'title', 'Chief', 'start', '2004', 'end', cast(null as string), 'is_current', true, 'bullets', cast(array() as array<struct<text:string,chunk_id:string>>))),
 'education', array(named_struct('degree', 'BSc Physics', 'institution', school, 'field', 'Physics', 'year', cast(1990 + k % 20 as int))),
 'chunks', array(named_struct('id', 'c_001', 'section', 'header', 'page', 1, 'text', concat(first, ' of ', school, ' and Qx', k)),
   named_struct('id', 'c_002', 'section', 'experience', 'page', 1, 'text', concat('Q', k, ' ran plants for ', co1, ' in Austin, Texas and Ottawa.'))),
 'cover_letter_chunks', array(named_struct('id', 'cl_001', 'section', 'other', 'page', 1, 'text', concat('I am ', name, ' and like ', co2, '.'))),
 'degraded', k % 13 = 0, 'degradation_reason', cast(null as string))"""
#: The same parts in the other engine, and what a blind reader sees of them.
PEOPLE_SQL = """f AS (SELECT c_custkey AS k, c_nationkey AS job_id, ['Ann', 'Bob', 'Cyd', 'Dee', 'Eve'][1 + c_custkey % 5] AS first FROM customer),
people AS (SELECT *, first || ' Q' || k AS name, lower(first) || '.' || k || '@mail.example' AS email, '+1 416 555 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS phone,
  CASE k % 4 WHEN 0 THEN 'Austin, Texas' WHEN 1 THEN 'Toronto' WHEN 2 THEN 'Paris, France' END AS place, 'Acme ' || k % 7 AS co1,
  CASE k % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Globex' ELSE 'Acme ' || k % 7 END AS co2, CASE WHEN k % 11 = 0 THEN 'Globex' ELSE 'Tech ' || k % 4 END AS school FROM f),
seen AS (SELECT *, CASE WHEN co2 = co1 THEN 'Employer A' WHEN co2 = school THEN 'Institution A' ELSE 'Employer B' END AS l2, CASE WHEN k % 4 = 1 THEN place END AS shown_place,
  '[name redacted].[contact redacted]' AS hidden_email FROM people),
blind AS (SELECT *, '[name redacted] led Employer A near ' || l2 || ', then in [location redacted]; write to ' || hidden_email || ' or call [contact redacted], 2002-2007.' AS b_summary,
  '[name redacted] of Institution A and Qx' || k AS b_c1, '[name redacted] ran plants for Employer A in [location redacted] and Ottawa.' AS b_c2, 'I am [name redacted] and like ' || l2 || '.' AS b_cover,
  name || ' led ' || co1 || ' near ' || co2 || ', then in Paris, France; write to ' || email || ' or call ' || phone || ', 2002-2007.' AS summary,
  first || ' of ' || school || ' and Qx' || k AS c1, 'Q' || k || ' ran plants for ' || co1 || ' in Austin, Texas and Ottawa.' AS c2, 'I am ' || name || ' and like ' || co2 || '.' AS cover FROM seen)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resume_id, job_id, the parts and doc of every customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("job_id"))
    c = c.select("k", "job_id", *[F.expr(e).alias(n) for n, e in PARTS.items()])
    return c.select(F.col("k").alias("resume_id"), "*", F.expr(DOC).alias("doc"))


def blind_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second job is reviewed blind; where the flag is not known a job counts as blind."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("job_id"), F.col("n_name").alias("title"), F.concat(F.lit("dept "), (k % 3).cast("string")).alias("department"), F.when(k % 7 != 3, k % 2 == 0).alias("blind_review"))


IS_BLIND = "coalesce(CASE WHEN job_id % 7 <> 3 THEN job_id % 2 = 0 END, true)"


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, b_summary AS summary, b_c1 AS c1, b_c2 AS c2, b_cover AS cover, 'Grew Employer A with [name redacted]' AS bullet, 'Employer A' AS company1, l2 AS company2,
  'Institution A' AS school, 'Plant lead' AS title, 'BSc Physics' AS degree, shown_place AS place, true AS bare FROM blind""")
def blind_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole parsed documents without identity."""
    d = redaction.blind_resumes(people(spark, sf_dir).select("resume_id", "doc"), "doc", "d", REGIONS)
    bare = F.col("d.candidate.name").isNull() & F.col("d.candidate.email").isNull() & F.col("d.candidate.phone").isNull() & F.col("d.education")[0]["year"].isNull()
    e = F.col("d.experience")
    return d.select(
        "resume_id", F.col("d.summary").alias("summary"), F.col("d.chunks")[0]["text"].alias("c1"), F.col("d.chunks")[1]["text"].alias("c2"), F.col("d.cover_letter_chunks")[0]["text"].alias("cover"), e[0]["bullets"][0]["text"].alias("bullet"),
        e[0]["company"].alias("company1"), e[1]["company"].alias("company2"), F.col("d.education")[0]["institution"].alias("school"), e[0]["title"].alias("title"), F.col("d.education")[0]["degree"].alias("degree"), F.col("d.candidate.location").alias("place"), bare.alias("bare"),
    )


@query(f"""WITH {PEOPLE_SQL}, l AS (SELECT k, unnest(map_entries(CASE WHEN co1 = co2 THEN MAP {{co1: 'Employer A', school: 'Institution A'}} WHEN co2 = school THEN MAP {{co1: 'Employer A', school: 'Institution A'}}
  ELSE MAP {{co1: 'Employer A', co2: 'Employer B', school: 'Institution A'}} END)) AS e, place FROM people) SELECT k AS resume_id, e.key AS name, e.value AS label, place FROM l""")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and place that a stored parse gives."""
    p = people(spark, sf_dir)
    return p.select("resume_id", F.explode(F.map_entries(redaction.labels_of(F.col("doc")))).alias("e"), F.col("doc.candidate.location").alias("place")).select("resume_id", F.col("e.key").alias("name"), F.col("e.value").alias("label"), "place")


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, CASE WHEN {IS_BLIND} AND k % 5 <> 0 THEN 'resume.pdf' ELSE name || '.PDF' END AS original_filename, CASE WHEN NOT ({IS_BLIND} AND k % 5 <> 0) THEN name END AS name,
  CASE WHEN {IS_BLIND} AND k % 5 <> 0 THEN b_summary ELSE summary END AS summary, CASE WHEN NOT ({IS_BLIND} AND k % 5 <> 0) THEN cover END AS cover_letter_text, {IS_BLIND} AND k % 5 <> 0 AS blinded FROM blind""")
def resume_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads; every fifth is revealed."""
    p = people(spark, sf_dir).select("resume_id", "job_id", F.concat("name", F.lit(".PDF")).alias("original_filename"), F.col("doc").alias("parsed"), F.col("doc.cover_letter_chunks")[0]["text"].alias("cover_letter_text"))
    out = reads.resume_read(p, blind_jobs(spark, sf_dir), F.col("resume_id") % 5 == 0, REGIONS)
    return out.select("resume_id", "original_filename", F.col("parsed.candidate.name").alias("name"), F.col("parsed.summary").alias("summary"), "cover_letter_text", "blinded")


EVIDENCE = """named_struct('requirements', case when k % 8 = 7 then cast(array() as array<struct<requirement:string,status:string,evidence:string,evidence_chunk_ids:array<string>,confidence:double>>)
   else array(named_struct('requirement', 'python', 'status', 'met', 'evidence', concat('Q', k, ' ran\\nplants'), 'evidence_chunk_ids', array('c_002', 'c_002', 'zz', 'c_001'), 'confidence', 0.9D),
     named_struct('requirement', '=sum(1)', 'status', element_at(array('missing', 'partial', 'met'), cast(1 + k % 3 as int)), 'evidence', '', 'evidence_chunk_ids', cast(array() as array<string>), 'confidence', 0.5D)) end,
 'overall_summary', concat(first, ' of\\n', co1), 'cover_letter_presence', 'yes',
 'cover_letter_evidence', array(named_struct('theme', 'why', 'evidence', concat('like ', co2), 'evidence_chunk_ids', array('cl_001'), 'confidence', 0.8D)), 'overall_motivation', 'none')"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlist entries: customers of a nation by key; with scores, contributions and evidence."""
    from ..operators.ranking import ranked

    p = ranked(people(spark, sf_dir), "job_id", [F.col("k")])
    one = lambda skill, must, reason: F.struct(F.lit(skill).alias("skill"), F.lit(must).alias("is_must_have"), reason.cast("string").alias("reason"))
    listed = F.array(one("python", True, F.lit(None)), one("+go", True, F.when(F.col("k") % 2 == 0, "missing").otherwise("implied-experience")), one("sql", False, F.when(F.col("k") % 3 == 0, "missing")))
    score = lambda n: (F.col("k") % n / n).cast("double")
    breakdown = F.struct(score(7).alias("structured"), score(3).alias("motivation"), score(5).alias("skill"), score(4).alias("experience"), F.lit(None).cast("double").alias("education"), score(9).alias("seniority"), score(8).alias("vector"), listed.alias("contributions"))
    return p.select(
        "job_id", "resume_id", "rank", (F.col("k") / 3).alias("score_final"), breakdown.alias("breakdown"), F.expr(EVIDENCE).alias("evidence"), F.lit("0123456789abcdef").alias("git_sha"),
        F.expr("TIMESTAMP '2001-02-03 04:05:06'").alias("generated_at"),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Résumés as they are stored; every sixth is withdrawn."""
    p = people(spark, sf_dir)
    gone = F.when(F.col("k") % 6 == 0, F.expr("TIMESTAMP '2001-01-01 00:00:00'"))
    return p.select("resume_id", F.col("doc").alias("parsed"), gone.alias("withdrawn_at"), F.col("name").alias("candidate_name"), F.col("email").alias("candidate_email"), F.col("phone").alias("candidate_phone"), F.concat("name", F.lit(".PDF")).alias("original_filename"))


ENTRIES_SQL = f"""{PEOPLE_SQL}, entry AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k) AS rank FROM blind)"""
PSEUDONYM = "'Candidate ' || CASE WHEN rank > 702 THEN chr(CAST(64 + ((rank - 703) // 676) % 26 + 1 AS INT)) ELSE '' END || CASE WHEN rank > 26 THEN chr(CAST(64 + ((rank - 27) // 26) % 26 + 1 AS INT)) ELSE '' END || chr(CAST(64 + (rank - 1) % 26 + 1 AS INT))"


@query(f"""WITH {ENTRIES_SQL} SELECT job_id, k AS resume_id, rank, CASE WHEN k % 8 = 7 THEN NULL WHEN {IS_BLIND} THEN '[name redacted] ran' || chr(10) || 'plants' ELSE 'Q' || k || ' ran' || chr(10) || 'plants' END AS quote,
  CASE WHEN k % 8 <> 7 AND {IS_BLIND} THEN b_c2 || chr(10) || chr(10) || b_c1 END AS source, CASE WHEN {IS_BLIND} THEN '[name redacted] of' || chr(10) || 'Employer A' ELSE first || ' of' || chr(10) || co1 END AS overall,
  CASE WHEN {IS_BLIND} THEN 'like ' || l2 ELSE 'like ' || co2 END AS cover, CASE WHEN {IS_BLIND} THEN {PSEUDONYM} END AS display_label, {IS_BLIND} AS blinded FROM entry WHERE k % 6 <> 0""")
def entry_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlists as they are listed, blind or clear; withdrawn résumés are left out."""
    out = reads.entries_read(entries(spark, sf_dir), stored(spark, sf_dir), blind_jobs(spark, sf_dir), REGIONS)
    first = F.try_element_at("evidence.requirements", F.lit(1))
    return out.select("job_id", "resume_id", "rank", first["evidence"].alias("quote"), first["source_context"].alias("source"), F.col("evidence.overall_summary").alias("overall"), F.col("evidence.cover_letter_evidence")[0]["evidence"].alias("cover"), "display_label", "blinded")


@query(f"""WITH {ENTRIES_SQL} SELECT job_id, k AS resume_id, rank FROM entry WHERE k % 6 <> 0 AND job_id % 4 = 1""")
def entry_reads_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that a hiring manager sees: those of the jobs assigned to them."""
    assignees = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("job_id"), F.lit("u1").alias("user_id"))
    out = reads.entries_read(entries(spark, sf_dir), stored(spark, sf_dir), blind_jobs(spark, sf_dir), REGIONS, assignees, "u1")
    return out.select("job_id", "resume_id", "rank")


def export_rows(spark: SparkSession, sf_dir: str, reveal: bool) -> DataFrame:
    jobs = blind_jobs(spark, sf_dir).select("job_id", F.col("title").alias("job_title"), F.col("department").alias("job_department"))
    return export.masked(export.shortlist_rows(entries(spark, sf_dir), jobs, stored(spark, sf_dir)), reveal, REGIONS)


CSV_SQL = f"""WITH {ENTRIES_SQL} SELECT rank, {PSEUDONYM} AS candidate_name, '' AS candidate_email, '' AS candidate_phone, 'resume.pdf' AS resume_file, n_name AS job_title, 'dept ' || job_id % 3 AS job_department, round(k / 3, 4) AS score_final,
  CASE WHEN k % 2 = 0 THEN '''+go' ELSE '' END AS must_have_missing, concat_ws('; ', CASE WHEN k % 2 = 0 THEN CASE WHEN true THEN '+go' END END, CASE WHEN k % 3 = 0 THEN 'sql' END) AS skills_missing0,
  3 - (k % 2 = 0)::INT - (k % 3 = 0)::INT AS skills_matched_count, 3 AS skills_total, 2 AS must_have_count, k % 7 / 7 AS score_structured,
  CASE WHEN k % 8 = 7 THEN 0.0 ELSE round((1 + CASE WHEN k % 3 = 1 THEN 0.5 ELSE 0 END) / 2, 4) END AS score_evidence_completeness, k % 3 / 3 AS score_motivation, k % 5 / 5 AS skill, k % 4 / 4 AS experience, NULL::DOUBLE AS education, k % 9 / 9 AS seniority, k % 8 / 8 AS vector,
  CASE WHEN k % 8 = 7 THEN 0 ELSE 2 END AS requirement_count, CASE WHEN k % 8 = 7 THEN 0 ELSE 1 + (k % 3 = 2)::INT END AS requirements_met, CASE WHEN k % 8 = 7 THEN 0 ELSE (k % 3 = 1)::INT END AS requirements_partial,
  CASE WHEN k % 8 = 7 THEN 0 ELSE (k % 3 = 0)::INT END AS requirements_missing, '[name redacted] of Employer A' AS evidence_summary, concat_ws('; ', 'python', CASE WHEN k % 2 <> 0 THEN '+go' END, CASE WHEN k % 3 <> 0 THEN 'sql' END) AS skills_matched,
  '2001-02-03T04:05:06Z' AS generated_at, '0123456789ab' AS pipeline_version, CAST(k AS VARCHAR) AS resume_id FROM entry JOIN nation ON n_nationkey = job_id WHERE k % 6 <> 0"""


@query(f"SELECT * EXCLUDE (skills_missing0), CASE WHEN skills_missing0[1] = '+' THEN '''' || skills_missing0 ELSE skills_missing0 END AS skills_missing FROM ({CSV_SQL})")
def export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export of 30 columns, masked, every cell safe to open."""
    return export.safe(export.candidates_table(export_rows(spark, sf_dir, False)))


@query(f"""WITH {ENTRIES_SQL}, r AS (SELECT *, unnest(CASE WHEN k % 8 = 7 THEN [0] ELSE [1, 2] END) AS nth FROM entry WHERE k % 6 <> 0)
SELECT rank, name AS candidate_name, name || '.PDF' AS resume_file, n_name AS job_title, CASE nth WHEN 0 THEN '(no evidence generated)' WHEN 1 THEN 'python' ELSE '''=sum(1)' END AS requirement,
  CASE nth WHEN 1 THEN 'met' WHEN 2 THEN ['missing', 'partial', 'met'][1 + k % 3] END AS status, CASE nth WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 END::DOUBLE AS confidence, CASE nth WHEN 1 THEN 'Q' || k || ' ran plants' WHEN 2 THEN '' END AS quote,
  CASE nth WHEN 1 THEN 'c_002; c_002; zz; c_001' WHEN 2 THEN '' END AS evidence_chunk_ids, CASE nth WHEN 1 THEN c2 || '  ' || c1 WHEN 2 THEN '' END AS evidence_context FROM r JOIN nation ON n_nationkey = job_id""")
def export_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of a revealed export: a row per candidate and requirement."""
    return export.safe(export.evidence_table(export_rows(spark, sf_dir, True)))


@query(f"""WITH {ENTRIES_SQL} SELECT k AS resume_id, {PSEUDONYM} AS name, '' AS email, 'resume.pdf' AS filename, NOT true AS has_parse, CASE WHEN k % 8 <> 7 THEN b_c2 || chr(10) || chr(10) || b_c1 END AS source,
  CAST(k / 3 AS DOUBLE) AS score FROM entry WHERE k % 6 <> 0""")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export, read back from its JSON."""
    d = export.nested(export_rows(spark, sf_dir, False))
    at = lambda path: F.get_json_object("document", f"$.{path}")
    return d.select(at("resume_id").cast("long").alias("resume_id"), at("candidate_name").alias("name"), at("candidate_email").alias("email"), at("original_filename").alias("filename"), at("parsed").isNotNull().alias("has_parse"), at("evidence.requirements[0].source_context").alias("source"), at("score_final").cast("double").alias("score"))


@query(f"""WITH {PEOPLE_SQL}, m AS (SELECT k, unnest([{{'r': 2, 'j': k % 25}}, {{'r': 1, 'j': (k + 3) % 25}}, {{'r': 3, 'j': (k + 8) % 25}}], recursive := true) FROM people WHERE k % 10 <> 7 AND k % 6 <> 0),
g AS (SELECT k, string_agg(r || ':' || n_name || ':dept ' || j % 3 || ':' || r / 4, ',' ORDER BY r) AS entries FROM m JOIN nation ON n_nationkey = j GROUP BY 1)
SELECT people.k AS resume_id, coalesce(entries, '') AS entries, CASE WHEN g.k IS NOT NULL THEN 'v1' END AS pipeline_version, CASE WHEN g.k IS NOT NULL THEN TIMESTAMP '2001-02-03 04:05:01' END AS generated_at FROM people LEFT JOIN g USING (k)""")
def reverse_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse matches by résumé; stamp and time are the first row's; none for a résumé never matched, or withdrawn."""
    p = people(spark, sf_dir).select("resume_id", "k")
    one = lambda rank, add: F.struct(F.lit(rank).alias("rank"), ((F.col("k") + add) % 25).cast("int").alias("job_id"))
    m = p.where("k % 10 <> 7").select("resume_id", F.explode(F.array(one(2, 0), one(1, 3), one(3, 8))).alias("x")).select("resume_id", "x.*")
    m = m.withColumns({"score_final": F.col("rank") / 4, "pipeline_version": F.concat(F.lit("v"), F.col("rank").cast("string")), "generated_at": F.timestamp_seconds(F.unix_timestamp(F.lit("2001-02-03 04:05:00")) + F.col("rank"))})
    out = reads.reverse_read(p, m, blind_jobs(spark, sf_dir), p.where("k % 6 = 0"))
    text = lambda e: F.concat_ws(":", e["rank"].cast("string"), e["title"], e["department"], e["score_final"].cast("string"))
    return out.select("resume_id", F.array_join(F.transform("entries", text), ",").alias("entries"), "pipeline_version", "generated_at")


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, 'led ' || co1 || ' near ' || co2 || ', then in ' || CASE WHEN k % 4 = 2 THEN '; write' ELSE 'Paris, France; write' END || ' to or call , 2002-2007.' AS text FROM people""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a summary in which the name breaks over a line: nothing of the candidate's own identity."""
    broken = F.expr("replace(doc.summary, name, replace(name, ' ', '\\n  '))")
    return people(spark, sf_dir).select("resume_id", embedding_safe(broken, F.col("name"), F.col("email"), F.col("phone"), F.col("place")).alias("text"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, 'python,method' AS skills, 2 AS dropped FROM people""")
def scrubbed_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill names without the candidate: what is nothing else is dropped and counted."""
    p = people(spark, sf_dir)
    names = F.array(F.lit("python"), F.upper("name"), F.concat("name", F.lit(" method")), F.col("email"))
    out = scrubbed_names(names, *map(F.col, ("name", "email", "phone", "place")))
    return p.select("resume_id", F.array_join(out, ",").alias("skills"), (F.size(names) - F.size(out)).alias("dropped"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, CASE WHEN k % 4 = 3 THEN 7 WHEN k % 30 = 0 THEN 4 ELSE k % 30 END AS min_years, 'sql,go' AS required, 1 AS nice, 'bachelors' AS min_level, 'Physics' AS fields FROM people""")
def job_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking reads of a job document: the column's years, if neither null nor 0, before the document's."""
    doc = F.expr("""named_struct('title', name, 'required_skills', array(named_struct('name', 'sql', 'min_years', 2), named_struct('name', ' ', 'min_years', 1), named_struct('name', cast(null as string), 'min_years', 1), named_struct('name', 'go', 'min_years', 1)),
      'nice_to_have_skills', array(named_struct('name', 'rust', 'min_years', cast(null as int)), named_struct('name', '\\t', 'min_years', 1)), 'min_years_experience', case when k % 4 = 3 then 7 else 4 end,
      'education', named_struct('min_level', 'bachelors', 'fields', array(' ', 'Physics', cast(null as string))))""")
    column = F.when(F.col("k") % 4 != 3, (F.col("k") % 30).cast("int"))
    v = people(spark, sf_dir).select("resume_id", documents.job_view(doc, column).alias("v"))
    names = F.array_join(F.transform("v.required", lambda s: s["name"]), ",")
    return v.select("resume_id", F.col("v.min_years").alias("min_years"), names.alias("required"), F.size("v.nice").alias("nice"), F.col("v.min_level").alias("min_level"), F.array_join("v.fields", ",").alias("fields"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, 'chunks,cover_letter_chunks,education,experience,skills,total_years_experience' AS kept, 'id,page,section' AS of_chunks FROM people""")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an event carries of a parse: neither identity nor summary nor the chunks' texts."""
    p = people(spark, sf_dir).select("resume_id", F.to_json(graph.embedding_payload(F.col("doc"))).alias("j"))
    keys = lambda c: F.array_join(F.array_sort(F.json_object_keys(c)), ",")
    return p.select("resume_id", keys(F.col("j")).alias("kept"), keys(F.get_json_object("j", "$.chunks[0]")).alias("of_chunks"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, '[{{"name":"Go","years":' || k % 81 || '}},{{"name":"Sql"}}]' AS kept, CASE WHEN k % 2 = 0 THEN 'c_002' ELSE '' END AS shown, 'c_002,c_002' AS cited FROM people""")
def tolerant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a parse that validate, chunks that may be shown when nothing is known of the candidate, citations that exist."""
    raw = F.concat(F.lit('[{"name":"Go","years":'), (F.col("k") % 81).cast("string"), F.lit('},{"name":" ","years":1},{"years":2},7,{"name":"C","years":99},{"name":"B","years":"x"},{"name":"Sql"}]'))
    p = people(spark, sf_dir)
    parts = F.when(F.col("k") % 2 == 0, F.col("doc.chunks")).otherwise(F.transform("doc.chunks", lambda c: c.withField("section", F.lit("HEADER"))))
    shown = F.array_join(F.transform(documents.without_headers(parts), lambda c: c["id"]), ",")
    valid = F.transform("doc.chunks", lambda c: c["id"])
    return p.select("resume_id", F.to_json(documents.readable_skills(raw)).alias("kept"), shown.alias("shown"), F.array_join(documents.cited(F.col("doc.skills")[0]["evidence_chunk_ids"], valid), ",").alias("cited"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, CASE k % 3 WHEN 0 THEN name || ' wrote' WHEN 1 THEN 'pasted ' || k ELSE '' END AS letter, k % 3 <> 2 AS has_letter, CASE WHEN k % 4 = 0 THEN k % 9 END AS years, CASE WHEN k % 4 < 2 THEN 'x' || k END AS note FROM people""")
def cover_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a cover letter comes from, and documents decoded: what is no object has no fields."""
    p, third = people(spark, sf_dir), F.col("k") % 3
    key, pasted = F.when(third == 0, F.concat(F.lit("cl/"), F.col("k").cast("string"))), F.when(third != 2, F.concat(F.lit("pasted "), F.col("k").cast("string")))
    letter = reads.cover_letter(F.concat("name", F.lit(" wrote")), key, pasted)
    raw = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"years": '), (F.col("k") % 9).cast("string"), F.lit(', "note": "x'), F.col("k").cast("string"), F.lit('"}'))).when(F.col("k") % 4 == 1, F.concat(F.lit('{"note": "x'), F.col("k").cast("string"), F.lit('"}'))).when(F.col("k") % 4 == 2, "[1, 2]").otherwise("{broken")
    doc = reads.document(raw, "years int, note string")
    return p.select("resume_id", letter.alias("letter"), reads.has_cover_letter(key, pasted).alias("has_letter"), doc["years"].alias("years"), doc["note"].alias("note"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, name, CASE WHEN k % 9 <> 0 THEN email END AS email, sha256(CASE WHEN k % 9 <> 0 THEN email END) AS email_hash, true AS hidden, NULL::VARCHAR AS wrong_key FROM people""")
def encrypted_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities encrypted and read back; nulls stay null, a wrong key opens nothing."""
    key = F.lit("0123456789abcdef")
    p = people(spark, sf_dir).select("resume_id", "name", F.when(F.col("k") % 9 != 0, F.concat(F.lit(" "), F.upper("email"))).alias("email"), F.col("name").alias("plain"))
    shut = governance.encrypted(p, ["name", "email"], key)
    wrong = governance.decrypted(shut.select("resume_id", F.col("name").alias("wrong_key")), ["wrong_key"], F.lit("fedcba9876543210"))
    out = governance.decrypted(shut.withColumn("hidden", F.col("name") != F.col("plain").cast("binary")), ["name", "email"], key)
    return out.join(wrong, "resume_id").select("resume_id", "name", F.lower(F.trim("email")).alias("email"), "email_hash", "hidden", "wrong_key")


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, job_id, {IS_BLIND} AS blind_review, 'm1' AS model_gen, 'abc' AS git_sha, 0.3::DOUBLE AS evidence_weight FROM people""")
def run_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed jobs, whose flag is never null, and the stamp of the run on every entry."""
    jobs = reads.typed_jobs(blind_jobs(spark, sf_dir))
    rows = people(spark, sf_dir).select("resume_id", "job_id").join(jobs.select("job_id", "blind_review"), "job_id")
    out = reads.stamped(rows, "m1", "e1", "abc", F.expr("TIMESTAMP '2001-01-01 00:00:00'"), {"evidence": 0.3, "structured": 0.6})
    return out.select("resume_id", "job_id", "blind_review", "pipeline_meta.model_gen", "pipeline_meta.git_sha", F.col("pipeline_meta.weights")["evidence"].alias("evidence_weight"))
