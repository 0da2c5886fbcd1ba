"""Structured scores, evidence and the full ranking, on the star schema.

Nations play jobs, their customers the job's candidates, brands skills: a customer has the brands bought in lines of 45 or
more; years are the distinct years shipped, the last use is the last of them.  A nation requires the brands of parts of
size 7 whose key falls to it.  A brand's family is its most frequent part type; PROMO earns no credit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import matching, ranker, ranking, recall
from ..operators.recall import normalised
from ..sources import memo
from ..sources.tables import kept
from .registry import query, table

#: The year that counts as now, the candidates recalled for a job, and those whose evidence is sought.
TODAY, COARSE_K, EVIDENCE_K = 2001, 50, 15
#: The jobs recalled for a résumé (50 but for the tables' few jobs), and those whose evidence is sought.
REVERSE_K, REVERSE_EVIDENCE_K = 20, 10


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("resume_id"))


def has_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("y"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rows.groupBy(F.col("o_custkey").alias("resume_id"), F.col("p_brand").alias("skill")).agg(F.countDistinct("y").cast("int").alias("years"), F.max("y").alias("last_used_year"))


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size = 7").select((F.col("p_partkey") % 25).cast("int").alias("job_id"), F.col("p_brand").alias("skill")).distinct()
    return parts.select("job_id", "skill", (1 + F.col("job_id") % 3).cast("int").alias("min_years"), (F.col("job_id") % 4 != 3).alias("is_must_have"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("skill"), F.element_at(F.split("p_type", " "), 1).alias("family")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("skill").orderBy(F.desc("n"), "family")
    return counts.withColumn("place", F.row_number().over(best)).where("place = 1").select("skill", "family")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """years: orders of a customer, the stand-in for years of experience; bar: 5 + nation % 20, and none for every fifth."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("resume_id")).agg(F.count("*").cast("int").alias("years"))
    out = candidates(spark, sf_dir).join(orders, "resume_id", "left")
    return out.withColumn("bar", F.when(F.col("job_id") % 5 != 0, 5 + F.col("job_id") % 20))


BASE_SQL = """
cand AS (SELECT c_nationkey AS job_id, c_custkey AS resume_id FROM customer),
hs AS (SELECT o_custkey AS resume_id, p_brand AS skill, count(DISTINCT year(l_shipdate)) AS years, max(year(l_shipdate)) AS last_used_year
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 GROUP BY 1, 2),
req AS (SELECT DISTINCT p_partkey % 25 AS job_id, p_brand AS skill, 1 + (p_partkey % 25) % 3 AS min_years, (p_partkey % 25) % 4 <> 3 AS is_must_have FROM part WHERE p_size = 7),
fam AS (SELECT skill, family FROM (SELECT p_brand AS skill, split_part(p_type, ' ', 1) AS family, count(*) AS n FROM part GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY skill ORDER BY n DESC, family) = 1),
tot AS (SELECT c.job_id, c.resume_id, o.years, CASE WHEN c.job_id % 5 <> 0 THEN 5 + c.job_id % 20 END AS bar
    FROM cand c LEFT JOIN (SELECT o_custkey AS resume_id, count(*) AS years FROM orders GROUP BY 1) o USING (resume_id)),
rows_ AS (SELECT c.job_id, c.resume_id, r.skill, r.min_years, r.is_must_have, h.years, h.last_used_year,
    CASE WHEN h.skill IS NOT NULL THEN 1.0 WHEN EXISTS (SELECT 1 FROM hs x JOIN fam fx ON fx.skill = x.skill JOIN fam fr ON fr.family = fx.family
        WHERE x.resume_id = c.resume_id AND fr.skill = r.skill AND fr.family <> 'PROMO') THEN 0.5 ELSE 0.0 END AS weight
    FROM cand c JOIN req r USING (job_id) LEFT JOIN hs h ON h.resume_id = c.resume_id AND h.skill = r.skill)"""
SKILL_SQL = f"""{BASE_SQL},
sc AS (SELECT *, CASE WHEN weight = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
      (CASE WHEN years IS NULL THEN 1.0 ELSE least(1.0, greatest(0, years) / greatest(1, coalesce(min_years, 1))) END)
    * (CASE WHEN {TODAY} - coalesce(nullif(last_used_year, 0), {TODAY}) <= 2 THEN 1.0 WHEN {TODAY} - coalesce(nullif(last_used_year, 0), {TODAY}) <= 5 THEN 0.7 ELSE 0.4 END) * weight)) END AS score FROM rows_),
g AS (SELECT job_id, resume_id, avg(score) AS mean, count(*) FILTER (is_must_have) AS must, count(*) FILTER (is_must_have AND weight = 0) AS missing FROM sc GROUP BY 1, 2),
sk AS (SELECT g.*, coalesce(t.years > 0 AND t.bar > 0 AND t.years >= t.bar * 1.5, false) AS senior FROM g JOIN tot t USING (job_id, resume_id)),
skill AS (SELECT job_id, resume_id, must, missing, mean * CASE WHEN must > 0 AND missing > 0 THEN
    CASE WHEN senior AND 1 - missing / must >= 0.5 THEN 0.75 ELSE 0.5 END ELSE 1.0 END AS skill_score FROM sk)"""


def requirement_rows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return matching.requirement_rows(candidates(spark, sf_dir) if of is None else of, requires(spark, sf_dir), has_skill(spark, sf_dir), families(spark, sf_dir), ("PROMO",))


def seniors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).select("job_id", "resume_id", scoring.is_senior(F.col("years"), F.col("bar")).alias("senior"))


def skill_scores(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return matching.skill_scores(requirement_rows(spark, sf_dir, of), seniors(spark, sf_dir), TODAY)


@query(f"WITH {BASE_SQL} SELECT job_id, resume_id, skill, min_years, is_must_have, years, last_used_year, CAST(weight AS DOUBLE) AS ontology_weight FROM rows_")
def requirement_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirement_rows(spark, sf_dir)


@query(f"WITH {SKILL_SQL} SELECT job_id, resume_id, round(skill_score, 6) AS skill_score, must, missing FROM skill")
def skill_ontology_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill_scores(spark, sf_dir).select("job_id", "resume_id", F.round("skill_score", 6).alias("skill_score"), "must", "missing")


EXPERIENCE = "CASE WHEN coalesce(bar, 0) = 0 THEN 1.0 WHEN coalesce(years, 0) / bar <= 1 THEN coalesce(years, 0) / bar WHEN years / bar <= 2 THEN 1.0 ELSE greatest(0.8, 1 - (years / bar - 2) * 0.1) END"


@query(f"WITH {BASE_SQL} SELECT job_id, resume_id, years, bar, round({EXPERIENCE}, 6) AS experience FROM tot")
def experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = totals(spark, sf_dir)
    return t.select("job_id", "resume_id", "years", "bar", F.round(scoring.experience(F.col("years"), F.col("bar")), 6).alias("experience"))


@query(
    """WITH d AS (SELECT p_partkey, ['PhD in ', 'Master of ', 'BSc ', 'Associate of ', 'High School ', 'Diploma ', ''][1 + p_partkey % 7] || p_name AS degree,
    ['bachelors', 'masters', 'phd', '', 'associate'][1 + p_size % 5] AS min_level, p_size % 3 = 0 AS fields_asked, p_size % 2 = 0 AS field_matches FROM part),
l AS (SELECT *, CASE WHEN contains(lower(degree), 'phd') OR contains(lower(degree), 'doctor') THEN 5
    WHEN contains(lower(degree), 'master') OR contains(lower(degree), 'msc') OR contains(lower(degree), 'mba') OR contains(lower(degree), 'ma ') THEN 4
    WHEN contains(lower(degree), 'bachelor') OR contains(lower(degree), 'bsc') OR contains(lower(degree), 'ba ') OR contains(lower(degree), 'bs ') OR contains(lower(degree), 'bfa') THEN 3
    WHEN contains(lower(degree), 'associate') THEN 2 WHEN contains(lower(degree), 'high school') THEN 1 END AS best,
    CASE min_level WHEN 'bachelors' THEN 3 WHEN 'masters' THEN 4 WHEN 'phd' THEN 5 WHEN 'associate' THEN 2 ELSE 0 END AS need FROM d)
SELECT p_partkey, best AS best_rank, round(CASE WHEN min_level = '' THEN 1.0 WHEN best IS NULL THEN 0.0 WHEN best < need THEN 0.5 * best / need
    WHEN NOT fields_asked OR field_matches THEN 1.0 ELSE 0.5 END, 6) AS education FROM l"""
)
def education(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.strings import degree_level, level_rank

    p = table(spark, sf_dir, "part")
    titles = F.array(*map(F.lit, ("PhD in ", "Master of ", "BSc ", "Associate of ", "High School ", "Diploma ", "")))
    levels = F.array(*map(F.lit, ("bachelors", "masters", "phd", "", "associate")))
    d = p.select("p_partkey", "p_size", F.concat(F.get(titles, (F.col("p_partkey") % 7).cast("int")), "p_name").alias("degree"), F.get(levels, (F.col("p_size") % 5).cast("int")).alias("min_level"))
    best = level_rank(degree_level(F.col("degree")))
    score = scoring.education(best, F.col("min_level"), F.col("p_size") % 3 == 0, F.col("p_size") % 2 == 0)
    return d.select("p_partkey", best.alias("best_rank"), F.round(score, 6).alias("education"))


#: Titles of candidates by customer, of jobs by nation; degrees and fields; what jobs ask for.
TITLES = ("Senior Engineer", "Data Engineer", "Engineer", " ", "Sales Manager", "Senior Data Engineer", "Manager", "Marketing Coordinator")
JOB_TITLES = ("Senior Data Engineer", "Sales Manager", "Engineer")
DEGREES = ("PhD in ", "Master of ", "BSc ", "Associate of ", "High School ", "Certificate of ")
FIELDS = ("Computer Science", "Comp Science", "Computing Science", "Software  Engineering", "Marketing", "Computer Science and Maths")
ASKED_LEVELS, ASKED_FIELDS = ("bachelors", "masters", "", "phd", "associate"), ("computer science", "Engineering")
#: Pairs of a candidate's and an asked field that are alike by the measure: words held in common, or 24 of 28 letters.
ALIKE = (("computer science", "computer science"), ("comp science", "computer science"), ("computer science and maths", "computer science"), ("software engineering", "engineering"))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations: title, years asked for, level and fields of education (none for every third)."""
    k = F.col("n_nationkey")
    fields = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ASKED_FIELDS)))
    return table(spark, sf_dir, "nation").select(k.alias("job_id"), _pick(JOB_TITLES, k % 3).alias("title"), F.when(k % 5 != 0, 5 + k % 20).alias("min_years"), _pick(ASKED_LEVELS, k % 5).alias("min_level"), fields.alias("fields"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: years (their orders), the most recent title, and two degrees."""
    k = F.col("resume_id")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("resume_id")).agg(F.count("*").cast("int").alias("total_years"))
    study = lambda a, b: F.struct(F.concat(_pick(DEGREES, a % 6), F.lit("Arts")).alias("degree"), F.when(b % 7 != 6, _pick(FIELDS, b % 6)).alias("field"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id")).join(orders, "resume_id", "left")
    return c.select("resume_id", "total_years", _pick(TITLES, k % 8).alias("title"), F.array(study(k, k), study(k + 4, k * 5 + 1)).alias("studies"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the customer, or of the job, whose key is a vector's id; customers without one are never recalled."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def claims(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, chunks).  A candidate has a chunk for every skill.  A requirement that is held quotes it: as it stands, in other
    letters and blanks, with a letter missing, or, for a third, as the chunk never said."""
    held = has_skill(spark, sf_dir)
    said = F.concat(F.lit("Worked "), F.col("years").cast("string"), F.lit(" years with "), F.col("skill"), F.lit(", most lately in "), F.col("last_used_year").cast("string"), F.lit("."))
    chunks = held.select("resume_id", F.concat(F.lit("c_"), "skill").alias("id"), said.alias("text"))
    rows = matching.requirement_rows(pairs, requires(spark, sf_dir), held, families(spark, sf_dir), ("PROMO",)).join(chunks.select("resume_id", F.expr("substring(id, 3)").alias("skill"), "text"), ["resume_id", "skill"], "left")
    how = F.pmod(F.col("resume_id") + F.col("job_id"), F.lit(6))
    quote = F.when(how == 0, F.upper(F.regexp_replace("text", " ", "  "))).when(how == 1, F.regexp_replace("text", "Worked ", "Wored ")).when(how.isin(2, 3), F.concat(F.lit("Leads the "), "skill", F.lit(" guild of our whole firm"))).otherwise(F.col("text"))
    found = F.col("ontology_weight") == 1
    status = F.when(found, "met").when(F.col("ontology_weight") > 0, "partial").otherwise("missing")
    ids = F.when(found, F.array(F.concat(F.lit("c_"), "skill"), F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    told = rows.select("job_id", "resume_id", F.col("skill").alias("at"), F.col("skill").alias("requirement"), status.alias("status"), F.when(found, quote).otherwise("").alias("evidence"), ids.alias("evidence_chunk_ids"), F.when(found, 0.9).otherwise(0.4).alias("confidence"))
    return told, chunks


def themes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(themes, chunks) of cover letters: a conversation's turns, quoted in their first 60 characters; every third backwards."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("resume_id"), F.col("turn").alias("at"), F.concat(F.lit("cl_"), F.col("turn").cast("string")).alias("id"), "text")
    begin = F.substring("text", 1, 60)
    quote = F.when(F.col("at") % 3 == 2, F.reverse(begin)).otherwise(begin)
    told = c.select("resume_id", "at", F.lit("motivation").alias("theme"), quote.alias("evidence"), F.array("id").alias("evidence_chunk_ids"), (F.lit(0.6) + F.col("at") % 4 * 0.1).alias("confidence"))
    return told, c.select("resume_id", "id", "text")


def _scored(spark: SparkSession, sf_dir: str, recalled: DataFrame, key: str) -> DataFrame:
    pool = kept(normalised(recalled, key).select("job_id", "resume_id", "vec_norm", "discriminating"), "pool")
    return kept(ranker.structured_scores(pool, jobs(spark, sf_dir), resumes(spark, sf_dir), requires(spark, sf_dir), has_skill(spark, sf_dir), families(spark, sf_dir), memo.bag_of_words, TODAY, ("PROMO",)), "scored")


def _evidence(spark: SparkSession, sf_dir: str):
    letters, letter_chunks = themes(spark, sf_dir)

    def evidence(pairs: DataFrame) -> DataFrame:
        told, chunks = claims(spark, sf_dir, pairs)
        return ranker.evidence_scores(told, letters, chunks.unionByName(letter_chunks))

    return evidence


def final_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in one plan: recall of each job's 50 most similar candidates, structured scores, verified evidence of the
    first 15, combination with motivation, total order.  All windows after the recall see 50 rows of a job at most."""
    v = vectors(spark, sf_dir)
    job_vectors = table(spark, sf_dir, "nation").join(v, F.col("n_nationkey") == F.col("id")).select(F.col("n_nationkey").alias("job_id"), F.col("vector").alias("job_vector"))
    pool = candidates(spark, sf_dir).join(v, F.col("resume_id") == F.col("id")).select("job_id", "resume_id", "vector")
    scored = _scored(spark, sf_dir, recall.within_pools(job_vectors, pool, COARSE_K), "job_id")
    return ranker.ranked(scored, "job_id", EVIDENCE_K, _evidence(spark, sf_dir))


def _values(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(chr(39) + v + chr(39) for v in values)}][1 + {at}]"


def _rank_of(degree: str) -> str:
    return f"""CASE WHEN {degree} ILIKE '%phd%' THEN 5 WHEN {degree} ILIKE '%master%' THEN 4 WHEN {degree} ILIKE '%bsc%' THEN 3 WHEN {degree} ILIKE '%associate%' THEN 2 WHEN {degree} ILIKE '%high school%' THEN 1 END"""


PAIR_SQL = f"""vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
job AS (SELECT n_nationkey AS job_id, {_values(JOB_TITLES, 'n_nationkey % 3')} AS title, CASE WHEN n_nationkey % 5 <> 0 THEN 5 + n_nationkey % 20 END AS bar, {_values(ASKED_LEVELS, 'n_nationkey % 5')} AS min_level,
  n_nationkey % 3 <> 0 AS asks, v FROM nation LEFT JOIN vec ON vec_id = n_nationkey),
study AS (SELECT c_custkey AS resume_id, unnest([{{'d': {_values(DEGREES, 'c_custkey % 6')} || 'Arts', 'f': CASE WHEN c_custkey % 7 <> 6 THEN {_values(FIELDS, 'c_custkey % 6')} END}},
  {{'d': {_values(DEGREES, '(c_custkey + 4) % 6')} || 'Arts', 'f': CASE WHEN (c_custkey * 5 + 1) % 7 <> 6 THEN {_values(FIELDS, '(c_custkey * 5 + 1) % 6')} END}}], recursive := true) FROM customer),
degree AS (SELECT resume_id, {_rank_of('d')} AS r, lower(replace(f, '  ', ' ')) AS f FROM study),
alike(own, asked) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALIKE)}),
person AS (SELECT c_custkey AS resume_id, o.years, trim({_values(TITLES, 'c_custkey % 8')}) AS title, v FROM customer LEFT JOIN vec ON vec_id = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS years FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
edu AS (SELECT p.job_id, p.resume_id, any_value(j.min_level) AS min_level, any_value(j.asks) AS asks, max(r) AS best, any_value(CASE j.min_level WHEN 'bachelors' THEN 3 WHEN 'masters' THEN 4 WHEN 'phd' THEN 5 WHEN 'associate' THEN 2 ELSE 0 END) AS need,
  coalesce(bool_or(a.own IS NOT NULL AND r >= CASE j.min_level WHEN 'bachelors' THEN 3 WHEN 'masters' THEN 4 WHEN 'phd' THEN 5 WHEN 'associate' THEN 2 ELSE 0 END), false) AS fits
  FROM pool p JOIN job j USING (job_id) JOIN degree d USING (resume_id) LEFT JOIN alike a ON a.own = d.f GROUP BY 1, 2),
edus AS (SELECT job_id, resume_id, CASE WHEN min_level = '' THEN 1.0 WHEN best IS NULL THEN 0.0 WHEN best < need THEN 0.5 * best / need WHEN NOT asks OR fits THEN 1.0 ELSE 0.5 END AS education FROM edu),
words AS (SELECT DISTINCT t AS title, list_distinct(string_split(lower(t), ' ')) AS w FROM (SELECT title AS t FROM job UNION SELECT title FROM person WHERE title <> '')),
likes AS (SELECT a.title AS job_title, b.title, len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)) AS cos FROM words a, words b),
st AS (SELECT p.job_id, p.resume_id, p.vec, coalesce(s.skill_score, 0.0) AS skill_score, {EXPERIENCE.replace('years', 'q.years').replace('bar', 'j.bar')} AS experience, e.education,
  CASE WHEN l.cos IS NOT NULL THEN least(1.0, greatest(0.0, (l.cos - 0.5) / 0.5)) END AS seniority
  FROM pool p JOIN job j USING (job_id) JOIN person q USING (resume_id) JOIN edus e USING (job_id, resume_id) LEFT JOIN skill s USING (job_id, resume_id) LEFT JOIN likes l ON l.job_title = j.title AND l.title = q.title),
st2 AS (SELECT *, 0.4 * skill_score + 0.25 * experience + 0.1 * education + 0.15 * coalesce(seniority, 0.0) + 0.1 * vec AS structured FROM st),
ev AS (SELECT job_id, resume_id, (count(*) FILTER (weight = 1 AND (resume_id + job_id) % 6 NOT IN (2, 3)) + 0.5 * count(*) FILTER (weight > 0 AND weight < 1)) / count(*) AS completeness FROM rows_ GROUP BY 1, 2),
said AS (SELECT conv_id AS resume_id, turn, trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) AS q FROM conversations),
mot AS (SELECT resume_id, sum(CASE WHEN turn % 3 <> 2 AND length(q) >= 16 AND 0.6 + turn % 4 * 0.1 >= 0.7 THEN 0.6 + turn % 4 * 0.1 ELSE 0.0 END) / count(*) AS motivation FROM said GROUP BY 1)"""
#: All pairs of jobs and résumés that a recall leaves, in place of each customer's own nation.
POOL = "cand AS (SELECT job_id, resume_id FROM pool)"
SCORES = SKILL_SQL.split("cand AS (SELECT c_nationkey AS job_id, c_custkey AS resume_id FROM customer),")
YEARS = SCORES[1]


def _final_sql(recalled: str, key: str, other: str, evidence_k: int) -> str:
    return f"""{recalled},
pool AS (SELECT job_id, resume_id, CASE WHEN max(s) OVER w - min(s) OVER w < 1e-9 THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS vec FROM rec WINDOW w AS (PARTITION BY {key})),
{POOL},{YEARS},
{PAIR_SQL},
st3 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(structured, 9) DESC, round(vec, 9) DESC, {other}) <= {evidence_k} AS evidence_evaluated FROM st2),
fin AS (SELECT st3.*, CASE WHEN evidence_evaluated THEN coalesce(completeness, 0.0) ELSE 0.0 END AS evidence, CASE WHEN evidence_evaluated AND completeness IS NOT NULL THEN coalesce(motivation, 0.0) ELSE 0.0 END AS motivation
  FROM st3 LEFT JOIN ev USING (job_id, resume_id) LEFT JOIN mot USING (resume_id))"""


SIMILAR = "(1 + list_cosine_similarity(a.v, b.v)) / 2"
FINAL_SQL = _final_sql(
    f"""v0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
rec AS (SELECT c_nationkey AS job_id, c_custkey AS resume_id, {SIMILAR} AS s FROM customer JOIN v0 a ON a.vec_id = c_custkey JOIN v0 b ON b.vec_id = c_nationkey
  QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY s DESC, c_custkey) <= {COARSE_K})""",
    "job_id", "resume_id", EVIDENCE_K,
) + """,
fin2 AS (SELECT *, 0.6 * structured + 0.3 * evidence + 0.1 * motivation AS final FROM fin),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(final, 9) DESC, round(structured, 9) DESC, round(vec, 9) DESC, resume_id) AS rank FROM fin2)"""  # fmt: skip


@query(f"""WITH {FINAL_SQL} SELECT job_id, resume_id, rank, round(final, 6) AS score_final, round(structured, 6) AS score_structured, round(evidence, 6) AS score_evidence, round(motivation, 6) AS motivation,
  round(education, 6) AS education, round(seniority, 6) AS seniority, evidence_evaluated FROM ranked""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = final_ranking(spark, sf_dir)
    scores = {"score_final": "final", "score_structured": "structured", "score_evidence": "evidence", "motivation": "motivation", "education": "education", "seniority": "seniority"}
    return out.select("job_id", "resume_id", "rank", *[F.round(c, 6).alias(n) for n, c in scores.items()], "evidence_evaluated")


@query(f"WITH {FINAL_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM ranked) SELECT job_id, resume_id, rank FROM c WHERE rank <= greatest(1, ceil(n * 10 / 100.0))")
def shortlist_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_percent(final_ranking(spark, sf_dir), "job_id", F.lit(10)).select("job_id", "resume_id", "rank")


@query(f"""WITH {FINAL_SQL} SELECT resume_id, job_id, round(0.6 * structured + 0.3 * evidence, 6) AS score_final,
    row_number() OVER (PARTITION BY resume_id ORDER BY round(0.6 * structured + 0.3 * evidence, 9) DESC, job_id) AS rank FROM fin2""")
def reverse_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlists seen by résumé: structured score and evidence only.  reverse_match ranks jobs for every résumé."""
    out = final_ranking(spark, sf_dir).withColumn("reverse", scoring.final(F.col("structured"), F.col("evidence")))
    out = ranking.ranked(out.drop("rank"), "resume_id", [F.desc(F.round("reverse", 9)), F.col("job_id")])
    return out.select("resume_id", "job_id", F.round("reverse", 6).alias("score_final"), "rank")


def reverse_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by résumé, for every résumé with a vector: its 20 most similar jobs of all, those that are open (after the cut),
    structured scores, verified evidence of the first 10, no motivation."""
    v = vectors(spark, sf_dir)
    job_vectors = table(spark, sf_dir, "nation").join(v, F.col("n_nationkey") == F.col("id")).select("id", "vector")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(v, "id")
    near = recall.nearest(people, job_vectors, REVERSE_K)
    rows = near.where(F.col("item_id") % 5 != 4).select(F.col("item_id").cast("int").alias("job_id"), F.col("query_id").alias("resume_id"), "vec_score")
    return ranker.ranked(_scored(spark, sf_dir, rows, "resume_id"), "resume_id", REVERSE_EVIDENCE_K, _evidence(spark, sf_dir), reverse=True)


REVERSE_SQL = _final_sql(
    f"""v0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT n_nationkey AS job_id, c_custkey AS resume_id, {SIMILAR} AS s FROM customer JOIN v0 a ON a.vec_id = c_custkey, nation JOIN v0 b ON b.vec_id = n_nationkey
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, n_nationkey) <= {REVERSE_K}),
rec AS (SELECT * FROM near WHERE job_id % 5 <> 4)""",
    "resume_id", "job_id", REVERSE_EVIDENCE_K,
)


@query(f"""WITH {REVERSE_SQL} SELECT resume_id, job_id, round(0.6 * structured + 0.3 * evidence, 6) AS score_final, evidence_evaluated,
    row_number() OVER (PARTITION BY resume_id ORDER BY round(0.6 * structured + 0.3 * evidence, 9) DESC, round(structured, 9) DESC, round(vec, 9) DESC, job_id) AS rank FROM fin""")
def reverse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by résumé: see reverse_final()."""
    return reverse_final(spark, sf_dir).select("resume_id", "job_id", F.round("final", 6).alias("score_final"), "evidence_evaluated", "rank")


@query(f"""WITH {SKILL_SQL}, u AS (SELECT s.*, sk.senior AND 1 - sk.missing / sk.must >= 0.5 AS relieved FROM sc s JOIN sk USING (job_id, resume_id))
SELECT job_id, resume_id, count(*) FILTER (NOT (weight = 0 AND NOT (is_must_have AND coalesce(relieved, false)))) AS matched_count,
  count(*) FILTER (weight = 0 AND NOT (is_must_have AND coalesce(relieved, false))) AS missing_count,
  coalesce(string_agg(skill, '; ' ORDER BY skill) FILTER (weight = 0 AND NOT (is_must_have AND coalesce(relieved, false))), '') AS missing_skills FROM u GROUP BY 1, 2""")
def skill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.export import gap_summary

    s = gap_summary(F.col("contributions"))
    return skill_scores(spark, sf_dir).select("job_id", "resume_id", *[s[k].cast("long").alias(k) for k in ("matched_count", "missing_count")], s["missing_skills"].alias("missing_skills"))


@query(
    """WITH s AS (SELECT o_custkey AS resume_id, p_brand AS skill, count(DISTINCT year(l_shipdate)) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT resume_id, skill, CASE WHEN count(*) OVER (PARTITION BY resume_id, years) < 6 THEN years END AS years FROM s"""
)
def smeared_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("y"))
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    skills = rows.groupBy(F.col("o_custkey").alias("resume_id"), F.col("p_brand").alias("skill")).agg(F.countDistinct("y").alias("years"))
    return matching.unsmeared(skills).select("resume_id", "skill", "years")


@query(f"""WITH {FINAL_SQL} SELECT job_id, resume_id, part, CAST(weight AS DOUBLE) AS weight, round(score, 6) AS score, round(weight * score, 6) AS contribution FROM ranked,
  LATERAL (VALUES ('skill', 0.4, skill_score), ('experience', 0.25, experience), ('education', 0.1, education), ('seniority', 0.15, seniority), ('vector', 0.1, vec)) AS v(part, weight, score)""")
def explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions by part; what was not measured, the likeness of a title that is not there, stays null."""
    entry = F.struct(F.col("skill_score").alias("skill"), "experience", "education", "seniority", F.col("vec_norm").alias("vector"))
    out = final_ranking(spark, sf_dir).withColumn("entry", entry)
    out = out.select("job_id", "resume_id", F.explode(matching.explanation(F.col("entry"))).alias("x")).select("job_id", "resume_id", "x.*")
    return out.withColumn("score", F.round("score", 6)).withColumn("contribution", F.round("contribution", 6))


@query(f"""WITH {BASE_SQL} SELECT job_id, count(*) AS requirement_count, count(*) FILTER (is_must_have) AS must_have_count FROM req GROUP BY 1""")
def requirement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requires(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("requirement_count"), F.count(F.when(F.col("is_must_have"), 1)).alias("must_have_count"))
