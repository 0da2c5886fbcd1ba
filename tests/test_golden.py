"""The ranking of parsed documents from end to end: pairs of résumés that differ in one thing, a bait, and published gaps."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.operators import ranker, ranking, skills
from veritrail.schemas import JOB_DOCUMENT, RESUME_DOCUMENT
from veritrail.sources import memo

TODAY = 2024
JOB = {
    "title": "Backend Data Engineer", "required_skills": [("Python", 4), ("PostgreSQL", 3), ("Airflow", 2), ("Docker", 2), ("REST API", 3)], "nice_to_have_skills": [("Kafka", None)], "min_years_experience": 5,
    "education": ("bachelors", ["Computer Science", "Software Engineering"]), "responsibilities": ["Build pipelines", "Run them"],
}
ASKED = {n.lower(): y for n, y in JOB["required_skills"]}


def resume(years=6, held=ASKED, last=TODAY, degree="BSc Computer Science", title="Backend Engineer", quotes=True, letter=False, summary="Builds backend data systems"):
    said = [f"In my last role I ran {name} in production for years, alone and in teams." for name in ("Python", "PostgreSQL", "Airflow", "Docker", "REST API")]
    texts = said if quotes else ["Results-driven professional with a passion for excellence and growth."]
    return {
        "candidate": ("Casey Rivera", "casey@r.example", None, "Toronto"), "summary": summary, "total_years_experience": years, "skills": [(n, y + 1, last, None, None) for n, y in held.items()],
        "experience": [("Acme", title, "2018", None, True, [])], "education": [(degree, "Tech", degree.split(" ", 1)[-1], 2010)], "chunks": [(f"c_{i:03d}", "experience", 1, t) for i, t in enumerate(texts, 1)],
        "cover_letter_chunks": [("cl_001", "other", 1, "I have wanted to build with you since I first used your product.")] if letter else [],
    }


RESUMES = {
    "strong": resume(), "letter": resume(letter=True), "overqualified": resume(years=14), "associate": resume(degree="Associate Computer Science"), "stale": resume(last=TODAY - 9),
    "no_docker": resume(held={k: v for k, v in ASKED.items() if k != "docker"}), "bait": resume(years=8, quotes=False, title="Backend Data Engineer"),
    "marketing": resume(held={"excel": 3}, degree="BA Communications", title="Marketing Coordinator", quotes=False, summary="Runs campaigns"),
}
PAIRS = [("education", "strong", "associate"), ("overqual", "strong", "overqualified"), ("motivation", "letter", "strong"), ("missing_must", "strong", "no_docker"), ("recency", "strong", "stale")]


def frame(spark, kind, docs):
    names = [f.name for f in kind.fields]
    return spark.createDataFrame([(i, tuple(d.get(n) for n in names)) for i, d in docs.items()], T.StructType().add("id", T.StringType()).add("doc", kind))


@pytest.fixture(scope="module")
def entries(spark):
    table = skills.vocabulary([{"canonical": c, "aliases": a} for c, a in (("python", []), ("postgresql", ["postgres"]), ("airflow", []), ("docker", []), ("rest api", ["rest apis"]), ("kafka", []), ("excel", []))])
    jobs = frame(spark, JOB_DOCUMENT, {"j": JOB}).select(F.col("id").alias("job_id"), "doc", F.lit(None).cast("int").alias("min_years"))
    people = frame(spark, RESUME_DOCUMENT, RESUMES).select(F.col("id").alias("resume_id"), F.lit("j").alias("job_id"), "doc")
    families = spark.createDataFrame([("python", "languages"), ("excel", "office")], "skill string, family string")

    def run():
        from veritrail.sources.tables import kept

        out = ranker.rank_documents(jobs, people, skills.dimension(spark, table), list(table), families, lambda t: memo.bag_of_words(t, 64), TODAY, keep=kept)
        return kept(out.select("job_id", "resume_id", "rank", F.col("final").alias("score"), "structured", "evidence", "motivation", "education", "seniority", "requirements"), "golden")

    return run(), run()


def test_pairs_that_differ_in_one_thing(spark, entries):
    pairs = spark.createDataFrame(PAIRS, "dimension string, higher string, lower string")
    got = {r.dimension: r for r in ranking.ordering_pairs(entries[0], pairs, "resume_id").collect()}
    assert all(r.holds for r in got.values()) and len(got) == 5
    # published gaps: +0.0411, +0.0120, +0.0900, +0.1460 and +0.1440; those whose texts are alike do not depend on an embedder
    assert got["overqual"].gap == pytest.approx(0.6 * 0.25 * 0.08, abs=1e-9)
    assert got["motivation"].gap == pytest.approx(0.1 * 0.9, abs=1e-9)
    assert got["recency"].gap == pytest.approx(0.6 * 0.4 * 0.6, abs=1e-9)
    assert got["education"].gap == pytest.approx(0.6 * 0.1 * 2 / 3, abs=0.02) and got["missing_must"].gap == pytest.approx(0.6 * 0.4 * 0.6, abs=0.02)


def test_bait_evidence_and_ties(spark, entries):
    rows = {r.resume_id: r for r in entries[0].collect()}
    assert rows["bait"].evidence == 0 and all(rows["bait"].rank > rows[s].rank for s in ("strong", "letter", "overqualified", "associate")) and rows["marketing"].rank == 8
    assert rows["letter"].rank == 1 and rows["strong"].evidence == pytest.approx(5 / 6) and rows["strong"].motivation == 0
    by = {q.requirement: q for q in rows["strong"].requirements}
    assert by["Docker"].status == "met" and by["Docker"].evidence_chunk_ids == ["c_004"] and by["Kafka"].status == "missing"
    assert rows["associate"].education == pytest.approx(1 / 3) and rows["marketing"].seniority == 0 and rows["bait"].seniority == 1
    tags = entries[0].withColumn("good", ~F.col("resume_id").isin("bait", "marketing"))
    assert ranking.precision_at(tags, "job_id", 5, F.col("good")).first().precision == 1.0


def test_two_runs_are_one(entries):
    d = ranking.drift(entries[0], entries[1], "resume_id").first()
    assert (d.rank_drift, d.score_drift, d.missing) == (0, 0.0, 0)
    assert json.dumps(sorted(RESUMES)) == json.dumps(sorted(r.resume_id for r in entries[0].collect()))
