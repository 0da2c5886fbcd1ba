import pytest
from pyspark.sql import functions as F

from veritrail.operators import chunking, export, governance, graph, matching, ranking, recall, redaction, relational, skills
from veritrail.schemas import EVIDENCE, RESUME_DOCUMENT, TABLES, checks, duplicates, violations


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_recall_stays_in_its_pool_and_scales(spark):
    jobs = spark.createDataFrame([("j", [1.0, 0.0]), ("k", [0.0, 1.0]), ("n", None)], "job_id string, job_vector array<double>")
    pool = spark.createDataFrame([("j", "a", [1.0, 0.0]), ("j", "b", [0.0, 1.0]), ("j", "c", [1.0, 1.0]), ("j", "d", None), ("k", "e", [1.0, 0.0]), ("n", "f", [1.0, 0.0])], "job_id string, resume_id string, vector array<double>")
    out = recall.normalised(recall.within_pools(jobs, pool, 50))
    got = {r.resume_id: r for r in out.collect()}
    assert set(got) == {"a", "b", "c", "e"}
    assert got["a"].vec_norm == 1.0 and got["b"].vec_norm == 0.0 and 0 < got["c"].vec_norm < 1
    assert got["e"].vec_norm == 1.0 and not got["e"].discriminating and got["a"].discriminating
    assert {r.resume_id for r in recall.within_pools(jobs, pool, 1).collect()} == {"a", "e"}


def test_nearest_equals_brute_force_in_small_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, None), (61, [1.0])], "id long, vector array<double>")
    got = {(r.query_id, r.place): (r.item_id, round(r.vec_score, 9)) for r in recall.nearest(df, df, 4, block=16).collect()}
    n = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    s = (1 + n @ n.T) / 2
    for q in (0, 3, 7, 20, 59):
        best = sorted(range(60), key=lambda i: (-round(s[q, i], 12), i))[:4]
        assert [got[q, p][1] for p in (1, 2, 3, 4)] == [round(s[q, i], 9) for i in best]
    assert got[61, 1] == (61, 1.0) and (61, 2) not in got


@pytest.mark.parametrize("small", [recall.SMALL, 100])
def test_near_names_equal_brute_force_with_copies_and_scaled_vectors(spark, monkeypatch, small):
    import numpy as np

    monkeypatch.setattr(recall, "SMALL", small)  # by one side sent to all, and by blocks
    monkeypatch.setattr(recall, "BLOCK", 7 * 23)
    monkeypatch.setattr(recall, "ROWS", 5)
    monkeypatch.setattr(recall, "TILE", 11)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 7))
    v[30:60] = v[:30] * rng.integers(1, 9, size=(30, 1))
    v[60:75] = v[0]
    v[75] *= 1e-200
    v[76], v[77] = v[75] * 1e300, 0
    ids = rng.permutation(90) * 10
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, vector array<double>")
    got = {(r.query_id, r.place): (r.item_id, round(r.vec_score, 9)) for r in recall.near_names(df, 5, 0.0).collect()}
    size = np.abs(v).max(1, keepdims=True)
    v = v / np.where(size > 0, size, 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    n = v / np.where(norm > 0, norm, 1)
    s = (1 + n @ n.T) / 2
    want = {}
    for q in range(90):
        best = sorted((j for j in range(90) if j != q), key=lambda j: (-round(s[q, j], 12), ids[j]))[:5]
        want |= {(int(ids[q]), p + 1): (int(ids[j]), round(s[q, j], 9)) for p, j in enumerate(best)}
    assert got == want


def test_best_of_many_items_holds_a_tile_of_scores(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    v = np.random.default_rng(8).normal(size=(30_000, 8))
    side = recall._sides(pa.array(np.arange(30_000)), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 8).cast(pa.list_(pa.float64())))
    few = recall._sides(pa.array(np.arange(1024)), pa.FixedSizeListArray.from_arrays(pa.array(v[:1024].ravel()), 8).cast(pa.list_(pa.float64())))
    tracemalloc.start()
    query, item, score, _ = recall._best(few, side, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(query) == 6 * 1024 and set(query[score > 1 - 1e-12]) == set(range(1024))
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 511, 512, 1023):
        s = (1 + n @ n[q]) / 2
        assert sorted(item[query == q]) == sorted(np.argsort(-s, kind="stable")[:6])
    assert peak < 100_000_000, "1,024 queries' scores of all items are 246 MB"


def test_requirements_credit_families_but_not_the_excluded(spark):
    cand = spark.createDataFrame([("j", "r1"), ("j", "r2"), ("j", "r3")], "job_id string, resume_id string")
    req = spark.createDataFrame([("j", "flask", 2, None), ("j", "misc", 1, False)], "job_id string, skill string, min_years int, is_must_have boolean")
    has = spark.createDataFrame([("r1", "flask", 4, 2024), ("r2", "django", 9, 2024), ("r3", "odd", 1, 2024)], "resume_id string, skill string, years int, last_used_year int")
    fam = spark.createDataFrame([("flask", "web"), ("django", "web"), ("misc", "other"), ("odd", "other")], "skill string, family string")
    out = matching.requirement_rows(cand, req, has, fam, ("other",))
    got = {(r.resume_id, r.skill): (r.ontology_weight, r.years, r.is_must_have) for r in out.collect()}
    assert got["r1", "flask"] == (1.0, 4, True) and got["r2", "flask"] == (0.5, None, True) and got["r3", "flask"] == (0.0, None, True)
    assert got["r3", "misc"] == (0.0, None, False)
    senior = spark.createDataFrame([("j", "r3", True)], "job_id string, resume_id string, senior boolean")
    s = {r.resume_id: r for r in matching.skill_scores(out, senior, 2024).collect()}
    assert s["r1"].skill_score == 0.5 and s["r2"].skill_score == 0.25 and s["r3"].skill_score == 0.0
    assert s["r3"].missing == 1 and [c.reason for c in s["r3"].contributions] == ["missing", "missing"]


def test_relief_marks_implied_experience_and_exports_count_it_as_matched(spark):
    data = [("j", "r", s, 1, True, None if w == 0 else 5, None if w == 0 else 2024, w) for s, w in (("a", 1.0), ("b", 1.0), ("c", 0.0))]
    req = spark.createDataFrame(data, "job_id string, resume_id string, skill string, min_years int, is_must_have boolean, years int, last_used_year int, ontology_weight double")
    senior = spark.createDataFrame([("j", "r", True)], "job_id string, resume_id string, senior boolean")
    out = matching.skill_scores(req, senior, 2024)
    r = out.first()
    assert r.skill_score == pytest.approx(2 / 3 * 0.75) and r.contributions[2].reason == "implied-experience" and r.contributions[2].score == 0.0
    g = out.select(*[c.alias(k) for k, c in export.gap_summary(F.col("contributions")).items()]).first()
    assert (g.matched_count, g.missing_count, g.matched_skills) == (3, 0, "a; b; c")


def test_evidence_is_verified(spark):
    text = "Designed streaming ingestion in Python and kept it running for four years."
    chunks = spark.createDataFrame([("r", "c1", text), ("r", "c2", "Sold houses in a small town by the sea."), ("q", "c9", text)], "resume_id string, id string, text string")
    data = [
        (1, "met", "streaming   ingestion IN Python", ["c2", "c1", "nope"], 0.9),
        (2, "met", "invented a compiler for spreadsheets", ["c1"], 0.9),
        (3, "partial", "invented a compiler for spreadsheets", ["c1"], 0.8),
        (4, "met", "", ["c1"], 0.9),
        (5, "met", "Python", ["c1"], 0.9),
        (6, "met", text + " And more.", ["c1"], 0.9),
        (7, "met", "streaming ingestion in Python", ["c9"], 0.2),
        (8, "met", "streaming ingestion in Pythom and kept", ["c1"], 0.9),
        (9, "met", None, None, 0.9),
        (10, "met", "streaming ingest\u00adion in Python", ["c1", "c1"], 0.9),
    ]
    req = spark.createDataFrame([(i, "r", *x) for i, *x in data], "row_id int, resume_id string, status string, evidence string, evidence_chunk_ids array<string>, confidence double")
    got = {r.row_id: r for r in matching.verified(req, chunks).collect()}
    assert (got[1].status, got[1].evidence_chunk_ids, got[1].confidence) == ("met", ["c2", "c1"], 0.9)
    assert (got[2].status, got[2].evidence, got[2].confidence) == ("missing", "", 0.3)
    assert (got[3].status, got[3].evidence) == ("partial", "")
    assert got[4].status == "met" and got[5].status == "missing" and got[6].status == "missing"
    assert (got[7].status, got[7].confidence, got[7].evidence_chunk_ids) == ("missing", 0.2, [])
    assert got[8].status == "met" and got[9].status == "met" and got[10].status == "met" and got[10].evidence_chunk_ids == ["c1", "c1"]


def test_extractor_cites_the_first_chunk(spark):
    req = spark.createDataFrame([("r", "Python", "python"), ("r", "Go", "go")], "resume_id string, requirement string, skill string")
    ch = spark.createDataFrame([("r", "c2", 2, "two", ["python"]), ("r", "c1", 1, "one", ["python", "sql"])], "resume_id string, id string, at int, text string, skills array<string>")
    got = {r.requirement: r for r in matching.extracted(req, ch).collect()}
    assert got["Python"].evidence_chunk_ids == ["c1"] and got["Python"].confidence == 0.9 and got["Go"].status == "missing" and got["Go"].evidence_chunk_ids == []


def test_smeared_years_and_merging(spark):
    s = spark.createDataFrame([("r", f"s{i}", 5) for i in range(6)] + [("r", "x", 3), ("q", "y", None)], "resume_id string, skill string, years int")
    got = {r.skill: r.years for r in matching.unsmeared(s).collect()}
    assert all(got[f"s{i}"] is None for i in range(6)) and got["x"] == 3 and got["y"] is None
    m = spark.createDataFrame([("r", "a", None, 2001, 1), ("r", "a", 4, 1999, 2)], "resume_id string, skill string, years int, last_used_year int, at int")
    assert rows(matching.merged_skills(m)) == [("r", "a", 4, 2001, 1)]


def test_ranks_caps_and_budgets(spark):
    df = spark.createDataFrame([("j", i, 1.0 if i < 3 else 0.5) for i in range(5)] + [("k", 9, 0.1)], "job_id string, id int, score double")
    r = ranking.ranked(df, "job_id", [F.desc("score"), F.col("id")])
    assert [(x.id, x.rank) for x in r.where("job_id = 'j'").orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    for percent, n in ((1, 1), (20, 1), (50, 3), (100, 5)):
        assert ranking.top_percent(r, "job_id", F.lit(percent)).where("job_id = 'j'").count() == n
    q = spark.createDataFrame([(1, 300), (2, 0), (3, 10)], "id int, cost int")
    assert [x.id for x in ranking.budget_prefix(q, ["id"], "cost", 200).orderBy("id").collect()] == [1]
    q = spark.createDataFrame([(1, 100), (2, 90), (3, 50), (4, 1)], "id int, cost int")
    assert [x.id for x in ranking.budget_prefix(q, ["id"], "cost", 200).orderBy("id").collect()] == [1, 2]
    pairs = spark.createDataFrame([("recency", 0, 3), ("tie", 0, 1), ("absent", 0, 77)], "dimension string, higher int, lower int")
    got = {x.dimension: x.holds for x in ranking.ordering_pairs(r.where("job_id = 'j'"), pairs, "id").collect()}
    assert got == {"recency": True, "tie": False, "absent": False}
    d = ranking.drift(r.where("job_id = 'j'"), r.where("job_id = 'j' and id > 0"), "id").first()
    assert (d.rank_drift, d.missing) == (0, 1)


def test_status_breakdown_fills_zeros_even_without_rows(spark):
    r = spark.createDataFrame([("parsed", True), ("parsed", False)], "status string, degraded boolean")
    got = dict(rows(relational.status_breakdown(r, F.col("status"), F.col("degraded"))))
    assert got == {"uploaded": 0, "parsing": 0, "parsed": 2, "failed": 0, "withdrawn": 0, "degraded": 1}
    assert sum(dict(rows(relational.status_breakdown(r.limit(0), F.col("status"), F.col("degraded")))).values()) == 0


def test_scope_dedup_upsert_patch(spark):
    jobs = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, n int")
    assignees = spark.createDataFrame([("a", "u"), ("a", "u")], "job_id string, user_id string")
    assert rows(relational.scoped(jobs, assignees, "job_id", "u")) == [("a", 1)]
    assert relational.scoped(jobs, assignees, "job_id", None).count() == 2 and relational.scoped(jobs, assignees, "job_id", "v").count() == 0
    batch = spark.createDataFrame([(1, "x", True), (2, "x", True), (3, "y", True), (4, "x", False), (5, None, True)], "at int, sha string, ok boolean")
    stored = spark.createDataFrame([("y",), ("y",)], "sha string")
    got = {r.at: r.outcome for r in relational.dedup_outcome(batch, stored, "sha", ["at"], F.col("ok")).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "duplicate", 4: "rejected", 5: "accepted"}
    users = spark.createDataFrame([("u", "Old", "admin"), ("w", None, None)], "id string, name string, role string")
    new = spark.createDataFrame([("u", None, "viewer"), ("w", "W", "viewer"), ("z", "Z", None)], "id string, name string, role string")
    assert rows(relational.upserted(users, new, ["id"], prefer_new=["name"], sticky=["role"]), "id") == [("u", "Old", "admin"), ("w", "W", "viewer"), ("z", "Z", None)]
    t = spark.createDataFrame([("a", "x", True), ("b", None, True)], "id string, title string, blind boolean")
    patch = spark.createDataFrame([("a", {"title": None, "blind": "true"}), ("b", {"title": None, "owner": "me"})], "id string, fields map<string,string>")
    got = {r.id: (r.title, r.blind, r.changed) for r in relational.patched(t, patch, "id", ["title", "blind"]).collect()}
    assert got == {"a": (None, True, ["title"]), "b": (None, True, [])}


def test_guards_states_and_details(spark):
    t = spark.createDataFrame([(1, "open"), (2, "closed"), (3, None)], "id int, status string")
    got = rows(relational.guarded_update(t, F.col("status") == "open", {"status": F.lit("done")}), "id")
    assert got == [(1, "done", True), (2, "closed", False), (3, None, False)]
    d = spark.createDataFrame([("view", {"k": "1", "z": "0", "q": "7"}), ("edit", {"k": "1"})], "action string, d map<string,string>")
    got = [r[0] for r in d.select(relational.masked_details(F.col("d"), F.col("action"), {"view": ("k",)})).collect()]
    assert got == [{"k": "1", "z": "0", "q": "<withheld>"}, {"k": "<withheld>"}]
    assert rows(relational.replaced(t, t.limit(0), "id", t.where("id = 2")), "id") == [(1, "open"), (3, None)]


def test_normaliser_stages(spark):
    table = skills.vocabulary([{"canonical": "Kubernetes", "aliases": ["k8s"]}, {"canonical": "airflow", "aliases": []}, {"canonical": "aws"}, {"canonical": "PostgreSQL", "aliases": ["psql"]}])
    assert table["k8s"] == "kubernetes" and table["aws"] == "aws" and skills.vocabulary(None) == {}
    names = ["K8s", "PostgreSQL 14", "Kubernetes (EKS)", "AWS MWAA (Airflow)", "Casey Rivera (psql)", "(airflow)", "Something-New", "", None, "psql", "psql"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = {r.i: (r.skill, r.known) for r in skills.normalised(df, skills.dimension(spark, table)).collect()}
    want = ["kubernetes", "postgresql", "kubernetes", "airflow", "casey rivera psql", "airflow", "something-new", "", None, "postgresql", "postgresql"]
    assert [got[i][0] for i in range(len(names))] == want and got[4][1] is False
    keys = {r.i: (r.skill_key, r.reason) for r in skills.resolved_keys(df, skills.dimension(spark, table), "s").collect()}
    assert len(keys) == len(names) and keys[0][0] == "kubernetes" and keys[6][0].startswith("h:") and keys[7][0] is None


def test_scanner_prefers_long_terms_and_respects_edges(spark):
    table = skills.vocabulary([{"canonical": "c++", "aliases": []}, {"canonical": "c", "aliases": []}, {"canonical": "rest api", "aliases": ["rest apis"]}])
    df = spark.createDataFrame([(1, "C++ and REST APIs, c. Abc c# rest api"), (2, ""), (3, None)], "i int, t string")
    scan = lambda t: {r.i: r.skills for r in skills.scanned(df, "i", "t", skills.dimension(spark, t), list(t)).collect()}
    assert scan(table) == {1: ["c++", "rest api", "c"], 2: [], 3: []} and scan({"x": "x"}) == {1: [], 2: [], 3: []}


def test_redaction(spark):
    df = spark.createDataFrame([("JANE Smith, Janet (Smith) of Acme Corp. and acme wrote from Austin, Texas to a@b.example, +1 (436) 555-8670.", "Jane Smith"), ("", "x"), (None, None)], "t string, n string")
    labels = F.create_map(F.lit("Acme"), F.lit("Employer B"), F.lit("Acme Corp"), F.lit("Employer A"))
    got = [r[0] for r in df.select(redaction.redact_text(F.col("t"), F.col("n"), labels, F.lit("Austin, Texas"), ("Texas",))).collect()]
    assert got[0] == "[name redacted], Janet ([name redacted]) of Employer A. and Employer B wrote from [location redacted] to [contact redacted], [contact redacted]."
    assert got[1] == "" and got[2] is None
    u = spark.createDataFrame([("éSmith met Smith.",)], "t string").select(redaction.redact_text(F.col("t"), F.lit("Smith"))).first()[0]
    assert u == "éSmith met [name redacted]."


def test_embedding_text_has_no_identifiers(spark):
    df = spark.createDataFrame([("Casey\n Rivera built it; casey.rivera and 555 0101.", "Casey Rivera", "casey.rivera@example.test", "555 0101", None), ("mail x@y.example", None, None, None, None), ("clean  text", "Casey", None, None, None)], "t string, n string, e string, p string, l string")
    got = [r[0] for r in df.select(redaction.embedding_safe(*map(F.col, "tnepl"))).collect()]
    assert got == ["built it; and .", "mail", "clean text"]
    free = spark.createDataFrame([("ring 555 010-99  now",), ("in 2001  -  2003 then",)], "t string").select(redaction.embedding_safe(F.col("t"), *[F.lit(None).cast("string")] * 4)).collect()
    assert [r[0] for r in free] == ["ring now", "in then"]
    kept = spark.createDataFrame([("a  b 12-34",)], "t string").select(redaction.embedding_safe(F.col("t"), *[F.lit(" ")] * 4)).first()[0]
    assert kept == "a  b 12-34"


def test_blind_resume(spark):
    doc = {
        "candidate": {"name": "Jane Roe", "email": "j@r.example", "phone": "1", "location": "Austin, Texas"}, "summary": "Jane Roe at Acme", "total_years_experience": 5, "skills": [],
        "experience": [{"company": "Acme", "title": "Dev", "start": "2001", "end": None, "is_current": True, "bullets": [{"text": "Acme and Roe", "chunk_id": "c"}]}, {"company": "ACME", "title": "T", "start": None, "end": None, "is_current": False, "bullets": []}, {"company": "Beta", "title": "T", "start": None, "end": None, "is_current": False, "bullets": None}],
        "education": [{"degree": "BSc", "institution": "MIT", "field": "CS", "year": 1999}], "chunks": [{"id": "c", "section": "s", "page": 1, "text": "Roe of MIT"}], "cover_letter_chunks": [], "degraded": False, "degradation_reason": None,
    }
    df = spark.createDataFrame([(doc,)], __import__("pyspark").sql.types.StructType().add("doc", RESUME_DOCUMENT))
    d = redaction.blind_resumes(df, "doc", "d", ("Texas",)).first().d
    assert d.candidate.name is None and d.candidate.location is None and d.summary == "[name redacted] at Employer A"
    assert [e.company for e in d.experience] == ["Employer A", "Employer A", "Employer B"] and d.experience[0].title == "Dev" and d.experience[0].bullets[0].text == "Employer A and [name redacted]"
    assert d.education[0].institution == "Institution A" and d.education[0].year is None and d.education[0].degree == "BSc" and d.chunks[0].text == "[name redacted] of Institution A"


def test_chunks(spark):
    def texts(body):
        df = spark.createDataFrame([("r", 1, body)], "resume_id string, page_no int, text string")
        return [r.text for r in chunking.chunks(df).orderBy("chunk_id").collect()]

    assert texts("") == [] and texts("a\n\nb") == []
    assert texts("x" * 600 + "\n\n" + "y" * 50) == ["x" * 600 + "\n\n" + "y" * 50]
    assert texts("x" * 1199 + "\n\n" + "y" * 50) == ["x" * 1199, "y" * 50]
    long = " ".join(["Word word word."] * 200)
    assert all(len(c) <= 1200 for c in texts(long)) and " ".join(texts(long)) == long and len(texts(long)[0]) == 1199
    assert [len(c) for c in texts("z" * 3000)] == [1200, 1200, 600]
    assert texts("a" * 100 + "\n\n" + "b" * 1300 + "\n \n" + "c" * 100) == ["a" * 100, "b" * 1200, "b" * 100, "c" * 100]
    para = "This line is surely longer than forty characters in all."
    pages = spark.createDataFrame([("r", 1, f"Name\nSkills:\n{para}\nshort"), ("r", 2, f"{para}\nEducation\n{para}"), ("q", 1, ""), ("n", 1, None)], "resume_id string, page_no int, text string")
    got = rows(chunking.chunks(pages), "chunk_id")
    assert [(c[1], c[2], c[3]) for c in got] == [("c_001", "skills", 1), ("c_002", "education", 2)]
    assert got[0][4] == f"{para}\nshort\n{para}"


@pytest.mark.parametrize("none", [0, 1])
def test_rows_appended_are_numbered_without_gaps_in_many_partitions(spark, none):
    log = spark.range(5).select("id", F.lit("view").alias("action"), F.col("id").cast("string").alias("entity_id"), F.col("id").alias("at"))
    n = 60_000  # more than a range sort samples, so that two sorts are cut at different places
    new = spark.range(n, numPartitions=8).select(F.lit("read").alias("action"), F.col("id").cast("string").alias("entity_id"), F.when(F.col("id") >= none, F.hash("id").cast("long") * n + F.col("id")).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = governance.appended(log, new)
        got = [r.id for r in out.where("action = 'read'").orderBy(F.asc_nulls_last("at")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(range(5, n + 5))
    assert out.where("action = 'view' and id = at").count() == 5


def test_export_and_governance(spark, tmp_path):
    e = spark.createDataFrame([(1, [("Python", "met", "=quote", ["c"], 0.9)]), (2, []), (3, None)], "id int, requirements array<struct<requirement:string,status:string,evidence:string,evidence_chunk_ids:array<string>,confidence:double>>")
    flat = export.evidence_rows(e, ["id"])
    assert [r[2] for r in rows(flat, "id")] == ["Python", export.NO_EVIDENCE, export.NO_EVIDENCE]
    export.write_csv(flat, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("id = 1").first().evidence == "'=quote"
    c = e.select(*[v.alias(k) for k, v in export.coverage(F.col("requirements")).items()]).first()
    assert (c.met_count, c.completeness) == (1, 1.0)
    b = spark.createDataFrame([('{"skill": 0.5, "flag": true, "odd": "true"}',), ("[]",), (None,)], "t string").select(*export.unfolded(F.col("t"), ("skill", "none"), ("flag", "odd"))).collect()
    assert tuple(b[0]) == (0.5, None, True, None) and tuple(b[2]) == (None, None, None, None)
    people = spark.createDataFrame([("Ann", "a@b.c"), (None, None)], "name string, email string")
    key = F.lit("0123456789abcdef")
    secret = governance.encrypted(people, ["name"], key)
    assert rows(governance.decrypted(secret, ["name"], key).select("name")) == [("Ann",), (None,)]
    assert governance.decrypted(secret, ["name"], F.lit("fedcba9876543210")).select("name").first()[0] is None
    a = spark.createDataFrame([("u", None), (None, "cron"), ("u", "cron"), (None, None)], "u string, s string").select(governance.actor(F.col("u"), F.col("s")).alias("a")).collect()
    assert [r.a.kind if r.a else None for r in a] == ["user", "service", None, None]
    log = spark.createDataFrame([("view", '{"a": 1}'), ("view", "{}"), ("view", "[1]"), ("view", None), ("drop", '{"a": 1}')], "action string, details string")
    assert governance.revealable(log, ("view",)).count() == 1


def test_graph(spark):
    jobs = spark.createDataFrame([("j", [("Python", 3), ("python ", 1), (" ", 0)], [("Go", None)])], "job_id string, required array<struct<name:string,min_years:int>>, nice array<struct<name:string,min_years:int>>")
    edges = graph.job_edges(jobs)
    assert rows(edges.select("kind", "skill", "display_name", "min_years", "is_must_have"), "kind") == [("nice_to_have", "go", "Go", None, False), ("requires", "python", "Python", 3, True)]
    old = spark.createDataFrame([("j", "x"), ("k", "y")], "job_id string, skill string")
    new, seen = spark.createDataFrame([("j", "z")], "job_id string, skill string"), spark.createDataFrame([("j",)], "job_id string")
    once = graph.project(old, new, "job_id", seen)
    assert rows(once, "job_id") == [("j", "z"), ("k", "y")] == rows(graph.project(once, new, "job_id", seen), "job_id")


def test_schemas(spark):
    assert set(TABLES) >= {"jobs", "resumes", "outbox", "sessions"} and EVIDENCE["requirements"]
    df = spark.createDataFrame([("open", 30, 1, None), ("gone", 731, 100, "ranking"), (None, None, 0, "x")], "status string, retention_days int, shortlist_top_percent int, shortlist_state string")
    assert dict(rows(violations(df, checks("jobs")))) == {"status": 1, "retention": 1, "top_percent": 1, "state": 1}
    assert rows(duplicates(df.unionByName(df.limit(1)), ["status"])) == [("open", 2)]
