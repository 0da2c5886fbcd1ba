import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.operators import documents, gates, lifecycle
from veritrail.schemas import JOB_DOCUMENT, RESUME_DOCUMENT


def frame(spark, kind, *docs):
    names = [f.name for f in kind.fields]
    return spark.createDataFrame([(tuple(d.get(n) for n in names), i) for i, d in enumerate(docs)], T.StructType().add("doc", kind).add("i", T.IntegerType()))


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_job_views_and_texts(spark):
    df = frame(spark, JOB_DOCUMENT, {"title": "Engineer", "required_skills": [("Python", 3), (" ", 1), (None, 1)], "nice_to_have_skills": [("Go", None)], "min_years_experience": 5, "education": ("bachelors", ["CS", " ", None]), "responsibilities": ["Build", "Run"]}, {"title": "Bare"})
    v = values(df, documents.job_view(F.col("doc"), F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lit(7))))
    assert (v[0].min_years, [s.name for s in v[0].required], v[0].fields, v[0].min_level) == (5, ["Python"], ["CS"], "bachelors") and (v[1].min_years, v[1].required, v[1].fields) == (7, [], [])
    assert values(df.where("i = 1"), documents.job_text(F.col("doc"))) == ["Bare"]
    full = frame(spark, JOB_DOCUMENT, {"title": "T", "required_skills": [("A", 1), ("B", 1)], "nice_to_have_skills": [("C", 1)], "responsibilities": ["x", "y"]})
    assert values(full, documents.job_text(F.col("doc"))) == ["T. x y. Required: A, B. Nice to have: C"]


def test_resume_texts_hold_no_identity(spark):
    role = lambda c, t, cur: (c, t, None, None, cur, None)
    df = frame(
        spark, RESUME_DOCUMENT,
        {"candidate": ("Jane", "j@x.example", "1", "Rome"), "summary": "Builds things", "skills": [(f"s{i}", None, None, None, None) for i in range(40)], "experience": [role("Acme", " ", False), role("Beta", "Lead ", True), role("Acme", "Dev", False)], "education": [("BSc", "MIT", "CS", 1999), ("MSc", "ETH", None, 0)]},
        {"candidate": ("Jane", None, None, None)},
    )
    got = values(df, documents.resume_text(F.col("doc")))
    assert got[0].startswith("Builds things. Skills: s0, ") and "s29" in got[0] and "s30" not in got[0] and "Recent roles:   at Acme; Lead  at Beta; Dev at Acme. Education: BSc, MIT (1999); MSc, ETH" in got[0]
    assert "Jane" not in got[0] and got[1] == "candidate"
    assert values(df, documents.recent_title(F.col("doc.experience"))) == ["Lead ", None]


def test_tolerant_rows_and_chunks(spark):
    raw = '[{"name": "Python", "years": 3}, {"name": " "}, {"years": 3}, 7, {"name": "Go", "years": 99}, {"name": "SQL"}, {"name": "C", "years": "x"}]'
    df = spark.createDataFrame([(raw, 0), ("[]", 1), (None, 2)], "raw string, i int")
    assert [[tuple(s) for s in x] if x is not None else None for x in values(df, documents.readable_skills(F.col("raw")))] == [[("Python", 3), ("SQL", None)], [], None]
    ch = spark.createDataFrame([([("a", "other"), ("b", "Header"), ("c", "skills")], 0)], "ch array<struct<id:string,section:string>>, i int")
    assert [c.id for c in values(ch, documents.without_headers(F.col("ch")))[0]] == ["c"]
    ids = spark.createDataFrame([(["x", "a", "a"], ["a", "b"], 0)], "ids array<string>, valid array<string>, i int")
    assert values(ids, documents.cited(F.col("ids"), F.col("valid"))) == [["a", "a"]]
    assert values(ids, documents.strip_nuls(F.lit("a\x00b"))) == ["ab"]


def test_withdraw_and_reinstate(spark):
    res = spark.createDataFrame([("a", "parsed", None, None), ("b", "parsed", None, None)], "resume_id string, status string, withdrawn_at timestamp, withdrawal_reason string")
    ids = spark.createDataFrame([("a", "asked"), ("a", "asked"), ("zz", None)], "resume_id string, reason string")
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    after, audit, events = lifecycle.withdraw(res, ids, now, "u1")
    assert after.where("withdrawn_at is not null").select("resume_id", "withdrawal_reason").first() == ("a", "asked")
    assert audit.count() == 1 and audit.first().details == '{"reason":"asked"}' and [e.event_type for e in events.collect()] == ["resume.withdrawn"]
    again, audit2, events2 = lifecycle.withdraw(after, ids, now, "u1")
    assert audit2.count() == 0 == events2.count() and sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    box = spark.createDataFrame([(1, "resume", "a", "resume.parsed", "old", "2024-01-01"), (2, "resume", "a", "resume.parsed", "new", "2024-01-02"), (3, "resume", "a", "resume.parsed", "unsent", None), (4, "resume", "b", "resume.parsed", "b", "2024-01-01")], "id int, aggregate string, aggregate_id string, event_type string, payload string, delivered_at string")
    back, replay = lifecycle.reinstate(after, ids, box, now)
    assert back.where("withdrawn_at is not null").count() == 0 and [(e.aggregate_id, e.payload) for e in replay.collect()] == [("a", "new")]
    assert lifecycle.reinstate(back, ids, box, now)[1].count() == 0
    parses = spark.createDataFrame([("a", False), ("b", True), ("c", None), ("d", None)], "resume_id string, degraded boolean")
    now_ = spark.createDataFrame([("a", "parsing", None), ("b", "parsing", None), ("c", "parsing", "2024-01-01"), ("d", "parsed", None)], "resume_id string, status string, withdrawn_at string")
    assert [r.resume_id for r in lifecycle.projectable(parses, now_).collect()] == ["a"]


def test_gates(spark):
    chunks = spark.createDataFrame([("r", "c1", "Ran Kubernetes clusters for a bank in production.")], "resume_id string, id string, text string")
    q = spark.createDataFrame([(1, "r", "kubernetes  clusters for a bank", ["c1", "no"]), (2, "r", "wrote a novel about whales", ["c1"]), (3, "r", "", ["c1"]), (4, "r", "x", [])], "row_id int, resume_id string, evidence string, evidence_chunk_ids array<string>")
    g = gates.verification_rate(q, chunks).first()
    assert (g.surfaced, g.verified, g.rate) == (2, 1, 0.5) and gates.verification_rate(q.limit(0), chunks).first().rate == 1.0
    gold = spark.createDataFrame([("r", "Clusters for a bank"), ("r", "spaceships"), ("s", "x")], "resume_id string, anchor string")
    a = gates.recalled_anchors(gold, q).first()
    assert (a.found, a.wanted) == (1, 3) and a.rate == pytest.approx(1 / 3)
    e = spark.createDataFrame([("j", "a", 1, 0.9), ("j", "b", 2, 0.2), ("j", "c", 3, 0.0)], "job_id string, resume_id string, rank int, score_evidence double")
    assert gates.completeness_in_top(e, "job_id", 1, 0.5).first().passes and not gates.completeness_in_top(e, "job_id", 2, 0.5).first().passes
    assert [tuple(r) for r in gates.must_not_surface(e, e.where("resume_id in ('b', 'c')"), "job_id", "resume_id", 2).collect()] == [("j", "b", 2)]
    t = spark.createDataFrame([("r", 1, "Ann Lee wrote"), ("r", 2, "call 555 010 9999"), ("r", 3, "fine")], "resume_id string, at int, text string")
    p = spark.createDataFrame([("r", "ann lee", None, "(555) 010-9999")], "resume_id string, name string, email string, phone string")
    assert sorted(r.at for r in gates.exposed(t, p).collect()) == [1, 2]
