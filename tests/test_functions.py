import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.functions import fuzzy, hashing, scoring, strings
from veritrail.functions.vectors import cosine
from veritrail.weights import Weights


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


def test_weights_are_read_from_settings():
    from veritrail.weights import DEFAULT, read

    assert read({"PATH": "/bin"}) == DEFAULT
    w = read({"MATCH_RECENCY_OLD": "0.5", "match_recency_mid_years": "6", "OTHER": "x"})
    assert (w.recency_old, w.recency_mid_years) == (0.5, 6)
    for bad in ({"MATCH_NOTHING": "1"}, {"MATCH_SKILL": "much"}, {"MATCH_SKILL": "0.9"}):
        with pytest.raises(ValueError):
            read(bad)


def test_weights_are_checked():
    assert Weights().skill == 0.4
    for bad in ({"structured": 0.9}, {"skill": 0.9}, {"must_have_miss_penalty": 0.8}, {"recency_mid": 1.5}, {"seniority_floor": 1.0}, {"overqual_ratio": 0.5}):
        with pytest.raises(ValueError):
            Weights(**bad)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def plain_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    windows = [b[max(0, e - n) : min(len(b), e)] for e in range(1, len(b) + n)]
    return max((2 * plain_lcs(a, w) / (n + len(w)) for w in windows), default=0.0)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", min_size=1, max_size=9), st.text("abcé ", min_size=1, max_size=20))
def test_partial_ratio_is_the_best_window(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    want = plain_partial(a, b)
    assert fuzzy.partial_ratio(a, b) == pytest.approx(want)
    assert fuzzy.partial_ratio(a, b, 0.8) == pytest.approx(want if want >= 0.8 else 0.0)


def test_fuzzy_edges():
    assert fuzzy.partial_ratio("", "") == 1.0 and fuzzy.partial_ratio("", "x") == 0.0
    assert fuzzy.partial_ratio("quote", "a quote here") == 1.0
    assert fuzzy.token_set_ratio("computer science", "science of computer") == 1.0
    assert fuzzy.token_set_ratio("", "x") == 0.0
    assert fuzzy.token_set_ratio("communications", "computer science") < 0.85


def test_soft_hyphens_lower_the_score_as_published():
    chunk = "Built and operated Python services for the ingestion platform, owning design, rollout and on-call, and cut the p95 latency of the public API by half."[:148]
    every = lambda n: "\u00ad".join(chunk[i : i + n] for i in range(0, len(chunk), n))
    scores = [fuzzy.partial_ratio(chunk, every(n)) for n in (60, 20, 8, 5, 2)]
    assert scores == sorted(scores, reverse=True)
    assert scores[2] > 0.85 > scores[3]
    for got, published in zip(scores, (0.986, 0.956, 0.892, 0.838, 0.671)):
        assert abs(got - published) < 0.01


@pytest.mark.parametrize(
    "line,section",
    [("Skills:", "skills"), ("Skills and tools", "skills"), ("My skills", None), ("EDUCATION", "education"), ("Work History", "experience"), ("about", "summary"), ("x" * 41, None), ("", None), ("Papers::", "publications"), ("skillset", None)],
)
def test_section_heading(spark, line, section):
    assert one(spark, strings.section_heading(F.col("a")), a=line) == section


@pytest.mark.parametrize(
    "degree,level",
    [("PhD in Physics", "phd"), ("Master of Arts", "masters"), ("MBA", "masters"), ("Diploma in X", "masters"), ("BSc Computer Science", "bachelors"), ("Associate Degree", "associate"), ("High School", "high_school"), ("Certificate", None)],
)
def test_degree_level(spark, degree, level):
    """'diploma in' holds 'ma ', a quirk of searching substrings that is kept."""
    assert one(spark, strings.degree_level(F.col("a")), a=degree) == level


def test_string_functions(spark):
    assert one(spark, strings.clean(F.col("a")), a="  CI/CD   (naïve) c++ ") == "CICD naïve c++"
    assert one(spark, strings.strip_version(F.col("a")), a="postgresql v14.2") == "postgresql"
    assert one(spark, strings.csv_safe(F.col("a")), a="=1+1") == "'=1+1"
    assert one(spark, strings.csv_safe(F.col("a")), a="1=1") == "1=1"
    assert one(spark, strings.masked_filename(F.col("a")), a="Jane_Smith.tar.PDF") == "resume.pdf"
    assert one(spark, strings.masked_filename(F.col("a")), a="README") == "resume"
    assert one(spark, strings.masked_filename(F.lit(None).cast("string"))) == "resume"
    assert [one(spark, strings.letters(F.col("a")), a=n) for n in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert one(spark, strings.pseudonym(F.col("a")), a=0) == "Candidate ?"
    assert one(spark, strings.strip_controls(F.col("a")), a="a\u00adb\u200b\u202ec\td\x01") == "abc\td"
    assert one(spark, strings.json_body(F.col("a")), a='Sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, strings.json_body(F.col("a")), a='so [1, 2] it is') == "[1, 2]"
    assert one(spark, strings.mask_phones(F.col("a")), a="call +1 (436) 555-8670 or 555-1234") == "call [contact redacted] or 555-1234"
    assert one(spark, strings.mask_emails(F.col("a")), a="mail a.b@x-y.example.com now") == "mail [contact redacted] now"


@pytest.mark.parametrize("name,reason", [("Python", None), ("x" * 61, "length_or_token_cap"), ("a b c d e f g h i", "length_or_token_cap"), ("me (at) mail.example", "email_shape"), ("555-010-9999", "phone_shape"), ("C++ 17", None)])
def test_reject_reason(spark, name, reason):
    assert one(spark, strings.reject_reason(F.col("a")), a=name) == reason


def test_scores(spark):
    exp = lambda y, b: one(spark, scoring.experience(F.col("y").cast("int"), F.col("b").cast("int")), y=y, b=b)
    assert exp(3, 0) == 1.0 and exp(None, 4) == 0.0 and exp(2, 4) == 0.5 and exp(8, 4) == 1.0
    assert exp(14, 5) == pytest.approx(0.92) and exp(100, 5) == pytest.approx(0.8)
    assert 0.6 * 0.25 * (1 - exp(14, 5)) == pytest.approx(0.0120)
    rec = lambda y: one(spark, scoring.recency(F.col("y").cast("int"), 2024), y=y)
    assert [rec(y) for y in (2030, 2022, 2021, 2019, 2018, None, 0)] == [1.0, 1.0, 0.7, 0.7, 0.4, 1.0, 1.0]
    assert 0.6 * 0.40 * (rec(2024) - rec(2010)) == pytest.approx(0.144)
    sk = lambda y, o: one(spark, scoring.skill_score(F.col("y").cast("int"), F.lit(4), F.lit(2024), F.col("o"), 2024), y=y, o=float(o))
    assert sk(None, 1) == 1.0 and sk(0, 1) == 0.0 and sk(2, 1) == 0.5 and sk(None, 0.5) == 0.5 and sk(9, 0) == 0.0
    miss = lambda m, x, s: one(spark, scoring.miss_multiplier(F.col("m"), F.col("x"), F.col("s")), m=m, x=x, s=s)
    assert miss(4, 0, False) == 1.0 and miss(4, 1, False) == 0.5 and miss(4, 1, True) == 0.75 and miss(4, 3, True) == 0.5 and miss(0, 0, True) == 1.0
    assert one(spark, scoring.is_senior(F.lit(6), F.lit(4))) is True and one(spark, scoring.is_senior(F.lit(6), F.lit(None).cast("int"))) is False
    edu = lambda b, need, asked, hit: one(spark, scoring.education(F.lit(b).cast("int"), F.lit(need), F.lit(asked), F.lit(hit)))
    assert edu(None, "", True, False) == 1.0 and edu(None, "bachelors", False, False) == 0.0 and edu(2, "bachelors", False, False) == pytest.approx(1 / 3)
    assert edu(3, "bachelors", True, False) == 0.5 and edu(3, "bachelors", True, True) == 1.0 and edu(0, "unheard of", False, False) == 1.0
    assert one(spark, scoring.seniority(F.lit(0.75))) == 0.5 and one(spark, scoring.seniority(F.lit(None).cast("double"))) == 0.0
    assert [one(spark, scoring.coerced_year(F.lit(y))) for y in ("2001", " 7 ", "85", "850", "x")] == [2001, 2007, 1985, None, None]


def test_vectors_and_hashes(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in row.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] == 0.0 and got[2] is None
    assert one(spark, hashing.email_hash(F.lit("  "))) is None
    assert one(spark, hashing.email_hash(F.lit(" A@B.c "))) == one(spark, hashing.email_hash(F.lit("a@b.C")))
    with pytest.raises(ValueError):
        hashing.salted_key(F.lit("x"), "")
    import hashlib

    for t in ("python", "é", ""):
        want = int.from_bytes(hashlib.sha1(t.encode()).digest()[:8], "big") % 768
        assert one(spark, hashing.token_bucket(F.lit(t))) == want
    low = int.from_bytes(hashlib.sha256(b"match:j1").digest()[-4:], "big", signed=True)
    assert one(spark, hashing.lock_id(F.lit("match"), F.lit("j1"))) == low
    assert math.isclose(0.6 + 0.3 + 0.1, 1.0)
