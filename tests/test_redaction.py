"""Redaction and evidence, against independent brute force; by the names of the queries that have no SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veritrail.functions import fuzzy, strings
from veritrail.operators import matching, redaction
from veritrail.plans.registry import QUERIES
from veritrail.plans import lifecycles, texts  # noqa: F401


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_phones_count_their_own_digits(spark):
    kept = ["call 555-1234 567890a", "on 2021-03-04 12345x", "tel 2020 - 2021 4567ab", "in 2002-2007 and 1999", "x416 555 01994", None, ""]
    assert one(spark, strings.mask_phones, *kept) == kept
    gone = ["+1 (416) 555-0199 or", "416.555.0199", "(416) 555-0199,", "a 416 555 0199 b 2002-2007"]
    assert one(spark, strings.mask_phones, *gone) == ["[contact redacted] or", "[contact redacted]", "([contact redacted],", "a [contact redacted] b 2002-2007"]


def test_terms_are_replaced_in_one_pass(spark):
    labels = F.create_map(F.lit("Acme Corp"), F.lit("Employer A"), F.lit("Employer"), F.lit("Employer B"), F.lit("acme"), F.lit("Employer C"), F.lit("a.b (c)"), F.lit("Institution A"))
    got = one(spark, lambda t: redaction.redact_text(t, labels=labels), "Acme Corp and Employer", "ACME CORP, acme and Acmex", "of a.b (c)!", "axb (c)", None)
    assert got == ["Employer A and Employer B", "Employer A, Employer C and Acmex", "of Institution A!", "axb (c)", None]


def test_names_by_the_longest_part_and_whole_words(spark):
    hide = lambda t: redaction.redact_text(t, name=F.lit(" Jane  Smith X"))
    assert one(spark, hide, "Jane Smith of Smithsonian, jane and SMITH; X stays", "éJane Jane's $1 \\\\ x") == ["[name redacted] [name redacted] of Smithsonian, [name redacted] and [name redacted]; X stays", "éJane [name redacted]'s $1 \\\\ x"]


def test_an_employer_that_is_a_school_does_not_break_the_labels(spark):
    a, b = F.create_map(F.lit("U"), F.lit("Employer A"), F.lit("V"), F.lit("Employer B")), F.create_map(F.lit("U"), F.lit("Institution A"))
    assert spark.range(1).select(redaction.overlay(a, b).alias("m")).first().m == {"U": "Institution A", "V": "Employer B"}


@pytest.mark.parametrize("n, label", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (475_254, "ZZZZ"), (475_255, "AAAAA"), (1_000_000, "BDWGN"), (0, ""), (-3, ""), (2**63 - 1, None)])
def test_letters_to_the_largest_number(spark, n, label):
    if label is None:
        label, rest = "", n
        while rest > 0:
            rest, r = divmod(rest - 1, 26)
            label = chr(65 + r) + label
    assert spark.range(1).select(strings.letters(F.lit(n))).first()[0] == label


def plain_redaction(text, name, place, regions):
    """The same masks by other means: scanning for words and runs by hand."""
    def whole(t, term, mark):
        return re.sub(rf"(?<!\w){re.escape(term)}(?!\w)", mark, t, flags=re.I) if term else t

    # the whole name and its parts at once, the longest first: parts are never found inside a mark
    terms = sorted({name.strip(), *(p for p in name.split() if len(p) >= 2)} - {""}, key=lambda x: (-len(x), x)) if any(len(p) >= 2 for p in name.split()) else []
    out, at = [], 0
    while at < len(text):
        for term in terms:
            end = at + len(term)
            if text[at:end].lower() == term.lower() and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                out.append("[name redacted]")
                at = end
                break
        else:
            out.append(text[at])
            at += 1
    t = "".join(out)
    if any(re.search(rf"\b{r}\b", place) for r in regions):
        t = whole(t, place, "[location redacted]")
    t = re.sub(rf"\b[A-Z][a-z][\w.'\-]*(?:[ \-][A-Z][a-z][\w.'\-]*){{0,3}}\s*,\s*(?:{'|'.join(sorted(regions, key=lambda r: (-len(r), r)))})\b", "[location redacted]", t)
    t = re.sub(r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[contact redacted]", t)
    return re.sub(r"(?<!\w)\+?\d[\d().\-\s]{6,}\d(?!\w)", lambda m: "[contact redacted]" if sum(c.isdigit() for c in m[0]) >= 10 else m[0], t)


BITS = ["Ann", "Lee", "ann lee", "Leeds", "Austin, Texas", "Paris, France", "Berlin, Germany", "Lyon , France", "a.b@c.example", "x@y", "+1 416 555 0199", "2002-2007", "555-1234 567890a", "(416) 555.0199", "\n", ", ", " ", "Ännchen", "éLee", "of", "1234567890"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables, for queries that are held against brute force."""
    r = random.Random(4)
    folder = str(tmp_path_factory.mktemp("small"))
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(60)]
    body = [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(body)]
    rows += [(30 + 2 * i, t) for i, t in enumerate(body[:10])]  # an odd document quotes the next, which may be like it
    rows += [(31 + 2 * i, "".join(c for j, c in enumerate(t) if j % (9 + i) != 8)) for i, t in enumerate(body[:10])]
    rows += [(60 + i, " ".join(r.choice(BITS) for _ in range(12))) for i in range(60)] + [(130, ""), (131, "short"), (133, "  Spaced \t out " * 20), (134, "spaced out " * 20)]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_redact_names_equals_brute_force(spark, small):
    import hashlib

    folder, rows = small
    got = {r.doc_id: (r.digest, r.names) for r in QUERIES["redact_names"](spark, folder).collect()}
    for i, t in rows:
        name = " ".join(re.split(r"[ \t\n\x0b\f\r]+", t)[:2])
        want = plain_redaction(t, name, "Austin, Texas", ("Texas", "France", "Germany"))
        assert got[i] == (hashlib.md5(want.encode()).hexdigest(), want.count("[name redacted]")), (t, want)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def best_window(a, b):
    """Every window of the longer text, by dynamic programming."""
    n = len(a)
    return max((2 * longest(a, b[max(0, e - n) : e]) / (n + len(b[max(0, e - n) : e])) for e in range(1, len(b) + n)), default=0.0)


def borne(quote, text):
    plain = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    q, t = plain(quote), plain(text)
    return len(q) >= 16 and len(q) <= len(t) and (q in t or best_window(q, t) >= 0.85)


def told_by_force(rows):
    by = dict(rows)
    out = {}
    for i, t in rows:
        quote, cited = ("" if i % 7 == 0 else t[20:80]), (i if i % 2 == 0 else i + 1)
        out[i] = (quote, cited in by, cited in by and borne(quote, by[cited]))
    return out


def test_fuzzy_verify_equals_brute_force(spark, small):
    folder, rows = small
    want = told_by_force(rows)
    got = {r.row_id: r for r in QUERIES["fuzzy_verify"](spark, folder).collect()}
    assert set(got) == set(want) and 10 < sum(good for _, _, good in want.values()) < len(want) - 10
    for i, (quote, known, good) in want.items():
        loses, status = bool(quote) and not good, "partial" if i % 3 == 0 else "met"
        r = got[i]
        assert (r.status, r.quoted, r.confidence) == ("missing" if loses and status == "met" else status, bool(quote) and not loses, 0.3 if loses else 0.9), i
        assert r.evidence_chunk_ids == ([str(i if i % 2 == 0 else i + 1)] if known else [])


def test_verification_rate_equals_brute_force(spark, small):
    folder, rows = small
    plain = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    shown = verified = 0
    by = dict(rows)
    for i, (quote, known, _) in told_by_force(rows).items():
        if quote:
            shown += 1
            q, t = plain(quote), plain(by.get(i if i % 2 == 0 else i + 1, ""))
            verified += bool(known and len(q) <= len(t) and (q in t or best_window(q, t) >= 0.85))
    r = QUERIES["verification_rate"](spark, folder).first()
    assert (r.surfaced, r.verified) == (shown, verified) and r.rate == pytest.approx(verified / shown)


def test_partial_ratio_equals_dynamic_programming():
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (8, 20))
        if len(a) > len(b):
            a, b = b, a
        assert fuzzy.partial_ratio(a, b) == pytest.approx(1.0 if a in b else best_window(a, b))


def test_caps_leave_short_evidence_alone(spark):
    from veritrail.schemas import EVIDENCE

    row = {"requirements": [("r", "met", "quote", ["a"], 0.9)], "overall_summary": "s", "cover_letter_presence": None, "cover_letter_evidence": None, "overall_motivation": None}
    df = spark.createDataFrame([(row,)], __import__("pyspark").sql.types.StructType().add("e", EVIDENCE))
    got = df.select(matching.taken_in(F.col("e")).alias("e")).first().e
    assert tuple(got.requirements[0]) == ("r", "met", "quote", ["a"], 0.9) and got.cover_letter_evidence is None and got.overall_summary == "s"
