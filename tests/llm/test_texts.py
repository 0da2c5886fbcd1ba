"""BPE, secrets, decontamination, pseudonyms, toxicity and quality."""

import datetime
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.llm import bpe, decontaminate, pii, quality, queries, secret_scan, toxicity
from veritrail.llm.automaton import Automaton

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = queries.tokenizer_path()
LONG = "lorem ipsum " * 40_000
KEY = "a key"


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


BITS = ["a", "s", "'s", "'re", " ", "  ", "\t", "\n", " ", "　", " ", "é", "ß", "€", "!", "''", "9", "½", "中", "\U0001f642", "<|endoftext|>", "I'll", "\x85", "\x1c", "Ⅷ", "\r\n", "LL", "é", "<|", "|>", "​", "\x00", "the", "tion"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=4)), max_size=14))
def test_encoding_equals_the_library(coder, library, parts):
    t = "".join(parts)
    t = t.encode("utf-8", "ignore").decode()
    ids = library.encode(t, add_special_tokens=False).ids
    assert coder.encode(t) == ids and coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_and_broken_sequences(coder, library):
    r = random.Random(3)
    for n in (47, 48, 49, 300, 4000):
        for letters in ("ab", "thein", "0123456789abcdef", "é", "!?"):
            t = "".join(r.choice(letters) for _ in range(n))
            assert coder.encode(t) == library.encode(t, add_special_tokens=False).ids
    for ids in ([0, 50256, 128, 200], list(range(150, 260)), []):
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain(coder):
    tokens = [t for t in coder.bytes if len(t) > 1 and t != b"<|endoftext|>"]
    assert not any(coder.cuts[t[i] * 256 + t[i + 1]] for t in tokens for i in range(len(t) - 1))
    assert coder.cuts[ord("e") * 256 + ord(" ")] and coder.fragments(b"the cat sat")[1] == b" cat"


def test_coding_tables(spark, library):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, LONG, 9), (None, "café <|endoftext|>", 9), (5, "x", None), (5, "x", None)], "doc_id long, text string, ids int")
    out = bpe.encode_decode(df, PATH)
    rows = out.collect()
    assert len(rows) == 6 and all(r.ids == library.encode(t or "", add_special_tokens=False).ids for r, t in zip(rows, (None, "", LONG, "café <|endoftext|>", "x", "x")))
    assert [r.decoded for r in rows][:2] == ["", ""] and rows[2].decoded == LONG
    assert [r.ids for r in bpe.encode(df, PATH).collect()] == [r.ids for r in rows]
    assert [r.decoded for r in bpe.decode(out.select("doc_id", "ids"), PATH).collect()] == [r.decoded for r in rows]
    d = bpe.digests(out).where("doc_id = 1").first()
    assert d.n_tokens == 0 and d.ids_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" == d.decoded_sha256
    assert bpe.digests(bpe.encode_decode(df.limit(0), PATH)).count() == 0


def test_automaton_is_minimal_and_right():
    a = Automaton([("(ab|ac)x{2,}", False)], anywhere=False)
    run = lambda s: __import__("functools").reduce(lambda q, b: a.next[q][b] if q >= 0 else -1, s.encode(), 0)
    for s, ok in (("abxx", 1), ("acxxx", 1), ("abx", 0), ("axx", 0), ("", 0)):
        assert (run(s) >= 0 and a.accepts[run(s)] or 0) == ok
    assert len(a.next) <= 6  # start, a, ab=ac, x, xx+, dead
    either = Automaton([("k[0-9]?e+", True)], anywhere=True)
    q = 0
    for b in b"..K3E":
        q = either.next[q][b]
    assert either.accepts[q] == 1


def brute_spans(t, rules=secret_scan.RULES):
    out = []
    for k, r in enumerate(rules):
        prefix = re.sub(r"\((?!\?)", "(?:", r.prefix)
        for m in re.finditer(f"{'(?i:' + prefix + ')' if r.either_case else prefix}({r.tail}+)", t, re.A):
            if len(m[1]) >= r.least:
                out.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


SECRET_BITS = ["password", "PassWd", "secret", "token", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "abcdef", "0123456789", "deadbeef", "\n", "é", "ghp_", "a" * 20, "-----BEGIN RSA PRIVATE KEY-----", "eyJabc.", "xoxb-", "z", ".", "_", "A", "9"]


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner()


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(SECRET_BITS), max_size=14))
def test_spans_equal_regexes(scanner, parts):
    t = "".join(parts)
    assert scanner.spans(t) == brute_spans(t)


@pytest.mark.parametrize("text", ["eyJ" * 350_000 + "0123456789abcdef", "eyJa." * 200_000, "token" * 200_000 + "=abcdefghijklmnop", "token= " * 150_000, "AKIA" * 250_000, "password" + " " * 10**6 + "=abcdefghijklmnop", "-----BEGIN " * 90_000])
def test_long_texts_of_beginnings_take_linear_time(scanner, text):
    began = time.perf_counter()
    got = scanner.spans(text)
    assert time.perf_counter() - began < 10
    short = text[-6000:]
    assert scanner.spans(short) == brute_spans(short) and (not brute_spans(short) or got[-1][0] == brute_spans(short)[-1][0])


def test_scan_tables(spark):
    long = LONG + "token = abcdefghijklmnop " + LONG
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, long, "s"), (4, "é中 password: 'hunter2hunter2'", "s"), (4, "é中 password: 'hunter2hunter2'", None), (None, "AKIA" + "A" * 14, None)], "doc_id long, text string, spans string")
    got = secret_scan.scan(df).collect()
    assert [[tuple(s) for s in r.spans] for r in got] == [brute_spans(r[1] or "") for r in df.collect()]
    d = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(df)).collect()}
    assert d[4].spans == "assign:3:28" and d[4].n_assign == 1 and d[1].spans == "" and d[3].spans.startswith(f"assign:{len(LONG)}:")
    clean = secret_scan.redact(df.drop("spans").withColumn("kind", F.lit(1)))
    assert clean.columns == ["doc_id", "text", "kind"] and [r.text for r in clean.where("doc_id = 4 or doc_id < 3").collect()] == [None, "", "é中 [secret]'", "é中 [secret]'"]
    assert secret_scan.digests(secret_scan.scan(df.limit(0))).count() == 0


def test_decontamination(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(30)]
    swapped = [word() if i % 6 == 5 else w for i, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(20) + swapped + noise(9)).upper()), (3, " ".join(noise(200))), (4, None), (5, ""), (6, " ".join(item[:10] + noise(30))),
        (7, "alpha beta gamma"), (8, " ".join(noise(5000) + item)), (1, " ".join(noise(50) + item)), (9, " ".join(item[5:27])),
    ]
    items = [(10, ", ".join(item)), (11, "Alpha! beta."), (12, None), (13, ""), (14, "...")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = decontaminate.overlaps(df, bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in found) == [(1, 10), (1, 10), (2, 10), (7, 11), (8, 10), (9, 10)]
    assert {(x.doc_id, x.start, x.end) for x in found} >= {(8, 5000, 5030), (7, 0, 2), (9, 0, 22)}
    assert sorted((x.doc_id, x.item_id) for x in decontaminate.overlaps(df.withColumn("text", F.concat("text", F.lit(" "), "text")), bench).collect()) == [(1, 10), (1, 10), (2, 10), (7, 11), (8, 10), (9, 10)]
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_excerpts_at_the_edges_of_a_document():
    item = [f"w{i}" for i in range(40)]
    index, hashes = decontaminate.Index([(1, " ".join(item))]), decontaminate.WordHashes()
    noise = [f"n{i}" for i in range(30)]
    for n in range(15, 20):
        for words, start in ((noise + item[:n], 30), (item[-n:] + noise, 0)):
            assert index.match(hashes(words)) == [(0, start, start + n, n / 20)]
        assert [hit[3] for hit in index.match(hashes(noise + item[12 : 12 + n] + noise))] == [n / 20]
    assert index.match(hashes(noise + item[:14])) == [] and index.match(hashes(item[-14:] + noise)) == []


def test_short_documents_that_are_pieces_of_an_item():
    item = [f"w{i}" for i in range(200)]
    index, hashes = decontaminate.Index([(1, " ".join(item))]), decontaminate.WordHashes()
    for n in range(6, 25):
        assert index.match(hashes(item[50 : 50 + n])) == [(0, 0, n, 1.0 if n >= 8 else n / 8)]
    assert index.match(hashes(item[50:55])) == [] and index.match(hashes(item[50:55] + ["x", "y", "z"])) == []
    assert [hit[3] for hit in index.match(hashes(item[50:53] + ["x"] + item[54:60]))] == [0.9]


@pytest.mark.parametrize("n", range(1, 21))
def test_masks_leave_a_hit_whichever_words_differ(n):
    """Also where a document's edge cuts the stretch: what lies beyond it differs, and no mask reaches there."""
    for beyond in range(n // 4 + 1):
        for low, high in ((beyond, n), (0, n - beyond)):
            placed = [sum(1 << (at + i) for i, on in enumerate(m) if on == "1") for m in decontaminate.masks_for(n) for at in range(low, high - len(m) + 1)]
            for differ in itertools.combinations(range(low, high), n // 4 - beyond):
                bits = sum(1 << i for i in differ)
                assert any(not p & bits for p in placed)


def all_diagonals(items, doc):
    """item's index to agreement, by laying every item everywhere."""
    out = {}
    for i, item in enumerate(items):
        need = min(20, len(item), max(8, len(doc)))
        for shift in range(-len(item) + 1, len(doc)):
            same = [0 <= shift + j < len(doc) and doc[shift + j] == w for j, w in enumerate(item)]
            top = max(sum(same[j : j + need]) for j in range(len(item) - need + 1))
            if top >= 0.75 * need:
                out[i] = max(out.get(i, 0), top / need)
    return out


def doctored(items, r):
    """A document with a copy of an item, words substituted and cut off, and its words."""
    k = r.randrange(len(items))
    copy = [f"s{r.random()}" if r.random() < 0.2 else w for w in items[k]]
    a, b = (r.randrange(4), r.randrange(4)) if r.random() < 0.5 else (0, 0)
    if r.random() < 0.3:  # a piece, alone
        at = r.randrange(len(copy))
        return copy[at : at + r.randint(1, 22)]
    return [f"d{j}" for j in range(r.randrange(4))] + copy[a : len(copy) - b] + [f"e{j}" for j in range(r.randrange(4))]


def test_decontamination_equals_a_scan_of_all_diagonals():
    r, hashes = random.Random(11), decontaminate.WordHashes()
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate([*range(1, 26), 40])] + [["a", "b"] * 12, ["a"] * 30]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    found = 0
    for _ in range(1500):
        doc = doctored(items, r)
        want = all_diagonals(items, doc)
        assert {i: agree for i, _, _, agree in index.match(hashes(doc))} == want
        found += len(want)
    assert found > 500


def test_words_that_repeat_take_linear_time():
    hashes, items = decontaminate.WordHashes(), [["a"] * 400, ["a", "b"] * 200]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    began = time.perf_counter()
    assert index.match(hashes(["a"] * 20_000)) == [(0, 0, 400, 1.0)]
    assert index.match(hashes(["a", "b"] * 10_000)) == [(1, 0, 400, 1.0)]
    assert time.perf_counter() - began < 20


def test_both_ways_of_joining_a_benchmark_agree(spark, monkeypatch):
    r = random.Random(5)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate([*range(1, 26), 40, 40])] + [["a", "b"] * 12, ["a"] * 30]
    docs = [(k % 90, " ".join(doctored(items, r)) if k % 7 else None, k) for k in range(500)] + [(1, " ".join(["a"] * 500), 0), (2, "x " * 3000 + " ".join(items[25]) + " x" * 3000 + " " + " ".join(items[25][:30]), 0), (3, "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    bench = spark.createDataFrame([(f"k{i % 28}", " ".join(w), "x") for i, w in enumerate(items)] + [("none", None, "x"), ("bare", "?!", "x")], "item_id string, text string, words string")
    small = sorted(map(tuple, decontaminate.overlaps(df, bench, ("doc_id", "n")).collect()))
    kept = sorted(map(tuple, decontaminate.clean(df, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    large = decontaminate.overlaps(df, bench, ("doc_id", "n"))
    assert large.columns == ["doc_id", "n", "item_id", "start", "end", "agree"] and sorted(map(tuple, large.collect())) == small and len(small) > 50
    again = decontaminate.clean(df, bench)
    assert again.columns == df.columns and sorted(map(tuple, again.collect()), key=str) == kept
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.overlaps(df.withColumnRenamed("n", "start"), bench, ("doc_id", "start"))


def test_a_large_benchmark_is_matched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "a b c " + t) for i, t in items] + [(99, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()) == [(i, i) for i in range(6)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [99]


def check_digit(head):
    return head + next(str(d) for d in range(10) if pii.luhn(head + str(d)) == 0)


VALUES = {
    "card": ["4485275742308327", "4485 2757 4230 8327", "3714-496353-98431"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], "date": ["1984-02-29", "31.12.1999", "02/28/2001"],
    "ssn": ["123-45-6789", "899-01-0001"], "phone": ["+1 (436) 555-8670", "+1 (112) 555-8670", "(212) 555-0100", "212-555-0100"], "ip": ["42.179.73.104", "255.255.255.255"], "email": ["word.91@mail3.example.com", "A-b_9@x.example"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_pseudonyms_keep_their_format_and_can_be_inverted(kind, value):
    f = pii.Finder(KEY)
    [(a, b, got, new)] = f.find(f"x {value} y")
    assert (a, b, got) == (2, 2 + len(value), kind) and (len(new) == len(value) or kind == "ip") and new != value
    assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", new)) == re.sub(r"[A-Za-z]", "a", re.sub(r"\d", "0", value)) or kind == "ip"
    assert f.find(new)[0][2] == kind, "a pseudonym is valid itself"
    assert getattr(f.permuter, kind)(new, True) == value
    assert getattr(pii.Permuter("other key"), kind)(value) != new


@pytest.mark.parametrize("value", ["4485275742308328", "0000000000000000", "DE88370400440532013000", "1985-02-29", "32.01.2001", "13/13/2001", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "256.1.1.1", "01.2.3.4", "12345"])
def test_invalid_values_stay(value):
    assert pii.Finder(KEY).find(f"x {value} y") == []


def test_permutations_are_permutations():
    p = pii.Permuter(KEY)
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(p.permute(x, n, "t") for x in range(n)) == list(range(n))
        assert all(p.permute(p.permute(x, n, "t"), n, "t", True) == x for x in range(n))
    day = lambda s: datetime.date.fromisoformat(p.date(s))
    assert datetime.date(1900, 1, 1) <= day("2001-01-01") <= datetime.date(2099, 12, 31)


def iban(country, body):
    return f"{country}{98 - pii.iban_rest(country + '00' + body):02d}{body}"


def values_of(kind, r, n):
    """Random valid values of a kind, of all the formats and domains that it has."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    day = lambda: datetime.date.fromordinal(r.randint(pii.FIRST_DAY, pii.LAST_DAY))
    make = {
        "card": lambda: check_digit(r.choice("3456") + digits(r.choice((11, 13, 14, 17)))),
        "iban": lambda: iban(r.choice(("DE", "GB")), r.choice(("WEST", "")) + digits(r.choice((14, 18)))),
        "date": lambda: r.choice((lambda d: d.isoformat(), lambda d: d.strftime("%d.%m.%Y"), lambda d: d.strftime("%m/%d/%Y"), lambda d: d.strftime("%d/%m/%Y")))(day()),
        "ssn": lambda: f"{r.choice(pii.AREAS):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "phone": lambda: r.choice((f"({r.choice((555, 212, 155, 911, 311))}) {r.randint(0, 999):03d}-{digits(4)}", f"+1 {digits(3)} {digits(3)} {digits(4)}", f"+44 20 {digits(4)} {digits(4)}")),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "email": lambda: f"{r.choice('abc')}{r.choice('.-_')}{digits(1)}{r.choice('XYZ')}@{r.choice(('a.example', 'b.example'))}",
    }[kind]
    return {make() for _ in range(n)}


@pytest.mark.parametrize("kind", list(pii.PATTERNS))
def test_no_two_values_share_a_pseudonym(kind):
    p, r = pii.Permuter(KEY), random.Random(kind)
    made, forward = {}, getattr(p, kind)
    for v in values_of(kind, r, 15_000):
        new = forward(v)
        assert new is not None and forward(new, True) == v, v
        assert made.setdefault(new, v) == v, (v, made[new], new)
    assert len(made) > 100


def test_numbers_outside_the_plan_stay_outside():
    p = pii.Permuter(KEY)
    out = {p.phone(f"(555) {e:03d}-{n:04d}") for e in pii.NO_CODES for n in range(0, 10_000, 97)}
    assert len(out) == len(pii.NO_CODES) * len(range(0, 10_000, 97)) and all(int(v[6:9]) in pii.NO_CODES and v.startswith("(555) ") for v in out)
    assert p.phone("(555) 100-0000") != p.phone("(223) 646-1014") and p.iban("GB01WEST12345698765432") is None
    with pytest.raises(ValueError):
        pii.Permuter("")


PIECES = {k: [v for v in vs if not (k == "phone" and v[0] not in "+(")] for k, vs in {"card": ["4485275742308327"], "iban": ["DE89370400440532013000"], "date": ["1984-02-29", "02/28/2001", "25/12/2024"], "ssn": ["123-45-6789"], "phone": ["+1 (436) 555-8670", "(555) 100-0000"], "ip": ["42.179.73.104"], "email": ["word.91@mail3.example.com"]}.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(PIECES)), st.integers(0, 5), st.sampled_from([" and ", "; ", "\n", " (x), "])), max_size=6))
def test_finds_equal_what_was_planted(parts):
    f, t, want, out = pii.Finder(KEY), "", [], ""
    for kind, i, gap in parts:
        v = PIECES[kind][i % len(PIECES[kind])]
        t, out = t + gap, out + gap
        want.append((len(t), len(t) + len(v), kind, getattr(f.permuter, kind)(v)))
        t, out = t + v, out + want[-1][3]
    assert f.find(t) == want
    back = f.find(out)
    assert [x[2] for x in back] == [x[2] for x in want] and [getattr(f.permuter, k)(out[a:b], True) for a, b, k, _ in back] == [t[a:b] for a, b, _, _ in want]


def test_pseudonymise_replaces_a_column_of_the_name_of_its_spans(spark):
    df = spark.createDataFrame([(1, "on 2001-02-03", "old"), (1, "on 2001-02-03", "old")], "doc_id long, text string, SPANS string")
    rows = pii.pseudonymise(df, KEY).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and [tuple(s) for s in rows[0].spans] == [("date", 3, 13)]


def test_pseudonymise_tables(spark):
    card = check_digit("424242424242424")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, f"{card} and {card}, {LONG}", 1), (4, f"pay {card} on 2001-02-03", 1), (4, "clean", None)], "doc_id long, text string, kind int")
    out = pii.pseudonymise(df, KEY)
    r = {x.doc_id: x for x in out.where("text <> 'clean' or text is null").collect()}
    assert r[1].text is None and r[2].text == "" and out.where("text = 'clean'").count() == 1
    new = r[4].text.split()[1]
    assert new != card and r[3].text.startswith(f"{new} and {new}, lorem") and pii.luhn(new) == 0 and [s.kind for s in r[4].spans] == ["card", "date"]
    assert pii.summary(out).where("doc_id = 3").first().n_values == 2 and pii.summary(pii.pseudonymise(df.limit(0), KEY)).count() == 0


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    n, starts = 200, np.array([0, 3, 70, 71, 150])
    d, trans, first = rng.normal(size=n) * 2, np.array([[0.9, 0.2], [0.4, 1.3]]), np.array([0.8, 0.3])
    got = toxicity.marginals(d, starts, trans, first)
    for a, b in zip(starts, [*starts[1:], n]):
        psi = 1 / (1 + np.exp(-np.stack([-d[a:b], d[a:b]], 1)))
        if b - a <= 3:  # over all paths
            import itertools

            total = np.zeros((b - a, 2))
            for path in itertools.product((0, 1), repeat=b - a):
                w = first[path[0]] * psi[0][path[0]]
                for t in range(1, b - a):
                    w *= trans[path[t - 1], path[t]] * psi[t][path[t]]
                for t, y in enumerate(path):
                    total[t, y] += w
            assert np.allclose(total[:, 1] / total.sum(1), got[a:b])
    assert len(toxicity.marginals(np.zeros(0), np.zeros(0, int), trans, first)) == 0


@pytest.mark.parametrize(
    "before, value, after, kind",
    [
        ("", "4485275742308327", " 123", "card"), ("", "4485 2757 4230 8327", " 12/27", "card"), ("", "4485-2757-4230-8327", " 12", "card"), ("10 30 ", "4485 2757 4230 8327", "", "card"), ("7 ", "4485275742308327", " 123", "card"),
        ("", "BE68 5390 0754 7034", " PAID", "iban"), ("", "BE68539007547034", " AMOUNT DUE", "iban"), ("AB12 CDEF ", "BE68 5390 0754 7034", " IN", "iban"),
    ],
)
def test_a_valid_number_among_other_groups(before, value, after, kind):
    f = pii.Finder(KEY)
    (a, b, k, new), = f.find(f"{before}{value}{after}")
    assert (a, b, k) == (len(before), len(before) + len(value), kind) and new != value
    assert getattr(f.permuter, kind)(new, inverse=True) == value


@pytest.mark.parametrize("value, kind, kept", [("+44 20 7946 0958", "phone", "+44 "), ("+33 1 42 68 53 00", "phone", "+33 "), ("+49 (0)30 901820", "phone", "+49 ("), ("+353.1.679.3100", "phone", "+353."), ("25/12/2024", "date", "")])
def test_numbers_and_dates_of_other_countries(value, kind, kept):
    f = pii.Finder(KEY)
    (a, b, k, new), = f.find(f"on {value}, or")
    assert (a, b, k) == (3, 3 + len(value), kind) and new != value and new.startswith(kept)
    assert getattr(f.permuter, kind)(new, inverse=True) == value and [x[2] for x in f.find(new)] == [kind]
    assert f.find("+45.123456789 or 32/12/2024") == []


def toxic_corpus(n=400):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["zzidiot", "zzscum", "zztrash"]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        rows.append((i, " ".join(w).capitalize() + ".", int(y)))
    return rows


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_toxicity_training_is_not_shortened():
    assert toxicity.STEPS >= 40


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(None, "Zzidiot, zzscum zztrash!", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1002, "zzidiot " * 30_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if held(i, 4) != 2] + [(1000, 1), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.tag(docs, model).collect()}
    test = [(i, y) for i, _, y in rows if held(i, 4) == 2]
    assert sum(got[i].predicted == y for i, y in test) / len(test) > 0.97
    assert got[None].predicted == 1 and got[1002].predicted == 1 and 0 <= got[1000].score < 0.3 and got[1000].score == got[1001].score
    i, t, _ = next(x for x in rows if x[2])
    assert {t[s.start : s.end].lower() for s in got[i].spans} & {"zzidiot", "zzscum", "zztrash"} and got[1001].spans == []
    assert toxicity.tag(docs.limit(0), model).count() == 0
    again = toxicity.train(docs.repartition(7), labels)
    assert {r.doc_id: r.score for r in toxicity.tag(docs, again).collect()} == {k: r.score for k, r in got.items()}
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.tag(docs, none).where("score between 0 and 1").count() == docs.count()


def test_spans_are_offsets_of_the_given_text():
    t = "İİ Idiot! İst Trash ΣΑΣ"
    words = toxicity.WORD.findall(t.lower())
    p = np.array([float(w in ("idiot", "trash")) for w in words])
    assert [t[s["start"] : s["end"]] for s in toxicity.spans_of(t, p)] == ["Idiot", "Trash"]
    assert toxicity.spans_of("Idiot trash x", np.array([0.5, 0.5, 0.49])) == [{"start": 0, "end": 11}]


def test_the_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] + [(100, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    count = lambda **k: quality.labelled_sample(docs, labels, "quality", 40, **k).count()
    assert (count(), count(size=10_000), count(size=1), count(size=10**9)) == (40, 10, 1, 40)


def test_scores_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 7), (1, "a b", "old", 7), (2, None, None, 7)], "doc_id long, text string, Score string, predicted int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == 3 and out.where("score between 0 and 1").count() == 3


def test_quality_held_out(spark):
    r = random.Random(2)
    rows = []
    for i in range(500):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))]
        y = i % 3 != 0
        rows.append((i, " ".join(w).capitalize() + "." if y else " ".join([w[0]] * 30 + [x + "###" for x in w[:10]]), int(y)))
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows] + [(None, "x", 1), (1000, None, 1), (1001, "", 1), (1002, LONG, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if held(i, 5) != 0] + [(1000, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.score(docs, model).collect()}
    test = [(i, y) for i, _, y in rows if held(i, 5) == 0]
    assert sum(got[i].predicted == y for i, y in test) / len(test) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values()) and got[1000].score == got[1001].score
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}
    assert quality.score(docs.limit(0), model).count() == 0
    assert len(quality.statistics(None)) == len(quality.FEATURES) == len(quality.statistics(LONG))
    flat = quality.train(docs, labels.limit(0))
    assert quality.score(docs, flat).select("score").distinct().count() == 1


def test_forest_equals_its_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    f = quality.fit(x, y, trees=30, depth=3)
    s = f.score(x)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97

    def walk(row, i):
        while f.left[i] != i:
            i = f.left[i] if row[f.feature[i]] <= f.threshold[i] else f.right[i]
        return f.value[i]

    for k in range(0, 500, 50):
        assert s[k] == pytest.approx(1 / (1 + np.exp(-(f.base + sum(walk(x[k], r) for r in f.root)))))
