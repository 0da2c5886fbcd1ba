import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veritrail.sources import files, manifests, memo, tables
from veritrail.streaming import outbox as ob
from veritrail.streaming import sessions


def docx(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in entries.items():
            z.writestr(n, c)
    return out.getvalue()


def test_pages_of_all_kinds(spark, tmp_path):
    for name, data in {"a.txt": "caf\u00e9\x00".encode(), "b.txt": b"\xff\xfe latin", "c.docx": docx("One", "Two"), "d.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364?}", "e.docx": b"PK\x03\x04broken", "f.pdf": b"%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(data)
    blobs = tables.read_blobs(spark, str(tmp_path))
    assert [r.key for r in blobs.orderBy("key").collect()][:2] == ["a.txt", "b.txt"]
    got = {r.path: r for r in files.pages(blobs.select(F.col("key").alias("path"), "content")).collect()}
    assert got["a.txt"].text == "caf\u00e9" and got["b.txt"].text == "\u00ff\u00fe latin" and got["c.docx"].text == "One\nTwo"
    assert got["d.rtf"].text == "Hello bold\ncaf\u00e9 \u20ac" and got["d.rtf"].warning == files.SPARSE_WARNING
    assert got["e.docx"].error and got["f.pdf"].error
    empty = spark.createDataFrame([("g.txt", bytearray(b"")), ("n.txt", None)], "path string, content binary")
    assert [r.text for r in files.pages(empty).collect()] == ["", ""]


def test_mime_and_extension(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1")), ("a.docx", bytearray(b"PK\x03\x04x")), ("a.rtf", bytearray(b"  \n{\\rtf1")), ("a.txt", bytearray(b"hi")), ("a.pdf", bytearray(b"hi")), ("a", bytearray(b"hi")), ("a.exe", bytearray(b"hi"))], "n string, c binary")
    assert [r[0] for r in df.select(files.mime_agrees(F.col("n"), F.col("c"))).collect()] == [True, True, True, True, False, False, False]


def test_archives(spark):
    big = zipfile.ZipFile(io.BytesIO(), "w")
    big.close()
    df = spark.createDataFrame(
        [("ok", bytearray(archive(**{"x/a.txt": "A", "b.PDF": "B"}))), ("up", bytearray(archive(**{"../a.txt": "A", "b.txt": "B"}))), ("ext", bytearray(archive(**{"a.exe": "A"}))), ("many", bytearray(archive(**{f"{i}.txt": "" for i in range(51)}))), ("bad", bytearray(b"no zip")), ("abs", bytearray(archive(**{"C:\\a.txt": ""})))],
        "path string, content binary",
    )
    got = files.archive_entries(df).collect()
    assert [(r.entry, bytes(r.content)) for r in got if r.path == "ok"] == [("x/a.txt", b"A"), ("b.PDF", b"B")]
    assert {r.path for r in got if r.error} == {"up", "ext", "many", "bad", "abs"} and sum(r.path == "up" for r in got) == 1


def test_archive_that_grows_is_rejected(monkeypatch):
    monkeypatch.setattr(files, "ENTRY_BYTES", 1000)
    with pytest.raises(ValueError, match="cap"):
        files.expand_archive(archive(**{"a.txt": "0" * 1001}))


def test_job_text(spark):
    df = spark.createDataFrame([('{"jd": "Do it", "description": " "}',), ('{"x": 1}',), ("plain",)], "t string")
    assert [r[0] for r in df.select(files.job_text(F.col("t"))).collect()] == ["Do it", '{"x": 1}', "plain"]


def test_manifests(spark, tmp_path):
    docs = [
        (1, '{"applicants": [{"resume_file": "x/A.pdf", "cover_letter_file": "C.pdf", "cover_letter_flag": "Yes"}, {"resume_file": "a.PDF", "cover_letter_file": "C.pdf", "cover_letter_flag": "no"}, {"resume_file": "b.pdf", "cover_letter_file": "c2.pdf"}, {"resume_file": " "}]}'),
        (2, "[]"), (3, "not json"),
    ]
    got = manifests.pairing_rows(spark.createDataFrame(docs, "batch int, content string")).collect()
    assert {(r.resume_key, r.cover_key) for r in got if r.batch == 1} == {("a.pdf", None), ("b.pdf", "c2.pdf")}
    assert {r.batch for r in got if r.error} == {2, 3}
    names = ["Ann-Lee_resume.pdf", "ann lee cover letter.docx", "Ann_Lee-CV.pdf", "bob.txt", "zoe_coverletter.pdf", "c.pdf", "cl.pdf"]
    up = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "batch int, at int, filename string")
    pairs = spark.createDataFrame([(1, "c.pdf", "cl.pdf"), (1, "bob.txt", "no.pdf"), (1, "gone.pdf", None)], "batch int, resume_key string, cover_key string")
    out = {r.resume: r for r in manifests.paired(up, pairs).collect()}
    assert out["c.pdf"].cover == "cl.pdf" and out["bob.txt"].note and out["gone.pdf"].reason and out["Ann-Lee_resume.pdf"].cover == "ann lee cover letter.docx"
    assert out["Ann_Lee-CV.pdf"].cover is None and "without" in out["zoe_coverletter.pdf"].note and len(out) == 6
    (tmp_path / "m.csv").write_text(" FileName ,title,min_years,blind_review,seniority\nX/a.pdf,Dev,3,YES,senior\nb.pdf,,x,,\n,skip,,,\nc.pdf,,,no,lord\n")
    rows = {r.key: r for r in manifests.read_job_manifest(spark, str(tmp_path / "m.csv"), ("full_time",), ("senior",)).collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "c.pdf"} and rows["a.pdf"].min_years == 3 and rows["a.pdf"].blind_review is True and rows["b.pdf"].error == "min_years" and rows["c.pdf"].error == "seniority" and rows["c.pdf"].blind_review is False
    with pytest.raises(ValueError):
        (tmp_path / "n.csv").write_text("name\nx\n")
        manifests.read_job_manifest(spark, str(tmp_path / "n.csv"), (), ())


def test_memo_embeds_misses_only(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, ""), (4, None)], "id int, text string")
    empty = spark.createDataFrame([], "key string, vector array<double>, cached_at timestamp")
    out, new = memo.read_through(texts, empty, lambda t: memo.bag_of_words(t, 16), "m")
    got = {r.id: r.vector for r in out.collect()}
    assert got[1] == got[2] and sum(got[1]) == 2.0 and sum(got[3]) == 0.0 and got[4] is None and new.count() == 2
    again, rest = memo.read_through(texts, new.withColumn("cached_at", F.lit("2024-01-01").cast("timestamp")), lambda t: memo.bag_of_words(t, 16), "m")
    assert rest.count() == 0 and {r.id: r.vector for r in again.collect()} == got


def event(i, who, kind, payload):
    return (i, "resume", who, kind, payload, None, None, 0)


EVENTS = "id long, aggregate string, aggregate_id string, event_type string, payload string, created_at timestamp, delivered_at timestamp, delivery_attempts int"
ONE = '{"skills": [{"name": "Python", "years": 3}, {"name": "python", "years": 9}, {"name": " "}]}'
TWO = '{"skills": [{"name": "Go", "years": 1, "evidence_chunk_ids": ["c_002", "c_001"]}]}'


def test_outbox_routes_poison_and_budget(spark):
    o = spark.createDataFrame([event(1, "a", "resume.parsed", ONE), event(2, "b", "resume.parsed", "not json"), event(3, "a", "odd", "{}"), event(4, "a", "resume.withdrawn", "{}"), event(5, "c", "resume.parsed", TWO)], EVENTS)
    r = ob.routed(o)
    assert {k: [x.id for x in v.collect()] for k, v in r.items()} == {"job.parsed": [], "resume.parsed": [1, 5], "resume.withdrawn": [4], "poison": [2], "unknown": [3]}
    assert [tuple(x) for x in ob.failed(o, r["poison"]).collect()] == [(2, 1, "PayloadError")]
    assert [x.id for x in ob.next_batch(o, budget=3).orderBy("id").collect()] == [1, 2, 3, 4]
    edges, seen = ob.resume_changes(o.where("id <> 2"))
    assert [tuple(x) for x in edges.collect()] == [("c", "go", 1, None, "c_002")] and {x.resume_id for x in seen.collect()} == {"a", "c"}


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    base, inbox = str(tmp_path / "state"), tmp_path / "inbox"
    cols = ["id", "aggregate", "aggregate_id", "event_type", "payload", "created_at"]
    first = spark.createDataFrame([event(1, "a", "resume.parsed", ONE), event(2, "b", "resume.parsed", ONE)], EVENTS).select(cols)
    second = spark.createDataFrame([event(3, "a", "resume.parsed", TWO), event(4, "b", "resume.withdrawn", "{}"), event(5, "x", "resume.parsed", "broken")], EVENTS).select(cols)
    read = lambda: sorted(tuple(r) for r in ob.read_edges(spark, base).collect())
    first.coalesce(1).write.json(str(inbox / "1"))
    ob.drain(spark, str(inbox / "*"), base)
    assert [r[:3] for r in read()] == [("a", "python", 3), ("b", "python", 3)]
    second.coalesce(1).write.json(str(inbox / "2"))
    ob.drain(spark, str(inbox / "*"), base)
    want = read()
    assert [r[:3] for r in want] == [("a", "go", 1)]
    ob.drain(spark, str(inbox / "*"), base)
    assert read() == want
    ob.apply_batch(base)(second, 1)  # a batch that runs again
    assert read() == want
    edges, _ = ob.resume_changes(first.unionByName(second).where("id <> 5"))
    assert sorted(tuple(r) for r in edges.collect()) == want
    assert spark.read.parquet(f"{base}/poison").where("id = 5").count() == 1


def test_sessions(spark, tmp_path):
    s = spark.createDataFrame([(1, "2024-01-01 01:10:00", None), (2, "2024-01-01 03:00:00", None), (3, "2024-01-01 01:10:00", "2024-01-01 00:00:00"), (4, "2024-01-01 00:59:00", None)], "id int, expires_at string, revoked_at string")
    s = s.select("id", F.col("expires_at").cast("timestamp").alias("expires_at"), F.col("revoked_at").cast("timestamp").alias("revoked_at"))
    now = F.expr("TIMESTAMP '2024-01-01 01:00:00'")
    assert {r.id for r in sessions.active(s, now).collect()} == {1, 2}
    assert {r.id: r.extended for r in sessions.refreshed(s, now, 7200, 1800).collect()} == {1: True, 2: False, 3: False, 4: False}
    spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:05:00"), ("u", "2024-01-01 02:00:00"), ("v", "2024-01-03 00:00:00")], "u string, at string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, at string").json(str(tmp_path / "in"))
    q = sessions.sessionised(stream, "u", "at", "10 minutes", "1 hour").writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.u, r.n) for r in spark.table("got").collect()} == {("u", 2), ("u", 1)}


def test_vocabulary_files(spark, tmp_path):
    from veritrail.sources import vocabulary as v

    (tmp_path / "a.json").write_text('[{"canonical": "Go", "aliases": ["golang"]}]')
    (tmp_path / "f.json").write_text('{"web": ["Flask ", "go"], "sys": ["go"]}')
    assert sorted(map(tuple, v.read_aliases(spark, str(tmp_path / "a.json")).collect())) == [("go", "go"), ("golang", "go")]
    assert sorted((r.skill, r.families) for r in v.read_families(spark, str(tmp_path / "f.json")).collect()) == [("flask", ["web"]), ("go", ["sys", "web"])]
    assert v.read_aliases(spark, str(tmp_path / "none.json")).count() == 0


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    import json

    base, box = str(tmp_path / "edges"), tmp_path / "inbox"
    box.mkdir()
    event = lambda i, who, kind, payload: json.dumps({"id": i, "aggregate": "resume", "aggregate_id": who, "event_type": kind, "payload": payload, "created_at": "2024-01-01T00:00:00Z"})
    good = lambda *names: json.dumps({"skills": [{"name": n, "years": 1, "last_used_year": 2000, "evidence_chunk_ids": ["c"]} for n in names]})
    (box / "a.json").write_text("\n".join(event(i, f"r{i}", "resume.parsed", good("Go", "go ", "SQL")) for i in range(40)))
    ob.drain(spark, str(box), base)
    (box / "b.json").write_text("\n".join([event(100, "r3", "resume.parsed", good("Rust")), event(101, "r4", "resume.withdrawn", "{}"), event(102, "r5", "resume.parsed", "[]")]))
    ob.drain(spark, str(box), base)
    rows = {(r.resume_id, r.skill) for r in ob.read_edges(spark, base).collect()}
    assert rows == {(f"r{i}", s) for i in range(40) if i not in (3, 4) for s in ("go", "sql")} | {("r3", "rust")}
    wrote = {p.name for p in (tmp_path / "edges" / "edges" / "batch=000000001").iterdir() if p.name.startswith("bucket=")}
    assert 1 <= len(wrote) <= 2
    ob.apply_batch(base)(spark.read.schema(ob.EVENTS).json(str(box / "b.json")), 1)  # the same batch again changes nothing
    assert {(r.resume_id, r.skill) for r in ob.read_edges(spark, base).collect()} == rows
    assert [(r.id, r.delivery_attempts) for r in ob.set_aside(spark, base).collect()] == [(102, 1)]
    ob.retry(spark, base)
    assert [(r.id, r.delivery_attempts, r.last_error) for r in ob.set_aside(spark, base).collect()] == [(102, 2, "PayloadError")]
    ob.retry(spark, base, spark.createDataFrame([(102, good("C"))], "id long, payload string"))
    assert {r.skill for r in ob.read_edges(spark, base).where("resume_id = 'r5'").collect()} == {"c"}
    assert ob.read_edges(spark, str(tmp_path / "none")).count() == 0 == ob.set_aside(spark, str(tmp_path / "none")).count()


def test_blobs_are_put_listed_and_deleted(spark, tmp_path):
    import stat

    from veritrail.sources import tables

    base = str(tmp_path / "blobs")
    for key, data in (("b/2.bin", b"\x00\xff"), ("a.txt", b"one"), ("b/1.bin", b"x")):
        tables.put_blob(spark, base, key, data)
    got = tables.read_blobs(spark, base).orderBy("key").collect()
    assert [(r.key, bytes(r.content), r.length) for r in got] == [("a.txt", b"one", 3), ("b/1.bin", b"x", 1), ("b/2.bin", b"\x00\xff", 2)]
    assert stat.S_IMODE((tmp_path / "blobs" / "a.txt").stat().st_mode) == 0o600 and stat.S_IMODE((tmp_path / "blobs" / "b").stat().st_mode) == 0o700
    assert tables.delete_blob(spark, base, "a.txt") and not tables.delete_blob(spark, base, "a.txt")
    for bad in ("", "/a", "../a", "a/../../b"):
        with pytest.raises(ValueError):
            tables.put_blob(spark, base, bad, b"")


def test_folders_must_be_shared():
    from veritrail.sources import tables

    far = lambda **conf: type("S", (), {"conf": {k.replace("_", "."): v for k, v in conf.items()}, "sparkContext": type("C", (), {"master": "yarn"})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch_folder(far(spark_sql_warehouse_dir="file:/home/me"), "x")


def test_forms(spark):
    from veritrail.functions import text_forms

    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert df.select(text_forms.rendered("{{x}}-{{ y }}.", x=F.col("x"), y=F.col("y"))).first()[0] == "a-."
    with pytest.raises(KeyError):
        text_forms.rendered("{{ x }} {{ z }}", x=F.lit(1))
    calls = spark.createDataFrame([([(0.0, False), (1.0, False), (2.0, True), (12.0, False), (13.0, False), (14.0, True), (30.0, True), (31.0, False)],), ([],)], "c array<struct<at:double,ok:boolean>>")
    got = [r[0] for r in calls.select(text_forms.breaker(F.col("c"), 2, 10)).collect()]
    assert got == [["closed", "open", "refused", "half-open", "open", "refused", "half-open", "closed"], []]
