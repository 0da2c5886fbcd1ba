"""WARC archives, sharding, and the pipeline."""

import base64
import hashlib
import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import shard, warc
from veritrail.llm.common import Scratch, shared_folder, slices

zstd = pytest.importorskip("zstandard")


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def record(page=1, payload=b"<p>hi</p>", **more):
    return warc.format_record("response", page, "http://a.example/x", digest(payload), len(payload), payload, None, "2024-01-01T00:00:00Z")


def test_frames_are_measured_by_their_headers():
    for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
        for data in (b"", b"a", b"ab" * 100_000, os.urandom(300_000), bytes(500_000)):
            f = zstd.ZstdCompressor(**options).compress(data)
            assert warc.frame_length(f + b"tail", 0) == len(f)
            with pytest.raises(ValueError):
                warc.frame_length(f[:-1], 0)


def test_round_trip_with_a_dictionary():
    records = [record(i, f"<html><body>page {i} {'common words ' * (i % 7)}</body></html>".encode()) for i in range(300)]
    content = warc.pack(records)
    assert struct.unpack_from("<I", content)[0] == warc.DICTIONARY_MAGIC and struct.unpack_from("<I", content, 4)[0] > 1000
    assert [d for _, d, e in warc.unpack(content) if e is None] == records
    size = struct.unpack_from("<I", content, 4)[0]
    small = zstd.ZstdCompressor().compress(content[8 : 8 + size])  # a dictionary that is compressed itself
    assert [d for _, d, _ in warc.unpack(struct.pack("<II", warc.DICTIONARY_MAGIC, len(small)) + small + content[8 + size :])] == records
    plain = b"".join(map(zstd.ZstdCompressor().compress, records[:3]))
    assert [d for _, d, _ in warc.unpack(plain)] == records[:3]
    for few in ([record()], [record(1, b"")], [record(payload=os.urandom(5000))]):
        assert [d for _, d, _ in warc.unpack(warc.pack(few))] == few


def test_records_are_validated():
    good = record()
    assert warc.parse_record(good)["payload"] == b"<p>hi</p>"
    for bad in (
        good[:-4], good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"Content-Length: 9", b"Content-Length: 8"), good.replace(b"<p>hi", b"<p>ho"), good.replace(digest(b"<p>hi</p>").encode(), digest(b"x").encode()), b"", b"\r\n\r\n",
    ):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    odd = warc.format_record("response", None, "http://x/\r\nWARC-Type: revisit", digest(b""), 0, b"", None, "d")
    got = warc.parse_record(odd)
    assert got["record_type"] == "response" and got["page_id"] is None and got["payload_bytes"] == 0


def other_record(kind, content, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2024-01-01T00:00:00Z", *more, *([f"Content-Type: {content}"] if content else []), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark):
    http = "application/http; msgtype=response"
    records = [
        (other_record("warcinfo", "application/warc-fields", b"software: x\r\n"), "warcinfo", b"software: x\r\n", 13),
        (other_record("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", 27),
        (other_record("metadata", None, b""), "metadata", b"", 0),
        (other_record("response", "text/dns", b"a. 1 IN A 1.2.3.4"), "response", b"a. 1 IN A 1.2.3.4", 17),
        (other_record("response", http, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'hi')}"), "response", b"2\r\nhi\r\n0\r\n\r\n", 12),
        (other_record("response", http, b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhi"), "response", b"hi", 2),
        (other_record("revisit", http, b"HTTP/1.1 304 Not Modified\r\nServer: x\r\n\r\n", "WARC-Refers-To: <urn:uuid:0>"), "revisit", None, None),
    ]
    df = spark.createDataFrame([("a", warc.pack([r for r, *_ in records]))], "archive string, content binary")
    got = warc.read(df).orderBy("offset").collect()
    assert [(r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.error) for r in got] == [(k, p, n, None) for _, k, p, n in records]
    for bad in (other_record("response", http, b"hi"), other_record("response", http, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nhi"), records[4][0].replace(b"\r\nhi", b"\r\nho")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_reading_goes_on_after_damage():
    rng = np.random.default_rng(3)
    records = [record(i, rng.bytes(200) + b"word " * (i * 9)) for i in range(40)]
    content = warc.pack(records)
    at = [o for o, _, _ in warc.unpack(content)] + [len(content)]
    for _ in range(150):
        k = int(rng.integers(1, 39))
        flip, cut, junk = bytearray(content), int(rng.integers(1, 300)), rng.bytes(int(rng.integers(1, 300)))
        place = int(rng.integers(at[k], at[k + 1]))
        flip[place] ^= int(rng.integers(1, 256))
        for bad, hit in ((bytes(flip), {k}), (content[:place] + content[place + cut :], {i for i in range(40) if at[i] < place + cut and at[i + 1] > place}), (content[:place] + junk + content[place:], {k})):
            got = {d for _, d, e in warc.unpack(bad) if e is None}
            assert {i for i, r in enumerate(records) if r not in got} <= hit


def test_archives_are_read_in_pieces_and_within_bounds(monkeypatch):
    records = [record(i, bytes(i * 37 % 5000)) for i in range(50)]
    content = warc.pack(records)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    assert [d for _, d, _ in warc.unpack(io.BytesIO(content))] == records
    open_end = zstd.ZstdCompressor(write_content_size=False)
    bombs = open_end.compress(bytes(10**7)) + zstd.ZstdCompressor().compress(bytes(10**7)) + open_end.compress(records[0])
    got = list(warc.unpack(bombs, most=100_000))
    assert [e for _, _, e in got] == ["larger than the bound", "larger than the bound", None] and got[2][1] == records[0]
    skips = struct.pack("<II", 0x184D2A51, 5) + b"abcde" + zstd.ZstdCompressor().compress(records[0]) + struct.pack("<II", 0x184D2A50, 10**6)
    assert [d for _, d, e in warc.unpack(skips) if e is None] == records[:1]


def test_headers_that_contradict_each_other_are_told():
    good = record()
    for bad in (good.replace(b"Content-Type: app", b"Content-Length: 1\r\nContent-Type: app"), good.replace(b"WARC-Type: response", b"WARC-Type: response\r\nwarc-type: revisit")):
        with pytest.raises(ValueError, match="two headers"):
            warc.parse_record(bad)
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\nContent-Length: 3\r\n\r\nhi"
    with pytest.raises(ValueError, match="two lengths"):
        warc.parse_record(other_record("response", "application/http; msgtype=response", block))


def test_archives_as_files(spark, tmp_path, monkeypatch):
    rows = [(1, "u1", "same"), (7, "u7", "same"), (4, None, None), (6, "u6", "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    made = warc.write_files(df, str(tmp_path / "out")).collect()
    files = sorted(p for p in (tmp_path / "out").iterdir())
    assert sorted(r.archive for r in made) == [f"file://{p}" for p in files] and {r.bytes for r in made} == {p.stat().st_size for p in files}
    (tmp_path / "out" / "broken.warc.zst").write_bytes(b"no archive")
    (tmp_path / "out" / "other.txt").write_bytes(b"no archive")

    def told():
        got = warc.read_files(spark, str(tmp_path / "out")).collect()
        return sorted((str(r.record_type), str(r.page_id), str(r.refers_to), len(r.payload or b""), str(r.error)) for r in got)

    whole = told()
    assert [x for x in whole if x[0] in ("response", "revisit")] == [("response", "4", "None", 0, "None"), ("response", "6", "None", 250_000, "None"), ("response", "7", "None", 4, "None"), ("revisit", "1", "7", 0, "None")]
    assert len([x for x in whole if x[0] == "warcinfo"]) == len(files) and len([x for x in whole if x[4] != "None"]) == 1
    monkeypatch.setattr(warc, "WHOLE_BYTES", 0)
    assert told() == whole  # as streams
    gone = warc.read_streams(spark.createDataFrame([("file:///nowhere/x.warc.zst",)], "archive string")).collect()
    assert [r.error for r in gone] == ["cannot be opened: FileNotFoundError"]


def test_payloads_are_shuffled_only_for_a_large_table_of_repetitions(spark):
    df = spark.createDataFrame([(i, "u", f"page {i // 2}") for i in range(40)], "page_id long, url string, html string")
    plan = warc.archives(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_corrupt_archives_are_told(spark):
    content = warc.pack([record(i) for i in range(5)])
    broken = bytearray(content)
    broken[-3] ^= 0xFF
    df = spark.createDataFrame([("ok", bytearray(content)), ("cut", bytearray(content[:-5])), ("flip", broken), ("empty", bytearray()), ("junk", bytearray(b"junk"))], "archive string, content binary")
    errors = {r.archive: r.n for r in warc.read(df).groupBy("archive").agg(F.count("error").alias("n")).collect()}
    assert errors == {"ok": 0, "cut": 1, "flip": 1, "junk": 1}


def test_pages_to_archives_and_back(spark, tmp_path):
    rows = [(1, "u1", "same"), (7, "u7", "same"), (3, None, "same"), (4, "u4", None), (5, "u5", ""), (6, "u6", "café " * 100_000), (None, "u", "same"), (7, "u7", "same"), (8, "u8", "own")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, payload int").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    keep = {"same": 7, "": 5, rows[5][2]: 6, "own": 8}
    want = []
    for i, _, h in rows:
        b, k = (h or "").encode(), keep[h or ""]
        want.append((i, len(b), digest(b), "response" if i == k else "revisit", None if i == k else k))
    assert got == sorted(want, key=str)
    least = warc.round_trip(df, least=5).collect()
    assert all(r.record_type == "response" for r in least if r.payload_bytes < 5)
    assert warc.round_trip(df.limit(0)).count() == 0
    for r in warc.archives(df).collect():
        (tmp_path / r.archive).write_bytes(bytes(r.content))
    files = warc.read_files(spark, str(tmp_path)).collect()
    assert len(files) == len(rows) and {bytes(r.payload) for r in files if r.record_type == "response"} == {b"same", b"", rows[5][2].encode(), b"own"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 1000, 4097])
def test_permutation_and_inverse(n):
    p = shard.permute(np.arange(n), n, 17)
    assert sorted(p.tolist()) == list(range(n)) and (shard.unpermute(p, n, 17) == np.arange(n)).all()
    assert n < 40 or (p != shard.permute(np.arange(n), n, 18)).any()


def test_equal_texts_are_dealt_like_any_others(spark):
    df = spark.createDataFrame([(i, "same") for i in range(4000)], "doc_id long, text string")
    out = shard.assign(df, 40, Scratch(spark))
    assert out.select("text_crc32").distinct().count() == 1 and {r["count"] for r in out.groupBy("shard").count().collect()} == {100}


def test_scratch_tables(spark, tmp_path):
    s = Scratch(spark)
    kept = s.keep(spark.range(3), "three")
    assert kept.count() == 3 and os.path.isdir(s.base.removeprefix("file:") + "/three")
    s.close()
    assert not os.path.exists(s.base.removeprefix("file:"))

    def elsewhere(master, **conf):
        return type("S", (), {"conf": {k.replace("_", "."): v for k, v in conf.items()}, "sparkContext": type("C", (), {"master": master})})

    own, shared = "file:/home/me/warehouse", "hdfs://host/warehouse"
    for warehouse in (own, "/home/me/warehouse", "warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(elsewhere("spark://host:7077", spark_sql_warehouse_dir=warehouse))
    assert shared_folder(elsewhere("spark://host:7077", spark_sql_warehouse_dir=shared)) == shared
    assert shared_folder(elsewhere("local[4]", spark_sql_warehouse_dir=own)) == own
    assert shared_folder(elsewhere("spark://host:7077", spark_sql_warehouse_dir=own, spark_checkpoint_dir="/shared/")) == "/shared"


def test_slices_are_bounded_in_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 10, 500, 1, 1, 1, 1)] + [None, "é" * 60]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    got = [p.column(0).to_pylist() for p in slices(b, 0, 3, 100)]
    assert sum(got, []) == texts and [len(p) for p in got] == [2, 1, 3, 2, 1]
    assert list(slices(b.slice(0, 0), 0)) == []


def test_sharding(spark):
    rows = [(i % 900, f"text {i % 500}") for i in range(1500)] + [(None, None), (None, ""), (3, "é" * 50_000)] + [(1, "hot")] * 500
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, size int, part string")
    out = shard.assign(df, 40, Scratch(spark)).collect()
    n = len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    number = np.array([r.row_number for r in out])
    assert sorted(number.tolist()) == list(range(n))
    p = shard.permute(number, n, 17)
    assert [r.shard for r in out] == (p % 40).tolist() and [r.slot for r in out] == (p // 40).tolist()
    order = sorted(out, key=lambda r: r.row_number)
    ids = [(-1 if r.doc_id is None else r.doc_id) for r in order]
    assert ids == sorted(ids)
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in shard.assign(df.repartition(9), 40, Scratch(spark)).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in out}
    assert shard.assign(df.limit(0), 40, Scratch(spark)).count() == 0 and shard.assign(df.limit(1), 40, Scratch(spark)).first().slot == 0


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as cp
    from veritrail.llm import bpe, decontaminate, ngram_join, quality, secret_scan
    from veritrail.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "word " * 50_000, "en", "s", 1)], docs.schema)
    stage, seen = docs.unionByName(odd).unionByName(docs.limit(3)), []
    scratch = Scratch(spark)
    for name, f in cp.STAGES:
        stage = scratch.keep(f(spark, stage, SF), name)
        seen.append(stage)
        if name != cp.STAGES[-1][0]:
            assert stage.columns == docs.columns
    good, one, clean, masked, tokens = ({r.doc_id: r for r in s.collect()} for s in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in good for i, q in labels.items() if q) / sum(q for q in labels.values()) > 0.97
    sets = {i: set(_grams(r.text)) for i, r in good.items()}
    for i, s in sets.items():  # whatever went is like a row of its class with a smaller id
        if i not in one:
            assert any(j < i and len(s & t) >= 0.8 * len(s | t) for j, t in sets.items())
    kept = [(i, sets[i]) for i in one]
    assert not any(len(s & t) >= 0.8 * len(s | t) for k, (i, s) in enumerate(kept) for j, t in kept[k + 1 :] if s and t)
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t in (r.text or "").lower() for r in clean.values() for t in items)
    scanner, coder = secret_scan.Scanner(), bpe.Encoder(tokenizer_path())
    for i, r in masked.items():
        assert scanner.spans(r.text) == [] and (scanner.spans(clean[i].text) or r.text == clean[i].text)
        assert tokens[i].ids == coder.encode(r.text)
    assert cp.run(spark, SF).count() > 0 and quality and decontaminate and ngram_join


def _grams(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_warc", "op2_ngram_join", "op3_sharding", "op4_embedding_dedup", "op8_secrets"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from veritrail.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    sql = c.sql(ORACLES[name])
    assert sorted(sql.columns) == names
    at = [sql.columns.index(n) for n in names]
    assert sorted((tuple(str(r[n]) for n in names) for r in df.collect())) == sorted(tuple(str(r[i]) for i in at) for r in sql.fetchall())
