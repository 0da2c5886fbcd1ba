"""Files, manifests, small forms, outbox drains, audits and states.

What goes in is made from the tables' keys; the SQL beside a query says what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings, text_forms
from ..operators import chunking, governance, lifecycle, matching, reads, relational, skills
from ..operators.documents import strip_nuls
from ..operators.export import folded, unfolded
from ..schemas import EVIDENCE
from ..sources import files, manifests, memo, tables, vocabulary
from ..streaming import outbox as ob
from ..streaming import sessions
from .matching import BASE_SQL, candidates, families, has_skill, requires
from .registry import query, table
from .texts import ALIASES, DOUBLED, MENTION, SCAN_SQL, VOCABULARY

NOW = "TIMESTAMP '2001-08-01 00:00:00'"


def now():
    return F.expr(NOW)


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *columns)


def _uploads(batches):
    """Files of several kinds made from keys and names: path and content."""
    import io
    import zipfile

    import pyarrow as pa

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>%s</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t></w:r></w:p></w:body></w:document>'
    for b in batches:
        paths, contents = [], []
        for k, name in zip(*(c.to_pylist() for c in b.columns)):
            kind = k % 6
            if kind == 0:
                data, end = f"﻿plain {name} é\x00!".encode(), "txt"
            elif kind == 1:
                data, end = f"caf\xe9 {name}".encode("latin-1"), "txt"
            elif kind == 2:
                data, end = (r"{\rtf1{\fonttbl x}" + name + r"\par two}").encode(), "rtf"
            elif kind == 3:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(zipfile.ZipInfo("word/document.xml"), body % name)
                data, end = out.getvalue(), "docx"
            elif kind == 4:
                data, end = b"PK\x03\x04 broken", "docx"
            else:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for entry in (f"{name}.txt", f"in/{name}.RTF", *(["../up.txt"] if k % 4 == 1 else [])):
                        z.writestr(zipfile.ZipInfo(entry), f"text of {name}")
                data, end = out.getvalue(), "zip"
            paths.append(f"{k}.{end}")
            contents.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, "p_name").mapInArrow(_uploads, "path string, content binary")


@query("""SELECT p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.txt' WHEN 2 THEN '.rtf' ELSE '.docx' END AS path, CASE WHEN p_partkey % 6 <> 4 THEN 1 END AS page_no,
  CASE p_partkey % 6 WHEN 0 THEN 'plain ' || p_name || ' é!' WHEN 1 THEN 'café ' || p_name WHEN 2 THEN p_name || chr(10) || 'two' WHEN 3 THEN p_name || chr(10) || 'second' END AS text,
  CASE WHEN p_partkey % 6 = 2 THEN 'low_text_density_consider_ocr' END AS warning, CASE WHEN p_partkey % 6 = 4 THEN 'BadZipFile' END AS error, p_partkey % 6 <> 4 OR true AS agrees FROM part WHERE p_partkey % 6 <> 5""")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files of four kinds to texts; a broken one has an error in its row."""
    u = uploads(spark, sf_dir).where("path not like '%.zip'")
    told = u.select("path", files.mime_agrees(F.col("path"), F.col("content")).alias("agrees"))
    return files.pages(u).join(told, "path").select("path", "page_no", "text", "warning", F.substring_index("error", ":", 1).alias("error"), "agrees")


@query("""WITH z AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_partkey % 6 = 5) SELECT k || '.zip' AS path, 0 AS nth, name || '.txt' AS entry, 'text of ' || name AS text, NULL AS error FROM z WHERE k % 4 <> 1
UNION ALL SELECT k || '.zip', 1, 'in/' || name || '.RTF', 'text of ' || name, NULL FROM z WHERE k % 4 <> 1 UNION ALL SELECT k || '.zip', NULL, NULL, NULL, 'entry name climbs' FROM z WHERE k % 4 = 1""")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of uploaded archives; one bad name rejects its whole archive."""
    out = files.archive_entries(uploads(spark, sf_dir).where("path like '%.zip'"))
    return out.select("path", F.col("at").alias("nth"), "entry", F.col("content").cast("string").alias("text"), "error")


@query("""SELECT s_suppkey AS batch, 'cv ' || s_suppkey || '.pdf' AS resume_key, CASE WHEN s_suppkey % 3 <> 0 THEN 'last.pdf' END AS cover_key, NULL AS error FROM supplier WHERE s_suppkey % 4 <> 3
UNION ALL SELECT s_suppkey, 'b.pdf', NULL, NULL FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey, NULL, NULL, 'no applicants' FROM supplier WHERE s_suppkey % 4 = 3""")
def pairing_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of uploaded JSON manifests: a later row of the same résumé wins, a falsy flag vetoes the cover letter."""
    k = F.col("s_suppkey").cast("string")
    cv = F.concat(F.lit("dir\\\\CV "), k, F.lit(".PDF"))
    flag = F.when(F.col("s_suppkey") % 3 == 0, "no").otherwise("Yes")
    good = F.concat(F.lit('{"applicants": [{"resume_file": "'), cv, F.lit('", "cover_letter_file": "first.pdf"}, {"resume_file": "'), F.lower(cv), F.lit('", "cover_letter_file": "x/LAST.pdf", "cover_letter_flag": "'), flag, F.lit('"}, {"resume_file": " "}, {"resume_file": "b.pdf", "cover_letter_file": " "}]}'))
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("batch"), F.when(F.col("s_suppkey") % 4 != 3, good).otherwise('{"applicants": 1}').alias("content"))
    return manifests.pairing_rows(m)


@query("""SELECT 'job ' || s_suppkey || '.pdf' AS key, s_name AS title, CASE WHEN s_suppkey % 4 = 0 THEN 'hourly' ELSE 'full_time' END AS employment_type, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 9 END AS min_years, s_suppkey % 2 = 0 AS blind_review,
  CASE WHEN s_suppkey % 4 = 0 THEN 'employment_type' WHEN s_suppkey % 5 = 0 THEN 'min_years' END AS error FROM supplier""")
def job_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV manifest with odd headers; the first bad cell of a row is its error."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("up/Job "), k.cast("string"), F.lit(".pdf")).alias(" FileName "), F.concat(F.lit(" "), "s_name").alias("TITLE"), F.when(k % 4 == 0, "hourly").otherwise("full_time").alias("employment_type"),
        F.when(k % 5 == 0, "many").otherwise((k % 9).cast("string")).alias("Min_Years"), F.when(k % 2 == 0, "Yes").otherwise("off").alias("blind_review"),
    )
    base = tables.scratch_folder(spark, "manifest")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/jobs")
    out = manifests.read_job_manifest(spark, f"{base}/jobs", ("full_time", "part_time"), ("senior",))
    return out.select("key", "title", "employment_type", "min_years", "blind_review", "error")


@query(r"""SELECT p_partkey AS k, lower(p_name) || ' x' AS field, p_name || chr(9) || '​'[1:0] || '  X' AS scrubbed, p_name || ' X' AS collapsed, '{"a":' || p_partkey || '}' AS body, p_name AS plain FROM part""")
def field_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields scrubbed of controls, blanks collapsed, JSON found in a reply, NULs removed."""
    odd = F.concat(F.lit("‎"), "p_name", F.lit("\t­  X\u0007"))
    reply = F.when(F.col("k") % 2 == 0, F.concat(F.lit('Sure:\n```json\n{"a":'), F.col("k").cast("string"), F.lit("}\n``` done"))).otherwise(F.concat(F.lit('so {"a":'), F.col("k").cast("string"), F.lit("} it is")))
    return parts(spark, sf_dir, "p_name").select(
        "k", strings.normal_field(odd).alias("field"), strings.strip_controls(odd).alias("scrubbed"), strings.collapse(strings.strip_controls(odd)).alias("collapsed"), strings.json_body(reply).alias("body"), strip_nuls(F.concat("p_name", F.lit("\x00"))).alias("plain"),
    )


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 4 END AS skill, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS evidence_evaluated, p_size % 2 = 0 AS vector_discriminating, NULL::DOUBLE AS never FROM part""")
def folded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores folded into a stored breakdown and read back: what cannot be read, or is no strict boolean, is null."""
    k = F.col("k")
    stored = F.struct(F.when(k % 3 != 0, (F.col("p_size") / 4).cast("string")).otherwise("n/a").alias("skill"))
    both = folded(stored, vector_discriminating=F.col("p_size") % 2 == 0)
    flag = F.when(k % 4 == 0, "true").when(k % 4 == 1, "false").when(k % 4 == 2, '"true"').otherwise("1")
    text = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(', "evidence_evaluated": '), flag, F.lit("}"))
    d = parts(spark, sf_dir, "p_size").withColumn("j", F.to_json(both)).withColumn("j", text)
    return d.select("k", *unfolded(F.col("j"), ("skill", "never"), ("evidence_evaluated", "vector_discriminating")))


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 = 0 THEN 70 ELSE p_partkey % 5 END AS many FROM part)
SELECT k, least(64, many) AS n, CASE WHEN many > 0 THEN CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'met' END END AS status, CASE WHEN many > 0 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE 2000 END END AS quote,
  CASE WHEN many > 0 THEN 500 END AS requirement, CASE WHEN many > 0 THEN 8 END AS ids, CASE WHEN many > 0 THEN CASE WHEN k % 3 = 0 THEN 0.3 ELSE 0.9 END END::DOUBLE AS confidence, 1000 AS overall, 0.2::DOUBLE AS theme FROM p""")
def evidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence taken in within its caps: an overlong quote goes whole and costs its requirement the credit."""
    k = F.col("k")
    quote = F.repeat(F.lit("q"), F.when(k % 3 == 0, 2001).otherwise(2000).cast("int"))
    many = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    one = F.struct(F.repeat(F.lit("r"), F.lit(600)).alias("requirement"), F.lit("met").alias("status"), quote.alias("evidence"), many.alias("evidence_chunk_ids"), F.lit(0.9).alias("confidence"))
    listed = F.array_repeat(one, F.when(k % 40 == 0, 70).otherwise(k % 5).cast("int"))
    theme = F.array(F.struct(F.lit("t").alias("theme"), F.repeat(F.lit("q"), F.lit(3000)).alias("evidence"), many.alias("evidence_chunk_ids"), F.lit(0.2).alias("confidence")))
    whole = F.struct(listed.alias("requirements"), F.repeat(F.lit("s"), F.lit(1001)).alias("overall_summary"), F.lit("yes").alias("cover_letter_presence"), theme.alias("cover_letter_evidence"), F.lit("x").alias("overall_motivation"))
    d = parts(spark, sf_dir).select("k", matching.taken_in(whole.cast(EVIDENCE)).alias("e"))
    first = F.try_element_at("e.requirements", F.lit(1))
    return d.select(
        "k", F.size("e.requirements").alias("n"), first["status"].alias("status"), F.length(first["evidence"]).alias("quote"), F.length(first["requirement"]).alias("requirement"), F.when(first.isNotNull(), F.size(first["evidence_chunk_ids"])).alias("ids"),
        first["confidence"].alias("confidence"), F.length("e.overall_summary").alias("overall"), F.col("e.cover_letter_evidence")[0]["confidence"].alias("theme"),
    )


@query(f"""WITH {SCAN_SQL}, m AS (SELECT conv_id, turn, text, unnest(regexp_extract_all({DOUBLED}, '{MENTION}', 1)) AS t FROM conversations),
n AS (SELECT conv_id, canonical, min(turn) AS turn FROM m JOIN v ON lower(t) = term GROUP BY 1, 2), c AS (SELECT DISTINCT conv_id FROM conversations), r(skill) AS (VALUES ('the'), ('with'), ('python'))
SELECT c.conv_id, r.skill AS requirement, CASE WHEN n.turn IS NULL THEN 'missing' ELSE 'met' END AS status, CASE WHEN n.turn IS NULL THEN '' ELSE 'cl_' || n.turn END AS cited, CASE WHEN n.turn IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence,
  md5(coalesce((SELECT min(text) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = n.turn), '')) AS quote FROM c CROSS JOIN r LEFT JOIN n ON n.conv_id = c.conv_id AND n.canonical = r.skill""")
def stand_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic extractor: a requirement cites the first turn of a conversation that names its skill."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    named = c.join(skills.scanned(c, "key", "text", skills.dimension(spark, ALIASES), list(ALIASES)), "key")
    chunks = named.select(F.col("conv_id").alias("resume_id"), F.concat(F.lit("cl_"), F.col("turn").cast("string")).alias("id"), F.col("turn").alias("at"), "text", "skills")
    wanted = c.select(F.col("conv_id").alias("resume_id")).distinct().select("resume_id", F.explode(F.array(F.lit("the"), F.lit("with"), F.lit("python"))).alias("skill")).withColumn("requirement", F.col("skill"))
    out = matching.extracted(wanted, chunks)
    return out.select(F.col("resume_id").alias("conv_id"), "requirement", "status", F.array_join("evidence_chunk_ids", ",").alias("cited"), "confidence", F.md5("evidence").alias("quote"))


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outbox rows: every seventh payload is no object, attempts run up to the cap, every fourth is delivered."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(k % 5 == 0, "resume.withdrawn").when(k % 5 == 4, "other").otherwise("resume.parsed")
    payload = F.when(k % 7 == 0, "[1]").when(kind == "resume.parsed", F.concat(F.lit('{"skills": ['), F.array_join(F.array_repeat(F.lit('{"name": "x"}'), (k % 9).cast("int")), ","), F.lit("]}"))).otherwise("{}")
    return e.select(
        k.alias("id"), F.lit("resume").alias("aggregate"), F.col("user_id").cast("string").alias("aggregate_id"), kind.alias("event_type"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(k % 4 == 3, F.col("ts").cast("timestamp")).alias("delivered_at"), F.when(k % 11 == 0, 200).otherwise((k % 3).cast("int")).alias("delivery_attempts"), F.lit(None).cast("string").alias("last_error"),
    )


OUTBOX_SQL = """box AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'resume.withdrawn' WHEN event_id % 5 = 4 THEN 'other' ELSE 'resume.parsed' END AS event_type, event_id % 7 = 0 AS bad,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 IN (1, 2, 3) THEN event_id % 9 ELSE 0 END AS cost, event_id % 4 = 3 AS sent, CASE WHEN event_id % 11 = 0 THEN 200 ELSE event_id % 3 END AS attempts FROM events),
ok AS (SELECT * FROM box WHERE NOT sent AND attempts < 200)"""


@query(f"""WITH {OUTBOX_SQL}, first50 AS (SELECT *, sum(cost) OVER (ORDER BY id) AS total, row_number() OVER (ORDER BY id) AS place FROM (SELECT * FROM ok ORDER BY id LIMIT 50)), stop AS (SELECT min(id) AS id FROM first50 WHERE total > 120 AND place > 1),
taken AS (SELECT f.id, bad AND event_type <> 'other' AS poison FROM first50 f, stop WHERE stop.id IS NULL OR f.id < stop.id)
SELECT id, sent OR coalesce(NOT poison, false) AS delivered, attempts + coalesce(poison, false)::INT AS delivery_attempts, CASE WHEN poison THEN 'PayloadError' END AS last_error FROM box LEFT JOIN taken USING (id)""")
def drained_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox after one drain: 50 rows by id within the budget, poison one attempt on, unknown types delivered."""
    out = ob.stepped(_outbox(spark, sf_dir), now(), 50, 120)
    return out.select("id", F.col("delivered_at").isNotNull().alias("delivered"), "delivery_attempts", "last_error")


@query(f"""WITH {OUTBOX_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM ok) SELECT id, CAST(place % 4 AS INT) AS drainer FROM n WHERE place < 200""")
def drainer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that four drainers take at once; no two have one in common."""
    return ob.claimed(_outbox(spark, sf_dir), 4).select("id", "drainer")


@query(f"""WITH {OUTBOX_SQL} SELECT id FROM box WHERE NOT sent AND attempts >= 200""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.dead_letters(_outbox(spark, sf_dir)).select("id")


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 AND event_type = 'view' OR row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) > 1 THEN 'already_running' ELSE 'started' END AS outcome FROM events""")
def single_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of runs: one at a time for a kind and entity."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("entity"))
    running = e.where("kind = 'view' and entity % 5 = 0").select("kind", "entity")
    return ob.single_flight(e, running).select("event_id", "outcome")


@query("""SELECT event_id, CASE WHEN event_id % 6 < 5 THEN 'deferred' ELSE 'exhausted' END AS state, CASE WHEN event_id % 6 < 5 THEN 60 END AS seconds, round(least(8.0, 2.0 ** (event_id % 6)) * (1 + ((event_id % 10) / 10 * 2 - 1) * 0.25), 9) AS wait FROM events""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of failed runs, and how long they wait."""
    k = F.col("event_id")
    s = text_forms.retry_state(k % 6, 5, 60)
    return table(spark, sf_dir, "events").select("event_id", s["state"].alias("state"), s["seconds"].alias("seconds"), F.round(text_forms.backoff(k % 6, k % 10 / 10), 9).alias("wait"))


@query(
    """WITH RECURSIVE c AS (SELECT user_id, event_type <> 'error' AS ok, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS nth, 0 AS failures, NULL::DOUBLE AS opened, '' AS state FROM events
  UNION ALL SELECT user_id, nth, CASE WHEN waits THEN failures ELSE f END, CASE WHEN waits THEN opened WHEN NOT ok AND f >= 2 THEN sec END,
    CASE WHEN waits THEN 'refused' WHEN NOT ok AND f >= 2 THEN 'open' WHEN trial THEN 'half-open' ELSE 'closed' END
  FROM (SELECT *, CASE WHEN ok THEN 0 WHEN trial THEN 1 ELSE failures + 1 END AS f FROM (
    SELECT s.user_id, c.nth, s.failures, s.opened, c.ok, c.sec, s.opened IS NOT NULL AND c.sec - s.opened < 20000 AS waits, s.opened IS NOT NULL AND c.sec - s.opened >= 20000 AS trial
    FROM s JOIN c ON c.user_id = s.user_id AND c.nth = s.nth + 1)))
SELECT user_id, state, count(*) AS n FROM s WHERE nth > 0 GROUP BY 1, 2"""
)
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breaker for each user's calls: two errors in a row open it for 20,000 seconds."""
    e = table(spark, sf_dir, "events")
    call = F.struct("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    calls = e.groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("c"))
    states = text_forms.breaker(F.transform("c", lambda x: F.struct(x["at"].alias("at"), x["ok"].alias("ok"))), 2, 20_000)
    return calls.select("user_id", F.explode(states).alias("state")).groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'u' || c_custkey END AS "user", CASE WHEN c_custkey % 4 = 1 THEN 'INVALID_TICKET' END AS failure FROM customer""")
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and refusals of single sign-on responses; what is no XML, or has no user, tells of none."""
    k, ns = F.col("c_custkey"), "<c:serviceResponse xmlns:c='http://www.yale.edu/tp/cas'>"
    xml = F.when(k % 4 == 0, F.concat(F.lit(f"{ns}<c:authenticationSuccess><c:user> u"), k.cast("string"), F.lit(" </c:user></c:authenticationSuccess></c:serviceResponse>")))
    xml = xml.when(k % 4 == 1, f"{ns}<c:authenticationFailure code='INVALID_TICKET'>no</c:authenticationFailure></c:serviceResponse>").when(k % 4 == 2, f"{ns}<c:authenticationSuccess></c:authenticationSuccess></c:serviceResponse>").otherwise("<broken")
    return table(spark, sf_dir, "customer").select(k.alias("k"), text_forms.ticket_user(xml).alias("user"), text_forms.ticket_failure(xml).alias("failure"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand END AS choice, CASE WHEN p_partkey % 2 = 0 THEN 'cloud,web' END AS families, 'Rank ' || p_name || ' against ' || p_size || '!' AS prompt FROM part""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers held against what was asked: one of the offered names, at most two known families; and the rendered prompt."""
    k = F.col("k")
    answer = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_type")).when(k % 3 == 1, F.col("p_brand")).otherwise("something else")
    named = F.when(k % 2 == 0, F.array(F.lit("nonsense"), F.lit("cloud"), F.lit("web"), F.lit("data"))).otherwise(F.array(F.lit("nonsense")))
    told = skills.validated_families(named, ("web", "cloud", "data"))
    return parts(spark, sf_dir, "p_name", "p_type", "p_brand", "p_size").select("k", skills.chosen(answer, F.array("p_type", "p_brand")).alias("choice"), F.array_join(told, ",").alias("families"), text_forms.rendered("Rank {{ name }} against {{size}}!", name=F.col("p_name"), size=F.col("p_size")).alias("prompt"))


@query("""SELECT DISTINCT lower(p_type) AS name FROM part WHERE lower(p_type) <> 'promo'""")
def unclassified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of the vocabulary, which a classifier would be asked about."""
    known = spark.createDataFrame([("promo", "promo"), ("p", "promo")], "alias string, canonical string")
    return skills.unclassified(parts(spark, sf_dir, F.concat(F.lit(" "), "p_type").alias("name")), known)


@query("""SELECT p_partkey AS k, lower(p_type) AS skill, CASE lower(p_type) WHEN 'promo' THEN 'cheap,sales' WHEN 'economy' THEN 'cheap' END AS families, CASE WHEN p_partkey % 2 = 0 THEN 'almond' ELSE 'python' END AS canonical FROM part""")
def curated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary and families read from curated files, an absent one among them, and looked up."""
    import json

    base = tables.scratch_folder(spark, "curated")
    for name, doc in (("aliases", VOCABULARY), ("families", {"sales": ["Promo "], "cheap": ["economy", "promo"]})):
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{base}/{name}.json")
    aliases = vocabulary.read_aliases(spark, f"{base}/aliases.json").unionByName(vocabulary.read_aliases(spark, f"{base}/nowhere.json"))
    d = parts(spark, sf_dir, F.lower("p_type").alias("skill")).withColumn("alias", F.when(F.col("k") % 2 == 0, "al mond").otherwise("py"))
    out = skills.with_families(d, vocabulary.read_families(spark, f"{base}/families.json")).join(aliases, "alias")
    return out.select("k", "skill", F.array_join("families", ",").alias("families"), "canonical")


@query("""SELECT c_custkey AS id, 'r' || c_custkey AS resume_id, 'u1' AS user_id FROM customer WHERE c_custkey > 0 AND c_custkey % 3 = 1""")
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalogue, made twice without harm, written with its declared schema, and scanned by a property."""
    base = tables.scratch_folder(spark, "catalogue")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0").select(k.alias("id"), F.concat(F.lit("r"), k.cast("string")).alias("resume_id"), F.concat(F.lit("u"), (k % 3).cast("string")).alias("user_id"), F.expr(NOW).alias("revealed_at"))
    rows.write.parquet(f"{base}/reveal_audit")
    return tables.nodes(tables.read_table(spark, base, "reveal_audit"), user_id="u1").select("id", "resume_id", "user_id")


@query("""WITH log AS (SELECT event_id AS id, event_type AS action, CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE event_type <> 'view')
SELECT *, 'user' AS actor_kind FROM log UNION ALL SELECT (SELECT max(id) FROM log) + row_number() OVER (ORDER BY c_custkey), 'read', CAST(c_custkey AS VARCHAR), 'user' FROM customer WHERE c_acctbal > 0""")
def audit_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log with the rows of a read that was granted, numbered on; nothing that stands is changed."""
    log = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.lit("user").alias("actor_kind"), F.col("user_id").cast("string").alias("entity_id"))
    shown = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entity_id"))
    rows = governance.audited(shown, "read", "u1", now()).select("action", "actor_kind", "entity_id", F.col("entity_id").cast("long").alias("at"))
    return governance.appended(log, rows)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'service' END AS kind, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS user_id, CASE WHEN event_id % 4 = 1 THEN event_type END AS service,
  event_type IN ('click', 'error') AND event_id % 3 = 0 AS revealable FROM events""")
def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who did it, exactly one of a user and a service; and whose details may be revealed: listed actions, non-empty objects."""
    k = F.col("event_id")
    details = F.when(k % 3 == 0, F.col("props")).when(k % 3 == 1, "{}").otherwise("[1]")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 % 2 == 0, F.col("user_id").cast("string")).alias("u"), F.when((k % 4 == 1) | (k % 4 == 2), F.col("event_type")).alias("s"), F.col("event_type").alias("action"), details.alias("details"))
    shown = governance.revealable(e, ("click", "error")).select("event_id", F.lit(True).alias("revealable"))
    return e.withColumn("a", governance.actor(F.col("u"), F.col("s"))).join(shown, "event_id", "left").select("event_id", "a.kind", "a.user_id", "a.service", F.coalesce("revealable", F.lit(False)).alias("revealable"))


@query("""WITH a AS (SELECT event_id, 'u' || user_id % 7 AS user_id, event_id % 1000 AS resume_id, ['admin', 'recruiter', 'hiring_manager', 'auditor'][1 + event_id % 4] AS role FROM events)
SELECT a.user_id, o_orderkey AS resume_id, 'C' || o_custkey AS candidate_name, true AS audited FROM a JOIN orders ON o_orderkey = resume_id WHERE role IN ('admin', 'recruiter') OR role = 'hiring_manager' AND o_custkey % 7 = CAST(substr(a.user_id, 2) AS INT)""")
def reveals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reveals that were asked for: gate, then scope; each that is shown has its audit row, blocked ones have none."""
    k = F.col("event_id")
    role = F.get(F.array(*map(F.lit, ("admin", "recruiter", "hiring_manager", "auditor"))), (k % 4).cast("int"))
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("user_id"), (k % 1000).alias("resume_id"), role.alias("role"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("job_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("candidate_name"))
    assignees = r.select("job_id", F.concat(F.lit("u"), (F.col("job_id") % 7).cast("string")).alias("user_id")).distinct()
    shown, audit = governance.revealed(asked, r, assignees, True, now())
    told = audit.select("user_id", F.col("entity_id").alias("resume_id")).distinct().withColumn("audited", F.lit(True))
    return shown.join(told, ["user_id", "resume_id"], "left").select("user_id", "resume_id", "candidate_name", "audited")


@query("""SELECT event_id AS id, 'u' || user_id AS user_id, ts AS revealed_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50""")
def reveal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the list of reveals, newest first."""
    from ..operators.ranking import page

    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.col("ts").cast("timestamp").alias("revealed_at"))
    return page(e, [F.desc("revealed_at"), F.desc("id")], 25, 50)


@query(f"""SELECT c_custkey AS id, TIMESTAMP '2001-09-01 00:00:00' AS expires_at, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' WHEN c_custkey % 3 = 0 THEN {NOW} END AS revoked_at FROM customer
UNION ALL SELECT c_custkey + 10000000, {NOW} + INTERVAL 1 HOUR, NULL FROM customer WHERE c_custkey % 5 = 0""")
def session_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after some are opened and some revoked; what was revoked keeps its time."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    old = c.select(k.alias("id"), F.lit("u").alias("user_id"), now().alias("created_at"), F.expr("TIMESTAMP '2001-09-01 00:00:00'").alias("expires_at"), F.when(k % 4 == 0, F.expr("TIMESTAMP '2001-01-01 00:00:00'")).alias("revoked_at"))
    new = c.where(k % 5 == 0).select(F.explode(F.array(k, k + 10_000_000, k + 10_000_000)).alias("id"), F.lit("v").alias("user_id"))
    out = sessions.revoked(sessions.opened(old, new, now(), 3600), c.where(k % 3 == 0).select(k.alias("id")), now())
    return out.select("id", "expires_at", "revoked_at")


@query(f"""WITH {BASE_SQL}, extra(skill, family) AS (SELECT DISTINCT p_brand, CASE WHEN p_brand LIKE '%1' THEN 'ECONOMY' ELSE 'PROMO' END FROM part),
given AS (SELECT skill, family FROM fam UNION SELECT * FROM extra)
SELECT c.job_id, c.resume_id, r.skill, CAST(CASE WHEN h.skill IS NOT NULL THEN 1.0 WHEN EXISTS (SELECT 1 FROM hs x JOIN given fx ON fx.skill = x.skill JOIN fam fr ON fr.family = fx.family
  WHERE x.resume_id = c.resume_id AND fr.skill = r.skill AND fr.family <> 'PROMO') THEN 0.5 ELSE 0.0 END AS DOUBLE) AS ontology_weight FROM cand c JOIN req r USING (job_id) LEFT JOIN hs h ON h.resume_id = c.resume_id AND h.skill = r.skill""")
def classified_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit with families that a classifier found: they count for what a candidate has, never for what a job asks."""
    extra = table(spark, sf_dir, "part").select(F.col("p_brand").alias("skill"), F.when(F.col("p_brand").like("%1"), "ECONOMY").otherwise("PROMO").alias("family")).distinct()
    rows = matching.requirement_rows(candidates(spark, sf_dir), requires(spark, sf_dir), has_skill(spark, sf_dir), families(spark, sf_dir), ("PROMO",), classified=extra)
    return rows.select("job_id", "resume_id", "skill", "ontology_weight")


@query("""SELECT p_partkey AS k, 3 AS n, CASE WHEN p_size % 3 = 0 THEN 5 ELSE 3 END AS best, 'BSc/' || p_name || ',PhD/-,-/x' AS zipped FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 2, 3, 'BSc/' || p_name || ',-/x' FROM part WHERE p_size % 3 <> 0""")
def zipped_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and fields position by position, padded, and the highest level that can be read."""
    third = F.col("p_size") % 3 == 0
    levels = F.when(third, F.array(F.lit("BSc"), F.lit("PhD"))).otherwise(F.array(F.lit("BSc")))
    fields = F.when(third, F.array(F.col("p_name"), F.lit(None).cast("string"), F.lit("x"))).otherwise(F.array(F.col("p_name"), F.lit("x")))
    d = parts(spark, sf_dir, "p_name", "p_size").select("k", matching.zipped(levels, fields).alias("z"))
    rows = matching.education_rows(F.transform("z", lambda x: F.struct(x["level"].alias("degree"), x["field"].alias("field"))))
    text = F.array_join(F.transform("z", lambda x: F.concat(F.coalesce(x["level"], F.lit("-")), F.lit("/"), F.coalesce(x["field"], F.lit("-")))), ",")
    return d.select("k", F.size("z").alias("n"), matching.best_rank(rows).alias("best"), text.alias("zipped"))


@query("""SELECT p_partkey AS k, 'c_001=one,c_002=' || CASE WHEN p_partkey % 2 = 0 THEN 'letter' ELSE 'two' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ',cl_001=letter' END AS texts FROM part""")
def chunk_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of résumé and cover letter by id; of an id that both have the cover letter's counts."""
    one = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"))
    cover = F.when(F.col("k") % 2 == 0, F.array(one("c_002", "letter"))).otherwise(F.array(one("cl_001", "letter")))
    m = chunking.chunk_texts(F.array(one("c_001", "one"), one("c_002", "two")), cover)
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return parts(spark, sf_dir).select("k", F.array_join(entries, ",").alias("texts"))


@query(f"""SELECT o_orderkey AS resume_id, CASE WHEN o_orderkey % 3 = 1 THEN 'ranking' WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'awaiting_llm' END AS state, CASE WHEN o_orderkey % 3 = 1 THEN 'asked' WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'old' END AS reason,
  CASE WHEN o_orderkey % 3 = 1 THEN {NOW} WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS since FROM orders WHERE o_orderkey % 7 <> 0""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states set for some jobs and cleared for others; some rows are deleted first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("awaiting_llm").alias("shortlist_state"), F.lit("old").alias("shortlist_state_reason"), F.col("o_orderdate").cast("timestamp").alias("shortlist_state_at"))
    left = relational.deleted(o, o.where("job_id % 7 = 0").select("job_id"), ["job_id"])
    out = reads.run_state(left, o.where("job_id % 3 = 1"), "ranking", "asked", now())
    out = reads.run_state(out, o.where("job_id % 3 = 2"), None, None, now())
    return out.select(F.col("job_id").alias("resume_id"), F.col("shortlist_state").alias("state"), F.col("shortlist_state_reason").alias("reason"), F.col("shortlist_state_at").alias("since"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'uploaded' ELSE 'parsing' END AS status, o_orderpriority = '5-LOW' AS gone FROM orders), q AS (SELECT event_id AS id FROM events)
SELECT q.id, CASE WHEN r.id IS NULL THEN 'missing' WHEN gone THEN 'withdrawn' WHEN status = 'parsing' THEN 'proceed' WHEN status = 'parsed' THEN 'already_done' ELSE 'not_ready' END AS outcome,
  coalesce(status = 'parsing' AND NOT gone AND q.id % 4 <> 0, false) AS announced FROM q LEFT JOIN r USING (id)""")
def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of results that come back: stale, withdrawn and degraded ones are not announced."""
    status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("parsing")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resume_id"), status.alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("withdrawn_at"))
    q = table(spark, sf_dir, "events").select(F.col("event_id").alias("resume_id"), (F.col("event_id") % 4 == 0).alias("degraded"))
    told = lifecycle.projectable(q, r).select("resume_id", F.lit(True).alias("announced"))
    out = lifecycle.outcomes(q, r, "resume_id", ("parsing",), ("parsed", "failed")).join(told, "resume_id", "left")
    return out.select(F.col("resume_id").alias("id"), "outcome", F.coalesce("announced", F.lit(False)).alias("announced"))


@query("""WITH t AS (SELECT DISTINCT p_name AS text FROM part), a AS (SELECT text, length(text) % 3 AS age FROM t) SELECT md5(text) AS digest, age = 0 OR age = 2 AS embedded FROM a""")
def memo_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memo of embeddings: texts that are unknown, or were embedded over 90 days ago, are embedded again."""
    from ..functions.hashing import cache_key

    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    age = F.length("text") % 3
    known = t.where(age > 0).select(cache_key(F.lit("m"), F.col("text")).alias("key"), F.array(F.lit(-1.0)).alias("vector"), F.when(age == 1, F.expr(f"{NOW} - INTERVAL 89 DAYS")).otherwise(F.expr(f"{NOW} - INTERVAL 91 DAYS")).alias("cached_at"))
    out, _ = memo.read_through(t.withColumn("id", F.lit(1)), known, lambda x: x.select("text", F.array(F.lit(1.0)).alias("vector")), "m", now())
    return out.select(F.md5("text").alias("digest"), (F.col("vector")[0] == 1.0).alias("embedded"))


@query("""SELECT 'events' AS "check", count(*) AS n, true AS ok FROM events WHERE event_type IN ('purchase', 'error') UNION ALL SELECT 'resumes', count(DISTINCT user_id), true FROM events WHERE event_type IN ('purchase', 'error')
UNION ALL SELECT 'edges', (SELECT count(*) FROM (SELECT DISTINCT user_id, s FROM (SELECT user_id, unnest([(CAST(props AS JSON)->>'k')::INT % 7, (CAST(props AS JSON)->>'k')::INT % 3]) AS s FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type = 'purchase'))), true
UNION ALL SELECT 'undelivered', 0, true""")
def harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds an outbox, drains it until nothing is left, reads the projection back, and reports."""
    from .incremental import outbox

    base = tables.scratch_folder(spark, "harness")
    seeded = outbox(spark, sf_dir).where("event_type in ('resume.parsed', 'resume.withdrawn')")
    seeded.select("id", "aggregate", "aggregate_id", "event_type", "payload", "created_at").write.json(f"{base}/inbox")
    ob.drain(spark, f"{base}/inbox", base, files_per_batch=10_000)
    edges, want = ob.read_edges(spark, base), ob.resume_changes(seeded)[0]
    missing = want.select("resume_id", "skill").exceptAll(edges.select("resume_id", "skill")).agg(F.count("*").alias("n"))
    one = lambda name, df: df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
    report = one("events", seeded.agg(F.count("*").alias("n"))).unionByName(one("resumes", seeded.agg(F.countDistinct("aggregate_id").alias("n"))))
    report = report.unionByName(one("edges", edges.agg(F.count("*").alias("n")))).unionByName(one("undelivered", missing))
    return report.withColumn("ok", (F.col("check") != "undelivered") | (F.col("n") == 0))
