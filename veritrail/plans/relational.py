"""Scopes, joins, counts, histories, guarded changes and exports on the star schema.

Orders play résumés: status F is parsed, O uploaded, P parsing; the priority 5-LOW marks withdrawn rows, and a parsed row
below 50,000 is degraded.  Customers play jobs, nations owners; events play the audit log and the outbox.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import export, governance, ranking, relational
from .registry import query, table

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("parsing")
    gone = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").alias("job_id"), status.alias("status"), gone.alias("withdrawn"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("price"), F.concat(F.lit("CV_"), F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("filename"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


RESUMES_SQL = """res AS (SELECT o_orderkey AS resume_id, o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'uploaded' ELSE 'parsing' END AS status,
  o_orderpriority = '5-LOW' AS withdrawn, o_orderdate AS created_at, o_totalprice AS price, 'CV_' || o_orderkey || '.PDF' AS filename FROM orders)"""


@query(
    f"""WITH {RESUMES_SQL}, b AS (SELECT job_id, CASE WHEN withdrawn THEN 'withdrawn' ELSE status END AS bucket, count(*) AS n FROM res GROUP BY 1, 2
  UNION ALL SELECT job_id, 'degraded', count(*) FILTER (status = 'parsed' AND NOT withdrawn AND price < 50000) FROM res GROUP BY 1),
frame AS (SELECT j.job_id, x.bucket FROM (SELECT DISTINCT job_id FROM res) j, (VALUES ('uploaded'), ('parsing'), ('parsed'), ('failed'), ('withdrawn'), ('degraded')) x(bucket))
SELECT job_id, bucket, coalesce(n, 0) AS n FROM frame LEFT JOIN b USING (job_id, bucket)"""
)
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resumes(spark, sf_dir)
    bucket = F.when(F.col("withdrawn"), "withdrawn").otherwise(F.col("status"))
    degraded = (F.col("status") == "parsed") & ~F.col("withdrawn") & (F.col("price") < 50000)
    return relational.status_breakdown(r, bucket, degraded, "job_id")


@query(
    f"""WITH {RESUMES_SQL} SELECT resume_id, job_id, status FROM res r WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.job_id AND c.c_nationkey = 7)
AND NOT EXISTS (SELECT 1 FROM res w WHERE w.withdrawn AND w.resume_id = r.resume_id)"""
)
def scope_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resumes(spark, sf_dir)
    assignees = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").cast("string").alias("user_id"))
    mine = relational.scoped(r, assignees, "job_id", "7")
    return relational.live(mine, r.where("withdrawn"), "resume_id").select("resume_id", "job_id", "status")


@query(
    """SELECT event_id, ts, event_type, c_name AS user_name, CASE WHEN c_custkey IS NULL THEN 'service' ELSE 'user' END AS actor_kind FROM events
LEFT JOIN customer ON c_custkey = user_id * 100 WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 50"""
)
def audit_left_join_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the audit log in total order; rows without a user stay."""
    rows = log(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = rows.join(users, rows["user_id"] * 100 == users["c_custkey"], "left")
    kind = F.when(F.col("c_custkey").isNull(), "service").otherwise("user")
    out = joined.select("event_id", "ts", "event_type", F.col("c_name").alias("user_name"), kind.alias("actor_kind"))
    return ranking.page(out, [F.desc("ts"), F.desc("event_id")], 100, 50)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' AND user_id = 5")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are not given let everything pass."""
    return relational.optional_filter(log(spark, sf_dir), event_type="purchase", user_id=5, event_id=None).select("event_id", "event_type", "user_id")


@query(
    """SELECT l_orderkey, l_linenumber, o_custkey, c_name, c_mktsegment, round(l_extendedprice * (1 - l_discount), 4) AS score_final
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW'"""
)
def export_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their résumé and job, withdrawn résumés left out, ready for a flat export."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return export.safe(out.select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "c_mktsegment", F.round("s", 4).alias("score_final")))


@query(
    """WITH t AS (SELECT c_custkey, ['=', '+', '-', '@', chr(9), ''][1 + c_custkey % 6] || c_name AS c_name, c_acctbal FROM customer)
SELECT c_custkey, CASE WHEN c_name[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || c_name ELSE c_name END AS c_name, c_acctbal FROM t"""
)
def export_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(*map(F.lit, ("=", "+", "-", "@", "\t", "")))
    c = table(spark, sf_dir, "customer")
    return export.safe(c.select("c_custkey", F.concat(F.get(starts, (F.col("c_custkey") % 6).cast("int")), "c_name").alias("c_name"), "c_acctbal"))


@query(
    """WITH e AS (SELECT conv_id, list({'turn': turn, 'text': text} ORDER BY turn, text) FILTER (role = 'assistant') AS requirements FROM conversations GROUP BY 1)
SELECT conv_id, pos AS "at", text AS requirement FROM (SELECT conv_id, unnest(range(len(requirements))) AS pos, unnest(requirements).text AS text FROM e WHERE requirements IS NOT NULL)
UNION ALL SELECT conv_id, NULL, '(no evidence generated)' FROM e WHERE requirements IS NULL"""
)
def evidence_rows_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per requirement, and a placeholder where there is none."""
    one = F.struct("turn", F.col("text").alias("requirement"), F.lit("met").alias("status"), F.lit("").alias("evidence"), F.lit(1.0).alias("confidence"))
    e = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", one))).alias("requirements"))
    return export.evidence_rows(e, ["conv_id"]).select("conv_id", "at", "requirement")


@query(
    """SELECT user_id, event_id, props FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).where("event_type <> 'error'")
    return relational.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "props")


@query(
    """WITH d AS (SELECT doc_id, sha256(text) AS sha, length(text) >= 50 AS ok, source = 'src0' AS stored FROM documents),
s AS (SELECT DISTINCT sha FROM d WHERE stored),
n AS (SELECT d.*, row_number() OVER (PARTITION BY sha, ok ORDER BY doc_id) AS place, sha IN (SELECT sha FROM s) AS known FROM d WHERE NOT stored)
SELECT doc_id, sha, CASE WHEN NOT ok THEN 'rejected' WHEN known OR place > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM n"""
)
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of an upload: too short, already stored, earlier in the batch, or accepted.  The first source is stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), (F.length("text") >= 50).alias("ok"), (F.col("source") == "src0").alias("stored"))
    batch, stored = d.where("not stored").drop("stored"), d.where("stored")
    return relational.dedup_outcome(batch, stored, "sha", ["doc_id"], F.col("ok")).select("doc_id", "sha", "outcome")


@query(
    """WITH d AS (SELECT source, length(text) >= 200 AS ok, doc_id FROM documents)
SELECT source, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, 0 AS duplicate FROM d GROUP BY 1"""
)
def outcome_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.when(F.length("text") >= 200, "accepted").otherwise("rejected").alias("outcome"))
    return relational.outcome_tallies(d, "source", ("accepted", "rejected", "duplicate"))


@query(
    """WITH n AS (SELECT user_id AS c_custkey, max('new-' || user_id) FILTER (user_id % 3 = 0) AS c_name, max(event_type) AS c_mktsegment, max(user_id) AS c_nationkey FROM events GROUP BY 1)
SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(c.c_mktsegment, n.c_mktsegment) AS c_mktsegment,
  CASE WHEN n.c_custkey IS NOT NULL THEN n.c_nationkey ELSE c.c_nationkey END AS c_nationkey FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey"""
)
def upsert_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert: names take new values that are there, the segment sticks, the nation is replaced."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_type").alias("c_mktsegment"))
    new = e.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("new-"), F.col("c_custkey").cast("string"))).alias("c_name"), "c_mktsegment", F.col("c_custkey").alias("c_nationkey"))
    return relational.upserted(c, new, ["c_custkey"], prefer_new=["c_name"], sticky=["c_mktsegment"], replace=["c_nationkey"])


@query(f"""WITH {RESUMES_SQL} SELECT resume_id, CASE WHEN status = 'uploaded' AND NOT withdrawn THEN 'parsing' ELSE status END AS status, status = 'uploaded' AND NOT withdrawn AS applied FROM res""")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.guarded_update(resumes(spark, sf_dir), (F.col("status") == "uploaded") & ~F.col("withdrawn"), {"status": F.lit("parsing")})
    return out.select("resume_id", "status", "applied")


@query(
    f"""WITH {RESUMES_SQL} SELECT resume_id, status, CASE WHEN resume_id % 2 = 0 THEN 'parsed' ELSE 'failed' END AS wanted,
  (status = 'uploaded' AND resume_id % 2 = 1) OR status = 'parsing' AS legal FROM res"""
)
def lifecycle_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = {"uploaded": ("parsing", "failed"), "parsing": ("parsed", "failed"), "failed": ("uploaded",)}
    r = resumes(spark, sf_dir).withColumn("wanted", F.when(F.col("resume_id") % 2 == 0, "parsed").otherwise("failed"))
    return r.select("resume_id", "status", "wanted", relational.transitions(F.col("status"), F.col("wanted"), steps).alias("legal"))


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 4 = 0 THEN 7 ELSE p_size END AS p_size,
  (p_partkey % 3 = 0)::INT + (p_partkey % 4 = 0 AND p_size <> 7)::INT AS n_changed FROM p"""
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch: a field that is absent stays, one that is given as null becomes null, equal values are no change."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    none = F.create_map().cast("map<string,string>")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("p_brand"), F.lit(None).cast("string"))).otherwise(none)
    size = F.when(F.col("p_partkey") % 4 == 0, F.create_map(F.lit("p_size"), F.lit("7"))).otherwise(none)
    patch = p.select("p_partkey", F.map_concat(brand, size).alias("fields"))
    out = relational.patched(p, patch, "p_partkey", ["p_brand", "p_size"])
    return out.select("p_partkey", "p_brand", "p_size", F.size("changed").alias("n_changed"))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT l_orderkey, 1000 + l_linenumber, l_quantity * 2 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_quantity > 40"""
)
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every fifth order are replaced, those without new entries vanish."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    hit = li.where("l_orderkey % 5 = 0")
    new = hit.where("l_quantity > 40").select("l_orderkey", (1000 + F.col("l_linenumber")).alias("l_linenumber"), (F.col("l_quantity") * 2).alias("l_quantity"))
    return relational.replaced(li, new, "l_orderkey", hit)


@query(
    f"""WITH {RESUMES_SQL} SELECT resume_id, CASE WHEN date_diff('second', created_at, {AS_OF}) <= 86400 * 365 THEN status END AS visible FROM res"""
)
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resumes(spark, sf_dir)
    return r.select("resume_id", relational.visible_state(F.col("status"), F.col("created_at"), F.expr(AS_OF), 86400 * 365).alias("visible"))


@query(
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('second', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) > 21600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2"""
)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.gap_sessions(log(spark, sf_dir), "user_id", "ts", 6 * 3600)


@query(
    """WITH e AS (SELECT event_id, event_type, CAST(CAST(props AS JSON)->>'k' AS INT) AS cost FROM events),
s AS (SELECT *, sum(cost) OVER w AS total, row_number() OVER w AS place FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, max((total > 2000 AND place > 1)::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS over_ FROM s)
SELECT event_id, event_type, cost FROM o WHERE over_ = 0"""
)
def drain_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's next batch: events in order while their costs stay within the budget."""
    e = log(spark, sf_dir).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("cost"))
    return ranking.budget_prefix(e, ["event_id"], "cost", 2000, "event_type")


@query(
    f"""WITH {RESUMES_SQL} SELECT 'stuck' AS "check", count(*) FILTER (status = 'parsing' AND NOT withdrawn AND created_at < {AS_OF} - INTERVAL 6 HOURS) AS n FROM res
UNION ALL SELECT 'not_an_object', count(*) FILTER (props NOT LIKE '{{%') FROM events
UNION ALL SELECT 'unattributable', count(*) FILTER (event_type = 'error' AND user_id IS NULL) FROM events
UNION ALL SELECT 'hashed_names', count(*) FILTER (props LIKE '%"h:%') FROM events"""
)
def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("status") == "parsing") & ~F.col("withdrawn") & (F.col("created_at") < F.expr(f"{AS_OF} - INTERVAL 6 HOURS"))
    stuck = resumes(spark, sf_dir).agg(F.count(F.when(late, 1)).alias("n")).withColumn("severity", F.lit(2))
    e = log(spark, sf_dir)
    one = lambda cond, severity: e.agg(F.count(F.when(cond, 1)).alias("n")).withColumn("severity", F.lit(severity))
    shape = F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT")
    return governance.findings(
        stuck=stuck,
        not_an_object=one(~F.coalesce(shape, F.lit(False)), 1),
        unattributable=one((F.col("event_type") == "error") & F.col("user_id").isNull(), 2),
        hashed_names=one(F.col("props").like('%"h:%'), 1),
    ).select("check", "n")


@query(
    """SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') OR CAST(props AS JSON)->>'k' IN ('', '0', 'false') THEN CAST(props AS JSON)->>'k' ELSE '<withheld>' END AS k FROM events"""
)
def allowlist_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.from_json("props", "map<string,string>")
    shown = relational.masked_details(details, F.col("event_type"), {"click": ("k",), "view": ("k",)})
    return log(spark, sf_dir).select("event_id", "event_type", shown["k"].alias("k"))


@query(
    f"""WITH {RESUMES_SQL} SELECT resume_id, CASE WHEN job_id % 2 = 0 THEN 'resume.pdf' ELSE filename END AS filename, CASE WHEN job_id % 2 = 0 THEN NULL ELSE 'N' || resume_id END AS candidate_name FROM res"""
)
def blind_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resumes(spark, sf_dir).withColumn("candidate_name", F.concat(F.lit("N"), F.col("resume_id").cast("string")))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 2 == 0).alias("blind_review"))
    return governance.resume_list(r, jobs).select("resume_id", "filename", "candidate_name")


@query(
    """WITH f AS (SELECT o_custkey, lower(trim(o_orderpriority)) AS fold, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2)
SELECT o_custkey, fold, row_number() OVER (PARTITION BY o_custkey ORDER BY first_at, fold) AS number,
  'Candidate ' || chr(CAST(64 + row_number() OVER (PARTITION BY o_custkey ORDER BY first_at, fold) AS INT)) AS label FROM f"""
)
def label_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.label_numbers(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return out.select("o_custkey", "fold", "number", strings.pseudonym(F.col("number")).alias("label"))


@query(
    """WITH RECURSIVE n AS (SELECT c_custkey * 6148914691 + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE -c_custkey * 6148914690 END AS k, c_custkey AS id FROM customer),
l AS (SELECT id, k, k AS rest, '' AS s FROM n UNION ALL SELECT id, k, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INT)) || s FROM l WHERE rest > 0)
SELECT id AS c_custkey, 'Candidate ' || s AS label FROM l WHERE rest = 0 AND k > 0"""
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ranks: the customers' keys, every second one far larger."""
    far = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 6_148_914_691).otherwise(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", strings.pseudonym(far).alias("label"))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id AS cover_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE lang <> 'en')
SELECT doc_id, source, place, cover_id FROM r LEFT JOIN c USING (source, place)"""
)
def pairing_rank_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents play résumés, all others cover letters of the same source."""
    d = table(spark, sf_dir, "documents")
    left, right = d.where("lang = 'en'").select("doc_id", "source"), d.where("lang <> 'en'").select(F.col("doc_id").alias("cover_id"), "source")
    return relational.rank_aligned(left, right, "source", ["doc_id"], ["cover_id"]).select("doc_id", "source", "place", "cover_id")


@query(
    """WITH r AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank, l.quality FROM documents d JOIN labels l USING (doc_id))
SELECT source, round(avg(quality), 6) AS precision, count(*) AS n, count(*) >= 5 AS enough FROM r WHERE rank <= 5 GROUP BY 1"""
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    r = ranking.ranked(d, "source", [F.desc("n_chars"), F.col("doc_id")])
    return ranking.precision_at(r, "source", 5, F.col("quality") == 1).withColumn("precision", F.round("precision", 6))


@query(
    """WITH r AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank, CASE WHEN l.toxic = 1 THEN 'bait' WHEN l.quality = 1 THEN 'strong' ELSE 'other' END AS tag FROM documents d JOIN labels l USING (doc_id))
SELECT source, min(rank) FILTER (tag = 'bait') AS first_bait, max(rank) FILTER (tag = 'strong') AS last_strong, min(rank) FILTER (tag = 'bait') > max(rank) FILTER (tag = 'strong') AS below FROM r GROUP BY 1"""
)
def bait_below_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    tag = F.when(F.col("toxic") == 1, "bait").when(F.col("quality") == 1, "strong").otherwise("other")
    return ranking.bait_and_strong(d.withColumn("tag", tag), "source", "tag", F.struct((-F.col("n_chars")).alias("n"), "doc_id"))


@query(
    """WITH r AS (SELECT o_orderkey, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_custkey FROM orders),
p AS (SELECT a.o_custkey AS dimension, a.o_orderkey AS higher, b.o_orderkey AS lower, a.rank AS ra, b.rank AS rb, a.score - b.score AS gap FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.rank = 1 AND b.rank = 2)
SELECT dimension, higher, lower, round(gap, 6) AS gap, ra < rb AND gap >= 1e-6 AS holds FROM p"""
)
def ordering_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"))
    r = ranking.ranked(o, "o_custkey", [F.desc("score"), F.col("o_orderkey")])
    firsts = r.groupBy(F.col("o_custkey").alias("dimension")).agg(F.max(F.when(F.col("rank") == 1, F.col("o_orderkey"))).alias("higher"), F.max(F.when(F.col("rank") == 2, F.col("o_orderkey"))).alias("lower"))
    return ranking.ordering_pairs(r, firsts.where("lower is not null"), "o_orderkey").withColumn("gap", F.round("gap", 6))


@query(
    """WITH a AS (SELECT o_orderkey, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
b AS (SELECT o_orderkey, o_totalprice + o_orderkey % 3 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice + o_orderkey % 3 DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT max(abs(a.r - b.r)) AS rank_drift, max(abs(a.s - b.s)) AS score_drift, count(*) FILTER (a.r IS NULL OR b.r IS NULL) AS missing FROM a FULL JOIN b USING (o_orderkey)"""
)
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same rows, the second without those of low priority and with other scores."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score"), "o_orderpriority")
    order = [F.desc("score"), F.col("o_orderkey")]
    other = o.where("o_orderpriority <> '5-LOW'").withColumn("score", F.col("score") + F.col("o_orderkey") % 3)
    return ranking.drift(ranking.ranked(o, "o_custkey", order), ranking.ranked(other, "o_custkey", order), "o_orderkey")


@query("SELECT n_regionkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS active, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("active"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query(
    """WITH h AS (SELECT c_custkey AS id, 'u' || c_custkey AS user_id, TIMESTAMP '2001-01-01 00:00:00' + INTERVAL 1 MINUTE * (c_custkey % 120) AS expires_at, c_custkey % 7 = 0 AS revoked FROM customer)
SELECT id, expires_at > TIMESTAMP '2001-01-01 01:00:00' AND NOT revoked AS active, expires_at > TIMESTAMP '2001-01-01 01:00:00' AND NOT revoked AND expires_at <= TIMESTAMP '2001-01-01 01:30:00' AS extended,
  CASE WHEN expires_at > TIMESTAMP '2001-01-01 01:00:00' AND NOT revoked AND expires_at <= TIMESTAMP '2001-01-01 01:30:00' THEN TIMESTAMP '2001-01-01 03:00:00' ELSE expires_at END AS expires_at FROM h"""
)
def sliding_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.sessions import refreshed

    start = F.unix_timestamp(F.lit("2001-01-01 00:00:00"))
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (start + F.col("c_custkey") % 120 * 60).cast("timestamp").alias("expires_at"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2000-12-31").cast("timestamp")).alias("revoked_at"))
    as_of = F.expr("TIMESTAMP '2001-01-01 01:00:00'")
    s = s.withColumn("active", F.col("revoked_at").isNull() & (F.col("expires_at") > as_of))
    return refreshed(s, as_of, 7200, 1800).select("id", "active", "extended", "expires_at")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that stand more than once."""
    from ..schemas import duplicates

    return duplicates(table(spark, sf_dir, "part"), ["p_type"]).withColumnRenamed("times", "n")


@query(
    """WITH w AS (SELECT p_brand, list(DISTINCT split_part(p_type, ' ', 1)) AS f FROM part WHERE p_size % 5 = 0 GROUP BY 1), v AS (SELECT p_brand, list(DISTINCT split_part(p_type, ' ', 1)) AS f FROM part WHERE p_size % 7 = 0 GROUP BY 1)
SELECT p_brand, list_sort(list_intersect(w.f, v.f)) AS shared, len(list_filter(list_intersect(w.f, v.f), lambda x: x <> 'PROMO')) > 0 AS overlap FROM w JOIN v USING (p_brand)"""
)
def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of two sets of parts, shared and usable."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", F.element_at(F.split("p_type", " "), 1).alias("f"))
    side = lambda n, name: p.where(F.col("p_size") % n == 0).groupBy("p_brand").agg(F.collect_set("f").alias(name))
    both = side(5, "a").join(side(7, "b"), "p_brand")
    shared = F.array_sort(F.array_intersect("a", "b"))
    return both.select("p_brand", shared.alias("shared"), (F.size(F.array_except(shared, F.array(F.lit("PROMO")))) > 0).alias("overlap"))


@query(
    """SELECT resume_id, skill, years, last_used_year FROM (SELECT o_custkey AS resume_id, o_orderpriority AS skill, first(CASE WHEN o_totalprice > 200000 THEN year(o_orderdate) END ORDER BY CASE WHEN o_totalprice > 200000 THEN 0 ELSE 1 END, o_orderkey) AS last_used_year,
  first(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 30 END ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey) AS years FROM orders GROUP BY 1, 2)"""
)
def merged_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per skill, each field the first that is there by arrival."""
    from ..operators.matching import merged_skills as merge

    o = table(spark, sf_dir, "orders")
    mentions = o.select(F.col("o_custkey").alias("resume_id"), F.col("o_orderpriority").alias("skill"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 30).alias("years"), F.when(F.col("o_totalprice") > 200000, F.year("o_orderdate")).alias("last_used_year"), F.col("o_orderkey").alias("at"))
    return merge(mentions).select("resume_id", "skill", "years", "last_used_year")
