"""Incremental operators: the outbox as a stream, projections, withdrawals and replays.

Events play the outbox: purchases carry parsed résumés of their user, errors withdraw them, other types are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, relational  # noqa: F401
from ..sources.tables import scratch_folder
from ..streaming import outbox as ob
from .registry import query, table


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.when(F.col("event_type") == "purchase", "resume.parsed").when(F.col("event_type") == "error", "resume.withdrawn").otherwise(F.concat(F.lit("other."), F.col("event_type")))
    skill = lambda n: F.struct(F.concat(F.lit("skill "), (F.col("k") % n).cast("string")).alias("name"), F.col("k").alias("years"), F.lit(2001).alias("last_used_year"), F.array(F.lit("c_001")).alias("evidence_chunk_ids"))
    payload = F.when(kind == "resume.parsed", F.to_json(F.struct(F.array(skill(7), skill(3)).alias("skills"), F.lit("j1").alias("job_id")))).otherwise("{}")
    return e.select(
        F.col("event_id").alias("id"), F.lit("resume").alias("aggregate"), F.col("user_id").cast("string").alias("aggregate_id"), kind.alias("event_type"), payload.alias("payload"),
        F.col("ts").alias("created_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("delivered_at"), F.lit(0).alias("delivery_attempts"),
    )


LAST_SQL = """o AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS resume_id, event_type, CAST(CAST(props AS JSON)->>'k' AS INT) AS k FROM events WHERE event_type IN ('purchase', 'error')),
last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY id DESC) = 1),
edges AS (SELECT resume_id, 'skill ' || (k % 7) AS skill, k AS years FROM last WHERE event_type = 'purchase' UNION SELECT resume_id, 'skill ' || (k % 3), k FROM last WHERE event_type = 'purchase')"""


@query(f"WITH {LAST_SQL} SELECT resume_id, skill, years, 'c_001' AS evidence_chunk_id FROM edges")
def batch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after all events, in one batch."""
    edges, _ = ob.resume_changes(outbox(spark, sf_dir))
    return edges.select("resume_id", "skill", "years", "evidence_chunk_id")


@query(f"WITH {LAST_SQL} SELECT resume_id, skill, years, 'c_001' AS evidence_chunk_id FROM edges")
def stream_outbox_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges by draining the outbox as a stream of files."""
    base = scratch_folder(spark, "outbox")
    events = outbox(spark, sf_dir).select("id", "aggregate", "aggregate_id", "event_type", "payload", "created_at")
    # the last event of a key counts within a batch, and later batches come later: only the halves need an order
    half = events.agg(F.percentile_approx("id", 0.5)).first()[0]
    for i, part in enumerate((events.where(F.col("id") <= half), events.where(F.col("id") > half))):
        part.write.mode("append").json(f"{base}/inbox/{i}")
        ob.drain(spark, f"{base}/inbox/*", base, files_per_batch=10_000)
    return ob.read_edges(spark, base).select("resume_id", "skill", "years", "evidence_chunk_id")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS aggregate_id, md5('k' || (CAST(props AS JSON)->>'k')) AS digest FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def replayed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivered payload of every résumé, for reinstatement."""
    o = outbox(spark, sf_dir)
    out = ob.replay(o, o.select(F.col("aggregate_id").alias("resume_id")).distinct())
    k = F.get_json_object("payload", "$.skills[0].years")
    return out.select("aggregate_id", F.md5(F.concat(F.lit("k"), k)).alias("digest"))


@query(
    """SELECT CASE event_type WHEN 'purchase' THEN 'resume.parsed' WHEN 'error' THEN 'resume.withdrawn' ELSE 'unknown' END AS route, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1"""
)
def event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undelivered events by route."""
    rows = ob.routed(ob.eligible(outbox(spark, sf_dir)))
    out = None
    for name in ("resume.parsed", "resume.withdrawn", "unknown"):
        one = rows[name].groupBy(F.lit(name).alias("route")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH s AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS cost FROM events WHERE event_id % 2 = 1 ORDER BY event_id LIMIT 50),
t AS (SELECT *, sum(cost) OVER (ORDER BY id) AS total, row_number() OVER (ORDER BY id) AS place FROM s)
SELECT id, cost FROM t WHERE place = 1 OR total <= 20"""
)
def next_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of the outbox: at most 50 rows by id whose skills stay within the budget."""
    return ob.next_batch(outbox(spark, sf_dir), 50, 20).select("id", "cost")


@query(
    """WITH p AS (SELECT c_nationkey AS job_id, c_mktsegment AS name, min(c_custkey) AS at FROM customer GROUP BY 1, 2),
r AS (SELECT n_nationkey AS job_id, 'requires' AS kind, lower(c_mktsegment) AS skill, c_mktsegment AS display_name, true AS is_must_have FROM nation JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000) ON c_nationkey = n_nationkey)
SELECT * FROM r UNION ALL SELECT n_nationkey, 'nice_to_have', lower(n_name), n_name, false FROM nation"""
)
def job_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement edges from nested job documents."""
    name = lambda c: F.struct(F.col(c).alias("name"), F.lit(1).alias("min_years"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(name("c_mktsegment"))).alias("required"))
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    jobs = n.select(F.col("n_nationkey").alias("job_id"), F.coalesce("required", F.array().cast("array<struct<name:string,min_years:int>>")).alias("required"), F.array(name("n_name")).alias("nice"))
    return graph.job_edges(jobs).select("job_id", "kind", "skill", "display_name", "is_must_have")


@query("SELECT n_nationkey AS job_id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def unlinked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("job_id"), F.lit("requires").alias("kind"))
    return graph.unlinked_jobs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_id")), edges)


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_counts(**{t: table(spark, sf_dir, t) for t in ("customer", "part", "supplier")})


@query(
    """SELECT o_orderkey AS resume_id, o_custkey AS job_id FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 3 = 0"""
)
def unprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after an upsert and the withdrawal of some; a new value that is null keeps the old one."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("resume_id"), F.lit(None).cast("long").alias("job_id"))
    new = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("resume_id"), F.col("o_custkey").cast("long").alias("job_id"))
    gone = o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("resume_id"))
    return graph.without_withdrawn(graph.upsert_nodes(old, new), gone)
