"""Documents, withdrawals and gates on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, gates, lifecycle
from .matching import FINAL_SQL, final_ranking
from .registry import query, table
from .texts import _evidence

NOW = "TIMESTAMP '2001-08-01 00:00:00'"


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gone = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").cast("string").alias("resume_id"), F.lit("parsed").alias("status"), gone.alias("withdrawn_at"), F.lit(None).cast("string").alias("withdrawal_reason"), "o_orderstatus")


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS resume_id, CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS TIMESTAMP) WHEN o_orderstatus = 'P' THEN {NOW} END AS withdrawn_at,
  o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AS announced FROM orders"""
)
def withdrawal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of status P are withdrawn; those withdrawn before stay, and are not announced again."""
    r = _resumes(spark, sf_dir)
    ids = r.where("o_orderstatus = 'P'").select("resume_id", F.lit("closed").alias("reason"))
    after, _, events = lifecycle.withdraw(r, ids, F.expr(NOW), "u1")
    told = events.select(F.col("aggregate_id").alias("resume_id"), F.lit(True).alias("announced"))
    return after.join(told, "resume_id", "left").select("resume_id", "withdrawn_at", F.coalesce("announced", F.lit(False)).alias("announced"))


@query(
    """SELECT n_nationkey AS job_id, concat_ws('. ', n_name, 'Required: ' || (SELECT string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = n_nationkey)),
  'Nice to have: ' || r_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def job_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    named = lambda a: F.transform(a, lambda s: F.struct(s.alias("name"), F.lit(1).alias("min_years")))
    doc = F.struct(F.col("n_name").alias("title"), F.array().cast("array<string>").alias("responsibilities"), named(F.col("segments")).alias("required_skills"), named(F.array("r_name")).alias("nice_to_have_skills"))
    return n.select(F.col("n_nationkey").alias("job_id"), documents.job_text(doc).alias("text"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'O' AS cur, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS title FROM orders)
SELECT o_custkey, arg_min(title, CASE WHEN cur THEN o_orderkey ELSE 1000000000000 + o_orderkey END) FILTER (trim(title) <> '') AS title FROM r GROUP BY 1"""
)
def recent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders play roles: open ones are current, every third has a blank title."""
    o = table(spark, sf_dir, "orders")
    role = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), (F.col("o_orderstatus") == "O").alias("is_current"))
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(role)).alias("roles")).select("o_custkey", documents.recent_title(F.col("roles")).alias("title"))


@query(f"WITH {FINAL_SQL} SELECT job_id, count(*) FILTER (round(evidence, 9) >= 0.5) AS good, count(*) AS n, count(*) FILTER (round(evidence, 9) >= 0.5) = count(*) AS passes FROM ranked WHERE rank <= 5 GROUP BY 1")
def completeness_in_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = final_ranking(spark, sf_dir).select("job_id", "rank", F.round("evidence", 9).alias("score_evidence"))
    return gates.completeness_in_top(entries, "job_id", 5, 0.5)


@query()
def verification_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the quotes with a citation that a cited chunk bears out."""
    req, chunks = _evidence(spark, sf_dir)
    return gates.verification_rate(req, chunks)
