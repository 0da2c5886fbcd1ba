"""Recall, reverse recall and near neighbours over the embeddings.

A label plays a job: its vector with the smallest id is the job's, all others of the label are the job's own pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import ranking, recall
from .registry import query, table

K = 50


def jobs_and_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("resume_id"), F.col("embedding").alias("vector"))
    first = e.groupBy("job_id").agg(F.min("resume_id").alias("resume_id"))
    jobs = e.join(first, ["job_id", "resume_id"], "left_semi").select("job_id", F.col("vector").alias("job_vector"))
    return jobs, e.join(first, ["job_id", "resume_id"], "left_anti")


JOBS_SQL = """
e AS (SELECT label AS job_id, vec_id AS resume_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
f AS (SELECT job_id, min(resume_id) AS first_id FROM e GROUP BY job_id),
jobs AS (SELECT e.job_id, e.vector AS job_vector FROM e JOIN f ON e.job_id = f.job_id AND e.resume_id = f.first_id),
pool AS (SELECT e.* FROM e JOIN f ON e.job_id = f.job_id AND e.resume_id <> f.first_id)"""
RECALL_SQL = f"""{JOBS_SQL},
scored AS (SELECT p.job_id, p.resume_id, (1 + list_cosine_similarity(p.vector, j.job_vector)) / 2 AS vec_score FROM pool p JOIN jobs j USING (job_id)),
recalled AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(vec_score, 12) DESC, resume_id) AS recall_rank FROM scored QUALIFY recall_rank <= {K}),
normed AS (SELECT *, CASE WHEN max(vec_score) OVER w - min(vec_score) OVER w < 1e-9 THEN 1.0
    ELSE (vec_score - min(vec_score) OVER w) / (max(vec_score) OVER w - min(vec_score) OVER w) END AS vec_norm,
    max(vec_score) OVER w - min(vec_score) OVER w >= 1e-9 AS discriminating FROM recalled WINDOW w AS (PARTITION BY job_id))"""


def recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, pool = jobs_and_pool(spark, sf_dir)
    return recall.normalised(recall.within_pools(jobs, pool, K))


@query(f"WITH {RECALL_SQL} SELECT job_id, resume_id, round(vec_score, 6) AS vec_score, recall_rank, round(vec_norm, 6) AS vec_norm, discriminating FROM normed")
def recall_topk_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalled(spark, sf_dir).select("job_id", "resume_id", F.round("vec_score", 6).alias("vec_score"), "recall_rank", F.round("vec_norm", 6).alias("vec_norm"), "discriminating")


@query(
    f"""WITH {RECALL_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM normed)
SELECT job_id, resume_id, recall_rank FROM c WHERE recall_rank <= greatest(1, ceil(n * 20 / 100.0))"""
)
def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_percent(recalled(spark, sf_dir), "job_id", F.lit(20), "recall_rank").select("job_id", "resume_id", "recall_rank")


@query(
    f"""WITH {JOBS_SQL},
r AS (SELECT p.resume_id, j.job_id, (1 + list_cosine_similarity(p.vector, j.job_vector)) / 2 AS vec_score FROM pool p, jobs j),
t AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY round(vec_score, 12) DESC, job_id) AS place FROM r QUALIFY place <= 5)
SELECT resume_id, job_id, round(vec_score, 6) AS vec_score, place FROM t WHERE job_id % 2 = 0"""
)
def reverse_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each résumé's five nearest of all jobs; jobs that are not open go after the cut, so fewer may stay."""
    jobs, pool = jobs_and_pool(spark, sf_dir)
    near = recall.nearest(pool.select(F.col("resume_id").alias("id"), "vector"), jobs.select(F.col("job_id").alias("id"), F.col("job_vector").alias("vector")), 5)
    open_jobs = jobs.where(F.col("job_id") % 2 == 0).select(F.col("job_id").cast("long").alias("item_id"))
    kept = near.join(open_jobs, "item_id", "left_semi")
    return kept.select(F.col("query_id").alias("resume_id"), F.col("item_id").cast("int").alias("job_id"), F.round("vec_score", 6).alias("vec_score"), "place")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, (1 + list_cosine_similarity(a.v, b.v)) / 2 AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, item_id) AS place FROM p QUALIFY place <= 5)
SELECT query_id, item_id, round(s, 6) AS vec_score, place, s >= 0.72 AS merged FROM t WHERE s > 0.66"""
)
def near_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near neighbours, the five best first and the threshold after; the bars are lowered to the table's likeness."""
    names = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return recall.near_names(names, 5, 0.66, 0.72).select("query_id", "item_id", F.round("vec_score", 6).alias("vec_score"), "place", "merged")


@query(
    f"""WITH {JOBS_SQL}, c AS (SELECT p.resume_id, list_cosine_similarity(p.vector, j.job_vector) AS cos FROM pool p JOIN jobs j USING (job_id))
SELECT resume_id, round(cos, 6) AS cos, round(least(1.0, greatest(0.0, (cos - 0.1) / 0.9)), 6) AS seniority FROM c"""
)
def seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw cosine of two titles above a floor, scaled to 1; the floor is lowered to the table's likeness."""
    from ..functions.scoring import seniority as score
    from ..weights import Weights

    jobs, pool = jobs_and_pool(spark, sf_dir)
    both = pool.join(jobs, "job_id").withColumn("cos", cosine(F.col("vector"), F.col("job_vector")))
    return both.select("resume_id", F.round("cos", 6).alias("cos"), F.round(score(F.col("cos"), Weights(seniority_floor=0.1)), 6).alias("seniority"))


@query(f"WITH {RECALL_SQL} SELECT job_id, count(*) AS n, round(max(vec_score) - min(vec_score), 6) AS spread, max(vec_score) - min(vec_score) >= 1e-9 AS discriminating FROM normed GROUP BY job_id")
def pool_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = recalled(spark, sf_dir).groupBy("job_id")
    spread = F.max("vec_score") - F.min("vec_score")
    return grouped.agg(F.count("*").alias("n"), F.round(spread, 6).alias("spread"), (spread >= 1e-9).alias("discriminating"))


def places(df: DataFrame, key: str, score: str, id: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), id)))
