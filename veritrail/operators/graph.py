"""Edge tables projected from parsed documents, replaced key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import replaced


def job_edges(jobs: DataFrame) -> DataFrame:
    """job_id, kind, skill, display_name, min_years, is_must_have from required and nice-to-have skills; every required
    skill is a must; blank names have no edge.  jobs: job_id, required, nice (arrays of struct<name, min_years>)."""
    def side(column: str, kind: str, must: bool) -> DataFrame:
        rows = jobs.select("job_id", F.posexplode(column).alias("at", "s")).where(F.trim("s.name") != "")
        return rows.select("job_id", F.lit(kind).alias("kind"), F.lower(F.trim("s.name")).alias("skill"), F.trim("s.name").alias("display_name"), F.col("s.min_years").alias("min_years"), F.lit(must).alias("is_must_have"), "at")

    both = side("required", "requires", True).unionByName(side("nice", "nice_to_have", False))
    first = F.min(F.struct("at", "display_name", "min_years", "is_must_have")).alias("x")
    return both.groupBy("job_id", "kind", "skill").agg(first).select("job_id", "kind", "skill", "x.display_name", "x.min_years", "x.is_must_have")


def resume_edges(skills: DataFrame) -> DataFrame:
    """resume_id, skill, years, last_used_year, evidence_chunk_id (the first cited)."""
    return skills.select("resume_id", "skill", "years", "last_used_year", F.try_element_at("evidence_chunk_ids", F.lit(1)).alias("evidence_chunk_id"))


def project(edges: DataFrame, new: DataFrame, key: str, seen: DataFrame) -> DataFrame:
    """Edges after a projection: all edges of the keys seen go, the new ones come; the same batch twice changes nothing."""
    return replaced(edges, new, key, seen)


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: str = "resume_id") -> DataFrame:
    """New values win where they are not null."""
    both = nodes.alias("a").join(new.alias("b"), key, "full")
    return both.select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in nodes.columns if c != key])


def without_withdrawn(df: DataFrame, withdrawn: DataFrame, key: str = "resume_id") -> DataFrame:
    return df.join(withdrawn.select(key), key, "left_anti")


def unlinked_jobs(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    return jobs.join(edges.where("kind = 'requires'"), "job_id", "left_anti")


def label_counts(**nodes: DataFrame) -> DataFrame:
    out = None
    for label, df in nodes.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def embedding_payload(doc, *gone: str):
    """A parsed document without the fields that must not leave: identity, summary, chunk texts."""
    out = doc.dropFields(*(gone or ("candidate", "summary", "degraded", "degradation_reason")))
    return out.withField("chunks", F.transform(doc["chunks"], lambda c: c.dropFields("text")))
