"""Curated vocabularies and families from JSON or YAML files on any path that Spark reads."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.skills import dimension, skill_families, vocabulary


def read_entries(spark: SparkSession, path: str) -> list:
    """The document of one curated file; an absent file has no entries."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException:
        return []
    if not rows:
        return []
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(rows[0][0]) or []
    return json.loads(rows[0][0]) or []


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, canonical of a list of {canonical, aliases}."""
    return dimension(spark, vocabulary(read_entries(spark, path)))


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """skill, families of a mapping from family to skills."""
    entries = read_entries(spark, path) or {}
    return skill_families(spark.createDataFrame(sorted(entries.items()), "family string, skills array<string>"))
