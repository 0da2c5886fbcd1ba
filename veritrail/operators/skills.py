"""Skill names: vocabularies, staged normalisation, scanning, keys and families."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_key
from ..functions.strings import clean, reject_reason, strip_version

EDGE = "A-Za-z0-9+#"


def vocabulary(entries: Iterable[Mapping]) -> dict[str, str]:
    """Alias to canonical name, both lower-cased; the last entry wins, and a canonical name stands for itself."""
    out: dict[str, str] = {}
    for e in entries or ():
        canonical = e["canonical"].strip().lower()
        out |= {a.strip().lower(): canonical for a in e.get("aliases") or ()}
        out[canonical] = canonical
    return out


def dimension(spark: SparkSession, table: Mapping[str, str], key: str = "alias", value: str = "canonical") -> DataFrame:
    """A vocabulary as a table; its size is that of a curated file."""
    return spark.createDataFrame(sorted(table.items()), f"{key} string, {value} string")


def skill_families(families: DataFrame) -> DataFrame:
    """family, skills (array) to skill, families (sorted array)."""
    flat = families.select("family", F.explode("skills").alias("skill")).select("family", F.lower(F.trim("skill")).alias("skill"))
    return flat.groupBy("skill").agg(F.array_sort(F.collect_set("family")).alias("families"))


def normalised(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Adds skill: the canonical name found by the whole phrase, by the phrase without its trailing version, by the
    phrase without brackets, or by what the brackets hold; the cleaned phrase if none is known.

    What brackets hold counts only if the phrase outside is empty or has a word of the vocabulary.  Lookups are equi-joins
    of the distinct names' candidates with the vocabulary.
    """
    low = F.lower(F.trim(name))
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    outer = clean(F.regexp_replace(low, r"\([^()]*\)", " "))
    inner = F.filter(F.regexp_extract_all(low, F.lit(r"\(([^()]*)\)"), 1), lambda x: F.trim(x) != "")
    base = distinct.select(name, clean(low).alias("full"), outer.alias("outer"), inner.alias("inner"))
    has = F.size("inner") > 0
    tries = [F.struct(F.lit(0).alias("step"), F.col("full").alias("try")), F.struct(F.lit(1).alias("step"), strip_version(F.col("full")).alias("try"))]
    tries += [F.struct(F.lit(2).alias("step"), F.when(has, F.col("outer")).alias("try")), F.struct(F.lit(3).alias("step"), F.when(has, strip_version(F.col("outer"))).alias("try"))]
    inside = F.flatten(F.transform("inner", lambda x, i: F.array(F.struct((i * 2 + 10).alias("step"), clean(x).alias("try")), F.struct((i * 2 + 11).alias("step"), strip_version(clean(x)).alias("try")))))
    asked = base.select(name, "full", "outer", F.explode(F.concat(F.array(*tries), inside)).alias("t")).select(name, "full", "outer", "t.step", "t.try")
    hits = asked.join(aliases, asked["try"] == aliases["alias"]).select(name, "step", "canonical")
    words = base.select(name, F.explode(F.split("outer", " ")).alias("word")).join(aliases, F.col("word") == F.col("alias"), "left_semi").select(name).distinct().withColumn("near", F.lit(True))
    best = hits.join(words, name, "left").join(base.select(name, "outer"), name)
    allowed = (F.col("step") < 10) | F.coalesce("near", F.lit(False)) | (F.col("outer") == "")
    found = best.where(allowed).groupBy(name).agg(F.min(F.struct("step", "canonical"))["canonical"].alias("canonical"))
    resolved = base.join(found, name, "left").select(F.col(name).alias("__name"), F.coalesce("canonical", "full").alias("skill"), F.col("canonical").isNotNull().alias("known"))
    return names.join(resolved, F.col(name) == F.col("__name"), "left").drop("__name")


def scan_pattern(terms: Iterable[str]) -> str:
    """Any term between characters that are no letter, digit, plus or hash, the longest first."""
    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?i)(?<![{EDGE}])({alternatives})(?![{EDGE}])" if alternatives else r"((?!x)x)"


def scanned(texts: DataFrame, key: str, text: str, aliases: DataFrame, terms: Iterable[str]) -> DataFrame:
    """key and skills: the canonical skills named in each text, each once, in the order of their first mention.

    aliases: alias, canonical; terms: the aliases.  The pattern finds mentions, a join names them, so what a mention costs
    does not depend on the size of the vocabulary.  Keys are unique.  A null text names nothing.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(scan_pattern(terms)), F.lit(1))
    mentions = texts.select(key, F.posexplode(found).alias("at", "mention")).withColumn("alias", F.lower("mention"))
    named = mentions.join(aliases, "alias").groupBy(key, "canonical").agg(F.min("at").alias("at"))
    listed = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "canonical"))).alias("found"))
    skills = F.coalesce(F.transform("found", lambda x: x["canonical"]), F.array().cast("array<string>"))
    return texts.select(key).join(listed, key, "left").select(key, skills.alias("skills"))


def unclassified(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that the vocabulary does not hold, which are those that a classifier is asked about."""
    low = names.select(F.lower(F.trim(name)).alias(name)).where(F.col(name) != "").distinct()
    return low.join(aliases.select(F.col("canonical").alias(name)), name, "left_anti")


def with_families(names: DataFrame, families: DataFrame, name: str = "skill") -> DataFrame:
    """Skills with their curated families (skill, families), null where there are none."""
    return names.join(families.select(F.col("skill").alias(name), "families"), name, "left")


def chosen(answer: Column, offered: Column) -> Column:
    """An answer, if it is one of those that were offered; null otherwise."""
    return F.when(F.array_contains(offered, F.trim(answer)), F.trim(answer))


def union_names(first: Column, second: Column, most: int = 400) -> Column:
    """Both lists in order, each name once, capped."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda x: x != "")), 1, most)


def resolved_keys(names: DataFrame, aliases: DataFrame, salt: str, name: str = "name") -> DataFrame:
    """Adds skill, reason (why the name is junk, or null) and skill_key (null for junk); every input has a row."""
    out = normalised(names, aliases, name).withColumn("reason", reject_reason(F.col(name)))
    key = canonical_key(F.col("skill"), F.coalesce("known", F.lit(False)), salt)
    return out.withColumn("skill_key", F.when(F.col("reason").isNull() & (F.col("skill") != ""), key)).drop("known")


def validated_families(offered: Column, known: Iterable[str], most: int = 2) -> Column:
    """At most two families of the closed set; null, never an empty list, if none is known."""
    good = F.slice(F.array_intersect(offered, F.array(*map(F.lit, sorted(known)))), 1, most)
    return F.when(F.size(good) > 0, good)
