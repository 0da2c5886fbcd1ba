"""Parsed job and résumé documents: views, embedding texts, and tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import known
from ..functions.strings import strip

EMPTY = "candidate"


def strip_nuls(c: Column) -> Column:
    """Text that a document store takes: without NUL characters."""
    return F.translate(c, "\x00", "")


def without_nuls(c: Column, kind: T.DataType) -> Column:
    """A nested value without NUL characters in any of its strings, keys of maps among them, however deep they lie."""
    if isinstance(kind, T.StringType):
        return strip_nuls(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: without_nuls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: without_nuls(k, kind.keyType)), lambda _, v: without_nuls(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[without_nuls(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def job_view(doc: Column, min_years: Column) -> Column:
    """What ranking reads of a job: the column's years if they are neither null nor 0, else the document's; blank names
    and fields go."""
    good = lambda a, name: F.filter(F.coalesce(a, F.array().cast("array<struct<name:string,min_years:int>>")), lambda s: F.coalesce(strip(s[name]) != "", F.lit(False)))
    fields = F.filter(F.coalesce(doc["education"]["fields"], F.array().cast("array<string>")), lambda f: F.coalesce(strip(f) != "", F.lit(False)))
    return F.struct(
        doc["title"].alias("title"),
        F.when(known(min_years), min_years).otherwise(doc["min_years_experience"]).alias("min_years"),
        good(doc["required_skills"], "name").alias("required"),
        good(doc["nice_to_have_skills"], "name").alias("nice"),
        doc["education"]["min_level"].alias("min_level"),
        fields.alias("fields"),
    )


def recent_title(roles: Column) -> Column:
    """The first title that is not blank, of current roles first, then of all roles in the document's order."""
    current = F.filter(roles, lambda r: F.coalesce(r["is_current"], F.lit(False)))
    order = F.concat(current, roles)
    return F.try_element_at(F.filter(F.transform(order, lambda r: r["title"]), lambda t: F.coalesce(strip(t) != "", F.lit(False))), F.lit(1))


def _listed(head: str, items: Column, sep: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(items, sep)))


def job_text(doc: Column) -> Column:
    """The text of a job that is embedded: title, responsibilities, skills."""
    names = lambda a: F.transform(a, lambda s: s["name"])
    return F.concat_ws(". ", doc["title"], _listed("", doc["responsibilities"], " "), _listed("Required: ", names(doc["required_skills"]), ", "), _listed("Nice to have: ", names(doc["nice_to_have_skills"]), ", "))


def resume_text(doc: Column) -> Column:
    """The text of a résumé that is embedded: summary, 30 skills, 5 roles, 3 degrees, and nothing of the candidate's
    identity; never empty."""
    skills = F.transform(F.slice(doc["skills"], 1, 30), lambda s: s["name"])
    roles = F.transform(F.slice(doc["experience"], 1, 5), lambda e: F.concat(F.coalesce(e["title"], F.lit("")), F.lit(" at "), F.coalesce(e["company"], F.lit(""))))
    year = lambda e: F.when(known(e["year"]), F.concat(F.lit(" ("), e["year"].cast("string"), F.lit(")"))).otherwise("")
    study = F.transform(F.slice(doc["education"], 1, 3), lambda e: F.concat(F.coalesce(e["degree"], F.lit("")), F.lit(", "), F.coalesce(e["institution"], F.lit("")), year(e)))
    text = F.concat_ws(". ", F.when(doc["summary"] != "", doc["summary"]), _listed("Skills: ", skills, ", "), _listed("Recent roles: ", roles, "; "), _listed("Education: ", study, "; "))
    return F.when(text == "", EMPTY).otherwise(text)


def readable_skills(raw: Column) -> Column:
    """Skill rows of a JSON array that validate: a name that is not blank, and years from 0 to 80 or none; a bad row goes
    alone.  Rows that are no objects go."""
    rows = F.from_json(raw, "array<string>")
    parsed = F.transform(rows, lambda r: F.struct(F.get_json_object(r, "$.name").alias("name"), F.get_json_object(r, "$.years").alias("years"), r.startswith("{").alias("object")))
    years = lambda r: r["years"].isNull() | F.coalesce(r["years"].try_cast("int").between(0, 80), F.lit(False))
    good = F.filter(parsed, lambda r: r["object"] & F.coalesce(strip(r["name"]) != "", F.lit(False)) & years(r))
    return F.transform(good, lambda r: F.struct(r["name"].alias("name"), r["years"].try_cast("int").alias("years")))


def without_headers(chunks: Column) -> Column:
    """Chunks without the first and without header sections, which may show who the candidate is."""
    return F.filter(chunks, lambda c, i: ~((i == 0) | (F.lower(F.coalesce(c["section"], F.lit(""))) == "header")))


def cited(ids: Column, valid: Column) -> Column:
    """Citations of chunks that exist, in order, repetitions kept."""
    return F.filter(ids, lambda i: F.array_contains(valid, i))
