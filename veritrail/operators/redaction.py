"""Masking of identities in texts and nested documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import collapse, let, letters, mask_emails, mask_phones, masked_filename, pseudonym, replace_matches, without_contacts  # noqa: F401

#: The marks, and the shape of a city before a comma and a region.
NAME_MARK, CONTACT_MARK, PLACE_MARK = "[name redacted]", "[contact redacted]", "[location redacted]"
NEVER = "(?!)"
CITY = r"\b[A-Z][a-z][\w.'\-]*(?:[ \-][A-Z][a-z][\w.'\-]*){0,3}\s*,\s*"


def quoted(c: Column) -> Column:
    """A literal for use inside a pattern."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#\-&~])", r"\\$1")


def whole_words(terms: Column) -> Column:
    """A pattern of any of the terms (array<string>) as whole words, case ignored, the longest first; null for none."""
    good = F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False))))
    longest = F.transform(F.array_sort(F.transform(good, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return F.when(F.size(longest) > 0, F.concat(F.lit(r"(?iU)(?<!\w)(?:"), F.array_join(F.transform(longest, quoted), "|"), F.lit(r")(?!\w)")))


def name_terms(name: Column) -> Column:
    """A person's whole name and its parts of two characters or more."""
    parts = F.filter(F.split(F.trim(name), r"(?U)\s+"), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) > 0, F.concat(F.array(F.trim(name)), parts)).otherwise(F.array().cast("array<string>"))


def replace_terms(text: Column, terms: Column, mark: Column | str) -> Column:
    pattern = whole_words(terms)
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.when(pattern.isNull(), text).otherwise(F.regexp_replace(text, pattern, F.regexp_replace(mark, r"([\\$])", r"\\$1")))


def overlay(a: Column, b: Column) -> Column:
    """The union of two maps; of a key that both have, the value of the second."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def foreign_pattern(regions: Iterable[str]) -> str:
    """A city, a comma and one of the regions."""
    any_region = "|".join(r.replace(".", r"\.") for r in sorted(regions, key=lambda r: (-len(r), r)))
    return rf"(?U){CITY}(?:{any_region})\b"


def is_foreign(location: Column, regions: Iterable[str]) -> Column:
    any_region = "|".join(r.replace(".", r"\.") for r in sorted(regions, key=lambda r: (-len(r), r)))
    return F.coalesce(location.rlike(rf"(?U)\b(?:{any_region})\b"), F.lit(False))


def masked_text(text: Column, name: Column, terms: Column, labels: Column, place: Column, regions: tuple[str, ...] = ()) -> Column:
    """Masks, in this order: the name, known terms by their labels, the own foreign place, foreign places, mail addresses,
    telephone numbers.  Null and empty texts stay.

    name, terms, place: patterns, NEVER for none; labels: array<struct<fold, label>> of the terms in lower case.  Terms are
    replaced in one pass: a label is never replaced.
    """
    label = lambda m: F.try_element_at(F.filter(labels, lambda x: x["fold"] == F.lower(m)), F.lit(-1))["label"]
    out = replace_matches(F.regexp_replace(text, name, F.lit(NAME_MARK)), terms, lambda m: F.coalesce(label(m), m))
    if regions:
        out = F.regexp_replace(F.regexp_replace(out, place, F.lit(PLACE_MARK)), foreign_pattern(regions), PLACE_MARK)
    return mask_phones(mask_emails(out, CONTACT_MARK), CONTACT_MARK)


def folded(labels: Column) -> Column:
    """A map of labels as masked_text() looks them up."""
    return F.transform(F.map_entries(labels), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("fold"), e["value"].alias("label")))


def _pattern(terms: Column) -> Column:
    return F.coalesce(whole_words(terms), F.lit(NEVER))


def redact_text(text: Column, name: Column | None = None, labels: Column | None = None, location: Column | None = None, regions: Iterable[str] = ()) -> Column:
    """A text without name, terms (map<string,string> to their labels), places and contacts; see masked_text().

    For many texts of one document add their patterns as columns once: see hider().
    """
    regions, none = tuple(regions), F.lit(None).cast("string")
    labels = F.create_map().cast("map<string,string>") if labels is None else labels
    place = F.when(is_foreign(location, regions), location) if regions and location is not None else none
    return masked_text(text, _pattern(name_terms(F.coalesce(none if name is None else name, F.lit("")))), _pattern(F.map_keys(labels)), folded(labels), _pattern(F.array(place)), regions)


HELPERS = ("__labels", "__name", "__terms", "__folds", "__place", "__texts")


def hider(df: DataFrame, doc: str, name: Column | None = None, regions: Iterable[str] = ()) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The rows with HELPERS added, which are worked out once a row, and a function that masks a text of the document (a
    column of schemas.RESUME_DOCUMENT) with them.  name: the candidate's, if it is not the document's."""
    regions, parsed = tuple(regions), F.col(doc)
    place = parsed["candidate"]["location"]
    df = df.withColumns({"__labels": labels_of(parsed), "__texts": source_texts(parsed), "__name": _pattern(name_terms(F.coalesce(parsed["candidate"]["name"] if name is None else name, F.lit(""))))})
    own = F.when(is_foreign(place, regions), place) if regions else F.lit(None).cast("string")
    df = df.withColumns({"__terms": _pattern(F.map_keys("__labels")), "__folds": folded(F.col("__labels")), "__place": _pattern(F.array(own))})
    return df, lambda t: masked_text(t, F.col("__name"), F.col("__terms"), F.col("__folds"), F.col("__place"), regions)


def label_map(names: Column, noun: str) -> Column:
    """Every distinct name's label by first appearance, case ignored: map<name, 'Employer A'>."""
    plain = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.coalesce(n != "", F.lit(False)))
    folds = F.array_distinct(F.transform(plain, lambda n: F.lower(n)))
    pairs = F.transform(F.array_distinct(plain), lambda n: F.struct(n.alias("key"), F.concat(F.lit(f"{noun} "), letters(F.array_position(folds, F.lower(n)))).alias("value")))
    return F.map_from_entries(pairs)


def labels_of(doc: Column) -> Column:
    """Labels of a parsed résumé's employers and institutions; a name that is both has its label as an institution."""
    names = lambda rows, field: F.coalesce(F.transform(rows, lambda r: r[field]), F.array().cast("array<string>"))
    return overlay(label_map(names(doc["experience"], "company"), "Employer"), label_map(names(doc["education"], "institution"), "Institution"))


def blind_resumes(df: DataFrame, doc: str, out: str, regions: Iterable[str] = ()) -> DataFrame:
    """Adds a parsed résumé without identity: texts masked, employers and institutions as labels, graduation years and
    foreign places gone; titles, dates, skills and degrees stay."""
    regions = tuple(regions)
    df, hide = hider(df, doc, None, regions)
    parsed, labels = F.col(doc), F.col("__labels")
    place = parsed["candidate"]["location"]
    label = lambda c: F.coalesce(labels[F.trim(c)], c)
    none = F.lit(None).cast("string")
    candidate = F.struct(none.alias("name"), none.alias("email"), none.alias("phone"), (F.when(~is_foreign(place, regions), place) if regions else place).alias("location"))
    texts = lambda rows: F.transform(rows, lambda r: r.withField("text", hide(r["text"])))
    blind = parsed.withField("candidate", candidate).withField("summary", hide(parsed["summary"]))
    blind = blind.withField("experience", F.transform(parsed["experience"], lambda r: r.withField("company", label(r["company"])).withField("bullets", texts(r["bullets"]))))
    blind = blind.withField("education", F.transform(parsed["education"], lambda e: e.withField("institution", label(e["institution"])).withField("year", F.lit(None).cast("int"))))
    for part in ("chunks", "cover_letter_chunks"):
        blind = blind.withField(part, texts(parsed[part]))
    return df.withColumn(out, blind).drop(*HELPERS)


def source_texts(doc: Column) -> Column:
    """The chunks of a parsed résumé as struct<id, text>, those of the cover letter after it."""
    none = F.array().cast("array<struct<id:string,text:string>>")
    part = lambda c: F.coalesce(F.transform(doc[c], lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))), none)
    return F.concat(part("chunks"), part("cover_letter_chunks"))


def cited_text(ids: Column, texts: Column) -> Column:
    """Texts of the cited chunks in order, each id once, joined by a blank line; of an id's definitions the first counts."""
    found = F.transform(F.array_distinct(ids), lambda i: F.try_element_at(F.filter(texts, lambda t: t["id"] == i), F.lit(1))["text"])
    return F.array_join(F.filter(found, lambda t: F.coalesce(t != "", F.lit(False))), "\n\n")


def with_sources(evidence: Column, texts: Column, hide=None) -> Column:
    """Evidence whose requirements carry the text of what they cite as source_context, null where that is nothing;
    hide masks it.  texts: as source_texts() gives them, a column of its own."""
    def one(r: Column) -> Column:
        text = F.coalesce(cited_text(r["evidence_chunk_ids"], texts), F.lit(""))
        return r.withField("source_context", let(text, lambda t: F.when(t != "", hide(t) if hide else t)))

    return evidence.withField("requirements", F.transform(evidence["requirements"], one))


def blind_evidence(evidence: Column, hide) -> Column:
    """Evidence with the quotes of requirements and cover letter, and both overall texts, masked."""
    quotes = lambda rows: F.transform(rows, lambda r: r.withField("evidence", hide(r["evidence"])))
    for part in ("requirements", "cover_letter_evidence"):
        evidence = evidence.withField(part, quotes(evidence[part]))
    for part in ("overall_summary", "overall_motivation"):
        evidence = evidence.withField(part, hide(evidence[part]))
    return evidence


def embedding_safe(text: Column, name: Column, email: Column, phone: Column, location: Column) -> Column:
    """A text without the candidate's own identifiers, however their blanks run, nor the part of the address before the @
    if it is not of letters alone; blanks are collapsed.  Without any identifier, whatever is shaped like a contact goes."""
    loose = lambda c: F.concat(F.lit("(?iU)"), F.regexp_replace(quoted(F.trim(c)), r"(?U)\s+", r"\\s+"))
    local = F.substring_index(email, "@", 1)
    distinctive = F.when(F.contains(email, F.lit("@")) & local.rlike("[^A-Za-z]"), local)
    given = F.filter(F.array(name, email, phone, location, distinctive), lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    removed = F.aggregate(given, text, lambda t, term: F.regexp_replace(t, loose(term), F.lit(" ")))
    return F.when(F.size(given) == 0, without_contacts(text)).otherwise(collapse(removed))


def scrubbed_names(skills: Column, name: Column, email: Column, phone: Column, location: Column) -> Column:
    """Skill names without the candidate's identifiers; what is blank then goes."""
    masked = F.transform(skills, lambda s: embedding_safe(s, name, email, phone, location))
    return F.filter(masked, lambda s: F.coalesce(s != "", F.lit(False)))


def leaks(text: Column, name: Column, email: Column) -> Column:
    """Whether a text shows a name, an address, or seven digits in a row of a phone number."""
    shown = lambda c: F.coalesce((F.trim(c) != "") & F.contains(F.lower(text), F.lower(c)), F.lit(False))
    return shown(name) | shown(email) | F.coalesce(text.rlike(r"\d(?:[ .()-]?\d){6,}"), F.lit(False))
