"""The scoring algebra as expressions.  Null stands for what was not recorded, and is never the same as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..weights import DEFAULT, Weights
from .strings import level_rank


def known(c: Column) -> Column:
    """True if the value is neither null nor 0."""
    return F.coalesce(c != 0, F.lit(False))


def is_senior(years: Column, bar: Column, w: Weights = DEFAULT) -> Column:
    return known(years) & known(bar) & F.coalesce(years >= bar * w.implied_seniority_factor, F.lit(False))


def recency(last_used: Column, today_year: int, w: Weights = DEFAULT) -> Column:
    """By years since the last use; unknown and future years count as now."""
    gap = F.lit(today_year) - F.when(known(last_used), last_used).otherwise(today_year)
    return F.when(gap <= w.recency_recent_years, w.recency_recent).when(gap <= w.recency_mid_years, w.recency_mid).otherwise(w.recency_old)


def skill_score(years: Column, wanted: Column, last_used: Column, ontology: Column, today_year: int, w: Weights = DEFAULT) -> Column:
    """Unknown years earn full credit on the axis of years; no ontology weight earns nothing."""
    need = F.greatest(F.lit(1), F.coalesce(wanted, F.lit(1)))
    held = F.when(years.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0), years) / need))
    return F.when(ontology == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), held * recency(last_used, today_year, w) * ontology)))


def miss_multiplier(must: Column, missing: Column, senior: Column, w: Weights = DEFAULT) -> Column:
    """1 without a missing must-have; else the penalty, or the relief of a senior candidate who has most of them."""
    coverage = 1 - F.try_divide(missing, must)
    relief = senior & (coverage >= w.implied_min_coverage)
    return F.when((must > 0) & (missing > 0), F.when(relief, w.implied_experience_relief).otherwise(w.must_have_miss_penalty)).otherwise(1.0)


def experience(years: Column, bar: Column, w: Weights = DEFAULT) -> Column:
    r = F.try_divide(F.coalesce(years, F.lit(0)), bar)
    over = F.greatest(F.lit(w.overqual_floor), 1 - (r - w.overqual_ratio) * w.overqual_slope)
    return F.when(known(bar), F.when(r <= 1, r).when(r <= w.overqual_ratio, 1.0).otherwise(over)).otherwise(1.0)


def education(best_rank: Column, min_level: Column, fields_asked: Column, field_matches: Column, w: Weights = DEFAULT) -> Column:
    """best_rank: the highest readable degree's rank, null if none is readable.  An unknown bar ranks 0 and is met."""
    need = level_rank(min_level)
    below = F.try_divide(w.education_partial * best_rank, need)
    met = F.when(~fields_asked | field_matches, 1.0).otherwise(w.education_partial)
    return F.when(F.coalesce(min_level, F.lit("")) == "", 1.0).when(best_rank.isNull(), 0.0).when(best_rank < need, below).otherwise(met)


def seniority(cos: Column, w: Weights = DEFAULT) -> Column:
    """From the raw cosine of two titles; 0 without a title."""
    scaled = (cos - w.seniority_floor) / (1 - w.seniority_floor)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)), F.lit(0.0))


def structured(skill: Column, exp: Column, edu: Column, sen: Column, vec: Column, w: Weights = DEFAULT) -> Column:
    return w.skill * skill + w.experience * exp + w.education * edu + w.seniority * sen + w.vector * vec


def final(structured_: Column, evidence: Column, motivation: Column | None = None, w: Weights = DEFAULT) -> Column:
    """Without motivation, as in reverse matching, the score stays below 1 - its weight."""
    out = w.structured * structured_ + w.evidence * evidence
    return out if motivation is None else out + w.motivation * motivation


def completeness(requirements: Column, w: Weights = DEFAULT) -> Column:
    """Met and partial requirements over all that were emitted; 0 for none."""
    met = F.size(F.filter(requirements, lambda r: (r["status"] == "met") & (r["confidence"] >= w.evidence_met_confidence)))
    partial = F.size(F.filter(requirements, lambda r: r["status"] == "partial"))
    n = F.size(requirements)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.try_divide(met + w.evidence_partial_weight * partial, n))


def motivation(themes: Column, w: Weights = DEFAULT) -> Column:
    """Confidence of the verified themes over all that were emitted; 0 for none."""
    good = F.filter(themes, lambda t: (t["confidence"] >= w.motivation_min_confidence) & (F.size(t["evidence_chunk_ids"]) > 0))
    total = F.aggregate(good, F.lit(0.0), lambda s, t: s + t["confidence"])
    n = F.size(themes)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0.0).otherwise(F.try_divide(total, n))


def coerced_year(text: Column) -> Column:
    """A year of four digits in 1900-2100, or of two: 0-68 in this century, 69-99 in the last; else null."""
    n = F.trim(text).try_cast("int")
    return F.when(n.between(1900, 2100), n).when(n.between(0, 68), 2000 + n).when(n.between(69, 99), 1900 + n)


def coerced_years(text: Column) -> Column:
    n = F.trim(text).try_cast("int")
    return F.when(n.between(0, 80), n)
