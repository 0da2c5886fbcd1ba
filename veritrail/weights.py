"""The tunables of the scoring algebra, validated when made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Weights:
    # fixed values: the published defaults of the scoring algebra
    structured: float = 0.6
    evidence: float = 0.3
    motivation: float = 0.1
    skill: float = 0.40
    experience: float = 0.25
    education: float = 0.10
    seniority: float = 0.15
    vector: float = 0.10
    must_have_miss_penalty: float = 0.5
    implied_experience_relief: float = 0.75
    recency_recent_years: int = 2
    recency_mid_years: int = 5
    recency_recent: float = 1.0
    recency_mid: float = 0.7
    recency_old: float = 0.4
    overqual_ratio: float = 2.0
    overqual_slope: float = 0.1
    overqual_floor: float = 0.8
    education_partial: float = 0.5
    education_field_fuzz: float = 0.85
    seniority_floor: float = 0.5
    implied_seniority_factor: float = 1.5
    implied_min_coverage: float = 0.5
    evidence_met_confidence: float = 0.7
    evidence_partial_weight: float = 0.5
    evidence_verify_fuzz: float = 0.85
    evidence_min_quote_chars: int = 16
    motivation_min_confidence: float = 0.7

    def __post_init__(self):
        at_least_one = {"overqual_ratio", "implied_seniority_factor"}
        unbounded = at_least_one | {"overqual_slope"}
        for f in fields(self):
            v = getattr(self, f.name)
            whole = f.name.endswith(("_years", "_chars"))
            if v < (1 if f.name in at_least_one else 0) or (not whole and f.name not in unbounded and v > 1):
                raise ValueError(f"{f.name} is out of range: {v}")
        if self.seniority_floor >= 1:
            raise ValueError("seniority_floor must be below 1")
        for names in (("structured", "evidence", "motivation"), ("skill", "experience", "education", "seniority", "vector")):
            total = sum(getattr(self, n) for n in names)
            if abs(total - 1) > 0.01:
                raise ValueError(f"{' + '.join(names)} must be 1, not {total:.3f}")
        if self.implied_experience_relief < self.must_have_miss_penalty:
            raise ValueError("the relief must not be harsher than the penalty")


DEFAULT = Weights()


def read(values: Mapping[str, str], prefix: str = "MATCH_") -> Weights:
    """Weights from settings such as os.environ: names with the prefix, in any case; others are left alone.

    A name that is no weight, and a value that is no number or out of range, is an error.
    """
    kinds = {f.name: type(f.default) for f in fields(Weights)}
    given = {k[len(prefix) :].lower(): v for k, v in values.items() if k.upper().startswith(prefix.upper())}
    if unknown := set(given) - set(kinds):
        raise ValueError(f"no such weights: {sorted(unknown)}")
    return Weights(**{k: kinds[k](v) for k, v in given.items()})
