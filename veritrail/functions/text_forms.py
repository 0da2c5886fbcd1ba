"""Templates, tickets, choices and waits: small forms that services exchange."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def rendered(template: str, **values: Column) -> Column:
    """A template with a column for every {{ name }}; a name without a column is an error, a null value is empty."""
    if missing := {m[1] for m in PLACE.finditer(template)} - set(values):
        raise KeyError(f"the template names what is not given: {sorted(missing)}")
    parts, at = [], 0
    for m in PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def ticket_user(xml: Column) -> Column:
    """The user of a single sign-on response, or null if it tells of a failure, has no user, or is no XML."""
    tag = lambda name: f"*[local-name()='{name}']"
    whole = F.when(xml.rlike(r"(?s)^\s*<.*>\s*$") & (F.regexp_count(xml, F.lit(r"<[^/!?][^>]*[^/]>|<\w>")) == F.regexp_count(xml, F.lit(r"</[^>]+>"))), xml)
    user = F.trim(F.xpath_string(whole, F.lit(f"//{tag('authenticationSuccess')}/{tag('user')}")))
    return F.when(user != "", user)


def ticket_failure(xml: Column) -> Column:
    """The code of a refusal."""
    code = F.regexp_extract(xml, r"authenticationFailure[^>]*\bcode=[\"']([^\"']*)", 1)
    return F.when(code != "", code)


def backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds before the next attempt: doubled up to 8, a quarter more or less by a jitter from 0 to 1."""
    return F.least(F.lit(8.0), F.pow(F.lit(2.0), attempt)) * (F.lit(1.0) + (jitter * 2 - 1) * 0.25)


def retry_state(attempt: Column, ceiling: int, defer_seconds: int) -> Column:
    """What becomes of a run that failed: state and the seconds until the next; the last attempt's state is final."""
    again = attempt < ceiling
    return F.struct(F.when(again, "deferred").otherwise("exhausted").alias("state"), F.when(again, F.lit(defer_seconds)).alias("seconds"))


def breaker(calls: Column, threshold: int, cooldown_seconds: float) -> Column:
    """The state of a circuit breaker after each call: array<string> of closed, open, half-open and refused.

    calls: array<struct<at: double, ok: boolean>> in order of time.  After `threshold` failures in a row it is open; calls
    within the cool-down are refused; the first one after it goes through as a trial: half-open stands for that trial,
    whatever its result, and counting begins anew.
    """
    none = F.lit(None).cast("double")

    def step(s: Column, call: Column) -> Column:
        waits = s["opened"].isNotNull() & (call["at"] - s["opened"] < cooldown_seconds)
        trial = s["opened"].isNotNull() & ~waits
        failures = F.when(call["ok"], 0).otherwise(F.when(trial, 0).otherwise(s["failures"]) + 1)
        opens = ~call["ok"] & (failures >= threshold)
        state = F.when(waits, "refused").when(opens, "open").when(trial, "half-open").otherwise("closed")
        return F.struct(
            F.when(waits, s["failures"]).otherwise(failures).cast("int").alias("failures"), F.when(waits, s["opened"]).when(opens, call["at"]).otherwise(none).alias("opened"),
            F.concat(s["states"], F.array(state)).alias("states"),
        )

    start = F.struct(F.lit(0).alias("failures"), none.alias("opened"), F.array().cast("array<string>").alias("states"))
    return F.aggregate(calls, start, step, lambda s: s["states"])
