"""Reads over the tables: scopes, joins, counts, histories and guarded changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ("uploaded", "parsing", "parsed", "failed", "withdrawn", "degraded")


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the columns given; null stands for any value."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def scoped(df: DataFrame, assignees: DataFrame, key: str, user: str | None) -> DataFrame:
    """Rows of the jobs that a user is assigned to; all rows for a user of unlimited scope (None)."""
    if user is None:
        return df
    mine = assignees.where(F.col("user_id") == user).select(F.col("job_id").alias(key))
    return df.join(mine, key, "left_semi")


def live(df: DataFrame, withdrawn: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not stand among the withdrawn."""
    return df.join(withdrawn.select(key), key, "left_anti")


def status_breakdown(rows: DataFrame, bucket: Column, degraded: Column, key: str | None = None, buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """Counts by bucket, zeros included, and the sub-count of degraded rows among the parsed."""
    keys = [key] if key else []
    counted = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    sub = rows.groupBy(*keys).agg(F.count(F.when(degraded, 1)).alias("n")).withColumn("bucket", F.lit("degraded"))
    names = F.explode(F.array(*map(F.lit, buckets))).alias("bucket")
    frame = rows.select(*keys).distinct().select(*keys, names) if key else rows.sparkSession.range(1).select(names)
    return frame.join(counted.unionByName(sub), [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Each key's first row in the order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__place = 1").drop("__place")


def dedup_outcome(batch: DataFrame, existing: DataFrame, sha: str, order: list[str], valid: Column) -> DataFrame:
    """Adds outcome: rejected rows first, then duplicates of a stored row or of an earlier row of the batch, then accepted."""
    stored = existing.select(sha).where(F.col(sha).isNotNull()).distinct().withColumn("__stored", F.lit(True))
    marked = batch.withColumn("__valid", F.coalesce(valid, F.lit(False))).join(stored, sha, "left")
    place = F.row_number().over(Window.partitionBy(sha, "__valid").orderBy(*order))
    outcome = F.when(~F.col("__valid"), "rejected").when(F.col("__stored") | (F.col("__place") > 1), "duplicate").otherwise("accepted")
    return marked.withColumn("__place", place).withColumn("outcome", outcome).drop("__valid", "__stored", "__place")


def upserted(table: DataFrame, new: DataFrame, key: list[str], prefer_new: list[str], sticky: list[str] = (), replace: list[str] = ()) -> DataFrame:
    """The table after an upsert: prefer_new fields take a new value that is not null, sticky fields keep the old one
    if there is one, replace fields take the new row's value whenever there is a new row."""
    a, b = table.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    both = a.join(b, key, "full")
    out = [F.col(k) for k in key]
    for c in table.columns:
        if c in key:
            continue
        old, now = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in prefer_new:
            out.append(F.coalesce(now, old).alias(c))
        elif c in sticky:
            out.append(F.coalesce(old, now).alias(c))
        elif c in replace:
            out.append(F.when(F.col("b.__new"), now).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return both.select(*out)


def guarded_update(table: DataFrame, guard: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Applies the changes to rows that pass the guard and adds applied; a null guard does not pass."""
    ok = F.coalesce(guard, F.lit(False))
    return table.withColumn("applied", ok).withColumns({k: F.when(ok, v).otherwise(F.col(k)) for k, v in changes.items()})


def patched(table: DataFrame, patch: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """A partial update: patch has key, fields (map<string,string>) and only names among the allowed count.  A field that
    is absent stays, a field given as null becomes null; changed lists the fields whose values differ, nulls compared."""
    both = table.join(patch.select(key, "fields"), key, "left")
    given = lambda c: F.coalesce(F.map_contains_key("fields", c), F.lit(False))
    value = lambda c: F.col("fields")[c].cast(table.schema[c].dataType)
    differs = F.filter(F.array(*[F.when(given(c) & ~F.col(c).eqNullSafe(value(c)), F.lit(c)) for c in allowed]), lambda x: x.isNotNull())
    out = both.withColumn("changed", differs)
    return out.withColumns({c: F.when(given(c), value(c)).otherwise(F.col(c)) for c in allowed}).drop("fields")


def deleted(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The table with all rows of the given keys replaced by the new ones, even where there are none."""
    return table.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def transitions(current: Column, wanted: Column, allowed: Mapping[str, tuple[str, ...]]) -> Column:
    """Whether a step from one state to another is allowed."""
    out = F.lit(False)
    for state, to in allowed.items():
        out = out | ((current == state) & wanted.isin(*to))
    return F.coalesce(out, F.lit(False))


def visible_state(state: Column, since: Column, as_of: Column, bound_seconds: int) -> Column:
    """A run state that shows only while it is younger than the bound."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(since)
    return F.when(age <= bound_seconds, state)


def gap_sessions(events: DataFrame, user: str, at: str, idle_seconds: int) -> DataFrame:
    """Sessions of each user, parted by gaps longer than the idle time: user, session, start, end, n."""
    by = Window.partitionBy(user).orderBy(at, "event_id")
    gap = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(by))
    marked = events.withColumn("new", F.when(gap.isNull() | (gap > idle_seconds), 1).otherwise(0))
    marked = marked.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def masked_details(details: Column, action: Column, allowed: Mapping[str, tuple[str, ...]], mark: str = "<withheld>") -> Column:
    """Values of a map<string,string> by the allow-list of its action; empty, zero and false values pass."""
    def keep(k: Column, v: Column) -> Column:
        listed = F.lit(False)
        for name, keys in allowed.items():
            listed = listed | ((action == name) & k.isin(*keys))
        falsy = v.isNull() | v.isin("", "0", "0.0", "false", "null", "[]", "{}")
        return F.when(listed | falsy, v).otherwise(mark)

    return F.transform_values(details, keep)


def outcome_tallies(df: DataFrame, key: str, outcomes: tuple[str, ...]) -> DataFrame:
    return df.groupBy(key).pivot("outcome", list(outcomes)).agg(F.count(F.lit(1))).na.fill(0, list(outcomes))


def rank_aligned(left: DataFrame, right: DataFrame, base: str, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Pairs the k-th row of a base on the left with the k-th of that base on the right; left rows without one stay."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(base).orderBy(*order_left)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(base).orderBy(*order_right)))
    return a.join(b, [base, "place"], "left")


def label_numbers(df: DataFrame, key: str, name: str, at: str) -> DataFrame:
    """Numbers each key's distinct names, case ignored, by first appearance: key, fold, number."""
    firsts = df.where(F.trim(name) != "").groupBy(key, F.lower(F.trim(name)).alias("fold")).agg(F.min(at).alias("first_at"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("first_at", "fold")))
