"""Ranks, prefixes and pages with total orders, and the quality measures of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: str, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based places in each list; the order must be total for the places to be reproducible."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def top_percent(df: DataFrame, key: str, percent: Column, rank: str = "rank") -> DataFrame:
    """Each list's first places up to a share of it, one at least."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__cap", F.greatest(F.lit(1), F.ceil(n * percent / 100))).where(F.col(rank) <= F.col("__cap")).drop("__cap")


def evaluated(df: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    """Marks the first k of each list as those whose evidence is sought."""
    return ranked(df, key, order, "__place").withColumn("evidence_evaluated", F.col("__place") <= k).drop("__place")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def _prefix(df: DataFrame, order: list[str], cost: str, budget: int, part: str | None) -> DataFrame:
    base = Window.partitionBy(part) if part else Window.partitionBy()
    window = base.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__sum", F.sum(cost).over(window)).withColumn("__place", F.row_number().over(base.orderBy(*order)))
    over = F.max(((F.col("__sum") > budget) & (F.col("__place") > 1)).cast("int")).over(window)
    return summed.withColumn("__over", over).where("__over = 0").drop("__sum", "__place", "__over")


def budget_prefix(df: DataFrame, order: list[str], cost: str, budget: int, part: str | None = None, buckets: int = 1024) -> DataFrame:
    """Rows in order while their summed cost stays within the budget; the first always, and none after a violation.

    A queue is first dealt into ranges of its leading order column, a number, and only the ranges' sums are put in order:
    rows of ranges that begin beyond the budget never reach the window.  Costs are not negative; of a null cost 0 counts.
    """
    keys = [part] if part else []
    df = df.withColumn(cost, F.coalesce(cost, F.lit(0)))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    low, high = F.min(order[0]).alias("__low"), F.max(order[0]).alias("__high")
    if keys:
        dealt = df.join(df.groupBy(*keys).agg(low, high), keys)
    else:
        ends = df.agg(low, high).first()
        dealt = df.withColumn("__low", F.lit(ends[0])).withColumn("__high", F.lit(ends[1]))
    at = F.floor((F.col(order[0]) - F.col("__low")) * F.lit(buckets) / (F.col("__high") - F.col("__low") + 1)).cast("int")
    dealt = dealt.withColumn("__range", F.coalesce(at, F.lit(0))).drop("__low", "__high")
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(cost).alias("__cost"))
    before = F.coalesce(F.sum("__cost").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min("__range").over(whole)
    near = sums.withColumn("__before", before).withColumn("__first", first).where((F.col("__before") <= budget) | (F.col("__range") == F.col("__first")))
    kept = dealt.join(near.select(*keys, "__range"), [*keys, "__range"], "left_semi").select(*df.columns)
    return _prefix(kept, order, cost, budget, part)


def precision_at(df: DataFrame, key: str, k: int, good: Column, rank: str = "rank") -> DataFrame:
    """Share of good rows among each list's first k, and whether the list is that long."""
    first = df.where(F.col(rank) <= k)
    return first.groupBy(key).agg(F.avg(good.cast("double")).alias("precision"), F.count("*").alias("n"), (F.count("*") >= k).alias("enough"))


def bait_below_strong(df: DataFrame, key: str, tag: str, rank: str = "rank") -> DataFrame:
    """Whether each list's first bait stands below its last strong candidate; null without either."""
    bait = F.min(F.when(F.col(tag) == "bait", F.col(rank)))
    strong = F.max(F.when(F.col(tag) == "strong", F.col(rank)))
    return df.groupBy(key).agg(bait.alias("first_bait"), strong.alias("last_strong"), (bait > strong).alias("below"))


def bait_and_strong(df: DataFrame, key: str, tag: str, place: Column) -> DataFrame:
    """As bait_below_strong, of rows that have not been ranked: place sorts a list, ties broken.

    Ranks are counted, not assigned: the first bait's and the last strong candidate's places are found by an aggregation,
    and a second one counts the rows up to them, so no list is ever sorted in one task.
    """
    rows = df.withColumn("__place", place)
    marks = rows.groupBy(key).agg(F.min(F.when(F.col(tag) == "bait", F.col("__place"))).alias("__bait"), F.max(F.when(F.col(tag) == "strong", F.col("__place"))).alias("__strong"))
    up_to = lambda mark: F.when(F.first(F.col(mark).isNotNull()), F.count(F.when(F.col("__place") <= F.col(mark), 1)))
    out = rows.join(marks, key).groupBy(key).agg(up_to("__bait").cast("int").alias("first_bait"), up_to("__strong").cast("int").alias("last_strong"))
    return out.withColumn("below", F.col("first_bait") > F.col("last_strong"))


def ordering_pairs(df: DataFrame, pairs: DataFrame, id: str, gap: float = 1e-6) -> DataFrame:
    """Whether the higher of each pair ranks first by a real gap.  df: id, rank, score; pairs: dimension, higher, lower."""
    hi = df.select(F.col(id).alias("higher"), F.col("rank").alias("rank_hi"), F.col("score").alias("score_hi"))
    lo = df.select(F.col(id).alias("lower"), F.col("rank").alias("rank_lo"), F.col("score").alias("score_lo"))
    both = pairs.join(hi, "higher", "left").join(lo, "lower", "left")
    holds = (F.col("rank_hi") < F.col("rank_lo")) & (F.col("score_hi") - F.col("score_lo") >= gap)
    return both.select("dimension", "higher", "lower", (F.col("score_hi") - F.col("score_lo")).alias("gap"), F.coalesce(holds, F.lit(False)).alias("holds"))


def drift(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Greatest differences of rank and score between two runs; rows of one run only count as missing."""
    both = a.select(id, F.col("rank").alias("ra"), F.col("score").alias("sa")).join(b.select(id, F.col("rank").alias("rb"), F.col("score").alias("sb")), id, "full")
    return both.agg(
        F.max(F.abs(F.col("ra") - F.col("rb"))).alias("rank_drift"),
        F.max(F.abs(F.col("sa") - F.col("sb"))).alias("score_drift"),
        F.count(F.when(F.col("ra").isNull() | F.col("rb").isNull(), 1)).alias("missing"),
    )
