"""Comparing candidates block by block, and connected components of the links found.

Candidates share a bucket.  A bucket may hold a third of all rows, so pairs are never emitted as rows.  Instead every
node joins the block of the smallest node it meets in its buckets; a block is dealt into parts of bounded size, and two
parts meet in one task only if some bucket has members in both.  A task sees all members of its two parts, compares
every pair of them that shares a bucket, and returns a row per member: its links counted, and a root that spans the
members linked there.  Each pair belongs to exactly one task, so counts add up exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def meeting_plan(buckets: DataFrame, weights: DataFrame, scratch: Scratch, most_rows: int, most_weight: int) -> DataFrame:
    """key, block and meetings (array of struct<pair, side>) of every node that shares a bucket with another.

    buckets: key, bucket; distinct.  weights: key, weight.  A pair's side is 0 for all members of a part that meets
    itself, else 0 and 1 for the two parts.
    """
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1").select("bucket", "leader")
    shared = scratch.keep(shared, "shared")
    hits = scratch.keep(buckets.join(shared, "bucket"), "hits")
    lead = hits.groupBy("key").agg(F.min("leader").alias("leader"))
    lead = scratch.keep(lead.join(weights, "key").select("key", "leader", "weight"), "lead")
    sizes = lead.groupBy("leader").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    parts = F.greatest(F.ceil(F.col("n") / most_rows), F.ceil(F.col("w") / most_weight), F.lit(1))
    sizes = scratch.keep(sizes.select("leader", parts.alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))
    blocks = scratch.keep(lead.join(sizes, "leader").select("key", F.xxhash64("leader", part).alias("block")), "blocks")
    seen = hits.select("key", "bucket").join(blocks, "key").select("bucket", "block").distinct()
    seen = scratch.keep(seen, "seen")
    several = scratch.keep(seen.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "several")
    across = seen.join(several, "bucket")
    pairs = across.alias("a").join(across.alias("b"), "bucket").where("a.block < b.block").select(F.col("a.block").alias("low"), F.col("b.block").alias("high")).distinct()
    pairs = pairs.select("low", "high", F.xxhash64("low", "high").alias("pair"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("low").alias("block"), "pair", F.lit(0).alias("side")), F.struct(F.col("high").alias("block"), "pair", F.lit(1).alias("side")))).alias("x")).select("x.*")
    own = blocks.select("block").distinct().select("block", F.col("block").alias("pair"), F.lit(0).alias("side"))
    meetings = ends.unionByName(own).groupBy("block").agg(F.collect_list(F.struct("pair", "side")).alias("meetings"))
    meetings = scratch.keep(meetings, "meetings")
    plan = scratch.keep(blocks.join(meetings, "block").select("key", "block", "meetings"), "plan")
    scratch.drop("shared", "hits", "lead", "sizes", "blocks", "seen", "several", "meetings")
    return plan


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index by a symmetric boolean matrix of links."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and the smallest node of its component, for every node of an edge.  edges: u, v.

    Alternates large-star and small-star steps until the edges stay the same; they are then stars around each
    component's smallest node.  Every step's tables are written to the shared folder.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"low{step}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"large{step}")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"least{step}")  # v < u on every edge
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges{step + 1}")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges{step}", f"low{step}", f"large{step}", f"least{step}")
        step += 1
        now = after
        if tuple(got) == state:
            break
        state = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(every: DataFrame, reps: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """id, key, class_key, class_id and n_links for every row.

    every: id, key; the key is null for rows that are linked with nothing, whose class is their own.  reps: key, id
    (smallest of the key), copies.  found: key, root, links, from the meetings.  class_key is null where key is.
    """
    found = scratch.keep(found, "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")), scratch)
    comps = scratch.keep(comps.withColumnRenamed("node", "key").join(reps.select("key", "id"), "key"), "comps")
    least = scratch.keep(comps.groupBy("root").agg(F.min("id").alias("class_id")), "least")
    named = comps.select("key", "root").join(least, "root")
    known = reps.select("key", F.col("id").alias("own_id"), "copies").join(named, "key", "left").join(links, "key", "left")
    known = known.select("key", F.coalesce("root", "key").alias("class_key"), F.coalesce("class_id", "own_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = scratch.keep(known, "known")
    scratch.drop("plan", "found", "comps", "least")
    keyed = every.where("key is not null").select("id", "key").join(known, "key").select("id", "key", "class_key", "class_id", "n_links")
    bare = every.where("key is null").select("id", "key", F.col("key").alias("class_key"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return keyed.unionByName(bare)
