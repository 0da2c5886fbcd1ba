"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is scaled to unit length and rotated by a random orthogonal matrix into at least 256 dimensions; its code is
the signs.  Stored beside the code is the factor f = <code, rotated vector>.  For a vector q, <code, q> / f is an unbiased
estimate of the inner product, and its error is below EPSILON * sqrt((1 - f^2) / f^2) / sqrt(D - 1) but with negligible
probability.  Only pairs whose estimate plus bound reaches the threshold are recomputed in double precision.

Sign bits also band the vectors: tables and bits are chosen so that a pair at the threshold shares a bucket with the
target recall at least, and so that a bucket holds a bounded expected number of unrelated vectors.  A pair is told in the
first table in which the two share a bucket, and in no other, so its link is counted once.  Buckets of more than PART
members are dealt into parts, and every two parts meet in one task, which returns rows of members, never of pairs.

What is shuffled for a table is a vector's code and its components in 8 bits; vectors in double precision go only to the
meetings in which an estimate could not part them from another.

Cases: vectors that are null, empty, zero or hold null or non-finite components are linked with nothing; vectors of
different lengths are not comparable, and never meet; long vectors are recomputed a few rows at a time; a cosine equal to
the threshold links; equal vectors are compared once and count as links of one another, as repeated rows do; an empty
table gives an empty one; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classes, roots
from .common import U64, Scratch, mix

THRESHOLD, RECALL, EPSILON = 0.95, 0.9999, 6.0
CODE_BITS = 256
#: Expected unrelated vectors of a bucket; members of a part of a large bucket; rows compared at a time.
BUCKET, PART, ROWS = 64, 2048, 512


def choose_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits of each) for n vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / BUCKET + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), bits


def unit(v) -> np.ndarray | None:
    """The vector in double precision scaled to unit length; None if it is to be linked with nothing."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    a = np.asarray(v, float)
    top = np.abs(a).max()
    if not np.isfinite(a).all() or top == 0:
        return None
    a = a / top
    return a / math.sqrt(a @ a)


def rotations(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """Stacked random rotations: count x D rows of dim components; the columns of each D x dim block are orthonormal."""
    wide = width(dim)
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((wide, wide)))[0][:, :dim] for _ in range(count)])


def width(dim: int) -> int:
    """Dimensions of the rotated vector."""
    return max(CODE_BITS, -(-dim // 64) * 64)


class Coder:
    def __init__(self, tables: int, bits: int):
        self.tables, self.bits, self.by_dim = tables, bits, {}

    def __call__(self, units: np.ndarray):
        """Signs (booleans; the first are the code), factors and buckets of unit vectors of one length."""
        dim = units.shape[1]
        wide = width(dim)
        if dim not in self.by_dim:
            self.by_dim[dim] = rotations(dim, -(-self.tables * self.bits // wide))
        turned = units @ self.by_dim[dim].T
        signs = turned > 0
        factor = np.abs(turned[:, :wide]).sum(1) / math.sqrt(wide)
        at = np.arange(self.tables, dtype=np.uint64)[None, :] * U64(1 << 32) + U64(dim)
        return signs, factor, mix(mix(at) + self.keys(signs)).view(np.int64)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The bits of every table as a number: two vectors of one length share a table's bucket if these are equal."""
        weights = U64(1) << np.arange(self.bits, dtype=np.uint64)
        return signs[:, : self.tables * self.bits].reshape(len(signs), self.tables, self.bits) @ weights


def _coded(reps: DataFrame, tables: int, bits: int) -> DataFrame:
    """key, dim, signs (packed), factor, query (8-bit components), its scale, and the buckets of all tables."""

    def run(batches):
        import pyarrow as pa

        coder = Coder(tables, bits)
        for b in batches:
            keys, vectors = b.column(0).to_pylist(), [np.frombuffer(x) for x in b.column(1).to_pylist()]
            for dim in sorted({len(v) for v in vectors}):
                of = [i for i, v in enumerate(vectors) if len(v) == dim]
                for at in range(0, len(of), 200):
                    own = of[at : at + 200]
                    units = np.stack([vectors[i] for i in own])
                    signs, factor, buckets = coder(units)
                    scale = np.abs(units).max(1) / 127
                    query = np.rint(units / scale[:, None]).astype(np.int8)
                    packed = [x.tobytes() for x in np.packbits(signs, axis=1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([keys[i] for i in own], pa.binary()), pa.array(np.full(len(own), dim, np.int32)), pa.array(packed, pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in query], pa.binary()), pa.array(scale), pa.array(buckets.tolist(), pa.list_(pa.int64()))],
                        ["key", "dim", "signs", "factor", "query", "scale", "buckets"],
                    )

    return reps.select("key", "unit").mapInArrow(run, "key binary, dim int, signs binary, factor double, query binary, scale double, buckets array<long>")


def _upper(code: np.ndarray, factor: np.ndarray, query: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors (rows) with queries, given rotated as well."""
    wide = code.shape[1]
    estimate = ((code * 2 - 1).astype(np.float32) / np.float32(math.sqrt(wide))) @ turned.T
    bound = EPSILON * np.sqrt((1 - np.minimum(factor, 1) ** 2) / factor**2) / math.sqrt(wide - 1)
    rounding = np.abs(query).max(1) / 254 * math.sqrt(query.shape[1])
    return (estimate + rounding[None, :].astype(np.float32)) / factor[:, None].astype(np.float32) + (bound[:, None] + 1e-4).astype(np.float32)


def possible(code: np.ndarray, factor: np.ndarray, query: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Pairs whose inner product may reach the threshold, by the estimates' upper confidence bounds either way.

    code: n x D signs; query: n x dim components whose rounding error is at most that of 8 bits; turn: the D x dim
    rotation of the codes.
    """
    turned = query.astype(np.float32) @ turn.T
    out = np.zeros((len(code), len(code)), bool)
    for low in range(0, len(code), ROWS):
        own = slice(low, low + ROWS)
        out[own] = (_upper(code[own], factor[own], query, turned) >= threshold) & (_upper(code, factor, query[own], turned[own]).T >= threshold)
    return out


def _first_shared(near: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
    """The pairs but those that share a bucket of an earlier table."""
    for t in range(table):
        near &= keys[:, t][:, None] != keys[:, t][None, :]
    return near


def _in_meetings(work):
    """Hands complete meetings to `work`, which gets a table's arrays and yields batches.  Rows come sorted by meeting; a
    meeting that a batch cuts is carried into the next."""

    def run(batches):
        import pyarrow as pa

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            meeting = rows["meeting"].to_numpy()
            last = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on in the next batch
            if last:
                yield work(rows.slice(0, last).combine_chunks())
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield work(held)

    return run


def _members(rows, names: tuple[str, ...]):
    """Index arrays of the rows that may be compared: of one meeting, one table and one length."""
    order = [rows[n].to_numpy() for n in names]
    sort = np.lexsort(order[::-1])
    cuts = np.flatnonzero(np.any([np.diff(x[sort]) != 0 for x in order], axis=0)) + 1 if len(sort) else []
    return [x for x in np.split(sort, cuts) if len(x) > 1]


def _near(tables: int, bits: int, threshold: float):
    """meeting, table, side and key of the members that estimates cannot part from another member."""

    def work(rows):
        import pyarrow as pa

        coder, turns = Coder(tables, bits), {}
        signs, queries, keys = (rows[n].to_pylist() for n in ("signs", "query", "key"))
        factor, scale, side, table = (rows[n].to_numpy() for n in ("factor", "scale", "side", "table"))
        picked = []
        for at in _members(rows, ("meeting", "table", "dim")):
            dim = len(queries[at[0]])
            if dim not in turns:
                turns[dim] = rotations(dim, 1).astype(np.float32)
            told = np.unpackbits(np.frombuffer(b"".join(signs[i] for i in at), np.uint8).reshape(len(at), -1), axis=1)
            query = np.frombuffer(b"".join(queries[i] for i in at), np.int8).reshape(len(at), dim) * scale[at, None]
            near = possible(told[:, : width(dim)].astype(np.int8), factor[at], query, turns[dim], threshold)
            np.fill_diagonal(near, False)
            if (side[at] != side[at[0]]).any():
                near &= side[at][:, None] != side[at][None, :]
            if near.any():
                some = near.any(1)  # what an earlier table tells is left to it
                near = _first_shared(near[np.ix_(some, some)], coder.keys(told[some].astype(bool)), int(table[at[0]]))
                picked += at[some][near.any(1)].tolist()
        take = pa.array(picked, pa.int64())
        return pa.RecordBatch.from_arrays([rows["meeting"].take(take).combine_chunks(), rows["table"].take(take).combine_chunks(), rows["side"].take(take).combine_chunks(), pa.array([keys[i] for i in picked], pa.binary())], ["meeting", "table", "side", "key"])

    return _in_meetings(work)


def _exact(tables: int, bits: int, threshold: float):
    """key, root and links of every member linked in a meeting: exact cosines in double precision."""

    def work(rows):
        import pyarrow as pa

        coder = Coder(tables, bits)
        units, signs, keys = (rows[n].to_pylist() for n in ("unit", "signs", "key"))
        copies, side, table = (rows[n].to_numpy() for n in ("copies", "side", "table"))
        out = ([], [], [])
        for at in _members(rows, ("meeting", "table", "dim")):
            u = np.stack([np.frombuffer(units[i]) for i in at])
            linked = np.zeros((len(at), len(at)), bool)
            for low in range(0, len(at), ROWS):
                linked[low : low + ROWS] = u[low : low + ROWS] @ u.T >= threshold
            linked |= linked.T
            np.fill_diagonal(linked, False)
            if (side[at] != side[at[0]]).any():
                linked &= side[at][:, None] != side[at][None, :]
            told = np.unpackbits(np.frombuffer(b"".join(signs[i] for i in at), np.uint8).reshape(len(at), -1), axis=1).astype(bool)
            linked = _first_shared(linked, coder.keys(told), int(table[at[0]]))
            some = linked.any(1)
            own = at[some]
            out[0].extend(keys[i] for i in own)
            out[1].extend(keys[i] for i in own[roots(linked[np.ix_(some, some)])])
            out[2].extend((linked[some] @ copies[at]).tolist())
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["key", "root", "links"])

    return _in_meetings(work)


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("meeting").sortWithinPartitions("meeting")


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """id, n_links, component_id and kept for every row; see blocks.classes for the meaning."""
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    def read(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            units = [unit(v) for v in b.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in units]
            keys = [None if x is None else hashlib.md5(x).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "unit"])

    every = scratch.keep(rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, key binary, unit binary"), "vectors")
    reps = every.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    reps = scratch.keep(reps, "reps")
    tables, bits = choose_tables(reps.count(), threshold, recall)
    coded = scratch.keep(_coded(reps, tables, bits), "coded")
    large = coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    large = scratch.keep(large.select("bucket", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "large")
    dealt = coded.select("key", "dim", "signs", "factor", "query", "scale", F.posexplode("buckets").alias("table", "bucket")).join(large, "bucket", "left")
    parts = F.coalesce("parts", F.lit(1))
    side = F.pmod(F.xxhash64("key", F.lit(3)), parts).cast("int")
    dealt = dealt.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    meeting = F.when(parts > 1, F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("bucket"))
    asked = _met(dealt.select(meeting.alias("meeting"), "table", "side", "dim", "key", "signs", "factor", "query", "scale"))
    near = scratch.keep(asked.mapInArrow(_near(tables, bits, threshold), "meeting long, table int, side int, key binary"), "near")
    met = near.join(coded.select("key", "dim", "signs"), "key").join(reps.select("key", "copies", "unit"), "key")
    found = _met(met.select("meeting", "table", "side", "dim", "key", "signs", "copies", "unit")).mapInArrow(_exact(tables, bits, threshold), "key binary, root binary, links long")
    out = classes(every.select("id", "key"), reps, found, scratch)
    kept = F.col("id").eqNullSafe(F.col("class_id"))
    return out.select(F.col("id").alias(id), "n_links", F.col("class_id").alias("component_id"), kept.alias("kept"))
