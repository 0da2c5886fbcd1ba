"""N-gram Jaccard self-join of texts by MinHash banding.

Words are what white space separates in the lower-case text; a text's n-grams are those of n words, or the whole text
if it has fewer.  Texts without words are linked with nothing.  Rows and bands of the signature are chosen so that two
texts at the threshold share a band with the target recall at least.  Signatures are banded, bands are shuffled by
their hash, and pairs are verified on the full n-gram sets, block by block (see blocks.py).

Equal texts are compared once: they form a class, and count as links of one another.  Links between different texts are
counted exactly, so a group of m texts that differ is compared pair by pair; its sets are shuffled once for each part of
PART_ROWS members (or PART_GRAMS n-grams) that they meet.

Cases: null and empty texts, and any without words, are linked with nothing; long texts are read whole; a similarity
equal to the threshold links; repeated rows, and rows of one id with different texts, are rows of their own; a class of
rows without ids has a null class id; an empty table gives an empty one; other columns are never read, whatever they are
called.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import classes, meeting_plan, roots
from .common import U64, Scratch, WordHashes, fresh, mix, shingle_set, slices

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: What str.split() takes for white space, as a class of a JVM expression.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Members of a part of a block, and its n-grams: two parts meet in one task.
PART_ROWS, PART_GRAMS = 768, 600_000
#: N-grams that so many members share at most are counted pair by pair, others by a product of matrices.
FEW = 8


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: tuple[int, ...] = (3, 4, 5, 6), most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, as many as the recall needs at the threshold, stay within `most` hashes."""
    for r in sorted(rows, reverse=True):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        if bands * r <= most:
            return bands, r
    raise ValueError("the recall needs more hashes")


def grams(text: str | None, hashes: WordHashes, n: int = N) -> np.ndarray:
    return shingle_set(hashes((text or "").lower().split()), n)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 23):
        k = np.arange(1, bands * rows + 1, dtype=np.uint64)
        self.a = mix(k + U64(seed * 1000)) | U64(1)
        self.b = mix(k + U64(seed * 1_000_000))
        self.shape = bands, rows

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes of sets that have members: sets x bands, signed 64-bit."""
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        bands, rows = self.shape
        out = np.zeros((len(sets), bands), np.uint64)
        for i in range(bands * rows):
            low = np.minimum.reduceat(flat * self.a[i] + self.b[i], starts)
            j = i // rows
            out[:, j] = mix(out[:, j] + low + U64(i + 1))
        return out.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """id, key (digest of the text), grams (count) and bands of every row; null bands of texts without words."""
    df = docs.select("id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"), "text")
    schema = T.StructType([df.schema["id"], df.schema["key"], T.StructField("grams", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        hashes, signer = WordHashes(), Signer(bands, rows)
        for b in batches:
            for part in slices(b, 2):
                sets = [grams(t, hashes, n) for t in part.column(2).to_pylist()]
                sizes = np.array(list(map(len, sets)), np.int64)
                got = iter(signer.bands([s for s in sets if len(s)]).tolist() if sizes.any() else ())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array([next(got) if k else None for k in sizes], pa.list_(pa.int64()))], schema.names)

    return df.mapInArrow(run, schema)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right, or with the others on the left."""
    both = left + (right or [])
    n, split = len(both), len(left) if right else 0
    owner = np.repeat(np.arange(n), list(map(len, both)))
    _, where, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    order = np.argsort(where, kind="stable")  # by n-gram, then by member
    owner, times = owner[order], times[where[order]]
    out = np.zeros((len(left), n - split), np.float32)
    for c in range(2, FEW + 1):
        own = owner[times == c].reshape(-1, c)
        if len(own):
            met = np.bincount(np.concatenate([own[:, i] * n + own[:, j] for i in range(c) for j in range(i + 1, c)]), minlength=n * n).reshape(n, n)
            out += (met + met.T)[: len(left), split:]
    often = times > FEW
    owner = owner[often]
    col = np.unique(where[order][often], return_inverse=True)[1]
    step = max(256, 4_000_000 // n)  # columns at a time: a dense matrix of bounded size
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, [low, low + step])
        dense = np.zeros((n, step), np.float32)
        dense[owner[i:j], col[i:j] - low] = 1
        out += dense[: len(left)] @ dense[split:].T
    return out


def _verified(threshold: float):
    def run(pdf):
        """One meeting: the links of every member, weighted by copies, and its root among the members."""
        import pandas as pd

        pdf = pdf.drop_duplicates("key").sort_values("key", ignore_index=True)
        n, side = len(pdf), pdf["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        size = np.array(list(map(len, sets)), float)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(b)
        b = a if alone else b
        linked = np.zeros((n, n), bool)
        if len(a) and len(b):
            # all pairs that meet are verified, whether they share a band or only a bucket with a third
            common = _overlaps([sets[i] for i in a], None if alone else [sets[i] for i in b]).astype(float)
            union = size[a][:, None] + size[b][None, :] - common
            linked[np.ix_(a, b)] = common >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            linked |= linked.T
        some = linked.any(1)
        root = roots(linked[np.ix_(some, some)])
        keys = pdf["key"][some].to_numpy()
        return pd.DataFrame({"key": keys, "root": keys[root], "links": (linked[some] @ pdf["copies"].to_numpy()).astype(np.int64)})

    return run


def similar_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """id, key, class_key, class_id and n_links for every row.

    class_id is the smallest id reachable by links, n_links the number of other rows whose similarity reaches the
    threshold.  key tells texts apart, class_key classes; both are null for texts without words.  Rows with null ids
    take part; a class id is null only in classes without any id.
    """
    import pyarrow as pa

    scratch = scratch or Scratch(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    every = scratch.keep(signed(docs, bands, rows, n), "signed")
    reps = every.where("grams > 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("grams").alias("weight"), F.first("bands").alias("bands"))
    reps = scratch.keep(reps, "reps")
    buckets = reps.select("key", F.posexplode("bands").alias("band", "hash")).select("key", F.xxhash64("band", "hash").alias("bucket"))
    plan = meeting_plan(buckets, reps.select("key", "weight"), scratch, PART_ROWS, PART_GRAMS)
    texts = docs.select("id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("key"))
    wanted = plan.join(reps, "key").select("key", "id", "copies", "meetings")
    met = texts.join(wanted, (texts["key"] == wanted["key"]) & texts["id"].eqNullSafe(wanted["id"])).select(wanted["key"], "copies", "meetings", "text")
    schema = "pair long, side int, key binary, copies long, `set` binary"
    names, kinds = ["pair", "side", "key", "copies", "set"], (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())

    def meet(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for b in slices(batch, 3):
                rows, size = [], 0
                for key, copies, meetings, body in zip(*(c.to_pylist() for c in b.columns)):
                    body = grams(body, hashes, n).tobytes()
                    for m in meetings:
                        rows.append((m["pair"], m["side"], key, copies, body))
                        size += len(body)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = met.mapInArrow(meet, schema).groupBy("pair").applyInPandas(_verified(threshold), "key binary, root binary, links long")
    every = every.select("id", F.when(F.col("grams") > 0, F.col("key")).alias("key"))
    return classes(every, reps, found, scratch).withColumnRenamed("id", id)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """All columns of one row of each class, that with the smallest id; null ids count as larger than any other.

    Of rows that share that id, the text that is smallest by its digest stays, and of rows that share the text as well,
    that whose other columns come first as JSON.  Texts without words are linked with nothing: all their rows stay.
    """
    plain = {c: F.col(f"`{c}`") for c in docs.columns}
    row = fresh(docs.columns, "row_key")
    body = F.coalesce(plain[text], F.lit(""))
    named = lambda i, key: F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")), F.lit(":"), F.hex(key)).cast("binary")))
    found = similar_texts(docs, id, text, scratch=scratch).where("class_key is not null")
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col(id).isNull().alias("bare"), F.col(id).alias("id"), "key")).alias("row"))
    kept = best.select(named(F.col("row.id"), F.col("row.key")).alias(row))
    rest = [c for n, c in plain.items() if n not in (id, text)]
    tie = F.to_json(F.struct(*rest)) if rest else F.lit("")
    keyed = docs.withColumn(row, named(plain[id], F.unhex(F.md5(body.cast("binary")))))
    one = keyed.groupBy(row).agg(F.min_by(F.struct(*plain.values()), tie).alias("one"))  # combined before the shuffle
    worded = one.join(kept, row, "left_semi").select(*[F.col("one").getField(c).alias(c) for c in docs.columns])
    return worded.unionByName(docs.where(F.length(F.regexp_replace(body, WHITE, "")) == 0))
