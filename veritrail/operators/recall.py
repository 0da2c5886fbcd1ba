"""Exact vector recall: within a pool, and of all pairs, against a small side or block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, similarity

#: Numbers of a block, and numbers that a side may hold in all to be sent to every executor; pairs of a task.
BLOCK, SMALL, PAIRS = 1 << 21, 1 << 23, 1 << 27
#: Queries and items of a tile, numbers that are multiplied at once outside the matrix product, and how far a cosine may
#: lie below another one and still be a tie, or before it: rounding to twelve places of a score and the product's errors.
ROWS, TILE, EXACT, OFF = 512, 4096, 1 << 21, 4e-12


def within_pools(jobs: DataFrame, pool: DataFrame, k: int = 50, key: str = "job_id", id: str = "resume_id") -> DataFrame:
    """The k most similar members of every job's own pool: key, id, vec_score, recall_rank.

    jobs: key, job_vector; pool: key, id, vector.  Rows without a vector take no part.  Ties go to the smaller id.
    """
    pairs = pool.where("vector is not null").join(jobs.where("job_vector is not null"), key)
    scored = pairs.select(key, id, similarity(cosine(F.col("vector"), F.col("job_vector"))).alias("vec_score"))
    best = Window.partitionBy(key).orderBy(F.desc("vec_score"), F.col(id))
    return scored.withColumn("recall_rank", F.row_number().over(best)).where(F.col("recall_rank") <= k)


def normalised(recalled: DataFrame, key: str = "job_id") -> DataFrame:
    """Adds vec_norm, the score scaled to its pool's range, and discriminating, false where all scores are one.

    A pool whose range is below 1e-9 scores 1 throughout.
    """
    pool = Window.partitionBy(key)
    low, high = F.min("vec_score").over(pool), F.max("vec_score").over(pool)
    flat = (high - low) < 1e-9
    return recalled.withColumn("vec_norm", F.when(flat, 1.0).otherwise((F.col("vec_score") - low) / (high - low))).withColumn("discriminating", ~flat)


def nearest(queries: DataFrame, items: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """The k most similar items of every query, over all pairs: query_id, item_id, vec_score, place.

    queries, items: id, vector; ids are numbers.  If the items hold SMALL numbers at most (a count decides), they are sent
    to the queries' tasks, as many as the pairs ask for.  Else both sides are dealt into blocks of about `block` rows, and
    two blocks meet in one task.  Either way a task holds the scores of a tile of pairs, and no row is made for a pair that
    is not among some block's best.  Vectors that are null, empty, of different lengths, or hold nulls have no similarity;
    zero vectors have cosine 0.  Scores alike to twelve places are ties, which go to the smaller id.
    """
    queries = queries.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    items = items.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    held = items.agg(F.sum(F.size("vector")).alias("n"), F.count("*").alias("rows")).first()
    n, asked = held.n or 0, queries.count()
    if n <= SMALL:
        some = _against(queries, items, k, -(-asked * held.rows // PAIRS))
    else:
        block = block or max(1, BLOCK * held.rows // n)
        some = _by_blocks(queries, items, k, max(1, -(-asked // block)), max(1, -(-held.rows // block)))
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")
    return some.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("grade")


#: grade is the score to twelve places, by which items are ranked.
SOME = "query_id long, item_id long, vec_score double, grade double"


def _dots(a, b):
    """Products of rows, summed in the vectors' own order, so that a pair's score does not hang on where it stands."""
    import numpy as np

    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _sides(ids, vectors) -> dict:
    """By length, the vectors of Arrow columns: (vectors, each once; their squared norms; ids; where each vector's begin).

    The ids of vector j are ids[begin[j]:begin[j + 1]], ascending.  Vectors that are not told to be alike stand twice,
    which costs time only.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    out, sizes, own = {}, pc.list_value_length(vectors).to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    for n in set(sizes.tolist()) - {0}:
        of = sizes == n
        v = (vectors if of.all() else vectors.filter(pa.array(of))).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        fine = np.isfinite(v).all(1)
        v, i = v[fine], own[of][fine]
        top = np.abs(v).max(1)
        far = (top > 1e60) | (top > 0) & (top < 1e-60)  # whose squares are no numbers: by a power of two, which changes no digit
        v[far] = np.ldexp(v[far], -np.frexp(top[far])[1][:, None])
        odd = np.random.default_rng(n).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        key = np.einsum("ij,j->i", v.view(np.uint64), odd)
        by = np.lexsort((i, key))
        v, i, key = v[by], i[by], key[by]
        new = np.append(True, key[1:] != key[:-1])[: len(i)]
        for low in range(0, len(maybe := np.flatnonzero(~new)), TILE):
            at = maybe[low : low + TILE]
            new[at] = (v[at] != v[at - 1]).any(1)
        begin = np.append(np.flatnonzero(new), len(i))
        v = v[new]
        out[n] = v, np.concatenate([np.zeros(0), *(_dots(x, x) for x in (v[low : low + TILE] for low in range(0, len(v), TILE)))]), i, begin
    return out


def _best(left: dict, right: dict, k: int):
    """Arrow columns of SOME: each query's k best items.  left, right: what _sides gives."""
    import numpy as np

    out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    out = [[x] for x in out]
    for n in left.keys() & right.keys():
        (x, x2, own, mine), (y, y2, ids, begin) = left[n], right[n]
        copies = np.minimum(np.diff(begin), k)
        for low in range(0, len(x), ROWS):
            a, a2 = x[low : low + ROWS], x2[low : low + ROWS]
            row, item, score, grade = _of_rows(a, a2, y, y2, ids, begin, copies, k)
            # each query that has the vector gets the vector's items
            first = np.searchsorted(row, np.arange(len(a) + 1))
            many = np.diff(mine[low : low + len(a) + 1])
            q, of = own[mine[low] : mine[low + len(a)]], np.repeat(np.arange(len(a)), many)
            each = np.diff(first)[of]
            at = np.repeat(first[of], each) + _count(each)
            for have, add in zip(out, (np.repeat(q, each), item[at], score[at], grade[at])):
                have.append(add)
    return [np.concatenate(x) for x in out]


def _count(sizes):
    """0 .. size - 1 for each size, in one array."""
    import numpy as np

    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _of_rows(a, a2, y, y2, ids, begin, copies, k: int):
    """(row, item id, score, grade) of the k best items of each row of a, by row.  A matrix product of a tile of items tells
    what may be among the best so far; only that is scored in the vectors' own order and merged."""
    import numpy as np

    unit = lambda v, v2: v / np.sqrt(np.where(v2 > 0, v2, 1))[:, None]
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    floor, left = np.full(len(a), -2.0), unit(a, a2)
    for at in range(0, len(y), TILE):
        cos = left @ unit(y[at : at + TILE], y2[at : at + TILE]).T
        hit = cos >= floor[:, None]
        width = cos.shape[1]
        if k < width and np.count_nonzero(hit) > 16 * k * len(a):
            kth = np.partition(cos, width - k, axis=1)[:, width - k]
            hit = cos >= np.maximum(floor, kth - OFF)[:, None]
        rows, cols = np.nonzero(hit)
        for low in range(0, len(rows), step := max(1, EXACT // y.shape[1])):
            r, c = rows[low : low + step], cols[low : low + step] + at
            both = np.sqrt(a2[r] * y2[c])
            score = (1 + np.clip(_dots(a[r], y[c]) / np.where(both > 0, both, 1), -1, 1)) / 2
            each = np.repeat(np.arange(len(r)), copies[c])
            add = r[each], ids[begin[c][each] + _count(copies[c])], score[each], np.floor(score * 1e12 + 0.5)[each]
            row, item, score, grade = (np.concatenate(z) for z in zip(best, add))
            order = np.lexsort((item, -grade, row))
            first = np.searchsorted(row[order], np.arange(len(a) + 1))
            order = order[np.arange(len(order)) - first[row[order]] < k]
            best = row[order], item[order], score[order], grade[order]
            first = np.searchsorted(best[0], np.arange(len(a) + 1))
            full = np.diff(first) == k
            floor[full] = 2 * best[2][first[1:][full] - 1] - 1 - OFF
    return best


def _rows(found, columns: type):
    import pyarrow as pa

    return columns.from_arrays([pa.array(x) for x in found], ["query_id", "item_id", "vec_score", "grade"])


def _against(queries: DataFrame, items: DataFrame, k: int, tasks: int) -> DataFrame:
    """Each query against all items, which have been counted."""
    all_items = items.toArrow().combine_chunks()
    sent = queries.sparkSession.sparkContext.broadcast(_sides(*(_whole(all_items, c) for c in ("id", "vector"))))
    del all_items

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield _rows(_best(_sides(b.column(0), b.column(1)), sent.value, k), pa.RecordBatch)

    return (queries.repartition(tasks, "id") if tasks > 1 else queries).mapInArrow(run, SOME)


def _whole(rows, name: str):
    """A column of an Arrow table as one array."""
    import pyarrow as pa

    c = rows.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _by_blocks(queries: DataFrame, items: DataFrame, k: int, nq: int, ni: int) -> DataFrame:
    deal = lambda df, n: df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = deal(queries, nq).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(ni - 1)))).select("id", "vector", F.col("own").alias("q"), F.col("other").alias("i"), F.lit(0).alias("side"))
    right = deal(items, ni).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("id", "vector", F.col("other").alias("q"), F.col("own").alias("i"), F.lit(1).alias("side"))

    def meet(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        sides = [rows.filter(pc.equal(rows.column("side"), s)).combine_chunks() for s in (0, 1)]
        return _rows(_best(*(_sides(_whole(x, "id"), _whole(x, "vector")) for x in sides), k), pa.Table)

    return left.unionByName(right).groupBy("q", "i").applyInArrow(meet, SOME)


def near_names(names: DataFrame, k: int = 5, threshold: float = 0.88, merge: float = 0.92) -> DataFrame:
    """Near neighbours of every name among the others: the threshold holds after the k best are taken.

    names: id, vector.  merged tells the pairs alike enough to be one.
    """
    pairs = nearest(names, names, k + 1).where("query_id <> item_id")
    best = Window.partitionBy("query_id").orderBy("place")
    return pairs.withColumn("place", F.row_number().over(best)).where((F.col("place") <= k) & (F.col("vec_score") > threshold)).withColumn("merged", F.col("vec_score") >= merge)
