"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and underscores of the lower-case text.  A seed is a mask over a window of words:
only the positions set in it are hashed, so a window with substituted words at the ignored positions still hits.  The
hashes of the benchmark's windows are joined with those of every window of every document; around each hit the item is
laid along the document and verified word by word: some stretch of STRETCH words must agree in at least AGREE of them.
The stretch is the whole item if that is shorter, and the whole document if that is, but SHORT words at least.  Words of
the item beyond the document's edges agree with nothing, so that an excerpt counts alike wherever it stands.

The masks are chosen by the stretch such that, whichever words of it differ, as many as AGREE allows, some mask at some
place avoids them all: every overlap that the verification accepts is tried.

A benchmark of at most PART_WORDS words is broadcast, as sorted arrays.  A larger one is joined by shuffles: a Bloom
filter of at most BLOOM_BITS bits lets through the document windows whose hash the benchmark may hold, these are joined
with its seeds, and each diagonal is verified on the words around its hits.  Both ways give the same rows.

Cases: items and documents that are null, empty or without words match nothing; long texts are read whole, and hits that
repeat along one diagonal are tried once; of equally good places of an item in a document the longest, then the first, is
told; repeated rows, of documents or items, give a row for each pair; an empty table on either side gives no rows (and
clean() all documents); columns to keep must not have the names of the result's, all others never matter.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, WordHashes, fresh, mix, share, slices

#: Fixed masks by the least words of a stretch: 1 is hashed, 0 ignored.  Shorter stretches have all positions set.
MASKS = {
    4: ("111", "1101", "1011"),
    8: ("11011", "1111", "11000011"),
    12: ("110111", "11010011", "1010001011", "1011011"),
}
STRETCH, SHORT, AGREE, PART_WORDS = 20, 8, 0.75, 2_000_000
#: Most bits of the filter of a large benchmark, bits set for each seed, and those of the pieces that it is built in.
BLOOM_BITS, BLOOM_SET, PIECE_BITS = 1 << 29, 5, 1 << 20
#: Hits expanded at a time, and cells of the matrices that diagonals are verified in.
HITS, CELLS = 1_000_000, 2_000_000
WORD = re.compile(r"\w+")
RESULT = ("item_id", "start", "end", "agree")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of a stretch of n words."""
    return next((MASKS[least] for least in sorted(MASKS, reverse=True) if n >= least), ("1" * n,))


def item_masks(n: int) -> list[tuple[str, bool]]:
    """The masks of an item of n words, and whether only documents shorter than the longest masks' stretch are tried with it."""
    longest = max(MASKS)
    return [(m, False) for m in masks_for(n)] + ([(m, True) for m in masks_for(SHORT)] if n >= longest else [])


def all_masks(short: bool) -> list[str]:
    """Every mask that a document is hashed with; a short one has no stretch of the longest masks'."""
    longest = max(MASKS)
    some = {m for least, masks in MASKS.items() for m in masks if not short or least < longest}
    return sorted(some | {"1" * n for n in range(1, min(MASKS))})


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for i, on in enumerate(mask):
        if on == "1":
            out = out * U64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out + U64(int(mask, 2)))


def agreement(item: np.ndarray, doc: np.ndarray, shifts: np.ndarray, need: int, at: int = 0) -> tuple[np.ndarray, ...]:
    """For every diagonal, word i of the item at place shift + i: the best stretch's agreeing words, and the first and end
    place of what the accepted stretches cover (0 words where there is none).  doc: the document's words from place `at`."""
    best, first, end = (np.zeros(len(shifts), np.int64) for _ in range(3))
    step = max(1, CELLS // len(item))
    for a in range(0, len(shifts), step):
        s = shifts[a : a + step]
        place = s[:, None] + np.arange(len(item)) - at
        inside = (place >= 0) & (place < len(doc))
        same = inside & (doc[np.clip(place, 0, len(doc) - 1)] == item)
        total = np.zeros((len(s), len(item) + 1), np.int32)
        np.cumsum(same, 1, out=total[:, 1:])
        sums = total[:, need:] - total[:, : len(item) + 1 - need]
        good = sums >= AGREE * need
        some = good.any(1)
        best[a : a + step] = np.where(some, sums.max(1), 0)
        first[a : a + step] = s + good.argmax(1)
        end[a : a + step] = s + sums.shape[1] - good[:, ::-1].argmax(1) - 1 + need
    return best, first, end


def stretch(item: int, doc: int) -> int:
    return min(STRETCH, item, max(SHORT, doc))


class Index:
    """Word hashes of a benchmark, and its seeds in sorted arrays."""

    def __init__(self, items: list[tuple]):
        hashes = WordHashes()
        found = [(i, hashes(w)) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in found]
        self.words = [h for _, h in found]
        by_mask: dict[tuple[bool, str], list[tuple[int, np.ndarray]]] = {}
        for k, h in enumerate(self.words):
            for mask, short in item_masks(len(h)):
                by_mask.setdefault((short, mask), []).append((k, h))
        self.seeds = []
        for (short, mask), of in sorted(by_mask.items(), key=lambda x: x[0]):
            each = [seed_hashes(h, mask) for _, h in of]
            values = np.concatenate(each)
            item = np.repeat([k for k, _ in of], list(map(len, each)))
            at = np.concatenate([np.arange(len(e)) for e in each])
            order = np.argsort(values, kind="stable")
            flags = np.zeros(1 << 16, bool)
            flags[(values >> U64(48)).astype(np.int64)] = True
            self.seeds.append((short, mask, values[order], item[order], at[order], flags))

    def diagonals(self, h: np.ndarray) -> np.ndarray:
        """item * 2^32 + shift + 2^31 of all diagonals with a hit, each once and sorted."""
        found = []
        for short, mask, values, item, at, flags in self.seeds:
            if short and len(h) >= max(MASKS):
                continue
            own = seed_hashes(h, mask)
            some = np.flatnonzero(flags[own >> U64(48)])
            if not len(some):
                continue
            of = own[some]
            low = np.searchsorted(values, of, "left")
            hit = values[np.minimum(low, len(values) - 1)] == of
            if not hit.any():
                continue
            some, low = some[hit], low[hit]
            times = np.searchsorted(values, of[hit], "right") - low
            ends = np.cumsum(times)
            a = 0
            while a < len(some):  # what repeats may hit as often as both sides' occurrences multiplied: expand a part, keep each diagonal once
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
                n = times[a:b]
                which = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(np.unique((item[which] << 32) + np.repeat(some[a:b], n) - at[which] + (1 << 31)))
                if sum(map(len, found)) > 8 * HITS:
                    found = [np.unique(np.concatenate(found))]
                a = b
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def match(self, h: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item's index, first word, end word, agreement) of the verified overlaps, the best for each item."""
        codes = self.diagonals(h)
        out = []
        if not len(codes):
            return out
        items, starts = np.unique(codes >> 32, return_index=True)
        for k, low, high in zip(items.tolist(), starts, [*starts[1:], len(codes)]):
            w = self.words[k]
            need = stretch(len(w), len(h))
            best, first, end = agreement(w, h, (codes[low:high] & 0xFFFFFFFF) - (1 << 31), need)
            if best.any():
                first, end = np.maximum(first, 0), np.minimum(end, len(h))
                i = np.lexsort((-first, end - first, best))[-1]
                out.append((k, int(first[i]), int(end[i]), float(best[i]) / need))
        return out


def _small(benchmark: DataFrame) -> bool:
    """Whether the benchmark's size allows a broadcast; texts hold a word for two characters at most."""
    return (benchmark.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0) <= PART_WORDS


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """A row for every document and item that overlap: the columns to keep, item_id, start and end word, agree."""
    if clash := {c.lower() for c in keep} & set(RESULT):
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    items, docs = _items(benchmark), docs.select(*keep, text)
    if _small(items):
        return _matched(docs, Index([tuple(r) for r in items.collect()]), len(keep), items.schema["item_id"])
    return _joined(docs, items, scratch or Scratch(docs.sparkSession))


def _matched(df: DataFrame, index: Index, kept: int, item: T.StructField) -> DataFrame:
    shared = share(df.sparkSession, index)
    schema = T.StructType([*df.schema.fields[:kept], item, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("agree", T.DoubleType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        hashes, index, kind = WordHashes(), shared(), to_arrow_type(item.dataType)
        for batch in batches:
            for b in slices(batch, kept, 1000, 4 << 20):
                rows, found = [], []
                for i, t in enumerate(b.column(kept).to_pylist()):
                    for hit in index.match(hashes(words_of(t))):
                        rows.append(i)
                        found.append(hit)
                if rows:
                    picked = b.take(pa.array(rows))
                    hit = [pa.array([index.ids[x[0]] for x in found], kind), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found])]
                    yield pa.RecordBatch.from_arrays([*(picked.column(i) for i in range(kept)), *hit], schema.names)

    return df.mapInArrow(run, schema)


def _bloom_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of the bits of seeds, BLOOM_SET for each."""
    a, b = mix(h + U64(77)), mix(h + U64(99)) | U64(1)
    return [((a + U64(i) * b) & U64(bits - 1)).astype(np.int64) for i in range(BLOOM_SET)]


def _seed_rows(items: DataFrame) -> DataFrame:
    """hash, item, at and short of every window of every item."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.frombuffer(words, np.uint64)
                for mask, short in item_masks(len(h)):
                    own = seed_hashes(h, mask)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(n, item)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, short))], ["hash", "item", "at", "short"])

    return items.select("item", "words").mapInArrow(run, "hash long, item long, at int, short boolean")


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter's bytes, built in pieces; its size has a bound whatever the benchmark's."""
    bits = min(BLOOM_BITS, max(PIECE_BITS, 1 << (16 * seeds.count()).bit_length()))

    def places(batches):
        import pyarrow as pa

        for b in batches:
            at = np.unique(np.concatenate(_bloom_places(b.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE_BITS), pa.array((at % PIECE_BITS).astype(np.int32))], ["piece", "at"])

    def built(pdf):
        import pandas as pd

        flags = np.zeros(PIECE_BITS, bool)
        flags[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "data": [np.packbits(flags).tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    spread = seeds.select("hash").mapInArrow(places, "piece long, at int").distinct()
    for piece, data in spread.groupBy("piece").applyInPandas(built, "piece long, data binary").collect():  # BLOOM_BITS at most
        out[piece * PIECE_BITS // 8 : (piece + 1) * PIECE_BITS // 8] = np.frombuffer(data, np.uint8)
    return out


def _near(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """Two kinds of rows: windows whose hash may be the benchmark's (row, segment, hash, at), and the segments of words
    around them (row, segment, start, words, n words of the document, and the columns to keep)."""
    shared, kept = share(docs.sparkSession, bloom), len(docs.columns) - 1
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{docs.columns[-1]}`"), F.struct(*[F.col(f"`{c}`") for c in docs.columns[:-1]]).alias("kept") if kept else F.lit(None).cast("int").alias("kept"))
    schema = T.StructType([T.StructField(n, k) for n, k in (("row", T.LongType()), ("segment", T.IntegerType()), ("n", T.IntegerType()), ("hash", T.LongType()), ("at", T.IntegerType()), ("start", T.IntegerType()), ("words", T.BinaryType()))] + [T.StructField("kept", df.schema["kept"].dataType)])
    masks = {True: all_masks(True), False: all_masks(False)}

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        filter_, hashes, arrow = shared(), WordHashes(), to_arrow_schema(schema)
        bits = len(filter_) * 8
        for batch in batches:
            for b in slices(batch, 1, 1000, 4 << 20):
                rows, keep_from = [], []
                for i, (row, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    h = hashes(words_of(t))
                    hit, where, spans = [], [], []
                    for mask in masks[len(h) < max(MASKS)]:
                        own = seed_hashes(h, mask)
                        may = np.ones(len(own), bool)
                        for place in _bloom_places(own, bits):
                            may &= (filter_[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                        at = np.flatnonzero(may)
                        hit.append(own[at].view(np.int64))
                        where.append(at)
                        spans.append(np.full(len(at), len(mask)))
                    hit, where, spans = map(np.concatenate, (hit, where, spans))
                    if not len(hit):
                        continue
                    order = np.argsort(where, kind="stable")
                    hit, where, spans = hit[order], where[order], spans[order]
                    low, high = np.maximum(where - STRETCH, 0), np.minimum(where + spans + STRETCH, len(h))
                    reach = np.maximum.accumulate(high)
                    new = np.concatenate([[True], low[1:] > reach[:-1]])
                    segment = np.cumsum(new) - 1
                    ends = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
                    for k, (a, e) in enumerate(zip(low[new].tolist(), ends.tolist())):
                        rows.append((row, k, len(h), None, None, a, h[a:e].tobytes()))
                        keep_from.append(i)
                    rows += [(row, int(k), len(h), int(x), int(a), None, None) for k, x, a in zip(segment, hit, where)]
                    keep_from += [None] * len(hit)
                if rows:
                    columns = [pa.array(c, arrow.field(j).type) for j, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([*columns, b.column(2).take(pa.array(keep_from, pa.int64()))], schema.names)

    return df.mapInArrow(run, schema)


def _laid():
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for row, item, n, shift, at, doc, words in zip(*(c.to_pylist() for c in b.columns)):
                w, d = np.frombuffer(words, np.uint64), np.frombuffer(doc, np.uint64)
                best, first, end = agreement(w, d, np.array([shift]), stretch(len(w), n), at)
                if best[0]:
                    rows.append((row, item, shift, max(0, int(first[0])), min(n, int(end[0])), float(best[0]) / stretch(len(w), n)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "item", "shift", "first", "end", "agree"])

    return run


def _joined(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """The overlaps with a benchmark too large for a broadcast."""
    kept = docs.columns[:-1]

    def hashed(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashes(words_of(t)).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["item", "item_id", "words"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    bench = numbered.mapInArrow(hashed, T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"], T.StructField("words", T.BinaryType())]))
    bench = scratch.keep(bench.where(F.octet_length("words") > 0), "benchmark")
    seeds = scratch.keep(_seed_rows(bench), "seeds")
    near = scratch.keep(_near(docs, _bloom(seeds)), "near")
    hits = near.where("hash is not null").join(seeds, "hash").where(f"not short or n < {max(MASKS)}")
    tried = scratch.keep(hits.select("row", "segment", "item", (near["at"] - seeds["at"]).alias("shift")).distinct(), "tried")
    segments = near.where("words is not null").select("row", "segment", "n", "start", F.col("words").alias("doc"))
    both = tried.join(segments, ["row", "segment"]).join(bench.select("item", "words"), "item")
    laid = both.select("row", "item", "n", "shift", "start", "doc", "words").mapInArrow(_laid(), "row long, item long, shift int, first int, end int, agree double")
    whole = laid.groupBy("row", "item", "shift").agg(F.max("agree").alias("agree"), F.min("first").alias("start"), F.max("end").alias("end"))
    best = whole.groupBy("row", "item").agg(F.max(F.struct("agree", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("back"), "start", "end")).alias("x"))
    named = best.join(bench.select("item", "item_id"), "item").select("row", "item_id", "x.start", "x.end", "x.agree")
    owners = near.where("words is not null and segment = 0").select("row", "kept")
    return named.join(owners, "row").select(*[F.col("kept").getField(c).alias(c) for c in kept], *RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """All columns of the documents that overlap no item."""
    items = _items(benchmark)
    if _small(items):
        return _without(docs, Index([tuple(r) for r in items.collect()]), docs.columns.index(text))
    scratch = scratch or Scratch(docs.sparkSession)
    key = fresh(docs.columns, "text_key")
    marked = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    found = scratch.keep(_joined(marked.select(key, text), items, scratch).select(key).distinct(), "found")
    return marked.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _without(df: DataFrame, index: Index, at: int) -> DataFrame:
    shared = share(df.sparkSession, index)

    def run(batches):
        import pyarrow as pa

        hashes, index = WordHashes(), shared()
        for b in batches:
            yield b.filter(pa.array([not index.match(hashes(words_of(t))) for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
