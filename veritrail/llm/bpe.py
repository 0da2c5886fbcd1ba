"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that never occurs inside any vocabulary token marks a certain token boundary: no merge can ever
produce a token across it.  A table of 65,536 flags therefore cuts a whole text in one vectorised look-up.  A cut is
made only where the pre-tokenizer, too, reads the two sides alike when apart (see `cut_table`).  The fragments are
encoded independently, each distinct one once per memo, and their ids are concatenated.

The vocabulary file is read once, on the driver, and sent to the executors, which need no copy of it.

Cases: a null text is encoded as an empty one, which has no ids and decodes to an empty text; long texts are encoded
whole, and long pieces in n log n steps; of merges of equal rank the leftmost comes first; added special tokens found in
a text become their id, as in the library; repeated rows have equal ids and all stay; an empty table gives an empty one;
columns to keep must not have the names of the results, others are never read.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share, slices

#: The split pattern of the byte-level pre-tokenizer, and the ASCII characters that it holds for white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPACE = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """Flags by first byte * 256 + second byte: True where a text may be cut between the two.

    The pair must occur inside no token.  Besides, the right side must read alike on its own.  It does if it begins
    with an ASCII space: what stands before never takes a space that follows, but for runs of white space, in which
    a cut between pieces is harmless as no merge crosses it.  It does as well after an ASCII character that is no
    white space, unless it begins with an apostrophe, which could join a run of symbols to its left or begin a
    contraction; after an ASCII letter or digit an apostrophe begins a new piece in either case.
    """
    seen = np.zeros(65536, bool)
    for t in tokens:
        if len(t) > 1:
            a = np.frombuffer(t, np.uint8).astype(np.int32)
            seen[a[:-1] * 256 + a[1:]] = True
    ok = np.zeros((256, 256), bool)
    space = np.isin(np.arange(256), list(ASCII_SPACE))
    alnum = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
    ok[~space & (np.arange(256) < 128)] = True
    ok[:, (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)] = False  # never inside a character
    ok[:, ord("'")] = alnum
    ok[:, ord(" ")] = True
    return ok.ravel() & ~seen


#: Pieces of at most so many bytes are merged in a list, longer ones with a heap.  Fragments of at most so many bytes are
#: remembered, as many as the encoder allows.  Largest vocabulary file that is sent to executors.
SHORT, REMEMBERED, FILE_BYTES = 48, 64, 1 << 27


class Encoder:
    """Encodes and decodes with a vocabulary file; holds at most `most` fragments in its memo."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            raw = f.read(FILE_BYTES + 1)
        if len(raw) > FILE_BYTES:
            raise ValueError("the vocabulary file is too large")
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes = [raw.get(i, b"") for i in range(max([*vocab.values(), *self.special.values()]) + 1)]
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.first = [0] * 256
        for i, t in raw.items():
            if len(t) == 1:
                self.first[t[0]] = i
        self.cuts = cut_table(list(raw.values()))
        self.most = most
        self.link()

    def link(self) -> None:
        import regex

        self.pieces = regex.compile(SPLIT).findall
        self.markers = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "markers", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.link()

    def merged(self, piece: bytes) -> list[int]:
        """Merges a piece's bytes, the lowest rank first and the leftmost of equal ranks first."""
        ids = list(map(self.first.__getitem__, piece))
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        """By searching a list of the neighbours' ranks again after each merge."""
        get, made, never = self.ranks.get, self.made, len(self.made)
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, never)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], never)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """With a heap over a linked list, in n log n steps."""
        n, get, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = made[r]
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def fragments(self, data: bytes) -> list[bytes]:
        a = np.frombuffer(data, np.uint8)
        at = (np.flatnonzero(self.cuts[(a[:-1].astype(np.uint16) << 8) | a[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if not text:
            return []
        found, memo = self.fragments(text.encode("utf-8")), self.memo
        long = []
        if new := set(found).difference(memo):
            if len(memo) > self.most:
                memo.clear()
                new = set(found)
            for f in new:
                memo[f] = tuple(chain.from_iterable(self.merged(p.encode()) for p in self.pieces(f.decode())))
            long = [f for f in new if len(f) > REMEMBERED]
        out = list(chain.from_iterable(map(memo.__getitem__, found)))
        for f in long:
            del memo[f]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.markers and self.markers.search(text):
            return list(chain.from_iterable([self.special[p]] if p in self.special else self.plain(p) for p in self.markers.split(text)))
        return self.plain(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and each whole text's token ids (array<int>); a null text gives no ids."""
    return _coded(df.select(*keep, text), path, text, ids, None, len(keep))


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode(), and the text that those ids decode to; one pass through Python."""
    return _coded(df.select(*keep, text), path, text, ids, decoded, len(keep))


def _coded(df: DataFrame, path: str, text: str, ids: str, decoded: str | None, kept: int) -> DataFrame:
    from pyspark.sql import types as T

    shared = share(df.sparkSession, Encoder(path))
    fields = [*df.schema.fields[:kept], T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches):
        import pyarrow as pa

        coder = shared()
        for b in batches:
            for part in slices(b, kept, 200):
                rows = [coder.encode(t) for t in part.column(kept).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1])))
                out = [*(part.column(i) for i in range(kept)), pa.ListArray.from_arrays(pa.array(ends), flat)]
                if decoded:
                    out.append(pa.array([coder.decode(r) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and the text that each row's ids stand for; null ids decode to an empty text."""
    from pyspark.sql import types as T

    df, shared = df.select(*keep, ids), share(df.sparkSession, Encoder(path))
    schema = T.StructType([*df.schema.fields[: len(keep)], T.StructField(decoded, T.StringType())])

    def run(batches):
        import pyarrow as pa

        coder = shared()
        for b in batches:
            text = pa.array([coder.decode(r or ()) for r in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), text], schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the comma-joined decimal ids, SHA-256 of the decoded text."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
