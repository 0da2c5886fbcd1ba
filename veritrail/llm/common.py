"""Helpers shared by the operators: reading tables, scratch tables in the shared folder, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes, so that a Python worker holds little text at a time.

    Sets two settings of the session and leaves them.  Only the registered queries call it; operators do not.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(batch, column: int, rows: int = 100, size: int = 1 << 20):
    """An Arrow batch in parts of at most so many rows and so many bytes of a text column; a longer text stands alone."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(at + rows, max(at + 1, fits))
        yield batch.slice(at, to - at)
        at = to


def fresh(columns: list[str], name: str) -> str:
    """The name, or one like it that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The columns but those of the names that an operator is about to add: its results replace them."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def share(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives the value on executors, from a broadcast; the value's size must have a bound.

    It is pickled with its class, as executors may not have the package; each task unpickles it once.
    """
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        import pickle

        return pickle.loads(sent.value)

    return get


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session, else the warehouse.

    A warehouse on the driver's own disk serves local mode only; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        if not local and (base.startswith(("file:", "/")) or ":" not in base):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


class Scratch:
    """Tables in the folder that the driver and all executors share.

    keep() writes a DataFrame and reads it back, which cuts its lineage and survives lost executors.  drop() removes
    tables that nothing reads any more, close() all of them; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = False

    def _path(self, *name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *name]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if not self.made:
            path, files = self._path()
            files.mkdirs(path)
            files.deleteOnExit(path)
            self.made = True
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)

    def close(self) -> None:
        path, files = self._path()
        files.delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHashes:
    """64-bit hashes of words, with a memo bounded in words and, as long words are not kept, in bytes.  Equal words hash
    alike in every process."""

    def __init__(self, most: int = 200_000, longest: int = 64):
        self.memo: dict[str, int] = {}
        self.most, self.longest = most, longest

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        memo, long = self.memo, []
        if new := set(words).difference(memo):
            if len(memo) > self.most:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            long = [w for w in new if len(w) > self.longest]
        out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        for w in long:
            del memo[w]
        return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a text of 1 to n-1 words has one shingle, the whole of it."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out + U64(k)))


def crc_mod(column: str, by: int):
    """crc32 of a value's decimal text, modulo by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by
