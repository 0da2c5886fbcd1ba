"""Quality classifier: histogram gradient-boosted trees over statistics of a whole text.

Training reads a bounded sample of labelled rows (SAMPLE, in the order of a hash of their ids); their statistics are
computed on the executors.  The trees are flattened into arrays, and documents are scored by vectorised traversal.

Cases: a null text counts as empty; an empty text has statistics and a score as any other; long texts are read whole; a
score equal to the threshold passes; repeated rows have equal scores and all stay; of an id's repeated labels the larger
counts, and of its texts the last in order; without labels, or with labels of one kind, every score is the same; an empty
table gives an empty one; columns that have the names of the score and the prediction are replaced by them, others pass.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import share, without

#: Most labelled rows that a model is fitted on.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAF, RIDGE = 64, 80, 4, 0.15, 10, 1.0
LINE_END, SENTENCE_END = b"\n", (b".", b"!", b"?")
FEATURES = (
    "chars", "words", "word_length", "distinct_words", "repeated_next", "common_word", "common_pair", "longest_word", "upper", "digit", "space", "symbol",
    "punctuation", "non_ascii", "lines", "distinct_lines", "line_length", "sentence_length", "ended", "bracket", "bar", "compression", "long_words", "capitals",
)


def statistics(text: str | None) -> list[float]:
    """The values named in FEATURES, of the whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    lower = [x.lower() for x in words]
    times: dict[str, int] = {}
    for x in lower:
        times[x] = times.get(x, 0) + 1
    pairs: dict[tuple[str, str], int] = {}
    for x in zip(lower, lower[1:]):
        pairs[x] = pairs.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    letters = count[65:91].sum() + count[97:123].sum()
    ends = sum(data.count(e) for e in SENTENCE_END)
    punctuation = count[[33, 44, 46, 58, 59, 63]].sum()
    symbol = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - punctuation
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), len(times) / w, sum(a == b for a, b in zip(lower, lower[1:])) / w, max(times.values(), default=0) / w,
        max(pairs.values(), default=0) / w, lengths.max(), count[65:91].sum() / max(1, letters), count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, symbol / n,
        punctuation / n, count[128:].sum() / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(text) / max(1, len(lines)), w / max(1, ends), sum(x[-1] in ".!?:;\"'" for x in lines) / max(1, len(lines)),
        count[[40, 41, 60, 62, 91, 93, 123, 125]].sum() / n, count[124] / w, len(zlib.compress(data, 1)) / n, float((lengths > 12).mean()), sum(x[:1].isupper() for x in words) / w,
    ]


@dataclass
class Forest:
    """All trees' nodes in arrays: a node goes left if its feature is at most its threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Logistic boosting on binned features.  Labels of one kind only, or none, give a constant score."""
    node = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    root: list[int] = []
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))

    def add() -> int:
        i = len(node["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", 0.0)):
            node[k].append(v)
        return i

    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            level = {add(): np.arange(len(y))}
            root.append(next(iter(level)))
            for d in range(depth + 1):
                below: dict[int, np.ndarray] = {}
                for i, rows in level.items():
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, -1, -1)
                    if d < depth and len(rows) >= 2 * LEAF:
                        for f in range(x.shape[1]):
                            b = binned[rows, f]
                            n = np.bincount(b, minlength=bins).cumsum()
                            gl, hl = np.bincount(b, g[rows], bins).cumsum(), np.bincount(b, h[rows], bins).cumsum()
                            gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                            gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), f, k)
                    if best[1] < 0:
                        node["value"][i] = float(rate * gs / (hs + RIDGE))
                        margin[rows] += node["value"][i]
                        continue
                    _, f, k = best
                    node["feature"][i], node["threshold"][i] = f, float(cuts[f][k])
                    goes = binned[rows, f] <= k
                    node["left"][i], node["right"][i] = add(), add()
                    below |= {node["left"][i]: rows[goes], node["right"][i]: rows[~goes]}
                level = below
    if not root:
        root.append(add())
    return Forest(**{k: np.array(v) for k, v in node.items()}, root=np.array(root), depth=depth, base=base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, size: int | None = None) -> DataFrame:
    """doc_id, text and label of at most `most` labelled documents, the first by a hash of their ids; with a size, of as
    many of them as begin within so many characters, one at least.

    labels: doc_id and a 0/1 label; null labels do not count, of repeated ids the larger label does.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # its size is bounded by `most`
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # of repeated ids one text
    out = texts.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("x")).select("doc_id", "x.text", "x.label")
    if size is None:
        return out
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.length("text")  # of `most` rows
    return out.withColumn("before", before).where(F.col("before") < size).drop("before")


def _statistics_of(df: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    return df.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Forest:
    """labels holds the rows that may be learnt from, and no other."""
    got = _statistics_of(labelled_sample(docs, labels, label, most)).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not depend on it
    return fit(x[order], y[order])


def score(df: DataFrame, model: Forest, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns, score (0 to 1, higher: label 1 likelier) and predicted (1 if the score reaches the threshold)."""
    spark: SparkSession = df.sparkSession
    df = without(df, "score", "predicted")
    shared, at = share(spark, model), df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        forest = shared()
        for b in batches:
            if b.num_rows:
                s = forest.score(np.array([statistics(t) for t in b.column(at).to_pylist()], float))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return df.mapInArrow(run, schema)


def keep_good(df: DataFrame, model: Forest, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of the rows whose score reaches the threshold."""
    shared, at, schema = share(df.sparkSession, model), df.columns.index(text), df.schema

    def run(batches):
        import pyarrow as pa

        forest = shared()
        for b in batches:
            if b.num_rows:
                s = forest.score(np.array([statistics(t) for t in b.column(at).to_pylist()], float))
                yield b.filter(pa.array(s >= threshold))

    return df.mapInArrow(run, schema)
