"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits and underscores, lower-cased.  The field has two states, clean and toxic.  A token's
emission sums the weights of its word, its prefixes of 3 to 7 letters, its suffix of 3 letters, and the words before and
after it.  Labels mark documents, so training tokens are labelled first: in a toxic document those tokens are toxic whose
word or prefix leans to toxic documents beyond chance, copied passages counted once; all others are clean.  The field is then fitted by gradient ascent
on the likelihood.  Forward-backward marginals, over whole texts, aggregate to a document's score through a logistic
link fitted on the same sample, and tokens whose marginal reaches one half make up the offending offsets.

The sample is bounded: at most SAMPLE documents of either label, the first by a hash of their ids, and of these as many
as begin within SAMPLE_CHARS characters.  The field and those of the sample's halves, on which the link is fitted, are
fitted by three tasks on executors; the driver sees the field's weights and six numbers for each document of the sample.

Cases: null and empty texts have no tokens, no spans and a score like any text without evidence; long texts are tagged
whole; a marginal of one half, and a score equal to the threshold, count as toxic; repeated rows have equal results and
all stay; of an id's repeated labels the larger counts; without labels, or with labels of one kind, every score is the
same; an empty table gives an empty one; columns to keep must not be called score, predicted or spans, others are never
read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, share, slices
from .quality import labelled_sample

#: Most labelled documents of either kind that the field is fitted on, and characters of either kind that they begin within.
SAMPLE, SAMPLE_CHARS = 1200, 32_000_000
STEPS, RATE, RIDGE, CHUNK, LEAST = 40, 0.5, 1e-3, 64, 3
#: Share of a feature's contexts that must lie in toxic documents, and nats of evidence that it is no chance.
SHARE = 0.6
SURPRISE = 11.0
#: Tokens that a training step works on at a time.
PART_TOKENS = 100_000
#: Lengths of the prefixes that are features; words that differ in their endings share them.
PREFIXES = (3, 4, 5, 6, 7)
OWN = len(PREFIXES) + 2
WORD = re.compile(r"\w+")


def own_features(word: str) -> list[str]:
    return [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES), f"s{word[-3:]}"]


def _chain(d: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Normalised forward and backward vectors (tokens x 2) and the step matrices of tokens in many documents.

    A document's first token has a step matrix of equal rows, which forgets what stands before.  Products of matrices
    are formed within chunks of tokens side by side, then carried from chunk to chunk.
    """
    n = len(d)
    psi = 1 / (1 + np.exp(-np.stack([-d, d], 1)))
    step = trans[None] * psi[:, None, :]
    step[starts] = (first[None] * psi[starts])[:, None, :]
    chunks = -(-n // CHUNK)
    m = np.full((chunks * CHUNK, 4), 0.5)
    m[:n] = step.reshape(n, 4)
    m = np.ascontiguousarray(m.reshape(chunks, CHUNK, 4).transpose(1, 2, 0))  # place in the chunk, cell, chunk

    def times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
        return out / out.sum(0)

    ahead, behind = np.empty_like(m), np.empty_like(m)
    ahead[0], behind[-1] = m[0], m[-1]
    for k in range(1, CHUNK):
        ahead[k] = times(ahead[k - 1], m[k])
        behind[-1 - k] = times(m[-1 - k], behind[-k])
    enter, leave = np.empty((2, chunks)), np.empty((2, chunks + 1))
    a0 = a1 = 0.5
    for c, (p, q, r, s) in enumerate(ahead[-1].T.tolist()):
        enter[0, c], enter[1, c] = a0, a1
        a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0 = b1 = leave[0, chunks] = leave[1, chunks] = 0.5
    for c, (p, q, r, s) in reversed(list(enumerate(behind[0].T.tolist()))):
        b0, b1 = p * b0 + q * b1, r * b0 + s * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        leave[0, c], leave[1, c] = b0, b1
    alpha = np.stack([enter[0] * ahead[:, 0] + enter[1] * ahead[:, 2], enter[0] * ahead[:, 1] + enter[1] * ahead[:, 3]])
    beta = np.empty((2, CHUNK, chunks))
    beta[0, :-1] = behind[1:, 0] * leave[0, 1:] + behind[1:, 1] * leave[1, 1:]
    beta[1, :-1] = behind[1:, 2] * leave[0, 1:] + behind[1:, 3] * leave[1, 1:]
    beta[:, -1] = leave[:, 1:]
    alpha, beta = (x.transpose(2, 1, 0).reshape(-1, 2)[:n] for x in (alpha, beta))
    return alpha / alpha.sum(1, keepdims=True), beta / beta.sum(1, keepdims=True), step


def marginals(d: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(toxic) of every token; d is the emission's log odds, starts the documents' first tokens."""
    if not len(d):
        return np.zeros(0)
    alpha, beta, _ = _chain(d, starts, trans, first)
    joint = alpha * beta
    return joint[:, 1] / joint.sum(1)


@dataclass
class Field:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    first: np.ndarray
    link: np.ndarray

    def emissions(self, words: list[str], memo: dict[str, tuple[float, float, float]]) -> np.ndarray:
        """Log odds of the tokens of one document; memo holds a word's own, left and right shares."""
        get = self.weights.get
        for w in set(words).difference(memo):
            memo[w] = (self.bias + sum(get(f, 0.0) for f in own_features(w)), get(f"<{w}", 0.0), get(f">{w}", 0.0))
        x = np.array([memo[w] for w in words]).reshape(len(words), 3)
        d = x[:, 0].copy()
        d[1:] += x[:-1, 1]
        d[:-1] += x[1:, 2]
        return d

    def tagged(self, texts: list[str | None], memo: dict) -> list[np.ndarray]:
        """Every text's token marginals."""
        if len(memo) > 300_000:
            memo.clear()
        each = [self.emissions(WORD.findall((t or "").lower()), memo) for t in texts]
        sizes = [len(e) for e in each]
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[np.array(sizes, int) > 0]
        p = marginals(np.concatenate(each) if each else np.zeros(0), starts, self.trans, self.first)
        return np.split(p, ends[:-1]) if each else []

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(evidence(p) @ self.link, -500, 500))))


def evidence(p: np.ndarray) -> np.ndarray:
    """What the link sees of a document's marginals: the three highest, their sum, and the sum by length."""
    top = np.zeros(3)
    if len(p):
        best = np.sort(p)[::-1][:3]
        top[: len(best)] = best
    top = np.clip(top, 1e-4, 1 - 1e-4)
    total = float(p.sum())
    return np.array([1.0, *np.log(top / (1 - top)), np.log1p(total), np.log1p(1000 * total / (len(p) + 50))])


def _leaning(own: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """Which features lean to toxic documents beyond chance, by their counts in documents of either kind."""
    n = own + other
    q = own / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0))
    return (q >= SHARE) & (surprise >= SURPRISE)


def fit_field(texts: list[str], toxic: np.ndarray) -> Field:
    """A field whose link is still to be fitted.  Features are handled as numbers; strings only name the kept ones."""
    import xxhash

    docs = [WORD.findall((t or "").lower()) for t in texts]
    trans, first = np.array([[0.9, 0.1], [0.5, 0.5]]), np.array([0.9, 0.1])
    sizes = np.array([len(w) for w in docs], int)
    if not sizes.sum() or toxic.min() == toxic.max():
        return Field({}, -5.0, trans, first, np.zeros(0))
    types = {w: i for i, w in enumerate(sorted({w for words in docs for w in words}))}
    x = np.concatenate([np.fromiter(map(types.__getitem__, words), np.int32, len(words)) for words in docs])
    docs.clear()
    none, count = len(types), len(texts)
    doc = np.repeat(np.arange(count), sizes)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    bad = toxic[doc] > 0
    left, right = np.concatenate([[none], x[:-1]]), np.concatenate([x[1:], [none]])
    left[starts] = none
    right[(starts - 1)[starts > 0]] = none
    hashed = np.array([[xxhash.xxh64_intdigest(f) for f in own_features(w)] for w in types], np.uint64)
    known, own = np.unique(hashed, return_inverse=True)
    own = own.reshape(none, OWN).astype(np.int32)
    # what a feature is seen in counts once for each document, and once for each word before it, whichever is less:
    # copied passages share the words before, and a document's own repetitions the document
    kinds = [np.zeros(len(known), int), np.zeros(len(known), int)]
    often = np.zeros(len(known), int)
    for j in range(OWN):
        seen_in = np.unique(own[x, j].astype(np.int64) * count + doc)
        often += np.bincount(seen_in // count, minlength=len(known))
        for kind in (0, 1):
            in_docs = np.bincount(seen_in[toxic[seen_in % count] == kind] // count, minlength=len(known))
            at = bad == bool(kind)
            contexts = np.unique(own[x[at], j].astype(np.int64) * (none + 1) + left[at]) // (none + 1)
            kinds[kind] += np.minimum(in_docs, np.bincount(contexts, minlength=len(known)))
    leaning = _leaning(kinds[1], kinds[0], float(toxic.mean()))
    marked = leaning[own[:, :-1]].any(1)
    of_word = often[own[:, 0]] >= LEAST  # the words that are features of their neighbours
    index = np.zeros(len(known), np.int32)
    index[often >= LEAST] = np.arange(1, (often >= LEAST).sum() + 1)
    own, kept = index[own], int(index.max()) + 1
    beside = np.zeros(none + 1, np.int32)
    beside[:-1][of_word] = np.arange(of_word.sum())
    to_right = np.where(np.append(of_word, False), kept + beside, 0)
    to_left = np.where(np.append(of_word, False), kept + of_word.sum() + beside, 0)
    y = (bad & marked[x]).astype(float)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    cuts = [0]  # parts of whole documents, so that a step's arrays stay small
    for s in [*starts.tolist(), len(x)]:
        if s - cuts[-1] >= PART_TOKENS:
            cuts.append(s)
    cuts.append(len(x))
    theta, bias, logs = np.zeros(kept + 2 * int(of_word.sum())), -3.0, np.log(trans)
    squares, bias_square, trans_square = np.full(len(theta), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(STEPS):  # ascent with per-weight step sizes
        trans = np.exp(logs)
        by_word = theta[own].sum(1)
        off, expected = np.empty(len(x)), np.zeros((2, 2))
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            part = slice(low, high)
            d = by_word[x[part]] + theta[to_right[left[part]]] + theta[to_left[right[part]]] + bias
            alpha, beta, step = _chain(d, np.flatnonzero(~inner[part]), trans, first)
            p = alpha * beta
            off[part] = y[part] - p[:, 1] / p.sum(1)
            at = np.flatnonzero(inner[part])
            a, b, s = alpha[at - 1], beta[at], step[at]
            pair = np.stack([a[:, i] * s[:, i, j] * b[:, j] for i in (0, 1) for j in (0, 1)])
            expected += (pair / pair.sum(0)).sum(1).reshape(2, 2)
        g = np.bincount(own.ravel(), np.repeat(np.bincount(x, off, none), OWN), len(theta))
        g += np.bincount(to_right, np.bincount(left, off, none + 1), len(theta)) + np.bincount(to_left, np.bincount(right, off, none + 1), len(theta))
        g -= RIDGE * theta
        g[0] = 0
        squares += g**2
        theta += RATE * g / np.sqrt(squares)
        bias_square += off.sum() ** 2
        bias += RATE * off.sum() / np.sqrt(bias_square)
        gt = seen - expected
        trans_square += gt**2
        logs += 0.1 * gt / np.sqrt(trans_square)
    weights: dict[str, float] = {}
    for i, w in enumerate(types):
        for f, k in zip((*own_features(w), f"<{w}", f">{w}"), (*own[i], to_right[i], to_left[i])):
            if k and abs(theta[k]) > 1e-6:
                weights[f] = float(theta[k])
    return Field(weights, float(bias), np.exp(logs), first, np.zeros(0))


def _seen(field: Field, texts: list[str]) -> np.ndarray:
    memo: dict = {}
    if not texts:
        return np.zeros((0, len(evidence(np.zeros(0)))))
    return np.stack([evidence(p) for at in range(0, len(texts), 100) for p in field.tagged(texts[at : at + 100], memo)])


def _logistic(e: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression; Newton steps are halved until the penalised likelihood rises."""
    penalty = np.full(e.shape[1], ridge)
    penalty[0] = 1e-3

    def value(b: np.ndarray) -> float:
        z = e @ b
        return float((weight * (y * z - np.logaddexp(0, z))).sum() - 0.5 * (penalty * b * b).sum())

    b = np.zeros(e.shape[1])
    now = value(b)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(e @ b, -30, 30)))
        step = np.linalg.solve((e * (weight * q * (1 - q))[:, None]).T @ e + np.diag(penalty), e.T @ (weight * (y - q)) - penalty * b)
        size = 1.0
        while size > 1e-6 and value(b + size * step) < now:
            size /= 2
        b = b + size * step
        if (new := value(b)) - now < 1e-9 * (1 + abs(now)):
            break
        now = new
    return b


def _prior(share: float) -> np.ndarray:
    return np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), *[0.0] * (len(evidence(np.zeros(0))) - 1)])


def linked(field: Field, e: np.ndarray, toxic: np.ndarray, share: float) -> Field:
    """The field with its link.  e: what fields that were fitted on the other half of the sample see of each document;
    share: toxic documents among all labelled ones, to which the link is adjusted."""
    prior = _prior(share)
    if not field.weights:
        field.link = prior
        return field
    mean = float(toxic.mean())
    weight = np.where(toxic == 1, share / mean, (1 - share) / (1 - mean))
    active = list(range(len(prior)))
    while True:  # evidence never counts against a document: what would, goes
        link = prior * 0
        link[active] = _logistic(e[:, active], toxic, weight)
        worst = min(active[1:], key=lambda i: link[i], default=0)
        if not worst or link[worst] >= 0:
            break
        active.remove(worst)
    field.link = link
    return field


def _fits(sample: DataFrame) -> DataFrame:
    """Three rows: fit 2 has the whole sample's field; 0 and 1 what the field of the other half sees of theirs.

    sample: nth (its place in the sample's order), text, label.
    """

    def run(batches):
        import pickle

        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            for which, *row in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(which, []).append(tuple(row))
        for which, rows in sorted(held.items()):
            rows.sort()
            texts, toxic = [r[1] for r in rows], np.array([r[2] for r in rows], float)
            half = np.arange(len(rows)) % 2
            if which == 2:
                made = fit_field(texts, toxic)
            else:
                learnt, seen = np.flatnonzero(half != which), np.flatnonzero(half == which)
                field = fit_field([texts[i] for i in learnt], toxic[learnt])
                made = _seen(field, [texts[i] for i in seen])
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([pickle.dumps(made.__dict__ if which == 2 else made)], pa.binary())], ["fit", "made"])

    each = sample.select(F.explode(F.array(*map(F.lit, range(3)))).alias("fit"), "nth", "text", "label")
    return each.repartitionByRange(3, "fit").mapInArrow(run, "fit int, made binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, scratch: Scratch | None = None) -> Field:
    """labels holds the rows that may be learnt from, and no other."""
    import pickle

    scratch = scratch or Scratch(docs.sparkSession)
    share = float(labels.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    of = [labelled_sample(docs, labels.where(F.col(label) == value), label, most, SAMPLE_CHARS) for value in (0, 1)]
    order = F.row_number().over(Window.orderBy("doc_id", "text", "label"))  # of twice `most` rows
    sample = scratch.keep(of[0].unionByName(of[1]).select((order - 1).alias("nth"), "text", "label"), "sample")
    made = {r["fit"]: pickle.loads(r["made"]) for r in _fits(sample).collect()}  # three rows, bounded as the sample is
    if not made:
        return linked(fit_field([], np.zeros(0)), np.zeros((0, 0)), np.zeros(0), share)
    toxic = np.array([r["label"] for r in sample.orderBy("nth").select("label").collect()], float)
    e = np.zeros((len(toxic), len(_prior(share))))
    for k in (0, 1):
        e[k::2] = made[k]
    scratch.drop("sample")
    return linked(Field(**made[2]), e, toxic, share)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as character offsets of the text."""
    out: list[dict] = []
    last = -2
    lower = text.lower()
    if len(lower) == len(text):
        place = lambda i: i
    else:  # a few characters become several in lower case: back to those they came from
        ends = np.cumsum([len(c.lower()) for c in text])
        place = lambda i: int(np.searchsorted(ends, i, "right"))
    for i, m in enumerate(WORD.finditer(lower)):
        if i < len(p) and p[i] >= 0.5:
            start, end = place(m.start()), place(m.end() - 1) + 1
            if last == i - 1:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end})
            last = i
    return out


def tag(df: DataFrame, model: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns to keep, score, predicted (1 if the score reaches the threshold) and spans (offsets in the text)."""
    df = df.select(*keep, text)
    n, shared = len(keep), share(df.sparkSession, model)
    schema = T.StructType([*df.schema.fields[:n], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches):
        import pyarrow as pa

        field, memo = shared(), {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for part in slices(b, n):
                texts = part.column(n).to_pylist()
                each = field.tagged(texts, memo)
                scores = np.array([field.score(p) for p in each])
                spans = [spans_of(t, p) if p.max(initial=0) >= 0.5 else [] for t, p in zip(texts, each)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)], schema.names)

    return df.mapInArrow(run, schema)
