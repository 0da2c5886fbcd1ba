"""Secret scans with one combined deterministic automaton.

Every rule is a prefix expression and a run of tail characters of some least length.  All rules are compiled into one
minimal automaton; one pass over a text's bytes finds where any rule has matched.  The stretch around a match, between
the nearest bytes on both sides that set the combined automaton back to its start, is read once more from its end, by the
combined automaton of the mirrored rules: it tells every place where a match of each rule begins.  A rule's own anchored
automaton reads on from such places only, so no text is gone over again and again from starts that come to nothing.
Spans are leftmost, longest and non-overlapping per kind; a match whose tail is too short is passed over and dropped.

Cases: a null text counts as empty, and an empty one has no spans; long texts are scanned whole, in time linear in their
length; spans that begin together stand in the rules' order; repeated rows have equal spans and all stay; an empty table
gives an empty one; a column to keep must not be called spans, other columns never matter, and redact() keeps them all.
Spans count code points, the end is exclusive.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton
from .common import share


@dataclass(frozen=True)
class Rule:
    kind: str
    prefix: str
    tail: str
    least: int
    either_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
)
MORE = (
    Rule("forge", "gh(p|o|u|s|r)_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 20),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 16),
    Rule("keyblock", "-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY----", "-", 1),
)
RULES = BASE + MORE
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # behind a prefix the first tail character counts as a hit: counting all tails at once would multiply the states
        hits = [(f"{r.prefix}{r.tail}{{{1 if r.prefix else r.least},}}", r.either_case) for r in rules]
        begins = [(f"{r.prefix}{r.tail}{{{1 if r.prefix else r.least}}}", r.either_case) for r in rules]
        self.whole, self.back = Automaton(hits, anywhere=True), Automaton(begins, anywhere=True, back=True)
        self.reset = (self.whole.next == 0).all(0)
        self.own = []
        for r in rules:
            prefix = Automaton([(r.prefix, r.either_case)], anywhere=False)
            tail = Automaton([(r.tail, False)], anywhere=False)
            self.own.append((prefix.next.tolist(), prefix.accepts.tolist(), (tail.next[0] >= 0).tolist()))
        self.link()

    def link(self) -> None:
        self.start, self.end = self.whole.rows()[0], self.back.rows()[0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("start", "end")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.link()

    def _spans(self, data: bytes, high: int, k: int, begins: list[int]):
        """Leftmost-longest spans of one rule that begin at the places given, before `high`, which no match crosses."""
        moves, accepts, tail = self.own[k]
        done = -1
        for at in begins:
            if at < done:
                continue
            state, i, body = 0, at, at if accepts[0] else -1
            while i < high and (state := moves[state][data[i]]) >= 0:
                i += 1
                if accepts[state]:
                    body = i
            if 0 <= body < high and tail[data[body]]:
                done = body
                while done < high and tail[data[done]]:
                    done += 1
                if done - body >= self.rules[k].least:
                    yield at, done

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in this order."""
        row = self.start
        hits = [i for i, b in enumerate(data) if (row := row[b])[256]]
        if not hits:
            return []
        stops = np.flatnonzero(self.reset[np.frombuffer(data, np.uint8)]).tolist()
        out, done = [], 0
        for i in hits:
            if i < done:
                continue
            k = bisect_left(stops, i)
            low, done = (stops[k - 1] + 1 if k else 0), (stops[k] if k < len(stops) else len(data))
            row = self.end
            begins = [(at, row[256]) for at, b in zip(range(done - 1, low - 1, -1), data[low:done][::-1]) if (row := row[b])[256]]
            for r in range(len(self.rules)):
                if places := [at for at, told in reversed(begins) if told >> r & 1]:
                    out += [(a, r, b) for a, b in self._spans(data, done, r, places)]
        return sorted(out)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then by the rules' order."""
        data = (text or "").encode("utf-8")
        found = self.scan(data)
        if not found:
            return []
        wide = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
        return [(self.rules[r].kind, int(wide[a]), int(wide[b])) for a, r, b in found]


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns to keep, and `spans`: each whole text's secrets as array<struct<kind, start, end>>."""
    df = df.select(*keep, text)
    n = len(keep)
    schema, shared = T.StructType([*df.schema.fields[:n], T.StructField("spans", T.ArrayType(SPAN))]), share(df.sparkSession, Scanner(rules))

    def run(batches):
        import pyarrow as pa

        scanner = shared()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [[{"kind": k, "start": a, "end": e} for k, a, e in scanner.spans(t)] for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(rows, kind)], schema.names)

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns and rows as they are, but with every secret in the text replaced by a mark; a null text stays null."""
    schema, at, shared = df.schema, df.columns.index(text), share(df.sparkSession, Scanner(rules))

    def run(batches):
        import pyarrow as pa

        scanner = shared()
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                out, done = [], 0
                for _, a, e in scanner.spans(t):
                    if e > done:
                        out += [t[done : max(a, done)], *([mark] if a >= done else [])]
                        done = e
                rows.append("".join([*out, t[done:]]) if out else t)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], schema.names)

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
