"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

Found values are validated (Luhn and mod-97 check digits, number plans, calendar), mapped to an integer below the number
of values of their format, permuted by a keyed Feistel network with cycle walking, and written back in the same format
with valid check digits.  The permutation depends on the key and the format alone, so equal values stay linked across
documents.  Every format's values are closed under its permutation, so no two values share a pseudonym and whoever has
the key can invert it.  What is not valid is left as it stands.  A run of groups that is no valid card or IBAN as a whole
is searched for one that ends, or starts, where a group does.

Cases: a null text stays null; an empty text, and any without a valid value, stays as it is, with no spans; a long text is
searched as a whole, in time linear in its length; of overlapping finds the leftmost, then the longest, counts, and of
finds of one extent the first kind by name; repeated rows are treated alike and all stay; an empty table gives an empty
one; a column that has the name of the spans is replaced by them, other columns pass, whatever they are called.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

ROUNDS = 8
#: Dates are permuted within these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DATE_ORDERS = {"-": "ymd", ".": "dmy", "/": "mdy"}
#: Slash dates whose first number is no month are day first; they are permuted among the days after the 12th.
LATE_DAYS = [d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]
#: Valid area codes and exchanges of the North American plan, the exchanges that it does not have, and the areas of social
#: security numbers.
CODES = [c for c in range(200, 1000) if c % 100 != 11]
NO_CODES = [c for c in range(1000) if c < 200 or c % 100 == 11]
AREAS = [a for a in range(1, 900) if a != 666]
#: Country codes of one and two digits; all others have three.
COUNTRY_CODE = re.compile(r"\+(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")

PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.(+-])[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}(?![\w-])|(?<![\w+])\+(?!\d+\.\d+(?![\d.]))[2-9]\d(?:[ .()/-]{0,2}\d){6,13}(?!\w)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: Kinds written in groups, and what stands between these.
GROUPED = {"card": re.compile("[ -]"), "iban": re.compile(" ")}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def luhn(digits: str) -> int:
    """The check sum of a number; a number is valid at 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


class Permuter:
    """A keyed permutation of 0..n-1 for every n and format."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("an empty key would make pseudonyms guessable")
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        h = hashlib.shake_256(self.key + tweak + bytes([i]) + value.to_bytes(size + 1, "big")).digest(size)
        return int.from_bytes(h, "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, inverse: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mark, mask = f"{tweak}:{n}".encode(), (1 << bits) - 1
        while True:
            a, b = x >> bits, x & mask
            for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
                if inverse:
                    a, b = b ^ self._round(mark, i, a, bits), a
                else:
                    a, b = b, a ^ self._round(mark, i, b, bits)
            x = a << bits | b
            if x < n:
                return x

    # each kind: the pseudonym of a valid value, or None

    def digits(self, text: str, at: list[int], tweak: str, inverse: bool) -> str:
        """The text with the digits at the given places permuted together."""
        if not at:
            return text
        new = self.permute(int("".join(text[i] for i in at)), 10 ** len(at), tweak, inverse)
        out = list(text)
        for i, c in zip(at, f"{new:0{len(at)}d}"):
            out[i] = c
        return "".join(out)

    def card(self, v: str, inverse: bool = False) -> str | None:
        at = [i for i, c in enumerate(v) if c.isdigit()]
        plain = "".join(v[i] for i in at)
        if luhn(plain) or len(set(plain)) == 1:
            return None
        while True:
            v = self.digits(v, at[1:-1], f"card{plain[0]}", inverse)
            rest = luhn("".join(v[i] for i in at[:-1]) + "0")
            v = v[: at[-1]] + str(-rest % 10) + v[at[-1] + 1 :]
            if len({v[i] for i in at}) > 1:  # one digit throughout is no card: walk on
                return v

    def iban(self, v: str, inverse: bool = False) -> str | None:
        at = [i for i, c in enumerate(v) if c != " "]
        plain = "".join(v[i] for i in at)
        if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or iban_rest(plain) != 1:
            return None
        v = self.digits(v, [i for i in at[4:] if v[i].isdigit()], f"iban{plain[:2]}", inverse)
        plain = "".join(v[i] for i in at)
        check = f"{98 - iban_rest(plain[:2] + '00' + plain[4:]):02d}"
        return v[:2] + check + v[4:]

    def date(self, v: str, inverse: bool = False) -> str | None:
        sep = next(c for c in v if not c.isdigit())
        late = sep == "/" and int(v[:2]) > 12
        order = "dmy" if late else DATE_ORDERS[sep]
        part = dict(zip(order, map(int, v.split(sep))))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        if late:
            new = datetime.date.fromordinal(LATE_DAYS[self.permute(bisect.bisect_left(LATE_DAYS, day), len(LATE_DAYS), "late date", inverse)])
        else:
            new = datetime.date.fromordinal(FIRST_DAY + self.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", inverse))
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(value[k] for k in order)

    def ssn(self, v: str, inverse: bool = False) -> str | None:
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = (bisect.bisect_left(AREAS, area) * 99 + group - 1) * 9999 + serial - 1
        x = self.permute(x, len(AREAS) * 99 * 9999, "ssn", inverse)
        return f"{AREAS[x // (99 * 9999)]:03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def phone(self, v: str, inverse: bool = False) -> str | None:
        if v[0] == "+" and v[1] != "1":  # outside North America: the country code stays
            code = COUNTRY_CODE.match("+" + "".join(filter(str.isdigit, v)))[0]
            return self.digits(v, [i for i, c in enumerate(v) if c.isdigit()][len(code) - 1 :], f"phone{code}", inverse)
        at = [i for i, c in enumerate(v) if c.isdigit()][-10:]
        area, exchange, line = (int("".join(v[i] for i in at[a:b])) for a, b in ((0, 3), (3, 6), (6, 10)))
        if area in CODES and exchange in CODES:
            x = (bisect.bisect_left(CODES, area) * len(CODES) + bisect.bisect_left(CODES, exchange)) * 10_000 + line
            x = self.permute(x, len(CODES) ** 2 * 10_000, "phone", inverse)
            new = f"{CODES[x // 10_000 // len(CODES)]}{CODES[x // 10_000 % len(CODES)]}{x % 10_000:04d}"
        elif area in CODES:  # written as a number, but outside the plan, where it stays: the area is kept
            x = self.permute(bisect.bisect_left(NO_CODES, exchange) * 10_000 + line, len(NO_CODES) * 10_000, f"phone{area}", inverse)
            new = f"{area}{NO_CODES[x // 10_000]:03d}{x % 10_000:04d}"
        else:  # no exchange lies inside the plan
            new = f"{area:03d}{self.permute(exchange * 10_000 + line, 10**7, f'phone{area:03d}', inverse):07d}"
        out = list(v)
        for i, c in zip(at, new):
            out[i] = c
        return "".join(out)

    def ip(self, v: str, inverse: bool = False) -> str | None:
        octets = v.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = self.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip", inverse)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def email(self, v: str, inverse: bool = False) -> str | None:
        """Letters and digits of the part before the @ are permuted within their kinds; the domain stays."""
        local, _, domain = v.partition("@")
        x, n = 0, 1
        kinds = [(10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") for c in local if c.isascii() and c.isalnum()]
        for (base, zero), c in zip(kinds, (c for c in local if c.isalnum())):
            x, n = x * base + ord(c) - ord(zero), n * base
        x = self.permute(x, n, f"email{''.join(z for _, z in kinds)}@{domain.lower()}", inverse)
        new = []
        for base, zero in reversed(kinds):
            new.append(chr(ord(zero) + x % base))
            x //= base
        return "".join(new.pop() if c.isalnum() else c for c in local) + "@" + domain


class Finder:
    def __init__(self, key: str, most: int = 100_000):
        self.permuter, self.most = Permuter(key), most
        self.memo: dict[tuple[str, str], str | None] = {}
        self.regexes = {k: re.compile(p, re.A if k != "email" else 0) for k, p in PATTERNS.items()}
        self.rough = re.compile(r"@|\d[\d .()/-]{5,}|[A-Z]{2}\d{2}")

    def pseudonym(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.memo:
            if len(self.memo) > self.most:
                self.memo.clear()
            self.memo[kind, value] = getattr(self.permuter, kind)(value)
        return self.memo[kind, value]

    def part(self, kind: str, value: str) -> str | None:
        """The pseudonym of a match or of its beginning."""
        return None if kind == "card" and sum(map(str.isdigit, value)) < 13 else self.pseudonym(kind, value)

    def find(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the valid values, in order, none overlapping."""
        if not text or not self.rough.search(text):
            return []
        found = []
        for kind, regex in self.regexes.items():
            at = 0
            while m := regex.search(text, at):
                gaps = list(GROUPED[kind].finditer(text, *m.span())) if kind in GROUPED else []
                at = gaps[0].end() if gaps else m.end()
                for end in (m.end(), *(g.start() for g in reversed(gaps))):
                    if (p := self.part(kind, text[m.start() : end])) is not None:
                        found.append((m.start(), -end, kind, p))
                        at = end
                        break
        out, done = [], 0
        for a, b, kind, p in sorted(found):
            if a >= done:
                out.append((a, -b, kind, p))
                done = -b
        return out


def pseudonymise(df: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """All columns, the text with pseudonyms for every valid value, and spans: where they stand in the given text."""
    df = without(df, spans)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])

    def run(batches):
        import pyarrow as pa

        finder = Finder(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, marks = [], []
            for t in b.column(at).to_pylist():
                got, out, done = finder.find(t), [], 0
                for a, e, _, p in got:
                    out += [t[done:a], p]
                    done = e
                texts.append("".join([*out, t[done:]]) if got else t)
                marks.append([{"kind": k, "start": a, "end": e} for a, e, k, _ in got])
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)), pa.array(marks, kind)], schema.names)

    return df.mapInArrow(run, schema)


def summary(df: DataFrame) -> DataFrame:
    """doc_id, the number of values replaced, their spans as text, and the new text."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return df.select("doc_id", F.size("spans").cast("long").alias("n_values"), F.concat_ws(",", F.transform("spans", one)).alias("spans"), "text")
