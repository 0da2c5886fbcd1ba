"""String expressions.  Patterns carry (?U) where a class must follow Unicode, as \\w, \\d and \\s are ASCII otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Controls and invisible format characters that quotes and fields are scrubbed of.
INVISIBLE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xad\x{180e}\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]"
#: Section headings by name, in order of precedence; a heading begins with one of the words.
SECTIONS = (
    ("summary", "summary|profile|objective|about"),
    ("experience", "experience|employment|work history|professional history"),
    ("education", "education|academic|qualifications"),
    ("skills", "skills|technical skills|technologies|competencies"),
    ("projects", "projects|selected projects"),
    ("certifications", "certifications|certificates"),
    ("publications", "publications|papers"),
)
#: Degree levels in order of search, with the substrings that show them, and their order of height.
DEGREE_WORDS = (
    ("phd", ("phd", "doctor")),
    ("masters", ("master", "msc", "mba", "ma ")),
    ("bachelors", ("bachelor", "bsc", "ba ", "bs ", "bfa")),
    ("associate", ("associate",)),
    ("high_school", ("high school",)),
)
LEVELS = {"high_school": 1, "associate": 2, "bachelors": 3, "masters": 4, "phd": 5}
#: First characters that a spreadsheet would take for a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r")
#: What a skill name is rid of, a trailing version, and the shapes of addresses and telephone numbers, the
#: latter with the digits that make one.
NOT_NAME, VERSION = r"(?U)[^\w.+#\- ]+", r"(?iU)\s+v?\d+(?:\.\d+)*$"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE, PHONE_DIGITS = r"(?U)(?<!\w)\+?\d[\d().\-\s]{6,}\d(?!\w)", 10
LOOSE_EMAIL = r"(?iU)[^\s@]+\s*(?:@|\(at\)|\[at\])\s*[^\s@]+\.[^\s@]+"
LOOSE_PHONE, LOOSE_DIGITS = r"(?U)[+()\-.\s\d]{7,}", 7


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_field(c: Column) -> Column:
    return F.lower(collapse(strip_controls(c)))


def clean(c: Column) -> Column:
    """Keeps word characters, dots, pluses, hashes, hyphens and blanks; runs of blanks become one."""
    return collapse(F.regexp_replace(c, NOT_NAME, ""))


def strip_version(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, VERSION, ""))


def section_heading(line: Column) -> Column:
    """The section that a line announces, or null: at most 40 characters, and a heading word at its beginning."""
    line = strip(line)
    head = strip(F.regexp_replace(line, ":+$", ""))
    out = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS):
        out = F.when(head.rlike(rf"^(?i:{words})\b"), name).otherwise(out)
    return F.when((F.length(line) <= 40) & (head != ""), out)


def degree_level(degree: Column) -> Column:
    """First level one of whose words occurs in the degree."""
    low, out = F.lower(degree), F.lit(None).cast("string")
    for name, words in reversed(DEGREE_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    """Height of a level; 0 for a level that is not known, null for none."""
    out = F.lit(0)
    for name, rank in LEVELS.items():
        out = F.when(level == name, rank).otherwise(out)
    return F.when(level.isNotNull() & (level != ""), out)


def csv_safe(c: Column) -> Column:
    """A quote before strings that a spreadsheet would run."""
    return F.when(F.substring(c, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(c)


def masked_filename(name: Column) -> Column:
    """resume and the lower-case extension; a leading dot begins no extension."""
    base = F.regexp_replace(F.trim(name), r"^.*/", "")
    ext = F.lower(F.regexp_extract(base, r"^.*[^.].*?(\.[^.]*)$", 1))
    return F.concat(F.lit("resume"), F.coalesce(F.when(ext != ".", ext), F.lit("")))


def basename_lower(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^.*/", ""))


def letters(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA, and so on to the largest long, which has 14 letters.

    The letter that counts 26^i stands if n reaches the least number with so many letters, 26^i + ... + 26 + 1.
    """
    n = n.cast("long")
    out = []
    for i in reversed(range(14)):
        least = (26 ** (i + 1) - 1) // 25
        out.append(F.when(n >= least, F.chr(65 + F.pmod(F.call_function("div", n - F.lit(least), F.lit(26**i)), F.lit(26)))).otherwise(""))
    return F.concat(*out)


def let(c: Column, body) -> Column:
    """body of a column that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def replace_matches(c: Column, pattern: Column | str, replacement) -> Column:
    """Every match of a pattern replaced by an expression of the match, all in one pass: what is put in is not searched."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    one = lambda between, match: F.concat(between, F.when(match.isNull(), "").otherwise(replacement(match)))
    return let(c, lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0)), one), ""))


def pseudonym(rank: Column) -> Column:
    return F.when(rank < 1, "Candidate ?").otherwise(F.concat(F.lit("Candidate "), letters(rank)))


def json_body(c: Column) -> Column:
    """The JSON in a reply: what a code fence holds, else from the first opening to the last closing bracket."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    between = F.regexp_extract(c, r"(?s)([\{\[].*[\}\]])", 1)
    return F.when(fenced != "", strip(fenced)).when(between != "", between).otherwise(strip(c))


def mask_emails(c: Column, mark: str = "[contact redacted]") -> Column:
    return F.regexp_replace(c, EMAIL, mark)


def digits(c: Column) -> Column:
    """How many digits a text has."""
    return F.length(F.regexp_replace(c, r"(?U)\D", ""))


def mask_phones(c: Column, mark: str = "[contact redacted]") -> Column:
    """Runs of digits, dots, hyphens, brackets and blanks that hold ten digits or more themselves."""
    return replace_matches(c, PHONE, lambda m: F.when(digits(m) >= PHONE_DIGITS, mark).otherwise(m))


def without_contacts(c: Column) -> Column:
    """Without whatever is shaped like a mail address or has seven digits of a number; as it is if there is nothing."""
    out = replace_matches(F.regexp_replace(c, LOOSE_EMAIL, " "), LOOSE_PHONE, lambda m: F.when(digits(m) >= LOOSE_DIGITS, " ").otherwise(m))
    return let(out, lambda t: F.when(t == c, c).otherwise(collapse(t)))


def reject_reason(name: Column) -> Column:
    """Why a skill name is junk, or null: too long, or shaped like a mail address or a phone number."""
    words = F.size(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""))
    mail = name.rlike(LOOSE_EMAIL)
    phone = F.exists(F.regexp_extract_all(name, F.lit(LOOSE_PHONE), F.lit(0)), lambda r: digits(r) >= LOOSE_DIGITS)
    return F.when((F.length(name) > 60) | (words > 8), "length_or_token_cap").when(mail, "email_shape").when(phone, "phone_shape")
