"""Text functions, vocabulary scans, redaction, chunking and evidence on the documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scoring, strings
from ..functions.fuzzy import partial_ratio_column, token_set_ratio_column
from ..operators import chunking, matching, redaction, skills
from ..sources import files, manifests, memo
from .registry import query, table

SALT = "demo-salt"
#: A vocabulary and families made for the tables; curated files have the same shape.
VOCABULARY = [
    {"canonical": "almond", "aliases": ["almonds", "al mond"]},
    {"canonical": "python", "aliases": ["py"]},
    {"canonical": "the", "aliases": ["der", "les", "los"]},
    {"canonical": "with", "aliases": ["mit", "avec", "con"]},
    {"canonical": "idiot", "aliases": []},
]
ALIASES = skills.vocabulary(VOCABULARY)


TURN_TERMS = "[('the', 'the'), ('der', 'the'), ('les', 'the'), ('los', 'the'), ('with', 'with'), ('mit', 'with'), ('avec', 'with'), ('con', 'with'), ('idiot', 'idiot'), ('python', 'python'), ('py', 'python'), ('almond', 'almond'), ('almonds', 'almond'), ('al  mond', 'almond')]"
SCAN_SQL = f"""v AS (SELECT unnest(list_transform({TURN_TERMS}, lambda x: x[1])) AS term, unnest(list_transform({TURN_TERMS}, lambda x: x[2])) AS canonical)"""
#: Terms between characters that are no letter, digit, plus or hash; these stand doubled, so that neighbours can share one.
MENTION = "(?i)(?:^|[^A-Za-z0-9+#])(almonds|al  mond|almond|python|idiot|avec|with|con|der|les|los|mit|the|py)(?:$|[^A-Za-z0-9+#])"
DOUBLED = "regexp_replace(text, '([^A-Za-z0-9+#])', '\\1\\1', 'g')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (v2)/' || p_type, '[^\p{L}\p{N}_.+# -]+', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", strings.clean(F.concat("p_name", F.lit(" (v2)/"), "p_type")).alias("name"))


@query(r"SELECT p_partkey, trim(regexp_replace(p_name || ' v' || p_size || '.1', '(?i)\s+v?\d+(\.\d+)*$', '')) AS name FROM part")
def version_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", strings.strip_version(F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"), F.lit(".1"))).alias("name"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, trim(line) AS line, trim(regexp_replace(trim(line), ':+$', '')) AS head FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (length(line) <= 40 AND head <> '' AND regexp_matches(head, '^(?i:summary|profile|objective|about|experience|employment|work history|professional history|education|academic|qualifications|skills|technical skills|technologies|competencies|projects|selected projects|certifications|certificates|publications|papers)\b')) AS headings FROM h GROUP BY 1"""
)
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))  # noqa: E741
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(strings.section_heading(F.col("line"))).alias("headings"))


@query(
    """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, trim(line) AS line FROM l WHERE length(trim(line)) >= 40)
SELECT doc_id, printf('c_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS chunk_id, length(line) AS n FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 200"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more, numbered from 1 and capped at 200 a document."""
    from pyspark.sql import Window

    l = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))  # noqa: E741
    k = l.select("doc_id", "pos", F.trim("line").alias("line")).where(F.length("line") >= 40)
    k = k.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("n <= 200")
    return k.select("doc_id", F.format_string("c_%03d", "n").alias("chunk_id"), F.length("line").alias("n"))


#: Packs as numbers by length: see operators.chunking.packed; a fold over lengths in the other engine.
PACKED = """list_reduce(list_prepend({{'n': 0, 'number': 0, 'held': 0, 'numbers': []::INT[]}}, list_transform({0}, lambda t: {{'n': length(t)::INT, 'number': 0, 'held': 0, 'numbers': []::INT[]}})),
  lambda a, x: {{'n': 0, 'number': a.number + (x.n > 1200 OR a.held = 0 OR a.held + x.n + {1} > 1200)::INT, 'held': CASE WHEN x.n > 1200 THEN 0 WHEN a.held + x.n + {1} > 1200 THEN x.n + {2} ELSE a.held + x.n + {1} END,
    'numbers': list_append(a.numbers, a.number + (x.n > 1200 OR a.held = 0 OR a.held + x.n + {1} > 1200)::INT)}}).numbers"""
SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def bare(x: str) -> str:
    """SQL for a text without white space at its ends."""
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


HEADING = "^(?i:summary|profile|objective|about|experience|employment|work history|professional history|education|academic|qualifications|skills|technical skills|technologies|competencies|projects|selected projects|certifications|certificates|publications|papers)\\b"
SECTION = "CASE WHEN regexp_matches({0}, '^(?i:summary|profile|objective|about)\\b') THEN 'summary' WHEN regexp_matches({0}, '^(?i:experience|employment|work history|professional history)\\b') THEN 'experience' WHEN regexp_matches({0}, '^(?i:education|academic|qualifications)\\b') THEN 'education' WHEN regexp_matches({0}, '^(?i:skills|technical skills|technologies|competencies)\\b') THEN 'skills' WHEN regexp_matches({0}, '^(?i:projects|selected projects)\\b') THEN 'projects' WHEN regexp_matches({0}, '^(?i:certifications|certificates)\\b') THEN 'certifications' ELSE 'publications' END"
PACK_SQL = rf"""l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS nth FROM documents),
h AS (SELECT *, {bare("regexp_replace(" + bare("line") + ", ':+$', '')")} AS head, length({bare("line")}) <= 40 AND regexp_matches({bare("regexp_replace(" + bare("line") + ", ':+$', '')")}, '{HEADING}') AS is_head FROM l),
g AS (SELECT *, count(*) FILTER (is_head) OVER (PARTITION BY doc_id ORDER BY nth) AS sec FROM h),
s AS (SELECT doc_id, sec, coalesce(max({SECTION.format('head')}) FILTER (is_head), 'other') AS section, {bare("coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT is_head), '')")} AS body FROM g GROUP BY 1, 2),
p AS (SELECT doc_id, sec, section, list_filter(list_transform(regexp_split_to_array(body, '\n{SPACE}*\n+'), lambda t: {bare('t')}), lambda t: t <> '') AS texts FROM s WHERE body <> ''),
q AS (SELECT doc_id, sec, section, unnest(texts) AS text, generate_subscripts(texts, 1) AS para, unnest({PACKED.format('texts', 2, 0)}) AS pack FROM p),
w AS (SELECT *, CASE WHEN length(text) > 1200 THEN list_filter(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(0), 'g'), chr(0)), lambda t: t <> '') ELSE [text] END AS bits FROM q),
x AS (SELECT doc_id, sec, section, para, pack, unnest(bits) AS bit, generate_subscripts(bits, 1) AS nth, unnest(CASE WHEN length(text) > 1200 THEN {PACKED.format('bits', 1, 1)} ELSE [0] END) AS part FROM w),
y AS (SELECT *, unnest(range(greatest(1, ceil(length(bit) / 1200)::INT))) AS cut FROM x),
z AS (SELECT doc_id, sec, section, pack, part, cut, {bare("CASE WHEN part > 0 THEN string_agg(substr(bit, cut * 1200 + 1, 1200), ' ' ORDER BY para, nth) ELSE string_agg(substr(bit, cut * 1200 + 1, 1200), chr(10) || chr(10) ORDER BY para, nth) END")} AS text FROM y GROUP BY doc_id, sec, section, pack, part, cut)"""


@query(
    f"""WITH {PACK_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, pack, part, cut) AS n FROM z WHERE length(text) >= 40)
SELECT doc_id, printf('c_%03d', n) AS chunk_id, section, length(text) AS n, md5(text) AS digest FROM k WHERE n <= 200"""
)
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections packed into chunks of 40 to 1200 characters."""
    pages = documents(spark, sf_dir).select(F.col("doc_id").alias("resume_id"), F.lit(1).alias("page_no"), "text")
    return chunking.chunks(pages).select(F.col("resume_id").alias("doc_id"), "chunk_id", "section", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+\b', '[contact redacted]', 'g') AS text FROM documents"""
)
def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the SQL's word boundary is that of ASCII; an address here never touches other letters
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+\b", "[contact redacted]").alias("text"))


@query()
def redact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, places, addresses and phone numbers masked; a document's first two words play its author's name."""
    d = documents(spark, sf_dir)
    name = F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ")
    shown = redaction.redact_text(F.col("text"), name=name, location=F.lit("Austin, Texas"), regions=("Texas", "France", "Germany"))
    return d.select("doc_id", F.md5(shown).alias("digest"), F.size(F.regexp_extract_all(shown, F.lit(r"(\[name redacted\])"), 1)).alias("names"))


@query(
    r"""SELECT page_id, 'resume' || coalesce(nullif(lower(regexp_extract(regexp_replace(trim(url), '^.*/', ''), '^.*[^.].*?(\.[^.]*)$', 1)), '.'), '') AS filename,
  lower(regexp_replace(replace(url, chr(92), '/'), '^.*/', '')) AS base FROM pages"""
)
def filename_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.masked_filename(F.col("url")).alias("filename"), strings.basename_lower(F.col("url")).alias("base"))


@query(
    r"""WITH f AS (SELECT p_partkey, p_brand || ['_Resume.pdf', '-cover letter.docx', ' CV.txt', '.rtf'][1 + p_partkey % 4] AS name FROM part), s AS (SELECT *, regexp_replace(lower(name), '\.[^.]*$', '') AS stem FROM f)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'cover' ELSE 'resume' END AS role,
  trim(regexp_replace(regexp_replace(regexp_replace(stem, '[\s_-]+(resume|cv)$', ''), '[\s_-]+cover letter$', ''), '[\s_-]+', ' ', 'g')) AS base,
  substr(trim(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[\s_-]+', ' ', 'g')), 1, 200) AS title FROM s"""
)
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("_Resume.pdf", "-cover letter.docx", " CV.txt", ".rtf")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.get(ends, (F.col("p_partkey") % 4).cast("int"))).alias("name"))
    return p.select("p_partkey", manifests.role(F.col("name")).alias("role"), manifests.pair_base(F.col("name")).alias("base"), manifests.title_from_filename(F.col("name")).alias("title"))


@query(
    """WITH m AS (SELECT p_partkey % 100 AS batch, 'cv_' || p_partkey || '.pdf' AS resume_key, CASE WHEN p_partkey % 2 = 0 THEN 'cl_' || p_partkey || '.pdf' END AS cover_key FROM part),
f AS (SELECT batch, resume_key, cover_key, CAST(regexp_extract(resume_key, '\\d+') AS INT) AS k FROM m)
SELECT batch, resume_key AS resume, CASE WHEN k % 5 <> 0 AND k % 2 = 0 AND k % 3 <> 0 THEN cover_key END AS cover,
  CASE WHEN k % 5 <> 0 AND k % 2 = 0 AND k % 3 = 0 THEN 'cover letter of the manifest is missing' END AS note, CASE WHEN k % 5 = 0 THEN 'resume of the manifest is missing' END AS reason FROM f
UNION ALL SELECT batch, cover_key, NULL, NULL, NULL FROM f WHERE k % 5 = 0 AND k % 2 = 0 AND k % 3 <> 0""".replace("\\\\", "\\")
)
def manifest_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a manifest: absent résumés are rejected, absent covers noted, files the manifest did not use count alone."""
    m = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("batch"), F.col("p_partkey").alias("k"))
    key = lambda head: F.concat(F.lit(head), F.col("k").cast("string"), F.lit(".pdf"))
    pairs = m.select("batch", key("cv_").alias("resume_key"), F.when(F.col("k") % 2 == 0, key("cl_")).alias("cover_key"))
    up = m.where("k % 5 <> 0").select("batch", F.col("k").alias("at"), key("CV_").alias("filename"))
    up = up.unionByName(m.where("k % 2 = 0 and k % 3 <> 0").select("batch", (F.col("k") + 1_000_000).alias("at"), key("cl_").alias("filename")))
    out = manifests.paired(up, pairs)
    return out.select("batch", F.lower("resume").alias("resume"), F.lower("cover").alias("cover"), "note", "reason")


@query(f"SELECT p_partkey, 'h:' || substr(sha256('{SALT}' || lower(p_name)), 1, 32) AS skill_key, sha256(lower(trim(' X' || p_name || '@example.test '))) AS email_hash FROM part")
def skill_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", hashing.salted_key(F.lower("p_name"), SALT).alias("skill_key"), hashing.email_hash(F.concat(F.lit(" X"), "p_name", F.lit("@example.test "))).alias("email_hash"))


@query("SELECT p_partkey, CAST(('0x' || substr(sha1(p_name), 1, 16))::UBIGINT % 768 AS INT) AS bucket FROM part")
def token_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", hashing.token_bucket(F.col("p_name")).alias("bucket"))


@query(
    """WITH t AS (SELECT DISTINCT p_name AS text, unnest(regexp_extract_all(lower(p_name), '([a-z0-9]+)')) AS token, 1 AS one FROM part),
t2 AS (SELECT text, token FROM (SELECT p_name AS text, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token, p_partkey FROM part) GROUP BY text, token),
c AS (SELECT text, CAST(('0x' || substr(sha1(token), 1, 16))::UBIGINT % 64 AS INT) AS b, count(*) AS n FROM t2 GROUP BY 1, 2)
SELECT md5(text) AS text_digest, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS buckets FROM c GROUP BY 1"""
)
def stand_in_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of hashed tokens, on distinct texts, through the memo; the SQL counts distinct tokens, as names repeat none."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    empty = spark.createDataFrame([], "key string, vector array<double>, cached_at timestamp")
    out, _ = memo.read_through(p, empty, lambda t: memo.bag_of_words(t, 64), "words")
    one = out.select("text", "vector").dropDuplicates(["text"])
    return one.select(F.md5("text").alias("text_digest"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).cast("long").alias("tokens"), F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("buckets"))


@query(f"""WITH {SCAN_SQL}, m AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({DOUBLED}, '{MENTION}', 1) AS x FROM documents)),
n AS (SELECT doc_id, canonical, min(pos) AS pos FROM m JOIN v ON lower(t) = term GROUP BY 1, 2), g AS (SELECT doc_id, list(canonical ORDER BY pos) AS skills FROM n GROUP BY 1)
SELECT d.doc_id, coalesce(skills, []) AS skills FROM documents d LEFT JOIN g USING (doc_id)""")
def skill_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary terms named in every document, each once, in order of mention."""
    return skills.scanned(documents(spark, sf_dir), "doc_id", "text", skills.dimension(spark, ALIASES), list(ALIASES))


CLEANED = r"""trim(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_.+# -]+', '', 'g'), '\s+', ' ', 'g'))"""
UNVERSIONED = r"""trim(regexp_replace({0}, '(?i)\s+v?\d+(\.\d+)*$', ''))"""


@query(
    rf"""WITH v AS (SELECT unnest(list_transform({TURN_TERMS.replace('al  mond', 'al mond')}, lambda x: x[1])) AS alias, unnest(list_transform({TURN_TERMS}, lambda x: x[2])) AS canonical),
n AS (SELECT p_partkey, unnest([p_name, p_name || ' 14', 'py (' || p_type || ')', p_type || ' (python 3.1)', p_name || '@mail.example']) AS name, unnest([0, 1, 2, 3, 4]) AS form FROM part),
b AS (SELECT *, {CLEANED.format("lower(trim(name))")} AS whole, {CLEANED.format("regexp_replace(lower(trim(name)), '[(][^()]*[)]', ' ', 'g')")} AS outside, {CLEANED.format("regexp_extract(lower(trim(name)), '[(]([^()]*)[)]', 1)")} AS inside FROM n),
t AS (SELECT p_partkey, form, unnest([whole, {UNVERSIONED.format('whole')}, CASE WHEN inside <> '' THEN outside END, CASE WHEN inside <> '' THEN {UNVERSIONED.format('outside')} END, inside, {UNVERSIONED.format('inside')}]) AS try, unnest([0, 1, 2, 3, 10, 11]) AS step,
  outside = '' OR len(list_filter(string_split(outside, ' '), lambda w: list_contains([{', '.join(repr(a) for a in ALIASES)}], w))) > 0 AS near FROM b),
f AS (SELECT p_partkey, form, arg_min(canonical, step) AS canonical FROM t JOIN v ON try = alias WHERE step < 10 OR near GROUP BY 1, 2),
r AS (SELECT n.*, coalesce(canonical, whole) AS skill, canonical IS NOT NULL AS known, CASE WHEN length(name) > 60 OR len(list_filter(regexp_split_to_array(name, '\s+'), lambda w: w <> '')) > 8 THEN 'length_or_token_cap'
  WHEN regexp_matches(name, '[^\s@]+\s*@\s*[^\s@]+\.[^\s@]+') THEN 'email_shape' END AS reason FROM b n LEFT JOIN f USING (p_partkey, form))
SELECT p_partkey, form, name, skill, reason, CASE WHEN reason IS NULL AND skill <> '' THEN CASE WHEN known THEN skill ELSE 'h:' || substr(sha256('{SALT}' || skill), 1, 32) END END AS skill_key FROM r"""
)
def normalise_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill names through all stages of the normaliser, with keys and reasons of rejection."""
    p = table(spark, sf_dir, "part")
    forms = F.array("p_name", F.concat("p_name", F.lit(" 14")), F.concat(F.lit("py ("), "p_type", F.lit(")")), F.concat("p_type", F.lit(" (python 3.1)")), F.concat("p_name", F.lit("@mail.example")))
    names = p.select("p_partkey", F.posexplode(forms).alias("form", "name"))
    out = skills.resolved_keys(names, skills.dimension(spark, ALIASES), SALT)
    return out.select("p_partkey", "form", "name", "skill", "reason", "skill_key")


@query(
    r"""SELECT p_partkey, CASE WHEN length(n) > 60 THEN 'length_or_token_cap' WHEN regexp_matches(n, '[^\s@]+\s*@\s*[^\s@]+\.[^\s@]+') THEN 'email_shape'
  WHEN len(list_filter(regexp_extract_all(n, '[+()\-.\s\d]{7,}'), lambda r: length(regexp_replace(r, '\D', '', 'g')) >= 7)) > 0 THEN 'phone_shape' END AS reason
FROM (SELECT p_partkey, p_name || ['', '@mail.example', ' 555-010-9999', repeat('x', 60)][1 + p_partkey % 4] AS n FROM part)"""
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("", "@mail.example", " 555-010-9999", "x" * 60)))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.get(ends, (F.col("p_partkey") % 4).cast("int"))).alias("n"))
    return p.select("p_partkey", strings.reject_reason(F.col("n")).alias("reason"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requirements that quote 60 characters of a document and cite it or, if odd, the next one; chunks are documents."""
    d = documents(spark, sf_dir)
    chunks = d.select(F.lit(0).alias("resume_id"), F.col("doc_id").cast("string").alias("id"), "text")
    quote = F.substring("text", 21, 60)
    cited = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string")
    req = d.select(
        F.col("doc_id").alias("row_id"), F.lit(0).alias("resume_id"), F.when(F.col("doc_id") % 3 == 0, "partial").otherwise("met").alias("status"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(quote).alias("evidence"), F.array(cited, F.lit("nowhere")).alias("evidence_chunk_ids"), F.lit(0.9).alias("confidence"),
    )
    return req, chunks


@query(
    r"""WITH d AS (SELECT doc_id, substr(text, 21, 60) AS q, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS cited FROM documents),
n AS (SELECT d.doc_id, trim(regexp_replace(trim(lower(q)), '[\s]+', ' ', 'g')) AS needle, c.doc_id AS known, trim(regexp_replace(lower(c.text), '[\s]+', ' ', 'g')) AS hay FROM d LEFT JOIN documents c ON c.doc_id = d.cited)
SELECT doc_id AS row_id, known IS NOT NULL AS cited, coalesce(length(needle) >= 16 AND length(needle) <= length(hay) AND contains(hay, needle), false) AS exact FROM n"""
)
def quote_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that are exact spans of the cited chunk, joined by citation."""
    req, chunks = _evidence(spark, sf_dir)
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.substring("text", 21, 60).alias("q"))
    cited = req.select("row_id", F.explode("evidence_chunk_ids").alias("id")).where("id <> 'nowhere'").join(d, "row_id")
    both = cited.join(chunks.select("id", "text"), "id", "left")
    needle, hay = strings.collapse(F.lower(F.trim("q"))), strings.collapse(F.lower("text"))
    exact = (F.length(needle) >= 16) & (F.length(needle) <= F.length(hay)) & F.contains(hay, needle)
    return both.select("row_id", F.col("text").isNotNull().alias("cited"), F.coalesce(exact, F.lit(False)).alias("exact"))


@query()
def fuzzy_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after verification: quotes that no cited chunk bears out are gone."""
    req, chunks = _evidence(spark, sf_dir)
    out = matching.verified(req, chunks)
    return out.select("row_id", "status", (F.col("evidence") != "").alias("quoted"), "evidence_chunk_ids", "confidence")


#: The longest common subsequence of a and b, a bit for each letter of a; of all windows of b; and of sets of words.
LCS = """length({0}) - bit_count(list_reduce(list_prepend((1::BIGINT << length({0})) - 1, list_transform(string_split({1}, ''), lambda c: coalesce(list_sum(list_transform(range(length({0})), lambda i: CASE WHEN substr({0}, i + 1, 1) = c THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length({0})) - 1)))"""
RATIO = "CASE WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE 2.0 * (" + LCS + ") / (length({0}) + length({1})) END"


@query(
    f"""WITH p AS (SELECT DISTINCT p_name, p_type, lower(p_name) AS x, lower(p_type) AS y FROM part), o AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS b FROM p),
w AS (SELECT p_name, p_type, a, substr(b, greatest(0, e - length(a)) + 1, least(length(b), e) - greatest(0, e - length(a))) AS win FROM (SELECT *, unnest(range(1, length(a) + length(b))) AS e FROM o)),
r AS (SELECT p_name, p_type, max({RATIO.format('a', 'win')}) AS partial FROM w GROUP BY 1, 2),
s AS (SELECT *, list_sort(list_distinct(string_split(x, ' '))) AS u, list_sort(list_distinct(string_split(y, ' '))) AS v FROM p),
t AS (SELECT p_name, p_type, array_to_string(list_sort(list_filter(u, lambda i: list_contains(v, i))), ' ') AS both_, array_to_string(list_filter(u, lambda i: NOT list_contains(v, i)), ' ') AS only_x, array_to_string(list_filter(v, lambda i: NOT list_contains(u, i)), ' ') AS only_y FROM s),
k AS (SELECT *, trim(both_ || ' ' || only_x) AS l, trim(both_ || ' ' || only_y) AS m FROM t),
g AS (SELECT p_name, p_type, CASE WHEN both_ <> '' AND (only_x = '' OR only_y = '') THEN 1.0 ELSE greatest({RATIO.format('l', 'm')}, {RATIO.format('both_', 'l')}, {RATIO.format('both_', 'm')}) END AS token_set FROM k)
SELECT p_name, p_type, round(partial, 6) AS partial, round(token_set, 6) AS token_set FROM r JOIN g USING (p_name, p_type)"""
)
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy scores of distinct names against types."""
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", F.round(partial_ratio_column(F.lower("p_name"), F.lower("p_type")), 6).alias("partial"), F.round(token_set_ratio_column(F.lower("p_name"), F.lower("p_type")), 6).alias("token_set"))


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant' AND length(text) > 200) AS met, count(*) FILTER (role = 'user') AS partial FROM conversations GROUP BY 1)
SELECT conv_id, round((met + 0.5 * partial) / n, 6) AS completeness FROM c"""
)
def evidence_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("role") == "assistant", "met").when(F.col("role") == "user", "partial").otherwise("missing")
    one = F.struct(status.alias("status"), F.when(F.length("text") > 200, 0.9).otherwise(0.5).alias("confidence"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("r"))
    return g.select("conv_id", F.round(scoring.completeness(F.col("r")), 6).alias("completeness"))


@query(
    """SELECT conv_id, round(coalesce(sum(0.7 + (length(text) % 4) * 0.1) FILTER (role = 'assistant'), 0.0) / count(*), 6) AS motivation FROM conversations GROUP BY 1"""
)
def motivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified themes over all: an assistant's turns cite a chunk, others none."""
    ids = F.when(F.col("role") == "assistant", F.array(F.lit("cl_001"))).otherwise(F.array().cast("array<string>"))
    one = F.struct(F.col("turn"), (F.lit(0.7) + (F.length("text") % 4) * 0.1).alias("confidence"), ids.alias("evidence_chunk_ids"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return g.select("conv_id", F.round(scoring.motivation(F.col("t")), 6).alias("motivation"))


@query(
    r"""SELECT doc_id, regexp_matches(text, '\d(?:[ .()-]?\d){6,}') OR contains(lower(text), lower(split_part(text, ' ', 1))) AND split_part(text, ' ', 1) <> '' AS leaks FROM documents"""
)
def pii_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", redaction.leaks(F.col("text"), F.substring_index("text", " ", 1), F.lit(None).cast("string")).alias("leaks"))


@query(
    """SELECT p_partkey, CASE WHEN n BETWEEN 1900 AND 2100 THEN n WHEN n BETWEEN 0 AND 68 THEN 2000 + n WHEN n BETWEEN 69 AND 99 THEN 1900 + n END AS year, CASE WHEN n BETWEEN 0 AND 80 THEN n END AS years
FROM (SELECT p_partkey, TRY_CAST(trim(CASE p_partkey % 3 WHEN 0 THEN ' ' || p_partkey || ' ' WHEN 1 THEN CAST(p_size * 2 AS VARCHAR) ELSE p_name END) AS INT) AS n FROM part)"""
)
def coerced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, (F.col("p_size") * 2).cast("string")).otherwise(F.col("p_name"))
    return p.select("p_partkey", scoring.coerced_year(raw).alias("year"), scoring.coerced_years(raw).alias("years"))


@query(
    """SELECT page_id, CASE WHEN html[1:1] = '<' THEN 'text/plain' ELSE 'text/plain' END AS mime, CASE WHEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '' THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE CAST(to_json({'page': page_id}) AS VARCHAR) END AS text FROM pages"""
)
def job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job texts from JSON: the first known key that is not blank, else the document itself."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    doc = F.when(F.trim(title) != "", F.to_json(F.struct(F.lit("").alias("description"), title.alias("jd")))).otherwise(F.to_json(F.struct(F.col("page_id").alias("page"))))
    return p.select("page_id", files.detect_mime(F.col("html").cast("binary")).alias("mime"), files.job_text(doc).alias("text"))


@query(
    """WITH t AS (SELECT DISTINCT p_brand FROM part) SELECT p.p_partkey, list_sort(list_distinct([p_brand, split_part(p_type, ' ', 1), 'STANDARD'])) AS names FROM part p"""
)
def union_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of names as one, each name once."""
    p = table(spark, sf_dir, "part")
    both = skills.union_names(F.array("p_brand", F.element_at(F.split("p_type", " "), 1)), F.array(F.lit("STANDARD"), F.col("p_brand")))
    return p.select("p_partkey", F.array_sort(both).alias("names"))
