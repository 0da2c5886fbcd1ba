"""Manifests of uploads, names of files, and pairing of résumés with cover letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import basename_lower

#: Words for true, and the cap of a manifest.
TRUE, MOST_BYTES, MOST_STEM = ("true", "1", "yes", "y", "t"), 1 << 20, 256
PAIRS = "applicants array<struct<resume_file:string,cover_letter_file:string,cover_letter_flag:string>>"
JOB_COLUMNS = ("filename", "title", "department", "location", "employment_type", "seniority", "min_years", "retention_days", "blind_review")
#: Suffixes that tell a cover letter's file and a résumé's, the rest being what the two share.
COVER, RESUME = r"^(.*\S)[\s_-]+(?:cover[\s_-]*letter|coverletter|cover[\s_-]*note|cover)$", r"^(.*\S)[\s_-]+(?:resume|cv)$"


def stem(name: Column) -> Column:
    base = basename_lower(name)
    return F.when(base.rlike(r"^.+\..*$") & ~base.rlike(r"^\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def base_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s_-]+", " "))


def role(name: Column) -> Column:
    """cover or resume, by the name's suffix; overlong names are not searched."""
    s = stem(name)
    return F.when((F.length(s) <= MOST_STEM) & s.rlike(COVER), "cover").otherwise("resume")


def pair_base(name: Column) -> Column:
    """What the names of a résumé and its cover letter share."""
    s = stem(name)
    cover, resume = F.regexp_extract(s, COVER, 1), F.regexp_extract(s, RESUME, 1)
    short = F.length(s) <= MOST_STEM
    return base_key(F.when(short & (cover != ""), cover).when(short & (resume != ""), resume).otherwise(s))


def title_from_filename(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"^.*/", "")
    bare = F.when(plain.rlike(r"^.+\..*$") & ~plain.rlike(r"^\.[^.]*$"), F.regexp_replace(plain, r"\.[^.]*$", "")).otherwise(plain)
    clean = base_key(bare)
    return F.when(F.length(clean) < 2, "Untitled job").otherwise(F.substring(clean, 1, 200))


def pairing_rows(manifests: DataFrame) -> DataFrame:
    """resume_key and cover_key of every manifest (batch, content as text); a falsy flag vetoes the cover, the last of
    equal résumés counts.  error is set, and the keys null, for manifests that are too large or not of the right shape."""
    parsed = manifests.withColumn("doc", F.from_json("content", PAIRS))
    shape = F.get_json_object("content", "$.applicants")
    error = F.when(F.octet_length("content") > MOST_BYTES, "too large").when(shape.isNull() | ~shape.startswith("["), "no applicants")
    rows = parsed.select("batch", error.alias("error"), F.posexplode_outer("doc.applicants").alias("at", "a"))
    flag = F.col("a.cover_letter_flag").isNull() | F.lower(F.trim("a.cover_letter_flag")).isin(*TRUE)
    cover = F.when(flag & (F.trim("a.cover_letter_file") != ""), basename_lower(F.col("a.cover_letter_file")))
    good = rows.where("error is null").where(F.trim("a.resume_file") != "").select("batch", "at", basename_lower(F.col("a.resume_file")).alias("resume_key"), cover.alias("cover_key"), F.lit(None).cast("string").alias("error"))
    last = Window.partitionBy("batch", "resume_key").orderBy(F.desc("at"))
    good = good.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "at")
    bad = rows.where("error is not null").select("batch", F.lit(None).cast("string").alias("resume_key"), F.lit(None).cast("string").alias("cover_key"), "error").distinct()
    return good.unionByName(bad)


def paired(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """batch, resume, cover, note, reason: explicit pairs first, then the k-th résumé of a base with its k-th cover.

    files: batch, at, filename; pairs: batch, resume_key, cover_key.  A résumé of the manifest that is absent is a
    rejected row with a reason, an absent cover a note; covers left over count as résumés with a note.
    """
    named = files.withColumn("key", basename_lower(F.col("filename")))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("batch", "key").orderBy(F.desc("at"))))
    by_name = named.where("n = 1").select("batch", "key", "filename", "at")
    res = by_name.select("batch", F.col("key").alias("resume_key"), F.col("filename").alias("resume"), "at")
    cov = by_name.select("batch", F.col("key").alias("cover_key"), F.col("filename").alias("cover"))
    explicit = pairs.join(res, ["batch", "resume_key"], "left").join(cov, ["batch", "cover_key"], "left")
    absent = F.col("resume").isNull()
    explicit = explicit.select(
        "batch", "resume_key", "cover_key", "at", F.coalesce("resume", "resume_key").alias("resume"), F.when(~absent, F.col("cover")).alias("cover"),
        F.when(~absent & F.col("cover_key").isNotNull() & F.col("cover").isNull(), "cover letter of the manifest is missing").alias("note"), F.when(absent, "resume of the manifest is missing").alias("reason"),
    )
    used = explicit.where("reason is null").select("batch", F.col("resume_key").alias("key")).unionByName(explicit.where("reason is null and cover is not null").select("batch", F.col("cover_key").alias("key")))
    rest = named.join(used, ["batch", "key"], "left_anti").withColumn("role", role(F.col("filename"))).withColumn("base", pair_base(F.col("filename")))
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("batch", "role", "base").orderBy("at")))
    resumes = rest.where("role = 'resume'").select("batch", "base", "k", "at", F.col("filename").alias("resume"))
    covers = rest.where("role = 'cover'").select("batch", "base", "k", F.col("at").alias("cover_at"), F.col("filename").alias("cover"))
    both = resumes.join(covers, ["batch", "base", "k"], "full")
    by_rule = both.select("batch", F.coalesce("at", "cover_at").alias("at"), F.coalesce("resume", "cover").alias("resume"), F.when(F.col("resume").isNotNull(), F.col("cover")).alias("cover"), F.when(F.col("resume").isNull(), "cover letter without a resume").alias("note"), F.lit(None).cast("string").alias("reason"))
    return explicit.drop("resume_key", "cover_key").unionByName(by_rule)


def read_job_manifest(spark: SparkSession, path: str, employment: tuple[str, ...], seniority: tuple[str, ...]) -> DataFrame:
    """Rows of a CSV manifest, headers matched whatever their case and blanks; error names the first bad cell of a row."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    headers = {h.strip().lower(): h for h in raw.columns}
    if "filename" not in headers:
        raise ValueError("the manifest has no filename column")
    cell = lambda k: F.when(F.trim(F.col(f"`{headers[k]}`")) != "", F.trim(F.col(f"`{headers[k]}`"))) if k in headers else F.lit(None).cast("string")
    rows = raw.select(*[cell(k).alias(k) for k in JOB_COLUMNS]).where("filename is not null")
    bad_int = lambda k: F.col(k).isNotNull() & F.col(k).try_cast("int").isNull()
    error = F.when(~F.col("employment_type").isin(*employment), "employment_type").when(~F.col("seniority").isin(*seniority), "seniority").when(bad_int("min_years"), "min_years").when(bad_int("retention_days"), "retention_days")
    return rows.select(
        basename_lower(F.col("filename")).alias("key"), "title", "department", "location", "employment_type", "seniority", F.col("min_years").try_cast("int").alias("min_years"),
        F.col("retention_days").try_cast("int").alias("retention_days"), F.when(F.col("blind_review").isNotNull(), F.lower("blind_review").isin(*TRUE)).alias("blind_review"), error.alias("error"),
    )
