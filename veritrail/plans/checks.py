"""Gates over stored lists, texts that give someone away, NULs in nested documents, and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, gates, ranking
from ..weights import read
from .people import PEOPLE_SQL, people
from .registry import query, table


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT source, doc_id, rank FROM r JOIN labels USING (doc_id) WHERE toxic = 1 AND rank <= 20""")
def surfaced_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows among the first 20 of each list that must not stand there."""
    d = ranking.ranked(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")])
    return gates.must_not_surface(d, table(spark, sf_dir, "labels").where("toxic = 1"), "source", "doc_id", 20)


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations), g AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN substr(text, 5, 30) ELSE 'said by nobody at all' END AS anchor FROM conversations WHERE turn = 0),
f AS (SELECT g.conv_id, bool_or(contains(t, trim(regexp_replace(lower(anchor), '\s+', ' ', 'g')))) AS hit FROM g JOIN c USING (conv_id) GROUP BY ALL)
SELECT count(*) FILTER (hit) AS found, count(*) AS wanted, round(count(*) FILTER (hit) / count(*), 9) AS rate FROM f""")
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that some quote of their résumé holds; conversations play résumés."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("resume_id"), "turn", F.col("text").alias("evidence"))
    gold = c.where("turn = 0").select("resume_id", F.when(F.col("resume_id") % 3 != 0, F.substring("evidence", 5, 30)).otherwise("said by nobody at all").alias("anchor"))
    return gates.recalled_anchors(gold, c).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, 1 AS nth FROM people UNION ALL SELECT k, 3 FROM people WHERE k % 2 = 0 UNION ALL SELECT k, 4 FROM people""")
def exposed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that show a candidate's name, address, or the digits of their number."""
    p = people(spark, sf_dir)
    number = F.concat(F.lit("ring 1 (416) 555-"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), F.when(F.col("k") % 2 == 0, "").otherwise("x"))
    odd = F.when(F.col("k") % 2 == 0, number).otherwise("ring 1 (416) 555")
    each = F.array(F.col("doc.summary"), F.lit("clean"), odd, F.concat(F.lit("to "), F.upper("email")))
    return gates.exposed(p.select("resume_id", F.posexplode(each).alias("p", "text")).select("resume_id", (F.col("p") + 1).alias("at"), "text"), p.select("resume_id", "name", "email", "phone")).select("resume_id", F.col("at").alias("nth"))


@query(f"""WITH {PEOPLE_SQL} SELECT k AS resume_id, name, 'python,' || name AS skills, true AS same FROM people""")
def nul_free_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents whose strings hold NULs, as a store takes them."""
    p = people(spark, sf_dir)
    nul = lambda c: F.concat(F.lit("\x00"), c, F.lit("\x00"))
    bad = F.col("doc").withField("candidate", F.col("doc.candidate").withField("name", nul(F.col("name")))).withField("skills", F.transform("doc.skills", lambda s: s.withField("name", nul(s["name"]))))
    d = p.select("resume_id", "doc", documents.without_nuls(bad, p.schema["doc"].dataType).alias("d"))
    return d.select("resume_id", F.col("d.candidate.name").alias("name"), F.array_join(F.transform("d.skills", lambda s: s["name"]), ",").alias("skills"), (F.to_json("d") == F.to_json("doc")).alias("same"))


@query("""SELECT * FROM (VALUES ('as they are', true), ('skill and vector', true), ('sum', false), ('range', false), ('relief', false), ('name', false)) AS v(settings, valid)""")
def weight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which settings make weights."""
    given = {
        "as they are": {}, "skill and vector": {"MATCH_SKILL": "0.45", "match_vector": "0.05"}, "sum": {"MATCH_EVIDENCE": "0.5"}, "range": {"MATCH_RECENCY_OLD": "1.5"},
        "relief": {"MATCH_IMPLIED_EXPERIENCE_RELIEF": "0.2"}, "name": {"MATCH_LUCK": "1"},
    }

    def valid(settings: dict[str, str]) -> bool:
        try:
            return bool(read(settings))
        except ValueError:
            return False

    return spark.createDataFrame([(name, valid(s)) for name, s in given.items()], "settings string, valid boolean")
