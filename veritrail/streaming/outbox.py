"""Draining an outbox of events into edge tables.

The outbox is read as a stream of files.  Each micro-batch is applied by keys: all edges of a key that the batch names are
replaced, so a batch that runs again, after a failure, changes nothing.  Edges are dealt by key into buckets, and a batch
rewrites the buckets of its own keys only, whatever the table's size.  Rows that cannot be read are set aside with a count
of attempts, which is carried on when they are tried again, and never stop the rows beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import budget_prefix
from ..operators.relational import latest

#: Attempts after which a row is a dead letter, rows and skills of a drain.
MOST_ATTEMPTS, BATCH_ROWS, SKILL_BUDGET = 200, 50, 200
BUCKETS = 64
EVENTS = "id long, aggregate string, aggregate_id string, event_type string, payload string, created_at timestamp"
PAYLOAD = "skills array<struct<name:string,years:int,last_used_year:int,evidence_chunk_ids:array<string>>>, job_id string"
EDGES = "resume_id string, skill string, years int, last_used_year int, evidence_chunk_id string"
KNOWN = ("job.parsed", "resume.parsed", "resume.withdrawn")


def eligible(outbox: DataFrame, cap: int = MOST_ATTEMPTS) -> DataFrame:
    return outbox.where(F.col("delivered_at").isNull() & (F.col("delivery_attempts") < cap))


def dead_letters(outbox: DataFrame, cap: int = MOST_ATTEMPTS) -> DataFrame:
    """Rows that are tried no more; they stay in the outbox."""
    return outbox.where(F.col("delivered_at").isNull() & (F.col("delivery_attempts") >= cap))


def cost(payload):
    """Skills of an event; 0 for a payload that cannot be read."""
    return F.coalesce(F.greatest(F.lit(0), F.size(F.from_json(payload, PAYLOAD)["skills"])), F.lit(0))


def next_batch(outbox: DataFrame, rows: int = BATCH_ROWS, budget: int = SKILL_BUDGET) -> DataFrame:
    """The first rows by id, as long as their skills stay within the budget; one at least."""
    first = eligible(outbox).orderBy("id").limit(rows).withColumn("cost", cost(F.col("payload")))
    return budget_prefix(first, ["id"], "cost", budget)


def claimed(outbox: DataFrame, drainers: int, rows: int = BATCH_ROWS) -> DataFrame:
    """The next rows of several drainers at once (adds drainer, from 0): the first by id are dealt in turn, so no two
    drainers have a row in common and none waits for another."""
    from pyspark.sql import Window

    first = eligible(outbox).orderBy("id").limit(rows * drainers)  # bounded: one window over it
    return first.withColumn("drainer", F.pmod(F.row_number().over(Window.orderBy("id")) - 1, F.lit(drainers)).cast("int"))


def readable(payload: Column) -> Column:
    """Whether a payload is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT<"), F.lit(False))


def routed(batch: DataFrame) -> dict[str, DataFrame]:
    """Rows by kind: each known type, poison (payload is no object), and unknown, which counts as delivered."""
    good, known = readable(F.col("payload")), F.col("event_type").isin(*KNOWN)
    out = {t: batch.where(good & (F.col("event_type") == t)) for t in KNOWN}
    return out | {"poison": batch.where(~good & known), "unknown": batch.where(~known)}


def failed(batch: DataFrame, poison: DataFrame) -> DataFrame:
    """Rows of the batch that failed, one attempt further on; the error names its kind only."""
    return batch.join(poison.select("id"), "id", "left_semi").select("id", (F.col("delivery_attempts") + 1).alias("delivery_attempts"), F.lit("PayloadError").alias("last_error"))


def stepped(outbox: DataFrame, as_of: Column, rows: int = BATCH_ROWS, budget: int = SKILL_BUDGET) -> DataFrame:
    """The outbox after one drain: rows of the batch are delivered at the time given, unknown types among them; rows that
    cannot be read have one attempt more and the kind of their error, and stay undelivered; all others are as they were."""
    taken = next_batch(outbox, rows, budget).select("id", (F.col("event_type").isin(*KNOWN) & ~readable(F.col("payload"))).alias("__bad"))
    both = outbox.join(F.broadcast(taken), "id", "left")  # a batch's rows at most
    good, bad = F.coalesce(~F.col("__bad"), F.lit(False)), F.coalesce(F.col("__bad"), F.lit(False))
    return both.withColumns({
        "delivered_at": F.when(good, as_of).otherwise(F.col("delivered_at")),
        "delivery_attempts": F.when(bad, F.col("delivery_attempts") + 1).otherwise(F.col("delivery_attempts")),
        "last_error": F.when(bad, "PayloadError").when(good, F.lit(None).cast("string")).otherwise(F.col("last_error")),
    }).select(*outbox.columns)


def resume_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new skill edges, résumés whose edges are replaced): the last event of each résumé counts; withdrawals bring none."""
    rows = batch.where(F.col("event_type").isin("resume.parsed", "resume.withdrawn"))
    last = latest(rows, ["aggregate_id"], [F.desc("id")])
    parsed = last.where("event_type = 'resume.parsed'").select(F.col("aggregate_id").alias("resume_id"), F.from_json("payload", PAYLOAD)["skills"].alias("skills"))
    skills = parsed.select("resume_id", F.posexplode("skills").alias("at", "s")).where(F.trim("s.name") != "")
    one = F.min(F.struct("at", "s.years", "s.last_used_year", F.try_element_at("s.evidence_chunk_ids", F.lit(1)).alias("evidence_chunk_id"))).alias("x")
    edges = skills.groupBy("resume_id", F.lower(F.trim("s.name")).alias("skill")).agg(one).select("resume_id", "skill", "x.years", "x.last_used_year", "x.evidence_chunk_id")
    return edges, last.select(F.col("aggregate_id").alias("resume_id"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("resume_id"), F.lit(BUCKETS)).cast("int")


def _done(spark: SparkSession, base: str, name: str) -> list[int]:
    """Numbers of the batches whose table of that name is complete."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().rpartition("=")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _read(spark: SparkSession, base: str, before: int | None, buckets: DataFrame | None = None) -> DataFrame:
    """The edges after the last complete batch, or the last before a number; of the buckets given only."""
    done = [n for n in _done(spark, base, "touched") if before is None or n < before]
    if not done:
        return spark.createDataFrame([], EDGES)
    touched = spark.read.schema("bucket int").parquet(*[f"{base}/touched/batch={n:09d}" for n in done])
    touched = touched.withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int"))
    newest = touched.groupBy("bucket").agg(F.max("batch").alias("batch"))
    if buckets is not None:
        newest = newest.join(buckets, "bucket", "left_semi")
    edges = spark.read.schema(f"{EDGES}, batch int, bucket int").option("basePath", f"{base}/edges").parquet(*[f"{base}/edges/batch={n:09d}" for n in done])
    return edges.join(F.broadcast(newest), ["batch", "bucket"], "left_semi").drop("batch", "bucket")  # BUCKETS rows at most


def apply_batch(base: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch.  A batch reads the newest version of the buckets that its keys lie in, writes its own
    version of them, and then which they are; if it runs again it writes the same again.  Its number counts versions."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = routed(batch)
        edges, touched = resume_changes(good["resume.parsed"].unionByName(good["resume.withdrawn"]))
        touched = touched.persist()
        buckets = touched.select(_bucket().alias("bucket")).distinct()
        kept = _read(spark, base, number, buckets).join(touched, "resume_id", "left_anti")
        new = kept.unionByName(edges).withColumn("bucket", _bucket())
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/edges/batch={number:09d}")
        attempts = F.coalesce("delivery_attempts", F.lit(0)) if "delivery_attempts" in batch.columns else F.lit(0)
        bad = good["poison"].withColumn("delivery_attempts", attempts + 1).withColumn("last_error", F.lit("PayloadError"))
        bad.write.mode("overwrite").parquet(f"{base}/poison/batch={number:09d}")
        buckets.coalesce(1).write.mode("overwrite").parquet(f"{base}/touched/batch={number:09d}")  # BUCKETS rows at most
        touched.unpersist()

    return run


def read_edges(spark: SparkSession, base: str) -> DataFrame:
    """The edges after all complete batches."""
    return _read(spark, base, None)


def set_aside(spark: SparkSession, base: str) -> DataFrame:
    """Rows that could not be read and have not been delivered since, each with its attempts so far."""
    done = _done(spark, base, "poison")
    empty = spark.createDataFrame([], f"{EVENTS}, delivery_attempts int, last_error string")
    if not done:
        return empty
    rows = spark.read.schema(empty.schema).parquet(*[f"{base}/poison/batch={n:09d}" for n in done])
    most = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "delivery_attempts").alias("x")).select("id", "x.*")
    return most.select(*rows.columns)


def retry(spark: SparkSession, base: str, repaired: DataFrame | None = None, cap: int = MOST_ATTEMPTS) -> None:
    """Tries the rows set aside once more, below the cap of attempts; repaired (id, payload) replaces payloads."""
    rows = set_aside(spark, base).where(F.col("delivery_attempts") < cap)
    if repaired is not None:
        rows = rows.join(repaired.select("id", F.col("payload").alias("__new")), "id", "left").withColumn("payload", F.coalesce("__new", "payload")).drop("__new")
    number = max(_done(spark, base, "touched"), default=-1) + 1
    apply_batch(base)(rows, number)


def drain(spark: SparkSession, inbox: str, base: str, files_per_batch: int = 1) -> None:
    """Applies all events that lie in the inbox, as JSON lines, and stops; the next call goes on from there."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).json(inbox)
    query = events.writeStream.foreachBatch(apply_batch(base)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def replay(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    """Events that reinstate résumés: the last delivered payload of each, byte by byte."""
    delivered = outbox.where("delivered_at is not null and event_type = 'resume.parsed'").join(ids, outbox["aggregate_id"] == ids["resume_id"], "left_semi")
    return latest(delivered, ["aggregate_id"], [F.desc("delivered_at"), F.desc("id")]).select("aggregate", "aggregate_id", "event_type", "payload")


def single_flight(requests: DataFrame, running: DataFrame) -> DataFrame:
    """Adds outcome: already_running if a run of the same key (kind, entity) is under way, or an earlier request of the batch
    has started one; started otherwise.  requests: at, kind, entity; running: kind, entity."""
    from pyspark.sql import Window

    held = running.select("kind", "entity").distinct().withColumn("__held", F.lit(True))
    both = requests.join(held, ["kind", "entity"], "left").withColumn("__place", F.row_number().over(Window.partitionBy("kind", "entity").orderBy("at")))
    busy = F.coalesce("__held", F.lit(False)) | (F.col("__place") > 1)
    return both.withColumn("outcome", F.when(busy, "already_running").otherwise("started")).drop("__held", "__place")
