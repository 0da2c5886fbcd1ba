"""Table readers with explicit schemas, and evaluation fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import TABLES


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir of the session, else below the warehouse, that goes when the application ends.

    The driver and all executors must share it: a warehouse on the driver's own disk serves local mode only.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")) and (base.startswith(("file:", "/")) or ":" not in base):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: what many joins read is worked out once, and survives lost
    executors."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def nodes(df: DataFrame, **equal) -> DataFrame:
    """Nodes of a label, which is a table, whose properties have the values given; pushed into the scan."""
    for name, value in equal.items():
        df = df.where(df[name] == value)
    return df


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the catalogue; its schema is declared, never inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")


def create_table(spark: SparkSession, name: str, partition: str | None = None) -> None:
    """Creates the table if it does not exist; running it twice, or from two sessions, does no harm."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" PARTITIONED BY ({partition})" if partition else ""))


def read_fixtures(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, all fields as declared; what does not parse fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def put_blob(spark: SparkSession, base: str, key: str, content: bytes) -> None:
    """Writes one blob below a folder, readable by its owner only; folders on the way are the owner's alone."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{_safe(key)}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    mode = lambda bits: jvm.org.apache.hadoop.fs.permission.FsPermission(bits)
    files.mkdirs(path.getParent(), mode("700"))
    out = files.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    files.setPermission(path, mode("600"))


def delete_blob(spark: SparkSession, base: str, key: str) -> bool:
    """Deletes one blob; whether there was one.  A missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{_safe(key)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def _safe(key: str) -> str:
    if not key or key.startswith("/") or ".." in key.split("/") or "\x00" in key:
        raise ValueError("a blob's key is a path below its folder")
    return key


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """key (path below the root), content and length of every file below a folder; Spark's reader leaves out empty files."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.regexp_replace("path", r"^.*?" + path.rstrip("/").split(":")[-1].replace(".", r"\.") + "/", "")
    return files.select(key.alias("key"), "content", "length")
