"""Where rows lie: spreading few files, keeping a document together, writing what is read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions than there are cores; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_parts(docs: DataFrame, text_bytes: int = 1 << 22) -> int:
    """How many tasks share the texts, by a pass over their lengths."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // text_bytes))


def by_document(docs: DataFrame, *columns: str, text_bytes: int = 1 << 22, parts: int | None = None) -> DataFrame:
    """``docs`` dealt by ``doc_id``: what is then counted by document and word needs no further exchange.

    A text is shuffled once, which is less than the words it is exploded into.
    A task holds the counts of all its texts, about a hundred times their
    bytes, so a pass over text lengths sets how many tasks share them, unless ``parts`` does.
    """
    return docs.select("doc_id", *columns).repartition(parts or text_parts(docs, text_bytes), "doc_id")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local master gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_lexloom_scratch", None)
    if own is None:
        own = spark._lexloom_scratch = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return own


def removed(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


#: Removes a write's shuffle files when it ends, not when the driver's collector comes to them.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, schema: StructType | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: computed once, and a lost executor costs a re-read.

    With a ``schema`` it is read as that, which may name other types of the same form.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANS, "false")
    spark.conf.set(_CLEANS, "true")  # nothing reads these shuffles again: the rows are
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANS, before)
    atexit.register(removed, spark, path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._lexloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_lexloom_path", None)
    if path:
        removed(df.sparkSession, path)
