"""What the operators share: tables, shared storage and text primitives."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, in UTF-8; ``bytes.split`` splits at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local master gets a folder of its own; a cluster
    must name one, since executors do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_lexloom_shared", None)
    if own is None:
        own = spark._lexloom_shared = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``written`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_lexloom_path", None)
    if path:
        _remove(df.sparkSession, path)


def shared_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Put ``data`` in a file that every executor can open by ``SparkFiles.get``.

    The file lies in the shared folder, so executors that join later fetch it too.
    """
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{name}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()
    sc.addFile(path)
    atexit.register(_remove, spark, path)
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int | None = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that only so many texts are Python strings at a time.

    Workers live on from task to task, so freed memory is given back at the end.
    """
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def arrow_map(df: DataFrame, schema: str | T.StructType, fn, *columns: str, rows: int | None = 1024) -> DataFrame:
    """``fn(lists of the columns' values) -> dict of columns`` over slices of at most ``rows`` rows, or whole batches."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kind]
    types = arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            out = fn(*(batch.column(c).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.field(n).type) for n in names], schema=types)

    return df.select(*columns).mapInArrow(run, kind)


def arrow_keep(df: DataFrame, keep, *columns: str) -> DataFrame:
    """The rows whose values of ``columns``, by default the text, ``keep`` accepts; all columns kept."""
    columns = columns or ("text",)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([keep(*x) for x in zip(*(batch.column(c).to_pylist() for c in columns))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_schema(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def held_out(modulus: int) -> F.Column:
    """True for rows whose crc32(doc_id as text) leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def frequent(counts: DataFrame, most: int, count: str = "n") -> DataFrame:
    """At most ``most`` rows of the largest counts, equal counts together.

    A histogram of count classes (eighths of a doubling, a few hundred at
    most) gives the threshold, so nothing is sorted and the driver sees only
    the histogram, however many rows there are.
    """
    level = F.floor(F.log2(F.col(count)) * 8)
    classes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min(count).alias("least")).collect()
    least, total = None, 0
    for row in sorted(classes, key=lambda r: -r["level"]):
        total += row["rows"]
        if total > most:
            break
        least = row["least"]
    return counts.where(F.lit(False) if least is None else F.col(count) >= least)
