"""Reading corpora from files: metadata, texts, stop lists, word counts, archives."""

from __future__ import annotations

import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A header-driven CSV, all strings; empty rows go."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.where(" OR ".join(f"`{c}` IS NOT NULL" for c in rows.columns)) if rows.columns else rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, text)`` of every file below ``path``, bytes that aren't UTF-8 left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(F.substring_index("path", "/", -1).alias("filename"), text.alias("text"))


def corpus(meta: DataFrame, texts: DataFrame) -> DataFrame:
    """Metadata with texts; a document without its file stays, with an empty text, so it counts in N."""
    return meta.join(texts, "filename", "left").withColumn("text", F.coalesce("text", F.lit("")))


def stop_words(spark: SparkSession, language: str | None = None, path: str | None = None, more: str = "") -> tuple[str, ...]:
    """A language's list, a file of one word a line and further words, trimmed; blanks go."""
    found: list[str] = []
    if language:
        from pyspark.ml.feature import StopWordsRemover

        found += StopWordsRemover.loadDefaultStopWords(language)
    if path:
        found += [r[0] for r in spark.read.text(path).select(F.trim("value")).collect()]
    found += more.split("\n")
    return tuple(dict.fromkeys(w.strip() for w in found if w.strip()))


def word_counts(spark: SparkSession, citations: str, counts: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and ``(doc_id, word, weight)`` of an external corpus that has counts instead of texts.

    A file of counts is named after its document and has WORDCOUNTS and WEIGHT.
    """
    cited = metadata(spark, citations)
    meta = cited.select(F.col("id").alias("doc_id"), "title", F.substring("pubdate", 1, 4).alias("year"), F.lit("external").alias("label"))
    rows = spark.read.csv(counts, header=True, recursiveFileLookup=True).select("*", F.input_file_name().alias("file"))
    doc = F.regexp_replace(F.substring_index("file", "/", -1), r"^wordcounts_|\.[^.]*$", "")
    return meta, rows.select(doc.alias("doc_id"), F.col("WORDCOUNTS").alias("word"), F.col("WEIGHT").cast("bigint").alias("weight"))


def unpack(archive: str, into: str) -> list[str]:
    """Unpack a data set; names that would leave ``into`` are refused by the library."""
    with zipfile.ZipFile(archive) as z:
        z.extractall(into)
        return z.namelist()


def archive_entries(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """``(archive, entry, content)`` of the files in all zip archives at ``path`` whose names match ``pattern``.

    Archives are opened by the tasks that read them, an entry at a time;
    nothing is unpacked to a disk.  Entries that can't be read have null content;
    what is no archive has no entries.
    """
    import io
    import re
    import zlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    wanted = re.compile(pattern)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not info.is_dir() and wanted.search(info.filename):
                        try:
                            data = archive.read(info)
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error):  # damaged, locked, or packed in a way unknown here
                            data = None
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info.filename]), pa.array([data], pa.binary())], names=["archive", "entry", "content"])

    return files.mapInArrow(run, "archive string, entry string, content binary")


def csv_entries(entries: DataFrame) -> DataFrame:
    """``(archive, entry, line, values)`` of header-driven CSV entries: a map by column name for each record."""
    import csv as reader
    import io

    def run(batches):
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for archive, entry, content in zip(*(batch.column(c).to_pylist() for c in ("archive", "entry", "content"))):
                rows = list(reader.DictReader(io.StringIO((content or b"").decode("utf-8", "replace").removeprefix("\ufeff"))))  # of one document or list
                maps = [[(k, v) for k, v in r.items() if k is not None and isinstance(v, str)] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), pa.array([entry] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(maps, kind)], names=["archive", "entry", "line", "values"])

    return entries.mapInArrow(run, "archive string, entry string, line int, values map<string,string>")


def data_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and ``(doc_id, word, weight)`` of all archived data sets at ``path``, as ``word_counts`` gives them for files.

    Each holds a list of citations and a file of counts for each document; a document in several has the counts of one.
    """
    rows = csv_entries(archive_entries(spark, path, r"(?i)\.csv$"))
    value = lambda c: F.col("values")[c]
    cited = rows.where("entry rlike '(?i)(^|/)citations\\.csv$'")
    meta = cited.select(value("id").alias("doc_id"), value("title").alias("title"), F.substring(value("pubdate"), 1, 4).alias("year"), F.lit("external").alias("label")).dropDuplicates(["doc_id"])
    doc = F.regexp_replace(F.substring_index("entry", "/", -1), r"^wordcounts_|\.[^.]*$", "")
    counts = rows.where("entry rlike '(^|/)wordcounts'").select(doc.alias("doc_id"), "archive", value("WORDCOUNTS").alias("word"), value("WEIGHT").try_cast("bigint").alias("weight"))
    first = counts.groupBy("doc_id").agg(F.min("archive").alias("archive"))
    return meta, counts.join(first, ["doc_id", "archive"]).select("doc_id", "word", "weight")


def extract(spark: SparkSession, path: str, hooks: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``(path, text)`` of files by extension: text, pages, and others by ``hooks``; unknown ones give null.

    A hook turns a file's bytes into text, for formats that need a library.
    """
    from lexloom.operators.texts import strip_html

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("ending", F.lower(F.substring_index("path", ".", -1)))
    plain = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.col("ending") == "txt", plain).when(F.col("ending").isin("html", "htm"), strip_html(plain))
    known = dict(hooks or {})
    rows = files.where(~F.col("ending").isin(*known)).select("path", text.alias("text")) if known else files.select("path", text.alias("text"))
    if not known:
        return rows

    def run(batches):  # whole batches of files of the hooks' endings only
        for b in batches:
            out = [known[e](bytes(c)) for e, c in zip(b.column("ending").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return rows.unionByName(files.where(F.col("ending").isin(*known)).select("path", "ending", "content").mapInArrow(run, "path string, text string"))


def imported_by_date(files: DataFrame, pattern: str) -> DataFrame:
    """``(day, number, path, issue)`` of ``(path, created)``: files of each day of creation numbered by name, with the issue found in the name.

    Files without a date are of the day of null.
    """
    from pyspark.sql import Window

    rows = files.select(F.to_date("created").alias("day"), "path")
    number = F.row_number().over(Window.partitionBy("day").orderBy("path"))
    return rows.select("day", number.alias("number"), "path", F.regexp_extract(F.substring_index("path", "/", -1), pattern, 1).alias("issue"))


def imported_issues(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(folder, number, path, issue)``: files of each folder numbered by name, with the issue found in the name."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    number = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    return files.withColumn("folder", folder).select("folder", number.alias("number"), "path", F.regexp_extract(F.substring_index("path", "/", -1), pattern, 1).alias("issue"))
