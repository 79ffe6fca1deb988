"""Files of topic models: states, shares, keys and feature weights, written and read as text.

Formats, a record a line, comments behind ``#``:

    state       doc source position type-index word topic     by blanks, gzip
    shares      number name topic share topic share ...       by tabs, largest share first
    keys        topic prior word word ...                     by tabs, words by blanks
    weights     FEATURES FOR CLASS topicN, then a line `` feature weight`` each

Readers are scans of text that Spark splits, from any store it reads; lines that
don't fit a format are left out, as are comments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.gibbs import Model

_CLASS = "FEATURES FOR CLASS topic"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))


def _write(lines: DataFrame, path: str, **options) -> None:
    lines.write.mode("overwrite").options(**options).text(path)


def write_state(model: Model, path: str) -> None:
    """Every token with its topic; the priors in comments of a file of their own."""
    spark = model.rows.sparkSession
    numbers = model.words.withColumnRenamed("w", "number")
    rows = model.state().join(numbers, "term")
    _write(rows.select(F.concat_ws(" ", "doc_id", F.lit("NA"), "position", "number", "term", "topic").alias("value")), path, compression="gzip")
    priors = ["#doc source pos typeindex type topic", "#alpha : " + " ".join(map(repr, map(float, model.alpha))), f"#beta : {float(model.beta)!r}"]
    spark.createDataFrame([("\n".join(priors),)], "value string").coalesce(1).write.mode("append").option("compression", "gzip").text(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, position, term, topic)``."""
    parts = _lines(spark, path).select(F.split("value", " ").alias("p")).where(F.size("p") == 6)
    return parts.select(F.col("p")[0].try_cast("bigint").alias("doc_id"), F.col("p")[2].try_cast("int").alias("position"), F.col("p")[4].alias("term"), F.col("p")[5].try_cast("int").alias("topic")).where("topic IS NOT NULL")


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """``(name, topic, prior)`` of a state's comments: ``alpha`` by topic, ``beta`` without one."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^#(alpha|beta) : (.*)$", 1).alias("name"), F.regexp_extract("value", r"^#(alpha|beta) : (.*)$", 2).alias("v")).where("name <> ''")
    rows = lines.select("name", F.posexplode(F.split(F.trim("v"), " +")).alias("topic", "v"))
    return rows.select("name", F.when(F.col("name") == "alpha", F.col("topic")).alias("topic"), F.col("v").try_cast("double").alias("prior"))


def write_doc_topics(shares: DataFrame, path: str) -> None:
    """Of ``(doc_id, topic, prop)``, a line for each document."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("prop")).alias("below"), "topic")))  # a topic each
    told = F.array_join(F.transform("p", lambda x: F.concat_ws("\t", x["topic"], -x["below"])), "\t")
    _write(shares.groupBy("doc_id").agg(pairs.alias("p")).select(F.concat_ws("\t", "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), told).alias("value")), path)


def read_doc_topics(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, name, topic, prop)``; the pairs may be in any order and not all there."""
    parts = _lines(spark, path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 3)
    at = F.transform(F.sequence(F.lit(2), F.size("p") - 2, F.lit(2)), lambda i: F.struct(F.get("p", i).alias("topic"), F.get("p", i + 1).alias("prop")))
    rows = parts.select(F.col("p")[0].try_cast("bigint").alias("doc_id"), F.col("p")[1].alias("name"), F.explode(at).alias("x"))
    return rows.select("doc_id", "name", F.col("x.topic").try_cast("int").alias("topic"), F.col("x.prop").try_cast("double").alias("prop"))


def write_keys(words: DataFrame, priors: DataFrame, path: str) -> None:
    """Of ``(topic, rank, term)`` and ``(topic, prior)``, a line for each topic."""
    tops = words.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("terms"))  # a few words each
    _write(tops.join(priors.select("topic", "prior"), "topic").select(F.concat_ws("\t", "topic", "prior", "terms").alias("value")), path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, prior, rank, term)``."""
    parts = _lines(spark, path).select(F.split("value", "\t").alias("p")).where(F.size("p") == 3)
    rows = parts.select(F.col("p")[0].try_cast("int").alias("topic"), F.col("p")[1].try_cast("double").alias("prior"), F.posexplode(F.split(F.trim(F.col("p")[2]), " +")).alias("rank", "term"))
    return rows.select("topic", "prior", (F.col("rank") + 1).alias("rank"), "term")


def write_weights(weights: DataFrame, path: str) -> None:
    """Of ``(topic, feature, weight)``, a block of lines for each topic."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature", "weight"))), lambda x: F.concat(F.lit(" "), x["feature"], F.lit(" "), x["weight"].cast("string"))), "\n")  # a feature each
    _write(weights.groupBy("topic").agg(lines.alias("l")).select(F.concat(F.lit(_CLASS), "topic", F.lit("\n"), "l").alias("value")), path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, feature, weight)``: a topic's heading separates the records, so each has its topic."""
    blocks = spark.read.option("lineSep", _CLASS).text(path).where(F.trim("value") != "")
    lines = blocks.select(F.split("value", "\n").alias("l")).select(F.trim(F.col("l")[0]).try_cast("int").alias("topic"), F.explode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("line"))
    parts = lines.select("topic", F.split(F.trim("line"), " ").alias("p")).where((F.size("p") == 2) & F.col("topic").isNotNull())
    return parts.select("topic", F.col("p")[0].alias("feature"), F.col("p")[1].try_cast("double").alias("weight"))
