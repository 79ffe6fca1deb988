"""Writing results: tables, manifests, records, and pages with their data."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def records(df: DataFrame, column: str, path: str) -> None:
    """One text record a row, such as bibliographic ones."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def export_texts(df: DataFrame, path: str) -> None:
    """Texts and their metadata side by side."""
    df.write.mode("overwrite").parquet(f"{path}/texts")
    csv(df.drop("text"), f"{path}/_metadata")


def page(title: str, data: dict, template: str = "<!DOCTYPE html><html><head><title>$TITLE</title></head><body><script>var data=$DATA;</script></body></html>") -> str:
    """A page that carries its data; the caller has reduced these to what a view shows."""
    text = json.dumps(data, default=str).replace("</", "<\\/")
    return template.replace("$TITLE", html.escape(title)).replace("$DATA", text)


def run_key(query: str, params: dict) -> str:
    """The key of a run: query and parameters."""
    import hashlib

    return hashlib.sha256(json.dumps([query, params], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet result at ``path``, built first where there is none."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def view_state(query: str, params: dict) -> str:
    """What a view shows as text that a link can hold: the query and its parameters, in a stated order."""
    from urllib.parse import quote, urlencode

    return quote(query, safe="") + "?" + urlencode([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(params.items())])


def from_view_state(text: str) -> tuple[str, dict]:
    """The query and the parameters of ``view_state``."""
    from urllib.parse import parse_qsl, unquote

    query, _, rest = text.partition("?")
    return unquote(query), {k: json.loads(v) for k, v in parse_qsl(rest, keep_blank_values=True)}


def view(spark: SparkSession, sf_dir: str, text: str, queries: dict) -> DataFrame:
    """The rows of a saved view: its query run with its parameters; lists stand for tuples."""
    name, params = from_view_state(text)
    return queries[name](spark, sf_dir, **{k: tuple(v) if isinstance(v, list) else v for k, v in params.items()})
