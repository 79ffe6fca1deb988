"""Time slices of a corpus: intervals, dense n-gram series and smoothing."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.operators import frequency
from lexloom.operators.layout import written


def span(dated: DataFrame, start: str | None = None, end: str | None = None) -> tuple[str, str] | None:
    """First and last day, as given or found; None without dates."""
    found = dated.agg(F.min("doc_date").cast("string").alias("a"), F.max("doc_date").cast("string").alias("b")).first()
    return None if found["a"] is None else (day(start) or found["a"], day(end) or found["b"])


def day(text: str | None) -> str | None:
    """A parameter ``YYYY-MM-DD``; None for anything else, so that a bad one doesn't restrict."""
    try:
        return datetime.strptime(text or "", "%Y-%m-%d").strftime("%Y-%m-%d")
    except ValueError:
        return None


def years(text: str) -> tuple[int, int] | None:
    """The ends of ``YYYY-YYYY`` or of one year; None for anything else."""
    found = re.fullmatch(r"\s*(\d{1,4})\s*(?:-\s*(\d{1,4})\s*)?", text)
    return (int(found[1]), int(found[2] or found[1])) if found else None


def in_range(dated: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive; rows without a date go, and ends that are no days don't count."""
    start, end = day(start), day(end)
    kept = dated.where(F.col("doc_date").isNotNull())
    if start:
        kept = kept.where(F.col("doc_date") >= F.lit(start).cast("date"))
    return kept.where(F.col("doc_date") <= F.lit(end).cast("date")) if end else kept


def grid(dated: DataFrame, days: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """``(interval, interval_start, interval_name)``: every interval up to the last day's, gaps included."""
    found = span(dated, start, end)
    spark = dated.sparkSession
    if found is None:
        return spark.createDataFrame([], "interval int, interval_start date, interval_name string")
    first, last = (F.lit(x).cast("date") for x in found)
    index = spark.range(1).select(F.explode(F.sequence(F.lit(0), D.interval_index(last, first, days))).alias("interval"))
    begin = D.interval_start(F.col("interval"), first, days)
    return index.select("interval", begin.alias("interval_start"), D.interval_name(begin, days).alias("interval_name"))


def sliced(dated: DataFrame, days: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """``dated`` in range, with its ``interval`` and ``label`` (the interval's first day): arithmetic, no range join."""
    found = span(dated, start, end)
    kept = in_range(dated, start, end)
    if found is None:
        return kept.select("*", F.lit(None).cast("int").alias("interval"), F.lit(None).cast("string").alias("label"))
    first = F.lit(found[0]).cast("date")
    index = D.interval_index(F.col("doc_date"), first, days)
    return kept.select("*", index.alias("interval"), D.interval_start(index, first, days).cast("string").alias("label"))


def ngram_series(dated: DataFrame, days: int, n: int = 1, top: int = 100, min_df: int = 1, stop_words: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """``(term, interval, interval_start, value)``: dense series of the terms of the largest mean share.

    A term's value is its share of the interval's n-grams, taken before the
    document-frequency filter; the mean counts empty intervals.
    """
    cut = sliced(dated, days, start, end).select("doc_id", "text", "interval")
    slots = grid(dated, days, start, end)
    bags = frequency.term_frequencies(cut, "interval", n=n, stop_words=stop_words)
    by_slot = written(bags.groupBy("interval", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")), "slots")
    totals = by_slot.groupBy("interval").agg(F.sum("tf").alias("total"))
    shares = by_slot.join(totals, "interval").select("interval", "term", "df", (F.col("tf") / F.col("total")).alias("value"))
    count = slots.count()
    means = shares.groupBy("term").agg(F.sum("df").alias("df"), F.round(F.sum("value") / F.lit(max(1, count)), 12).alias("mean")).where(F.col("df") >= min_df)
    chosen = frequency.top_with_ties(means, "mean", top).select("term")
    dense = chosen.crossJoin(slots.select("interval", "interval_start"))  # top terms by intervals, both bounded
    return dense.join(shares.select("interval", "term", "value"), ["interval", "term"], "left").select("term", "interval", "interval_start", F.coalesce("value", F.lit(0.0)).alias("value"))


def postings(dated: DataFrame, days: int, terms: DataFrame, n: int = 1, stop_words: tuple[str, ...] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """``(term, interval, doc_id)``: the documents behind each point of the series of ``terms``, a row each.

    Terms are written, so that their size is known before the join: few enough are sent to the bags, which then stay where they are.
    """
    cut = sliced(dated, days, start, end).select("doc_id", "text", "interval")
    bags = frequency.term_frequencies(cut, "interval", n=n, stop_words=stop_words)
    return bags.join(written(terms, "terms"), "term", "left_semi").select("term", "interval", "doc_id")


def moving(series: DataFrame, value: str, w: int, order: str, *by: str, median: bool = False) -> DataFrame:
    """``smoothed``: the mean or median of the 2w + 1 values around, a row's own where there are fewer."""
    around = Window.partitionBy(*by).orderBy(order).rowsBetween(-w, w)
    width, v = 2 * w + 1, F.col(value)
    if median:
        near = F.concat(F.collect_list(value).over(around), F.array_repeat(v, F.lit(width) - F.count(value).over(around).cast("int")))
        return series.withColumn("smoothed", F.element_at(F.sort_array(near), w + 1))
    return series.withColumn("smoothed", (F.sum(value).over(around) + (width - F.count(value).over(around)) * v) / width)
