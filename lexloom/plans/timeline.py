"""Queries over dated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.operators import compare, frequency, timeline
from lexloom.plans import words
from lexloom.plans.registry import DATED, STOP_WORDS, TERMS, TFIDF, query
from lexloom.sources.tables import table

DAYS = 90


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("doc_date"))
    return table(spark, sf_dir, "documents").join(orders, "doc_id").select("doc_id", "text", "source", "lang", "doc_date")


_CUT = f"""{DATED}, ends AS (SELECT min(doc_date) AS a, max(doc_date) AS b FROM dated),
idoc AS (SELECT doc_id, text, lang, ((doc_date - a) // {DAYS})::INT AS interval, strftime(a + ((doc_date - a) // {DAYS})::INT * {DAYS}, '%Y-%m-%d') AS source FROM dated, ends),
slots AS (SELECT i::INT AS interval, a + i::INT * {DAYS} AS begin FROM (SELECT a, unnest(range(0, (b - a) // {DAYS} + 1)) AS i FROM ends))"""
#: SQL: terms of documents whose label is their interval's first day.
CHRONO = f"{_CUT}, {TERMS.replace('FROM documents)', 'FROM idoc)')}"


@query("doc_scan_filter", f"""WITH {DATED} SELECT doc_id, source, strftime(doc_date, '%Y-%m-%d') AS day FROM dated
    WHERE doc_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")  # fmt: skip
def doc_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = timeline.in_range(dated(spark, sf_dir), "1996-01-01", "1997-12-31")
    return kept.select("doc_id", "source", F.date_format("doc_date", "yyyy-MM-dd").alias("day"))


@query("interval_assignment", f"WITH {_CUT} SELECT doc_id, interval, source AS label FROM idoc")
def interval_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sliced(dated(spark, sf_dir), DAYS).select("doc_id", "interval", "label")


@query("interval_grid", f"""WITH {_CUT} SELECT interval, strftime(begin, '%Y-%m-%d') AS interval_start,
    strftime(begin, '%Y/%m/%d') || '-' || strftime(begin + {DAYS}, '%Y/%m/%d') AS interval_name, count(doc_id) AS docs
    FROM slots LEFT JOIN idoc USING (interval) GROUP BY ALL""")  # fmt: skip
def interval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dated(spark, sf_dir)
    counts = timeline.sliced(docs, DAYS).groupBy("interval").agg(F.count("*").alias("docs"))
    slots = timeline.grid(docs, DAYS).join(counts, "interval", "left")
    return slots.select("interval", F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "interval_name", F.coalesce("docs", F.lit(0)).alias("docs")).orderBy("interval")


def _sliced(spark: SparkSession, sf_dir: str, days: int = DAYS, start: str | None = None, end: str | None = None) -> DataFrame:
    return timeline.sliced(dated(spark, sf_dir), days, start, end).select("doc_id", "text", "label")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequencies(_sliced(spark, sf_dir), "label", stop_words=STOP_WORDS)


@query("wordcloud_chrono", f"""WITH {CHRONO}, f AS (SELECT source AS label, term, count(*) AS freq FROM term GROUP BY ALL)
    SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM f) WHERE r <= 20""")  # fmt: skip
def wordcloud_chrono(spark: SparkSession, sf_dir: str, n: int = 20, days: int = DAYS, start: str | None = None, end: str | None = None) -> DataFrame:
    return frequency.label_clouds(_sliced(spark, sf_dir, days, start, end), "label", n, STOP_WORDS)


@query("wordcloud_chrono_tfidf", f"WITH {CHRONO}, {TFIDF.replace('FROM documents', 'FROM idoc')}, {words.BY_LABEL_TFIDF.format(label='source')}")
def wordcloud_chrono_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.label_clouds_tfidf(_sliced(spark, sf_dir), "label", 20, stop_words=STOP_WORDS)


@query("wordcloud_chrono_dunning", words.dunning_sql("source", prefix=CHRONO))
def wordcloud_chrono_dunning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.dunning_clouds(_bags(spark, sf_dir), "label", 20).withColumn("g2", F.round("g2", 4))


@query("wordcloud_chrono_mww", words.mww_sql("source", "idoc", CHRONO))
def wordcloud_chrono_mww(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compare.mann_whitney(_bags(spark, sf_dir), _sliced(spark, sf_dir), "label").withColumn("rho", F.round("rho", 6))
    return frequency.most_extreme(scored, "rho", 20, "label")


SERIES = f"""{CHRONO}, islot AS (SELECT interval, term, count(*) AS df, sum(tf) AS tf FROM bag JOIN (SELECT doc_id, interval FROM idoc) USING (doc_id) GROUP BY ALL),
share AS (SELECT interval, term, df, tf / sum(tf) OVER (PARTITION BY interval) AS value FROM islot),
mean AS (SELECT term, round(sum(value) / (SELECT count(*) FROM slots), 12) AS mean FROM share GROUP BY term HAVING sum(df) >= 3),
best AS (SELECT term FROM (SELECT term, rank() OVER (ORDER BY mean DESC) AS r FROM mean) WHERE r <= 100),
series AS (SELECT term, interval, begin, coalesce(value, 0.0) AS value FROM best CROSS JOIN slots LEFT JOIN share USING (term, interval))"""


def _series(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return timeline.ngram_series(dated(spark, sf_dir), **({"days": DAYS, "top": 100, "min_df": 3, "stop_words": STOP_WORDS} | how))


@query("ngrams_timeseries", f"WITH {SERIES} SELECT term, strftime(begin, '%Y-%m-%d') AS interval_start, round(value, 9) AS value FROM series")
def ngrams_timeseries(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """``how``: days, n, top, min_df, stop_words, start and end of the series."""
    return _series(spark, sf_dir, **how).select("term", F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), F.round("value", 9).alias("value"))


@query("ngrams_max", f"WITH {SERIES} SELECT round(max(value), 9) AS max_value, count(DISTINCT term) AS terms FROM series")
def ngrams_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).agg(F.round(F.max("value"), 9).alias("max_value"), F.countDistinct("term").alias("terms"))


@query("ngrams_smoothed", f"""WITH {SERIES} SELECT term, interval, round((sum(value) OVER w + (3 - count(*) OVER w) * value) / 3, 9) AS smoothed
    FROM series WINDOW w AS (PARTITION BY term ORDER BY interval ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")  # fmt: skip
def ngrams_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.moving(_series(spark, sf_dir), "value", 1, "interval", "term").select("term", "interval", F.round("smoothed", 9).alias("smoothed"))


@query("ngrams_median", f"""WITH {SERIES}, near AS (SELECT term, interval, value, list(value) OVER w AS l
    FROM series WINDOW w AS (PARTITION BY term ORDER BY interval ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT term, interval, round(list_sort(CASE WHEN len(l) < 3 THEN list_append(l, value) ELSE l END)[2], 9) AS smoothed FROM near""")  # fmt: skip
def ngrams_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.moving(_series(spark, sf_dir), "value", 1, "interval", "term", median=True).select("term", "interval", F.round("smoothed", 9).alias("smoothed"))


@query("ngrams_docs", f"""WITH {SERIES} SELECT b.term, i.interval, b.doc_id FROM bag b JOIN idoc i USING (doc_id) WHERE b.term IN (SELECT term FROM best)""")
def ngrams_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _series(spark, sf_dir).select("term").distinct()
    return timeline.postings(dated(spark, sf_dir), DAYS, terms, stop_words=STOP_WORDS)


@query("year_repair", """SELECT doc_id, raw, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN
    CASE WHEN raw::INT < 100 THEN raw::INT + 1900 WHEN raw::INT < 200 THEN raw::INT + 1800 ELSE raw::INT END END AS year
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 100)::VARCHAR WHEN 1 THEN (100 + doc_id % 100)::VARCHAR WHEN 2 THEN (1800 + doc_id % 200)::VARCHAR ELSE 'n/a' END AS raw FROM documents)""")  # fmt: skip
def year_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, (d % 100).cast("string")).when(d % 4 == 1, (100 + d % 100).cast("string")).when(d % 4 == 2, (1800 + d % 200).cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("year", D.repair_year(F.col("raw")))


@query("date_repair", """WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1999-00-00' WHEN 1 THEN '' WHEN 2 THEN '1999-12-31 noon' WHEN 3 THEN 'soon' ELSE '2001-05-00' END AS raw FROM documents)
    SELECT doc_id, raw, strftime(try_cast(CASE WHEN contains(raw[:10], '-00') THEN raw[:4] || '-01-01' ELSE raw[:10] END AS DATE), '%Y-%m-%d') AS day FROM r""")  # fmt: skip
def date_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 5
    raw = F.when(d == 0, "1999-00-00").when(d == 1, "").when(d == 2, "1999-12-31 noon").when(d == 3, "soon").otherwise("2001-05-00")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("day", F.date_format(D.parse_date(F.col("raw")), "yyyy-MM-dd"))


@query("decade_feature", f"""WITH {DATED}, y AS (SELECT doc_id, year(doc_date) AS y, source, lang FROM dated)
    SELECT doc_id, (round(y, -1))::INT AS decade, ('decade' || round(y, -1)::INT::VARCHAR || ' ' || regexp_replace(source, '[^A-Za-z0-9]+', '', 'g') || ' ' || regexp_replace(lang, '[^A-Za-z0-9]+', '', 'g')) AS features FROM y""")  # fmt: skip
def decade_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = D.decade(F.year("doc_date").cast("string"))
    plain = lambda c: F.regexp_replace(c, r"[\W_]+", "")
    return dated(spark, sf_dir).select("doc_id", decade.alias("decade"), F.concat_ws(" ", F.concat(F.lit("decade"), decade.cast("string")), plain("source"), plain("lang")).alias("features"))


@query("strptime_orders", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS raw, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def strptime_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return raw.withColumn("day", F.date_format(D.strptime(F.col("raw"), "%d/%m/%Y"), "yyyy-MM-dd"))


@query("event_tumbling", """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 4).alias("total"))
