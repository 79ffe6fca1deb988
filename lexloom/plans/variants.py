"""Queries with parameters other than their defaults, one or more of each family, and small forms that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.operators import frequency, phrases, topics
from lexloom.plans import catalog, geo, phrases as phrase_plans, texts, timeline, topics as topic_plans, words
from lexloom.plans.registry import DATED, STOP_LIST, STOP_WORDS, TERMS, query
from lexloom.sources.tables import table

# words

_ALL_TERMS = TERMS.replace(f" AND term NOT IN ({STOP_LIST})", "")


@query("wordcloud_small", f"WITH {_ALL_TERMS}, f AS (SELECT term, count(*) AS freq FROM term GROUP BY term) SELECT term, freq FROM (SELECT *, rank() OVER (ORDER BY freq DESC) AS r FROM f) WHERE r <= 10")
def wordcloud_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten words, stop words too."""
    return words.wordcloud(spark, sf_dir, n=10, stop_words=())


@query("wordcloud_languages", f"WITH {TERMS}, f AS (SELECT lang AS label, term, count(*) AS freq FROM term WHERE lang IN ('de', 'fr') GROUP BY ALL) SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM f) WHERE r <= 7")
def wordcloud_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.wordcloud_by_label(spark, sf_dir, n=7, label="lang", labels=("de", "fr"))


@query("label_term_stats", f"WITH {TERMS}, l AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS len FROM bag) SELECT source AS label, term, sum(tf)::BIGINT AS freq, count(*) AS docs, round(max(tf / len), 9) AS top FROM l GROUP BY source, term")
def label_term_stats(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    """Of each label and word how often it comes, in how many documents, and its largest share of one."""
    return frequency.label_stats(table(spark, sf_dir, "documents"), label, STOP_WORDS).withColumn("top", F.round("top", 9))


_SCALES = {"linear": "x", "log": "log2(1 + x)", "power": "sqrt(x)"}


@query("frequency_scales", f"""WITH {TERMS}, f AS (SELECT term, count(*) AS freq FROM term GROUP BY term), s AS (SELECT term, freq, (freq - min(freq) OVER ()) / greatest(max(freq) OVER () - min(freq) OVER (), 1) AS x FROM f)
    SELECT term, {', '.join(f'round(8 + 56 * {v}, 6) AS {k}' for k, v in _SCALES.items())} FROM s""")  # fmt: skip
def frequency_scales(spark: SparkSession, sf_dir: str, low: float = 8.0, high: float = 64.0) -> DataFrame:
    """Words' sizes on the linear, the logarithmic and the root scale."""
    freqs = frequency.term_rows(table(spark, sf_dir, "documents"), stop_words=STOP_WORDS).groupBy("term").agg(F.count("*").alias("freq"))
    return frequency.scaled(freqs, "freq", low, high).select("term", *(F.round(k, 6).alias(k) for k in _SCALES))


# time

_SLICES = timeline.CHRONO.replace(f"// {timeline.DAYS}", "// 200").replace(f"* {timeline.DAYS}", "* 200")


@query("wordcloud_chrono_200_days", f"WITH {_SLICES}, f AS (SELECT source AS label, term, count(*) AS freq FROM term GROUP BY ALL) SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM f) WHERE r <= 5")
def wordcloud_chrono_200_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.wordcloud_chrono(spark, sf_dir, n=5, days=200)


_SLOW_SERIES = timeline.SERIES.replace(f"// {timeline.DAYS}", "// 200").replace(f"* {timeline.DAYS}", "* 200").replace(">= 3", ">= 6").replace("r <= 100", "r <= 15")


@query("ngrams_timeseries_200_days", f"WITH {_SLOW_SERIES} SELECT term, strftime(begin, '%Y-%m-%d') AS interval_start, round(value, 9) AS value FROM series")
def ngrams_timeseries_200_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.ngrams_timeseries(spark, sf_dir, days=200, top=15, min_df=6)


#: Formats of dates, and the same in SQL.
_FORMATS = ("%Y-%m-%d %H:%M:%S", "%d/%m/%y", "%I.%M %p, %d %B %Y", "%a %d %b %Y", "%A, %d. %B %Y at %H h", "%j/%Y", "%Y%m%dT%H%M%S%z", "%e %b %Y", "100%% %Y")
_KEEPS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d 00:00:00", "%Y-%m-%d %H:%M:00", "%Y-%m-%d 00:00:00", "%Y-%m-%d %H:00:00", "%Y-%m-%d 00:00:00", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d 00:00:00", "%Y-01-01 00:00:00")


def _strftime_sql(fmt: str) -> str:
    return f"strftime(t, '{fmt.replace('%e', '%-d').replace('%z', '+0000')}')"


@query("strptime_formats", "WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 86400) SECOND AS t FROM orders) " + " UNION ALL ".join(f"SELECT o_orderkey, {i} AS fmt, {_strftime_sql(f)} AS raw, strftime(t, '{k}') AS time FROM o" for i, (f, k) in enumerate(zip(_FORMATS, _KEEPS))))
def strptime_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directive: texts made from order times, read again."""
    t = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    found = None
    for i, f in enumerate(_FORMATS):
        raw = F.date_format("t", D.strptime_format(f))
        part = rows.select("o_orderkey", F.lit(i).alias("fmt"), raw.alias("raw")).withColumn("time", F.date_format(D.strptime(F.col("raw"), f), "yyyy-MM-dd HH:mm:ss"))
        found = part if found is None else found.unionByName(part)
    return found


@query("topic_stream_text_dates", f"""WITH {topic_plans.STATE}, {DATED}, raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN strftime(doc_date, '%Y-%m-%d') WHEN 1 THEN strftime(doc_date, '%Y-00-00') ELSE strftime(doc_date, '%Y-%m-%d 12:00') END AS raw FROM dated),
    db AS (SELECT doc_id, raw[:4]::INT AS bin FROM raw), bin AS (SELECT unnest(range(min(bin), max(bin) + 1))::INT AS bin FROM db), cnt AS (SELECT bin, count(*) AS docs FROM db GROUP BY bin), tot AS (SELECT bin, topic, sum(prop) AS total FROM dt JOIN db USING (doc_id) GROUP BY ALL)
    SELECT bin, topic, round(coalesce(total / docs, 0.0), 9) AS value, coalesce(docs, 0) AS docs FROM bin CROSS JOIN (SELECT DISTINCT topic FROM dt) LEFT JOIN cnt USING (bin) LEFT JOIN tot USING (bin, topic)""")  # fmt: skip
def topic_stream_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream where dates come as texts, some without a month: bins are the years of repaired dates."""
    k, day = F.col("doc_id") % 3, lambda f: F.date_format("doc_date", f)
    raw = F.when(k == 0, day("yyyy-MM-dd")).when(k == 1, F.concat(day("yyyy"), F.lit("-00-00"))).otherwise(F.concat(day("yyyy-MM-dd"), F.lit(" 12:00")))
    docs = timeline.dated(spark, sf_dir).select("doc_id", raw.alias("date"))
    rows = topics.stream(topic_plans._doc_topics(spark, sf_dir), *topics.year_bins(docs))
    return rows.select("bin", "topic", F.round("value", 9).alias("value"), "docs")


@query("topic_search_years", f"""WITH {topic_plans.STREAM} SELECT 1 AS search_id, bin, topic, round(sum(prop), 6) AS total, count(*) AS docs FROM dt JOIN db USING (doc_id) WHERE bin BETWEEN 1994 AND 1995 AND doc_id IN (SELECT doc_id FROM bag WHERE term IN ('para')) GROUP BY ALL""")
def topic_search_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_plans._search(spark, sf_dir, ("para",), first=1994, last=1995)


# phrases


@query("phrasenet_preset_edges", "WITH " + ", ".join(f"p{i} AS (WITH {phrase_plans._found_sql(p)} SELECT {i} AS preset, * FROM edge)" for i, p in enumerate(phrases.PRESETS)) + " " + " UNION ALL ".join(f"FROM p{i}" for i in range(len(phrases.PRESETS))))
def phrasenet_preset_edges(spark: SparkSession, sf_dir: str, presets: tuple[str, ...] = phrases.PRESETS) -> DataFrame:
    """The nets of all patterns offered by name."""
    found = None
    for i, p in enumerate(presets):
        rows = phrases.edges(phrase_plans._found(spark, sf_dir, p)).select(F.lit(i).alias("preset"), "source", "target", "weight")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("mwu_frequent", phrase_plans._mwu_sql("scp").replace("g.f >= 2", "g.f >= 5"))
def mwu_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.multi_word_units(table(spark, sf_dir, "documents"), 3, "scp", min_freq=5).withColumn("glue", F.round("glue", 9))


# texts

_STRICT = texts.PREFILTER.replace("length(term) >= 3", "length(term) >= 5").replace("df >= 5", "df >= 8").replace("sum(tf) > 25", "sum(tf) > 40")


@query("topic_prefilter_strict", f"WITH {_STRICT} SELECT doc_id, term, tf FROM pre")
def topic_prefilter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.operators import texts as T

    return T.topic_prefilter(table(spark, sf_dir, "documents"), min_df=8, min_length=5, min_tokens=40, stop_words=STOP_WORDS)


@query("context_window_wide", rf"WITH {texts._SPAN_SQL.replace('and', 'with').replace('a + 3', 'a + 4').replace('a, 5', 'a, 6').replace('length(text) - 3', 'length(text) - 4')} SELECT doc_id, regexp_replace(substr(text, greatest(a - 40, 0) + 1, least(b + 40, length(text)) - greatest(a - 40, 0)), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g') AS context FROM h")
def context_window_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.context_window(spark, sf_dir, "with", 40)


# places, catalog


@query("geo_export_wide", rf"WITH {geo.MENTIONS} SELECT place AS name, lat, lon AS lng, 'geo/' || place AS uri, doc_id, regexp_replace(substr(text, greatest(men.spot - 60, 0) + 1, least(past + 60, length(text)) - greatest(men.spot - 60, 0)), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g') AS context FROM men JOIN spot USING (doc_id)")
def geo_export_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geo_export(spark, sf_dir, around=60)


@query("place_item_contexts", f"WITH {geo.MENTIONS}, i AS (SELECT place, doc_id, list({{'start': spot, 'end': past}} ORDER BY spot) AS spans FROM men GROUP BY ALL) SELECT place, doc_id, len(spans) AS n, to_json(spans)::VARCHAR AS spans FROM i")
def place_item_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place's items, each with the list of its spans: a row for each item, so that no place is one value."""
    spans = F.sort_array(F.collect_list(F.struct(F.col("spot").alias("start"), F.col("past").alias("end"))))  # of one text
    rows = geo._mentions(spark, sf_dir).groupBy("place", "doc_id").agg(spans.alias("spans"))
    return rows.select("place", "doc_id", F.size("spans").cast("bigint").alias("n"), F.to_json("spans").alias("spans"))


@query("manifest_outfiles", """SELECT doc_id AS "itemID", source || '/' || doc_id || '.html' AS filename, 'out/' || source || '/' || doc_id || '.txt' AS outfile, source AS collection FROM documents""")
def manifest_outfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of an extraction: each file, where its text goes, and its collection."""
    item = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("itemID"), F.concat("source", F.lit("/"), item, F.lit(".html")).alias("filename"), F.col("source").alias("collection"))
    return catalog.catalog.with_outfiles(files, "out")
