"""Queries over words: frequencies, tf-idf and label comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import compare, frequency
from lexloom.plans.registry import STOP_LIST, STOP_WORDS, TERMS, TFIDF, TOKEN_LIST, query
from lexloom.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _bags(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return frequency.term_frequencies(_docs(spark, sf_dir), *keep, stop_words=STOP_WORDS)


def _tokens(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    w = X.tokens(F.col("text"), sep)
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


_TOKENS_SQL = f"WITH {TOKEN_LIST} SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5, len(list_distinct(w)) AS n_distinct FROM toks"


@query("tokens_normalised_a", _TOKENS_SQL)
def tokens_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, "")


@query("tokens_normalised_b", _TOKENS_SQL.replace("'', 'g'", "' ', 'g'"))
def tokens_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, " ")


@query("term_freq_by_doc", f"WITH {TERMS} SELECT doc_id, term, tf FROM bag")
def term_freq_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir)


@query("corpus_freq", f"WITH {TERMS} SELECT term, sum(tf)::BIGINT AS cf FROM bag GROUP BY term")
def corpus_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_rows(_docs(spark, sf_dir), stop_words=STOP_WORDS).groupBy("term").agg(F.count("*").alias("cf"))


@query("doc_freq", f"WITH {TERMS} SELECT term, count(*) AS df FROM bag GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bags(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"))


@query("doc_length", f"WITH {TERMS} SELECT doc_id, coalesce(sum(tf), 0)::BIGINT AS len FROM documents LEFT JOIN bag USING (doc_id) GROUP BY doc_id")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = F.filter(X.tokens(F.col("text")), lambda w: X.admissible(F.array(w), STOP_WORDS))
    return _docs(spark, sf_dir).select("doc_id", F.size(grams).cast("bigint").alias("len")).groupBy("doc_id").agg(F.sum("len").alias("len"))


@query("wordcloud", f"""WITH {TERMS}, f AS (SELECT term, count(*) AS freq FROM term GROUP BY term)
    SELECT term, freq FROM (SELECT *, rank() OVER (ORDER BY freq DESC) AS r FROM f) WHERE r <= 50""")  # fmt: skip
def wordcloud(spark: SparkSession, sf_dir: str, n: int = 50, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    return frequency.word_cloud(_docs(spark, sf_dir), n, stop_words)


@query("tfidf_scores", f"WITH {TERMS}, {TFIDF} SELECT term, df, cf, round(score, 6) AS score FROM stats")
def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.tfidf(_bags(spark, sf_dir), _docs(spark, sf_dir).count()).withColumn("score", F.round("score", 6))


@query("wordcloud_tfidf", f"""WITH {TERMS}, {TFIDF}, kept AS (SELECT * FROM stats, cut WHERE score > least AND df > 3)
    SELECT term, cf AS freq, round(score, 6) AS score FROM (SELECT *, rank() OVER (ORDER BY cf DESC) AS r FROM kept) WHERE r <= 150""")  # fmt: skip
def wordcloud_tfidf(spark: SparkSession, sf_dir: str, n: int = 150, gram: int = 1, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    return frequency.word_cloud_tfidf(_docs(spark, sf_dir), n, gram, stop_words).withColumn("score", F.round("score", 6))


@query("wordcloud_by_label", f"""WITH {TERMS}, f AS (SELECT source AS label, term, count(*) AS freq FROM term GROUP BY ALL)
    SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM f) WHERE r <= 20""")  # fmt: skip
def wordcloud_by_label(spark: SparkSession, sf_dir: str, n: int = 20, label: str = "source", labels: tuple[str, ...] = ()) -> DataFrame:
    """``labels``: the chosen ones, all by default."""
    docs = _docs(spark, sf_dir)
    return frequency.label_clouds(docs.where(F.col(label).isin(*labels)) if labels else docs, label, n, STOP_WORDS)


BY_LABEL_TFIDF = """kept AS (SELECT term, cf AS freq FROM stats, cut WHERE score > least AND df > 3),
own AS (SELECT DISTINCT {label} AS label, term FROM bag)
SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM own JOIN kept USING (term)) WHERE r <= 20"""


@query("wordcloud_by_label_tfidf", f"WITH {TERMS}, {TFIDF}, {BY_LABEL_TFIDF.format(label='source')}")
def wordcloud_by_label_tfidf(spark: SparkSession, sf_dir: str, n: int = 20, gram: int = 1, label: str = "source") -> DataFrame:
    return frequency.label_clouds_tfidf(_docs(spark, sf_dir), label, n, gram, STOP_WORDS)


#: SQL: signed log-likelihood of (label, term) rows, from bag.
DUNNING = """own AS (SELECT {label} AS label, term, sum(tf)::DOUBLE AS a FROM bag GROUP BY ALL),
counts AS (SELECT label, term, a, sum(a) OVER (PARTITION BY term) {minus_a} AS b, sum(a) OVER (PARTITION BY label) AS c, sum(a) OVER () AS d_all FROM own),
quad AS (SELECT label, term, a, b, c, d_all {minus_c} AS d FROM counts),
g AS (SELECT label, term, a::BIGINT AS freq, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.0 ELSE
    (CASE WHEN a / c < b / d THEN -1 ELSE 1 END) * 2 * (a * ln(a / (c * (a + b) / (c + d))) + b * ln(b / (d * (a + b) / (c + d)))) END AS g2 FROM quad)"""
EXTREME = """r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY {v} DESC) AS hi, row_number() OVER (PARTITION BY label ORDER BY {v}) AS lo FROM {src}),
e AS (SELECT *, coalesce(max(CASE WHEN lo = 11 THEN {v} END) OVER (PARTITION BY label), max({v}) OVER (PARTITION BY label)) AS edge FROM r)"""


def dunning_sql(label: str, held_out: bool = False, prefix: str = TERMS) -> str:
    minus = {"minus_a": "- a", "minus_c": "- c"} if held_out else {"minus_a": "", "minus_c": ""}
    return f"""WITH {prefix}, {DUNNING.format(label=label, **minus)}, s AS (SELECT * FROM g WHERE abs(g2) > 15.13), {EXTREME.format(v='g2', src='s')}
    SELECT label, term, freq, round(g2, 4) AS g2 FROM e WHERE hi <= 10 OR g2 < edge"""


@query("wordcloud_dunning", dunning_sql("source"))
def wordcloud_dunning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.dunning_clouds(_bags(spark, sf_dir, "source"), "source", 20).withColumn("g2", F.round("g2", 4))


@query("dunning_held_out", dunning_sql("source", True))
def dunning_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.dunning_clouds(_bags(spark, sf_dir, "source"), "source", 20, held_out=True).withColumn("g2", F.round("g2", 4))


MWW = """sizes AS (SELECT {label} AS label, count(*) AS na FROM {docs} GROUP BY 1), tot AS (SELECT sum(na) AS n FROM sizes),
len AS (SELECT doc_id, sum(tf) AS len FROM bag GROUP BY doc_id),
val AS (SELECT term, {label} AS label, tf / len AS v FROM bag JOIN len USING (doc_id)),
rk AS (SELECT term, label, rank() OVER (PARTITION BY term ORDER BY v) + (count(*) OVER (PARTITION BY term, v) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY term) AS df FROM val),
sm AS (SELECT term, label, df, count(*) AS own, sum(rank + n - df) AS t, any_value(n) AS n FROM rk, tot WHERE df >= 10 GROUP BY term, label, df),
m AS (SELECT label, term, CASE WHEN n = na THEN 0.0 ELSE (na * (n - na) + na * (na + 1) / 2.0 - (t + (na - own) * (n - df + 1) / 2.0)) / (na * (n - na)) END AS rho FROM sm JOIN sizes USING (label))"""


def mww_sql(label: str, docs: str = "documents", prefix: str = TERMS) -> str:
    return f"WITH {prefix}, {MWW.format(label=label, docs=docs)}, mr AS (SELECT label, term, round(rho, 6)::DOUBLE AS rho FROM m), {EXTREME.format(v='rho', src='mr')} SELECT label, term, rho FROM e WHERE hi <= 10 OR rho < edge"


@query("wordcloud_mww", mww_sql("source"))
def wordcloud_mww(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compare.mann_whitney(_bags(spark, sf_dir, "source"), _docs(spark, sf_dir), "source").withColumn("rho", F.round("rho", 6))
    return frequency.most_extreme(scored, "rho", 20, "label")


@query("extreme_terms", f"""WITH {TERMS}, s AS (SELECT source AS label, term, count(*) AS freq FROM term GROUP BY ALL), {EXTREME.format(v='freq', src='s')}
    SELECT label, term, freq FROM e WHERE hi <= 10 OR freq < edge""")  # fmt: skip
def extreme_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    freqs = frequency.term_rows(_docs(spark, sf_dir), "source", stop_words=STOP_WORDS).groupBy(F.col("source").alias("label"), "term").agg(F.count("*").alias("freq"))
    return frequency.most_extreme(freqs, "freq", 20, "label")


def grams_sql(n: int) -> str:
    every = " AND ".join(rf"regexp_full_match(w[i + {k}], '\p{{L}}+') AND w[i + {k}] NOT IN ({STOP_LIST})" for k in range(n))
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH {TOKEN_LIST}, g AS (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM toks),
    f AS (SELECT {joined} AS term, count(*) AS freq FROM g WHERE {every} GROUP BY 1)
    SELECT term, freq FROM (SELECT *, rank() OVER (ORDER BY freq DESC) AS r FROM f) WHERE r <= 100"""


def _grams(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    freqs = frequency.term_rows(_docs(spark, sf_dir), n=n, stop_words=STOP_WORDS).groupBy("term").agg(F.count("*").alias("freq"))
    return frequency.top_with_ties(freqs, "freq", 100)


@query("bigrams", grams_sql(2))
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 2)


@query("trigrams", grams_sql(3))
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 3)


#: A small dictionary for translated clouds.
DICTIONARY = (("that", "que"), ("is", "est"), ("for", "pour"), ("with", "avec"), ("this", "ceci"), ("from", "de"))


@query("wordcloud_translated", f"""WITH {TERMS}, d(original, translation) AS (VALUES {", ".join(map(str, DICTIONARY))}), f AS (SELECT term, count(*) AS freq FROM term GROUP BY term)
    SELECT coalesce(translation, term) AS term, term AS original_text, freq FROM (SELECT *, rank() OVER (ORDER BY freq DESC) AS r FROM f) LEFT JOIN d ON original = term WHERE r <= 50""")  # fmt: skip
def wordcloud_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame(DICTIONARY, "original_text string, translation string")
    cloud = frequency.word_cloud(_docs(spark, sf_dir), 50, STOP_WORDS).withColumnRenamed("term", "original_text")
    return cloud.join(words, "original_text", "left").select(F.coalesce("translation", "original_text").alias("term"), "original_text", "freq")


@query("wordcloud_translated_multiple", f"""WITH {TERMS}, d(original, translation) AS (VALUES {", ".join(map(str, DICTIONARY))}), {DUNNING.format(label="source", minus_a="- a", minus_c="- c")},
    f AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM g WHERE g2 > 15.13) WHERE r <= 20)
    SELECT label, coalesce(translation, term) AS term, term AS original_text, freq, round(g2, 4) AS g2 FROM f LEFT JOIN d ON original = term""")  # fmt: skip
def wordcloud_translated_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame(DICTIONARY, "original_text string, translation string")
    scored = compare.dunning(_bags(spark, sf_dir, "source"), "source", held_out=True).where(F.col("g2") > compare.SIGNIFICANT)
    top = frequency.top_with_ties(scored, "freq", 20, "label").withColumnRenamed("term", "original_text")
    return top.join(words, "original_text", "left").select("label", F.coalesce("translation", "original_text").alias("term"), "original_text", "freq", F.round("g2", 4).alias("g2"))
