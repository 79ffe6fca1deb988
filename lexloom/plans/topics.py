"""Queries over topics.

All but the model's own use a deterministic table, a document's tokens by the
first letter of the word, so that what follows a model can be checked exactly.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import frequency, gibbs, texts, topics
from lexloom.operators.layout import forget, removed, shared_dir, written
from lexloom.plans.registry import DATED, STOP_WORDS, TERMS, query
from lexloom.plans.texts import PREFILTER
from lexloom.plans.timeline import dated
from lexloom.sources import topic_files
from lexloom.sources.tables import table
from lexloom.sources.writers import run_key

#: SQL: (doc_id, topic, term, n), (doc_id, topic, prop), years of documents and all year bins.
STATE = f"""{TERMS}, state AS (SELECT doc_id, (unicode(term) % 10)::INT AS topic, term, tf AS n FROM bag),
dt AS (SELECT doc_id, topic, sum(n) / sum(sum(n)) OVER (PARTITION BY doc_id) AS prop FROM state GROUP BY doc_id, topic)"""
STREAM = f"""{STATE}, {DATED}, db AS (SELECT doc_id, year(doc_date)::INT AS bin FROM dated), bin AS (SELECT unnest(range(min(bin), max(bin) + 1))::INT AS bin FROM db),
cnt AS (SELECT bin, count(*) AS docs FROM db GROUP BY bin), tot AS (SELECT bin, topic, sum(prop) AS total FROM dt JOIN db USING (doc_id) GROUP BY ALL),
str AS (SELECT bin, topic, coalesce(total / docs, 0.0) AS value, coalesce(docs, 0) AS docs FROM bin CROSS JOIN (SELECT DISTINCT topic FROM dt) LEFT JOIN cnt USING (bin) LEFT JOIN tot USING (bin, topic)),
smo AS (SELECT *, (sum(value) OVER w + (5 - count(*) OVER w) * value) / 5 AS smoothed FROM str WINDOW w AS (PARTITION BY topic ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, sf_dir, "documents"), stop_words=STOP_WORDS)


def _states(bags: DataFrame) -> DataFrame:
    return bags.select("doc_id", (F.ascii("term") % 10).alias("topic"), "term", F.col("tf").alias("n"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(_bags(spark, sf_dir))


def _shares(state: DataFrame) -> DataFrame:
    return written(topics.doc_shares(state), "shares")


def _doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's shares, a row a topic: texts are read once a query, whatever it then does with them."""
    return _shares(_state(spark, sf_dir))


def _bins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = written(dated(spark, sf_dir).select("doc_id", F.year("doc_date").alias("bin")), "bins")
    ends = own.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a IS NOT NULL")
    return own, ends.select(F.explode(F.sequence("a", "b")).alias("bin"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(topics.stream(_doc_topics(spark, sf_dir), *_bins(spark, sf_dir)), "stream")  # bins by topics


@query("doc_topics", f"WITH {STATE} SELECT doc_id, topic, round(prop, 9) AS prop FROM dt")
def doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_topics(spark, sf_dir).withColumn("prop", F.round("prop", 9))


@query("topic_words", f"""WITH {STATE}, tw AS (SELECT topic, term, sum(n) AS n, sum(n) / sum(sum(n)) OVER (PARTITION BY topic) AS prob FROM state GROUP BY topic, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rank FROM tw) SELECT topic, rank, term, round(prob, 9) AS prob FROM r WHERE rank <= 20""")  # fmt: skip
def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.word_shares(_state(spark, sf_dir)).withColumn("prob", F.round("prob", 9))


@query("topic_coherence", f"""WITH {STATE}, tw AS (SELECT topic, term, sum(n) AS n FROM state GROUP BY ALL),
    top AS (SELECT topic, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rank FROM tw) WHERE rank <= 10),
    d AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
    j AS (SELECT a.topic, a.rank AS ra, b.rank AS rb, count(*) AS n FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank JOIN bag x ON x.term = a.term JOIN bag y ON y.term = b.term AND y.doc_id = x.doc_id GROUP BY ALL)
    SELECT a.topic, round(sum(ln((coalesce(j.n, 0) + 1) / df)), 6) AS coherence FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank JOIN d ON d.term = a.term
    LEFT JOIN j ON j.topic = a.topic AND j.ra = a.rank AND j.rb = b.rank GROUP BY a.topic""")  # fmt: skip
def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = written(_bags(spark, sf_dir), "bags")
    return topics.coherence(topics.word_shares(_states(bags), 10), bags).withColumn("coherence", F.round("coherence", 6))


@query("allocation_ratio", f"""WITH {STATE}, p AS (SELECT topic, (n + 0.1) / (len + 1.0) AS prop FROM (SELECT doc_id, topic, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY doc_id) AS len FROM state GROUP BY doc_id, topic))
    SELECT topic, {', '.join(f'count(*) FILTER (prop >= {s}::DOUBLE) AS at_{int(s * 100):02d}' for s in topics.SHARES)},
    CASE WHEN at_02 > 0 THEN round(at_50 / at_02, 9) ELSE 0.0 END AS ratio FROM p GROUP BY topic""")  # fmt: skip
def allocation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.allocation(topics.doc_shares(_state(spark, sf_dir), 0.1, 10)).withColumn("ratio", F.round("ratio", 9))


@query("dominant_topics", f"WITH {STATE} SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prop DESC, topic) AS r FROM dt) WHERE r = 1")
def dominant_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.dominant(_doc_topics(spark, sf_dir))


@query("topic_stream", f"WITH {STREAM} SELECT bin, topic, docs, round(value, 9) AS value, round(smoothed, 9) AS smoothed FROM smo")
def topic_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.smoothed(_stream(spark, sf_dir)).select("bin", "topic", "docs", F.round("value", 9).alias("value"), F.round("smoothed", 9).alias("smoothed"))


@query("topic_zscore", f"WITH {STREAM} SELECT bin, topic, CASE WHEN stddev_samp(value) OVER t > 0 THEN round((value - avg(value) OVER t) / stddev_samp(value) OVER t, 6) ELSE 0.0 END AS z FROM str WINDOW t AS (PARTITION BY topic)")
def topic_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.zscores(_stream(spark, sf_dir)).withColumn("z", F.round("z", 6))


_PREV = "prev AS (SELECT topic, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS spread, round(max(smoothed), 9) AS peak FROM smo GROUP BY topic)"


@query("topic_rank", f"""WITH {STREAM}, {_PREV}, r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, topic) AS by_mean, row_number() OVER (ORDER BY peak DESC, topic) AS by_peak, row_number() OVER (ORDER BY spread DESC, topic) AS by_spread FROM prev)
    SELECT * FROM r WHERE by_mean <= 5 OR by_peak <= 5 OR by_spread <= 5""")  # fmt: skip
def topic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    prev = topics.prevalence(_stream(spark, sf_dir)).select("topic", *(F.round(c, 9).alias(c) for c in ("mean", "spread", "peak")))
    for c in ("mean", "peak", "spread"):
        prev = prev.withColumn(f"by_{c}", F.row_number().over(Window.orderBy(F.desc(c), "topic")))  # a row a topic
    return prev.where("by_mean <= 5 OR by_peak <= 5 OR by_spread <= 5")


@query("topic_more", f"WITH {STREAM}, {_PREV} SELECT topic, mean FROM (SELECT *, row_number() OVER (ORDER BY mean DESC, topic) AS r FROM prev) WHERE r BETWEEN 6 AND 10")
def topic_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    prev = topics.prevalence(_stream(spark, sf_dir)).select("topic", F.round("mean", 9).alias("mean"))
    return prev.orderBy(F.desc("mean"), "topic").offset(5).limit(5)


@query("label_means", f"WITH {STATE}, s AS (SELECT source AS label, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1) SELECT label, topic, round(sum(prop) / any_value(docs), 9) AS mean FROM dt JOIN (SELECT doc_id, source AS label FROM documents) USING (doc_id) JOIN s USING (label) GROUP BY ALL")
def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return topics.label_means(_doc_topics(spark, sf_dir), labels).withColumn("mean", F.round("mean", 9))


@query("topic_stack", f"WITH {STREAM} SELECT bin, topic, round(sum(value) OVER p - value, 6) AS low, round(sum(value) OVER p, 6) AS high, CASE WHEN sum(value) OVER (PARTITION BY bin) > 0 THEN round(value / sum(value) OVER (PARTITION BY bin), 6) ELSE 0.0 END AS share FROM str WINDOW p AS (PARTITION BY bin ORDER BY topic ROWS UNBOUNDED PRECEDING)")
def topic_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.stacked(_stream(spark, sf_dir))
    return rows.select("bin", "topic", *(F.round(c, 6).alias(c) for c in ("low", "high", "share")))


def _search_sql(search_id: int, terms: str) -> str:
    return f"SELECT {search_id} AS search_id, bin, topic, round(sum(prop), 6) AS total, count(*) AS docs FROM dt JOIN db USING (doc_id) WHERE bin BETWEEN 1996 AND 1999 AND doc_id IN (SELECT doc_id FROM bag WHERE {terms}) GROUP BY ALL"


def _search(spark: SparkSession, sf_dir: str, *searches: tuple[str, ...], first: int = 1996, last: int = 1999) -> DataFrame:
    """The stream of documents that have any of a search's terms, a part for each search; bags, shares and bins are made once for all."""
    bags = written(_bags(spark, sf_dir), "bags")
    own, _ = _bins(spark, sf_dir)
    shares = written(_shares(_states(bags)).join(own.where(F.col("bin").between(first, last)), "doc_id"), "binned")
    found = None
    for i, terms in enumerate(searches, 1):
        rows = shares.join(texts.search(bags, terms), "doc_id", "left_semi").groupBy(F.lit(i).alias("search_id"), "bin", "topic").agg(F.round(F.sum("prop"), 6).alias("total"), F.count("*").alias("docs"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("topic_search", f"""WITH {STREAM} {_search_sql(1, "term IN ('with', 'that')")}""")
def topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, ("with", "that"))


@query("topic_search_compare", f"""WITH {STREAM} {_search_sql(1, "term IN ('with', 'that')")} UNION ALL {_search_sql(2, "regexp_matches(term, '^ou.*')")}""")
def topic_search_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, ("with", "that"), ("^ou.*",))


@query("search_support", f"WITH {STREAM} SELECT bin, count(DISTINCT doc_id) AS docs FROM db WHERE doc_id IN (SELECT doc_id FROM bag WHERE term = 'with' UNION SELECT doc_id FROM bag WHERE term = 'para') GROUP BY bin")
def search_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = _bags(spark, sf_dir)
    hits = texts.search(bags, ("with",)).union(texts.search(bags, ("para",)))
    return _bins(spark, sf_dir)[0].join(hits, "doc_id", "left_semi").groupBy("bin").agg(F.countDistinct("doc_id").alias("docs"))


@query("topic_drilldown", f"WITH {STREAM}, dom AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prop DESC, topic) AS r FROM dt) WHERE r = 1) SELECT doc_id, source, topic AS main_topic FROM db JOIN documents USING (doc_id) LEFT JOIN dom USING (doc_id) WHERE bin = 1997")
def topic_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = topics.dominant(_doc_topics(spark, sf_dir)).withColumnRenamed("topic", "main_topic")
    own, _ = _bins(spark, sf_dir)
    return own.where("bin = 1997").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(main, "doc_id", "left").select("doc_id", "source", "main_topic")


@query("topic_mutual_information", f"""WITH {STREAM}, dom AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prop DESC, topic) AS r FROM dt) WHERE r = 1),
    pl AS (SELECT lang AS label, bin AS interval, topic, count(*) AS n FROM dom JOIN db USING (doc_id) JOIN documents USING (doc_id) GROUP BY ALL),
    met AS (SELECT x.label AS label_x, y.label AS label_y, x.topic AS tx, y.topic AS ty, sum(x.n * y.n)::DOUBLE AS n FROM pl x JOIN pl y ON x.interval = y.interval AND x.label < y.label GROUP BY ALL),
    sh AS (SELECT label_x, label_y, n / sum(n) OVER (PARTITION BY label_x, label_y) AS p, sum(n) OVER (PARTITION BY label_x, label_y, tx) / sum(n) OVER (PARTITION BY label_x, label_y) AS px, sum(n) OVER (PARTITION BY label_x, label_y, ty) / sum(n) OVER (PARTITION BY label_x, label_y) AS py FROM met)
    SELECT label_x, label_y, round(greatest(sum(p * log2(p / (px * py))), 0.0), 6) AS mi FROM sh GROUP BY ALL""")  # fmt: skip
def topic_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = topics.dominant(_doc_topics(spark, sf_dir))
    own, _ = _bins(spark, sf_dir)
    placed = main.join(own.withColumnRenamed("bin", "interval"), "doc_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), "doc_id")
    return topics.mutual_information(placed).withColumn("mi", F.round("mi", 6))


@query("topic_correlation", f"""WITH {STATE}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), o AS (SELECT topic, sum(prop) AS s, sum(prop * prop) AS q FROM dt GROUP BY topic),
    j AS (SELECT a.topic AS tx, b.topic AS ty, sum(a.prop * b.prop) AS ab FROM dt a JOIN dt b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY ALL)
    SELECT tx AS topic_x, ty AS topic_y, round((n * ab - x.s * y.s) / sqrt((n * x.q - x.s * x.s) * (n * y.q - y.s * y.s)), 9) AS r FROM n, j JOIN o x ON x.topic = tx JOIN o y ON y.topic = ty ORDER BY r DESC, tx, ty LIMIT 5""")  # fmt: skip
def topic_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.correlations(_doc_topics(spark, sf_dir), table(spark, sf_dir, "documents").count())


@query("segment_topics", r"""WITH seg AS (SELECT doc_id, i, unnest(list_filter(string_split_regex(regexp_replace(lower(l[i]), '[^\p{L}\p{N}_ ]+', ' ', 'g'), ' +'), lambda w: w <> '')) AS term
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(s) - length(replace(s, ' ', '')) > 5) AS l FROM documents))),
    st AS (SELECT doc_id, i, unicode(term) % 10 AS topic, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, i) AS prop FROM seg GROUP BY doc_id, i, unicode(term) % 10),
    su AS (SELECT doc_id, topic, sum(prop) AS p FROM st GROUP BY ALL) SELECT doc_id, topic, round(p / sum(p) OVER (PARTITION BY doc_id), 9) AS prop FROM su""")  # fmt: skip
def segment_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.functions import text as X

    rows = texts.segments(table(spark, sf_dir, "documents"), "\n").select("doc_id", "segment_id", F.explode(X.tokens(F.col("segment"), " ")).alias("term"))
    counts = rows.groupBy("doc_id", "segment_id", (F.ascii("term") % 10).alias("topic")).agg(F.count("*").alias("n"))
    shares = topics.doc_shares(counts.select(F.struct("doc_id", "segment_id").alias("doc_id"), "topic", "n")).select("doc_id.doc_id", "doc_id.segment_id", "topic", "prop")
    return topics.segments_to_documents(shares).withColumn("prop", F.round("prop", 9))


_NB = f"""{TERMS}, lab AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id % 3 <> 0), nw AS (SELECT label, term, sum(tf)::BIGINT AS n FROM bag JOIN lab USING (doc_id) GROUP BY ALL),
nc AS (SELECT label, count(*) AS docs FROM lab GROUP BY label), nt AS (SELECT label, sum(n)::BIGINT AS tokens FROM nw GROUP BY label),
cls AS (SELECT label, docs, coalesce(tokens, 0) AS tokens, (SELECT count(DISTINCT term) FROM nw) AS terms FROM nc LEFT JOIN nt USING (label))"""


def _trained(spark: SparkSession, sf_dir: str, bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels").where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("label"))
    classes, words = topics.naive_bayes(bags, labels)
    return written(classes, "classes"), written(words, "class-words")


@query("nb_train", f"WITH {_NB} SELECT label, term, n, round(ln((n + 1) / (tokens + terms)), 9) AS log_share FROM nw JOIN cls USING (label)")
def nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, words = _trained(spark, sf_dir, _bags(spark, sf_dir))
    return words.join(F.broadcast(classes), "label").select("label", "term", "n", F.round(F.log((F.col("n") + 1) / (F.col("tokens") + F.col("terms"))), 9).alias("log_share"))  # a row a class


@query("nb_classify", f"""WITH {_NB}, kn AS (SELECT * FROM bag WHERE term IN (SELECT term FROM nw)), ln AS (SELECT doc_id, coalesce(len, 0) AS len FROM (SELECT DISTINCT doc_id FROM bag) LEFT JOIN (SELECT doc_id, sum(tf) AS len FROM kn GROUP BY doc_id) USING (doc_id)),
    gain AS (SELECT doc_id, label, sum(tf * ln(n + 1)) AS gain FROM kn JOIN nw USING (term) GROUP BY ALL),
    sc AS (SELECT doc_id, label, round(ln(docs / (SELECT sum(docs) FROM cls)) - len * ln(tokens + terms) + coalesce(gain, 0), 6) AS score FROM ln CROSS JOIN cls LEFT JOIN gain USING (doc_id, label))
    SELECT doc_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1""")  # fmt: skip
def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = written(_bags(spark, sf_dir), "bags")
    return topics.classify(bags, *_trained(spark, sf_dir, bags))


#: Models of this process by application, tables and parameters: queries of one model fit it once.
_FITTED: dict[tuple, gibbs.Model] = {}


def _fitted(spark: SparkSession, sf_dir: str, name: str, bags: Callable[[], DataFrame], features: Callable[[], DataFrame] | None = None, terms: Callable[[DataFrame], DataFrame] | None = None, **how) -> gibbs.Model:
    """The model ``name`` with these parameters, of all words or the ``terms`` of its bags.  Its rows are written, so each query reads them."""
    key = (spark.sparkContext.applicationId, sf_dir, name, run_key(name, how))
    if key not in _FITTED:
        found = bags()
        _FITTED[key] = gibbs.fit(found, features=features() if features else None, terms=terms(found) if terms else None, **how)
        forget(found)
    return _FITTED[key]


#: The reference's defaults are 50 topics, 1,000 sweeps, 200 of them before the first fit of the priors, one every 10.
SWEEPS = {"k": 10, "alpha_sum": 50.0, "iterations": 20, "burn_in": 5, "optimize_every": 5}


def _lda(spark: SparkSession, sf_dir: str, min_df: int = 5, stemming: bool = False, segments: bool = False, **how) -> gibbs.Model:
    """The model of whole documents, or of their paragraphs as documents of their own, of words or of stems."""

    def bags() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        if segments:
            parts = texts.segments(docs.where("doc_id IS NOT NULL"), "\n", keep=("lang",))
            docs = parts.select(F.concat_ws("#", "doc_id", "segment_id").alias("doc_id"), "lang", F.col("segment").alias("text"))
        return texts.topic_prefilter(docs, min_df, stop_words=STOP_WORDS, stemming=stemming)

    return _fitted(spark, sf_dir, f"lda {min_df} {stemming} {segments}", bags, **(SWEEPS | how))


def _shown(model: gibbs.Model, top: int = 20) -> DataFrame:
    return topics.smoothed_words(model.counts(), model.k, float(model.beta), top)


@query("lda_topics")
def lda_topics(spark: SparkSession, sf_dir: str, top: int = 20, **how) -> DataFrame:
    """Each topic's heaviest words."""
    return _shown(_lda(spark, sf_dir, **how), top)


@query("lda_doc_topics")
def lda_doc_topics(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return _lda(spark, sf_dir, **how).doc_topics()


@query("lda_tokens", f"WITH {PREFILTER} SELECT doc_id, term, tf::BIGINT AS n, tf::BIGINT AS places FROM pre")
def lda_tokens(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The state counted by document and word: its tokens are the bags', none lost and none twice."""
    state = _lda(spark, sf_dir, **how).state()
    return state.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.countDistinct("position").alias("places"))


@query("lda_counts", f"WITH {PREFILTER} SELECT term, sum(tf)::BIGINT AS n FROM pre GROUP BY term")
def lda_counts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The merged counts by word: every word is in the model as often as in the bags."""
    return _lda(spark, sf_dir, **how).counts().groupBy("term").agg(F.sum("n").alias("n"))


def _files(spark: SparkSession, sf_dir: str, **how) -> str:
    """The folder of the model's files, written once."""
    model = _lda(spark, sf_dir, **how)
    path = f"{shared_dir(spark)}/lexloom-topic-files-{run_key(sf_dir, how)}-{spark.sparkContext.applicationId}"
    if path not in _WRITTEN:
        topic_files.write_state(model, f"{path}/state")
        topic_files.write_doc_topics(model.doc_topics(), f"{path}/shares")
        topic_files.write_keys(_shown(model), topic_files.read_priors(spark, f"{path}/state").where("name = 'alpha'"), f"{path}/keys")
        _WRITTEN.add(path)
        atexit.register(removed, spark, path)
    return path


_WRITTEN: set[str] = set()


@query("topic_files_tokens", f"WITH {PREFILTER} SELECT doc_id, term, tf::BIGINT AS n FROM pre")
def topic_files_tokens(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The tokens of the model's state file."""
    return topic_files.read_state(spark, _files(spark, sf_dir, **how) + "/state").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("topic_files_shares", f"WITH {PREFILTER} SELECT DISTINCT doc_id, 10::BIGINT AS topics, 1.0::DOUBLE AS total FROM pre")
def topic_files_shares(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The shares of the model's file of shares: all topics of a document add up to one."""
    rows = topic_files.read_doc_topics(spark, _files(spark, sf_dir, **how) + "/shares")
    return rows.groupBy("doc_id").agg(F.countDistinct("topic").alias("topics"), F.round(F.sum("prop"), 6).alias("total"))


@query("topic_files_keys", "SELECT unnest(range(0, 10))::INT AS topic, 20::BIGINT AS n_words, true AS same")
def topic_files_keys(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The words of the model's file of keys are those of its state file and priors."""
    path = _files(spark, sf_dir, **how)
    priors = {(r["name"], r["topic"]): r["prior"] for r in topic_files.read_priors(spark, path + "/state").collect()}  # a row a topic
    state = topic_files.read_state(spark, path + "/state").groupBy("topic", "term").agg(F.count("*").alias("n"))
    mine = topics.smoothed_words(state, len(priors) - 1, priors["beta", None]).select("topic", "rank", F.col("term").alias("counted"))
    met = topic_files.read_keys(spark, path + "/keys").join(mine, ["topic", "rank"], "full")
    return met.groupBy("topic").agg(F.count("*").alias("n_words"), F.bool_and(F.col("term").eqNullSafe(F.col("counted"))).alias("same"))


@query("lda_diagnostics")
def lda_diagnostics(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Each topic's tokens, coherence of its words and share of documents that it dominates."""
    model = _lda(spark, sf_dir, **how)
    tokens = model.counts().groupBy("topic").agg(F.sum("n").alias("tokens"))
    bags = model.state().groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    coherent = topics.coherence(_shown(model, 10), bags)
    return tokens.join(coherent, "topic").join(topics.allocation(model.doc_topics()).select("topic", "ratio"), "topic")


@query("lda_segments")
def lda_segments(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Shares of documents from a model of their paragraphs, of stems."""
    rows = _lda(spark, sf_dir, segments=True, stemming=True, **how).doc_topics()
    parts = rows.select(F.substring_index("doc_id", "#", 1).cast("bigint").alias("doc_id"), F.col("doc_id").alias("segment_id"), "topic", "prop")
    return topics.segments_to_documents(parts)


@query("lda_by_label")
def lda_by_label(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return topics.label_means(_lda(spark, sf_dir, **how).doc_topics(), labels)


@query("lda_label_sums", f"WITH {PREFILTER} SELECT source AS label, round(count(DISTINCT p.doc_id) / count(DISTINCT d.doc_id), 6) AS total FROM documents d LEFT JOIN pre p USING (doc_id) GROUP BY source")
def lda_label_sums(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The means of a label over all topics: the share of its documents that are in the model."""
    return lda_by_label(spark, sf_dir, **how).groupBy("label").agg(F.round(F.sum("mean"), 6).alias("total"))


@query("lda_by_tag")
def lda_by_tag(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    tags = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("label"))
    docs = table(spark, sf_dir, "documents").join(tags.select("doc_id"), "doc_id", "left_semi")
    model = _fitted(spark, sf_dir, "lda_by_tag", lambda: texts.topic_prefilter(docs, stop_words=STOP_WORDS), **(SWEEPS | how))
    return topics.label_means(model.doc_topics(), tags)


_TAGGED = f"tagged AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), {PREFILTER.replace('FROM documents', 'FROM tagged')}"


@query("lda_tag_sums", f"WITH {_TAGGED}, tag AS (SELECT DISTINCT doc_id, 'quality' || quality AS label FROM labels) SELECT label, round(count(DISTINCT p.doc_id) / count(DISTINCT t.doc_id), 6) AS total FROM tag t LEFT JOIN pre p USING (doc_id) GROUP BY label")
def lda_tag_sums(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The same of tags, in the model of tagged documents."""
    return lda_by_tag(spark, sf_dir, **how).groupBy("label").agg(F.round(F.sum("mean"), 6).alias("total"))


def _union_model(spark: SparkSession, sf_dir: str, **how) -> gibbs.Model:
    """Two corpora in one model, of words that are neither rare nor everywhere."""

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    both = docs.unionByName(other)
    bags = lambda: written(frequency.term_frequencies(both, stop_words=STOP_WORDS), "bags")
    return _fitted(spark, sf_dir, "lda_union_prune", bags, terms=lambda found: texts.prune(found, both.count()), **(SWEEPS | how))


@query("lda_union_prune")
def lda_union_prune(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return _union_model(spark, sf_dir, **how).doc_topics()


_UNION = f"""two AS (SELECT doc_id, text, NULL AS lang, NULL AS source FROM documents UNION ALL SELECT -1 - item_id, text, NULL, NULL FROM benchmark), {TERMS.replace('FROM documents', 'FROM two')},
kept AS (SELECT term FROM bag GROUP BY term HAVING sum(tf) >= 3 AND count(*) <= 0.3 * (SELECT count(*) FROM two))"""


@query("lda_union_tokens", f"WITH {_UNION} SELECT doc_id, sum(tf)::BIGINT AS n FROM bag JOIN kept USING (term) GROUP BY doc_id")
def lda_union_tokens(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The tokens of each document of both corpora in the model."""
    return _union_model(spark, sf_dir, **how).doc_counts().groupBy("doc_id").agg(F.sum("n").alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = F.concat(F.lit("decade"), F.round(F.year("doc_date"), -1).cast("string"))
    return dated(spark, sf_dir).select("doc_id", F.explode(F.array(decade, F.regexp_replace("source", r"[\W_]+", ""), "lang")).alias("feature"))


def _dated_model(spark: SparkSession, sf_dir: str, **how) -> gibbs.Model:
    """Topics of dated documents under priors from decade, source and language."""
    own = lambda: texts.topic_prefilter(table(spark, sf_dir, "documents"), stop_words=STOP_WORDS).join(dated(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return _fitted(spark, sf_dir, "dmr", own, lambda: _features(spark, sf_dir), **(SWEEPS | {"optimize_every": 7} | how))


@query("dmr_feature_weights")
def dmr_feature_weights(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Feature weights, fitted together with the topics."""
    return _dated_model(spark, sf_dir, **how).feature_weights()


@query("dmr_features", f"""WITH {DATED}, f AS (SELECT unnest(['decade' || round(year(doc_date), -1)::INT, regexp_replace(source, '[^A-Za-z0-9]+', '', 'g'), lang]) AS feature FROM dated UNION SELECT 'default')
    SELECT unnest(range(0, 10))::INT AS topic, feature FROM (SELECT DISTINCT feature FROM f WHERE feature IS NOT NULL)""")  # fmt: skip
def dmr_features(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Each feature has a weight for each topic, a finite number."""
    return _dated_model(spark, sf_dir, **how).feature_weights().where("abs(weight) < 1e6").select("topic", "feature")


@query("dmr_tokens", f"WITH {PREFILTER}, {DATED} SELECT doc_id, sum(tf)::BIGINT AS n FROM pre WHERE doc_id IN (SELECT doc_id FROM dated) GROUP BY doc_id")
def dmr_tokens(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The tokens of every dated document in the conditioned model."""
    return _dated_model(spark, sf_dir, **how).doc_counts().groupBy("doc_id").agg(F.sum("n").alias("n"))


@query("dmr_external_weights")
def dmr_external_weights(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """The same for a corpus that comes as word counts: of documents with labels, quality as the feature."""

    def bags() -> DataFrame:
        counted = frequency.term_frequencies(table(spark, sf_dir, "documents"), stop_words=STOP_WORDS).select("doc_id", F.col("term").alias("word"), F.col("tf").alias("weight"))
        found = texts.word_count_corpus(counted, STOP_WORDS).select("doc_id", F.col("word").alias("term"), F.col("weight").alias("tf"))
        return found.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")

    features = lambda: table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("feature"))
    return _fitted(spark, sf_dir, "dmr_external", bags, features, **(SWEEPS | {"k": 5, "optimize_every": 7} | how)).feature_weights()
