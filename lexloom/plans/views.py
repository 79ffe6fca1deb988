"""Queries of views: ranges, sizes of n-grams, graphs of labels, ranks, offsets, items and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import phrases, timeline, topics, views
from lexloom.operators.layout import spread, written
from lexloom.plans import timeline as dated_plans
from lexloom.plans import topics as topic_plans
from lexloom.plans import words
from lexloom.plans.registry import DATED, STOP_LIST, STOP_WORDS, TERMS, TOKEN_LIST, query
from lexloom.plans.texts import PREFILTER
from lexloom.sources.tables import table

#: The tables that ad-hoc SQL sees.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Makes the tables temporary views for ``spark.sql``."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


_ADHOC = "SELECT d.lang, count(*) AS docs, sum(l.toxic) AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang"


@query("sql_over_views", _ADHOC.replace("sum(l.toxic)", "sum(l.toxic)::BIGINT"))
def sql_over_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("documents", "labels"))
    return spark.sql(_ADHOC)


for _n in (4, 5):

    @query(f"grams_{_n}", words.grams_sql(_n))
    def _grams(spark: SparkSession, sf_dir: str, n: int = _n) -> DataFrame:
        return words._grams(spark, sf_dir, n)


def _series_sql(n: int, days: int, start: str, end: str) -> str:
    every = " AND ".join(rf"regexp_full_match(w[i + {k}], '\p{{L}}+') AND w[i + {k}] NOT IN ({STOP_LIST})" for k in range(n))
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH {DATED}, {TOKEN_LIST.replace('FROM documents)', 'FROM dated)')},
    idoc AS (SELECT doc_id, ((doc_date - DATE '{start}') // {days})::INT AS interval FROM dated WHERE doc_date BETWEEN DATE '{start}' AND DATE '{end}'),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM toks),
    bag AS (SELECT doc_id, {joined} AS term, count(*) AS tf FROM g WHERE {every} GROUP BY ALL),
    islot AS (SELECT interval, term, count(*) AS df, sum(tf) AS tf FROM bag JOIN idoc USING (doc_id) GROUP BY ALL),
    slots AS (SELECT unnest(range(0, (DATE '{end}' - DATE '{start}') // {days} + 1))::INT AS interval),
    share AS (SELECT interval, term, df, tf / sum(tf) OVER (PARTITION BY interval) AS value FROM islot),
    mean AS (SELECT term, round(sum(value) / (SELECT count(*) FROM slots), 12) AS mean FROM share GROUP BY term HAVING sum(df) >= 3),
    best AS (SELECT term FROM (SELECT term, rank() OVER (ORDER BY mean DESC) AS r FROM mean) WHERE r <= 50)
    SELECT term, interval, round(coalesce(value, 0.0), 9) AS value FROM best CROSS JOIN slots LEFT JOIN share USING (term, interval)"""


def ngram_range(spark: SparkSession, sf_dir: str, n: int, days: int, start: str, end: str) -> DataFrame:
    found = timeline.ngram_series(dated_plans.dated(spark, sf_dir), days, n=n, top=50, min_df=3, stop_words=STOP_WORDS, start=start, end=end)
    return found.select("term", "interval", F.round("value", 9).alias("value"))


for _n in (2, 3, 4, 5):

    @query(f"ngrams_timeseries_{_n}", _series_sql(_n, 120, "1995-03-01", "1998-06-30"))
    def _series(spark: SparkSession, sf_dir: str, n: int = _n, days: int = 120, start: str = "1995-03-01", end: str = "1998-06-30") -> DataFrame:
        return ngram_range(spark, sf_dir, n, days, start, end)


@query("wordcloud_chrono_range", f"""WITH {DATED}, idoc AS (SELECT doc_id, text, lang, strftime(DATE '1996-01-01' + (((doc_date - DATE '1996-01-01') // 180) * 180)::INT, '%Y-%m-%d') AS source
    FROM dated WHERE doc_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'), {TERMS.replace('FROM documents)', 'FROM idoc)')}, f AS (SELECT source AS label, term, count(*) AS freq FROM term GROUP BY ALL)
    SELECT label, term, freq FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY freq DESC) AS r FROM f) WHERE r <= 100""")  # fmt: skip
def wordcloud_chrono_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_plans.wordcloud_chrono(spark, sf_dir, n=100, days=180, start="1996-01-01", end="1997-12-31")


_BIGRAM_BAG = rf"""{TOKEN_LIST}, g AS (SELECT doc_id, source, w, unnest(range(1, len(w))) AS i FROM toks),
bag AS (SELECT doc_id, source, w[i] || ' ' || w[i + 1] AS term, count(*) AS tf FROM g
    WHERE regexp_full_match(w[i], '\p{{L}}+') AND w[i] NOT IN ({STOP_LIST}) AND regexp_full_match(w[i + 1], '\p{{L}}+') AND w[i + 1] NOT IN ({STOP_LIST}) GROUP BY ALL)"""


@query("wordcloud_by_label_tfidf_bigrams", f"WITH {_BIGRAM_BAG}, {words.TFIDF}, {words.BY_LABEL_TFIDF.format(label='source')}")
def wordcloud_by_label_tfidf_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.wordcloud_by_label_tfidf(spark, sf_dir, gram=2)


@query("import_tokens", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+')) AS n_words, md5(array_to_string(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+'), ' ')) AS words_md5,
    len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n_plain FROM documents""")
def import_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", views.import_tokens(text).alias("w"), F.size(views.import_tokens(text, plain=True)).cast("bigint").alias("n_plain"))
    return found.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"), "n_plain")


_PRESET_SQL = " UNION ALL ".join(
    rf"SELECT '{p}' AS pattern, count(*) AS n, count(DISTINCT m) AS n_distinct FROM (SELECT unnest(regexp_extract_all(text, '{phrases.compile_pattern(p)}')) AS m FROM documents)" for p in phrases.PRESETS
)


@query("phrasenet_presets", _PRESET_SQL)
def phrasenet_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each named pattern matches: all of them in one pass."""
    docs = spread(table(spark, sf_dir, "documents"))
    found = F.array(*(F.struct(F.lit(p).alias("pattern"), F.regexp_extract_all(F.col("text"), F.lit(phrases.compile_pattern(p)), F.lit(0)).alias("found")) for p in phrases.PRESETS))
    rows = docs.select(F.explode(found).alias("x")).select("x.pattern", F.explode_outer("x.found").alias("m"))
    return rows.groupBy("pattern").agg(F.count("m").alias("n"), F.countDistinct("m").alias("n_distinct"))


_STREAM = topic_plans.STREAM
_MI = f"""dom AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prop DESC, topic) AS r FROM dt) WHERE r = 1),
lab AS (SELECT doc_id, coalesce(c.label, d.source) AS label FROM documents d LEFT JOIN (SELECT doc_id, min('quality' || quality) AS label FROM labels GROUP BY doc_id) c USING (doc_id)),
pl AS (SELECT label, bin AS interval, topic, count(*) AS n FROM dom JOIN db USING (doc_id) JOIN lab USING (doc_id) GROUP BY ALL),
met AS (SELECT x.label AS label_x, y.label AS label_y, x.topic AS tx, y.topic AS ty, sum(x.n * y.n)::DOUBLE AS n FROM pl x JOIN pl y ON x.interval = y.interval AND x.label < y.label GROUP BY ALL),
sh AS (SELECT label_x, label_y, n / sum(n) OVER (PARTITION BY label_x, label_y) AS p, sum(n) OVER (PARTITION BY label_x, label_y, tx) / sum(n) OVER (PARTITION BY label_x, label_y) AS px, sum(n) OVER (PARTITION BY label_x, label_y, ty) / sum(n) OVER (PARTITION BY label_x, label_y) AS py FROM met),
mi AS (SELECT label_x, label_y, round(greatest(sum(p * log2(p / (px * py))), 0.0), 6) AS mi FROM sh GROUP BY ALL),
node AS (SELECT row_number() OVER (ORDER BY label) - 1 AS id, label FROM (SELECT DISTINCT label FROM pl))"""


def _information(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    classes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("label"))
    own, _ = topic_plans._bins(spark, sf_dir)
    main = topics.dominant(topic_plans._doc_topics(spark, sf_dir))
    placed = main.join(own.withColumnRenamed("bin", "interval"), "doc_id").join(views.relabelled(docs, classes), "doc_id")
    return written(topics.mutual_information(placed).withColumn("mi", F.round("mi", 6)), "information")


@query("classified_information", f"WITH {_STREAM}, {_MI} SELECT x.label AS label_x, y.label AS label_y, coalesce(mi, 0.0) AS mi FROM node x JOIN node y ON x.label < y.label LEFT JOIN mi ON label_x = x.label AND label_y = y.label")
def classified_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of labels, a document's class in place of its label where it has one."""
    return _information(spark, sf_dir)


@query("information_graph", f"WITH {_STREAM}, {_MI} SELECT x.id AS source, y.id AS target, mi FROM mi JOIN node x ON x.label = label_x JOIN node y ON y.label = label_y WHERE mi > 0.01")
def information_graph(spark: SparkSession, sf_dir: str, least: float = 0.01) -> DataFrame:
    nodes, edges = views.graph(_information(spark, sf_dir), least)
    return edges.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"), "mi")


@query("range_with_metadata", f"WITH {DATED} SELECT doc_id, source FROM dated WHERE doc_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND doc_id IN (SELECT doc_id FROM labels)")
def range_with_metadata(spark: SparkSession, sf_dir: str, start: str = "1995-01-01", end: str = "1998-12-31") -> DataFrame:
    """Documents in a range that have metadata; others are dropped after the range filter."""
    kept = timeline.in_range(dated_plans.dated(spark, sf_dir), start, end)
    return kept.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("first_collection", "SELECT c_mktsegment AS kind, min('N' || c_nationkey) AS collection FROM customer GROUP BY 1")
def first_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection of each kind: the first in name order, whatever the order of rows."""
    name = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.min(name).alias("collection"))


@query("topic_rank_coherence", f"""WITH {topic_plans.STATE}, tw AS (SELECT topic, term, sum(n) AS n FROM state GROUP BY ALL),
    top AS (SELECT topic, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS rank FROM tw) WHERE rank <= 10),
    d AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
    j AS (SELECT a.topic, a.rank AS ra, b.rank AS rb, count(*) AS n FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank JOIN bag x ON x.term = a.term JOIN bag y ON y.term = b.term AND y.doc_id = x.doc_id GROUP BY ALL),
    c AS (SELECT a.topic, round(sum(ln((coalesce(j.n, 0) + 1) / df)), 6) AS coherence FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank JOIN d ON d.term = a.term LEFT JOIN j ON j.topic = a.topic AND j.ra = a.rank AND j.rb = b.rank GROUP BY a.topic)
    SELECT topic, coherence FROM c ORDER BY (coherence = 0)::INT, coherence DESC, topic LIMIT 5""")  # fmt: skip
def topic_rank_coherence(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return views.by_coherence(topic_plans.topic_coherence(spark, sf_dir), k)


@query("topic_silhouette", f"""WITH {_STREAM}, st AS (SELECT bin, topic, value, sum(value) OVER (PARTITION BY bin ORDER BY topic ROWS UNBOUNDED PRECEDING) AS high, sum(value) OVER (PARTITION BY bin) AS top FROM str)
    SELECT bin, topic, round(high - value + ((SELECT max(top) FROM st) - top) / 2, 6) AS low, round(high + ((SELECT max(top) FROM st) - top) / 2, 6) AS high FROM st""")  # fmt: skip
def topic_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.silhouette(topics.stacked(topic_plans._stream(spark, sf_dir)))
    return rows.select("bin", "topic", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("topic_root_stream", f"WITH {_STREAM} SELECT bin, topic, CASE WHEN docs > 0 THEN round(value * sqrt(docs), 9) ELSE 0.0 END AS value FROM str")
def topic_root_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.root_stream(topic_plans._stream(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query("topic_years", f"WITH {_STREAM} SELECT bin, topic, round(value, 9) AS value, docs FROM str WHERE bin BETWEEN 1995 AND 1997")
def topic_years(spark: SparkSession, sf_dir: str, years: str = "1995-1997") -> DataFrame:
    """The stream between the years of a text ``YYYY-YYYY``; all of it if the text is none."""
    rows, ends = topic_plans._stream(spark, sf_dir), timeline.years(years)
    kept = rows.where(F.col("bin").between(*ends)) if ends else rows
    return kept.select("bin", "topic", F.round("value", 9).alias("value"), "docs")


@query("topic_documents", f"WITH {_STREAM} SELECT bin, topic, doc_id, round(prop, 9) AS prop FROM dt JOIN db USING (doc_id)")
def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contribute to each point of the stream, a row each."""
    own, _ = topic_plans._bins(spark, sf_dir)
    return topic_plans._doc_topics(spark, sf_dir).join(own, "doc_id").select("bin", "topic", "doc_id", F.round("prop", 9).alias("prop"))


@query("topic_drilldown_category", f"WITH {topic_plans.STATE}, dom AS (SELECT doc_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prop DESC, topic) AS r FROM dt) WHERE r = 1) SELECT doc_id, lang, topic AS main_topic FROM documents LEFT JOIN dom USING (doc_id) WHERE source = 'src1'")
def topic_drilldown_category(spark: SparkSession, sf_dir: str, category: str = "src1") -> DataFrame:
    main = topics.dominant(topic_plans._doc_topics(spark, sf_dir)).withColumnRenamed("topic", "main_topic")
    return table(spark, sf_dir, "documents").where(F.col("source") == category).select("doc_id", "lang").join(main, "doc_id", "left")


@query("paired_list", """SELECT doc_id, unnest([{'a': l[2 * i + 1], 'b': l[2 * i + 2]} FOR i IN range(0, len(l) // 2)], recursive := true) FROM (SELECT doc_id, string_split(lang || ',' || source || ',' || doc_id || ',x,' || lang, ',') AS l FROM documents)""")
def paired_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.split(F.concat_ws(",", "lang", "source", F.col("doc_id").cast("string"), F.lit("x"), "lang"), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(views.paired(items)).alias("p")).select("doc_id", "p.a", "p.b")


@query("nested_groups", "SELECT r_regionkey, unnest(flatten([[n], [n || '/a', n || '/b']])) AS name FROM (SELECT r_regionkey, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey)")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups within groups, a row for each member."""
    n = F.col("n_name")
    groups = F.array(F.array(n), F.array(F.concat(n, F.lit("/a")), F.concat(n, F.lit("/b"))))
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("r_regionkey", F.explode(F.flatten(groups)).alias("name"))


@query("series_entries", f"WITH {DATED}, c AS (SELECT source, strftime(doc_date, '%Y') AS x, count(*) AS y FROM dated GROUP BY ALL) SELECT source, string_agg(x || '=' || y, ' ' ORDER BY x) AS points FROM c GROUP BY source")
def series_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's yearly counts as a list of points."""
    counts = dated_plans.dated(spark, sf_dir).groupBy("source", F.date_format("doc_date", "yyyy").alias("x")).agg(F.count("*").alias("y"))
    points = counts.groupBy("source").agg(views.entries(F.map_from_entries(F.collect_list(F.struct("x", "y")))).alias("p"))  # a point a year
    return points.select("source", F.array_join(F.transform("p", lambda e: F.concat(e["x"], F.lit("="), e["y"].cast("string"))), " ").alias("points"))


@query("item_metadata", """SELECT o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y') AS year, coalesce(min('N' || c_nationkey), 'library') AS label
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20 GROUP BY ALL""")  # fmt: skip
def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey < 20")
    items = orders.select(F.col("o_orderkey").alias("item_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    owners = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("collection"))
    return views.item_metadata(items, owners)


@query("typed_manifest", """WITH p AS (SELECT page_id AS item_id, 'page' AS name, CASE WHEN url LIKE 'https%' THEN 'text/html' ELSE 'application/pdf' END AS mime, 0 AS part FROM pages
    UNION ALL SELECT conv_id, 'note', 'text/plain', 1 FROM conversations UNION ALL SELECT doc_id, 'page', 'text/plain', 2 FROM documents UNION ALL SELECT doc_id, 'tag', 'application/x-tag', 3 FROM labels)
    SELECT item_id, name, arg_min(mime, (part, mime)) AS mime FROM p WHERE mime IN ('text/html', 'text/plain') GROUP BY item_id, name""")  # fmt: skip
def typed_manifest(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("text/html", "text/plain")) -> DataFrame:
    """Attachments, notes, stand-alone files and tags of the chosen types; a name an item already has is ignored."""
    mime = F.when(F.col("url").startswith("https"), "text/html").otherwise("application/pdf")
    part = lambda name, key, what, kind: table(spark, sf_dir, name).select(F.col(key).alias("item_id"), F.lit(what).alias("name"), kind.alias("mime"))
    parts = [part("pages", "page_id", "page", mime), part("conversations", "conv_id", "note", F.lit("text/plain")), part("documents", "doc_id", "page", F.lit("text/plain")), part("labels", "doc_id", "tag", F.lit("application/x-tag"))]
    return views.manifest(parts, spark.createDataFrame([(k,) for k in kinds], "mime string"))


@query("lda_share_sums", f"WITH {PREFILTER} SELECT DISTINCT doc_id, 10::BIGINT AS topics, 1.0::DOUBLE AS total FROM pre")
def lda_share_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invariant of the fitted model: every document's shares of all topics add up to one."""
    rows = topic_plans.lda_doc_topics(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count_if((F.col("prop") >= 0) & (F.col("prop") <= 1)).alias("topics"), F.round(F.sum("prop"), 6).alias("total"))


@query("lda_word_order", "SELECT unnest(range(0, 10))::INT AS topic, 20::BIGINT AS n_words, true AS descends, true AS is_share")
def lda_word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another: each topic has its words once, by falling weights that are shares."""
    words_ = topic_plans.lda_topics(spark, sf_dir).groupBy("topic").agg(F.countDistinct("term").alias("n_words"), F.sort_array(F.collect_list(F.struct("rank", "prob"))).alias("p"))
    falls = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["prob"] <= F.get("p", i - 1)["prob"])
    share = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["prob"])
    return words_.select("topic", "n_words", falls.alias("descends"), ((share > 0) & (share <= 1)).alias("is_share"))
