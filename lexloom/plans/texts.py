"""Queries over getting, joining, pruning and searching texts."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import frequency, incremental, patterns, texts
from lexloom.operators.layout import by_document, removed, shared_dir, spread, written
from lexloom.plans.registry import DATED, STOP_LIST, STOP_WORDS, TERMS, TOKEN_LIST, query
from lexloom.plans.timeline import dated
from lexloom.sources import runs
from lexloom.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.term_frequencies(_docs(spark, sf_dir), stop_words=STOP_WORDS)


@query("html_extract", r"""SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->', '', 'g'), '<[!?/]?[A-Za-z][^>]*>', '', 'g'), '&#?[A-Za-z0-9]+;?', '', 'g') AS t FROM pages)""")  # fmt: skip
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = texts.strip_html(F.col("html"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", plain.alias("t")).select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text_md5"))


@query("concat_parts", "SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS text_md5, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.concat_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "\n").select("conv_id", F.md5("text").alias("text_md5"), "n_parts")


@query("segments", """WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(s) - length(replace(s, ' ', '')) > 5) AS l FROM documents)
    SELECT doc_id, doc_id::VARCHAR || '.' || (i - 1)::VARCHAR AS segment_id, md5(l[i]) AS segment_md5 FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""")  # fmt: skip
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.segments(_docs(spark, sf_dir), "\n").select("doc_id", "segment_id", F.md5("segment").alias("segment_md5"))


@query("corpus_union_dedup", """WITH u AS (SELECT doc_id AS id, 0 AS src, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark)
    SELECT id, src, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, text) AS r FROM u) WHERE r = 1""")  # fmt: skip
def corpus_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit(0).alias("src"), "text")
    other = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(1).alias("src"), "text")
    return texts.union_first([first, other], "id", "text").select("id", "src", F.md5("text").alias("text_md5"))


@query("word_count_corpus", rf"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_ ]+', '', 'g'), ' +'), lambda w: w <> '')) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*) AS weight FROM t WHERE word NOT IN ({STOP_LIST}) GROUP BY ALL)
    SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM c GROUP BY doc_id HAVING sum((length(word) + 1) * weight) >= 20)""")  # fmt: skip
def word_count_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = by_document(_docs(spark, sf_dir), "text").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("word"))
    return texts.word_count_corpus(words.groupBy("doc_id", "word").agg(F.count("*").alias("weight")), STOP_WORDS)


@query("prune_vocab", f"WITH {TERMS} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM bag GROUP BY term HAVING sum(tf) >= 3 AND count(*) <= 0.3 * (SELECT count(*) FROM documents)")
def prune_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.prune(_bags(spark, sf_dir), _docs(spark, sf_dir).count())


PREFILTER = f"""{TOKEN_LIST.replace("'', 'g'", "' ', 'g'")}, word AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) WHERE length(term) >= 3 AND term NOT IN ({STOP_LIST}) GROUP BY ALL),
wlen AS (SELECT doc_id, sum(tf) AS len FROM word GROUP BY doc_id),
wstat AS (SELECT term, count(*) AS df, max(tf / len) * log10((SELECT count(*) FROM documents) / count(*)) AS score FROM word JOIN wlen USING (doc_id) GROUP BY term),
wcut AS (SELECT score AS least FROM (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS k, count(*) OVER () AS v FROM wstat) WHERE k = least(5000, (v * 7) // 10, v - 1)),
wkept AS (SELECT w.* FROM word w JOIN wstat USING (term), wcut WHERE score >= least AND df >= 5),
pre AS (SELECT * FROM wkept WHERE doc_id IN (SELECT doc_id FROM wkept GROUP BY doc_id HAVING sum(tf) > 25))"""


@query("topic_prefilter", f"WITH {PREFILTER} SELECT doc_id, term, tf FROM pre")
def topic_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.topic_prefilter(_docs(spark, sf_dir), stop_words=STOP_WORDS)


@query("inverted_index", f"WITH {TERMS} SELECT DISTINCT term, doc_id FROM bag")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.inverted_index(_bags(spark, sf_dir))


#: Patterns over words.
PATTERNS = ("^than.*ing$", "ion", "^(un|re)[a-z]+ed$", "e{2}", "(ab)+c?", "^wor(d|ld)", "ment$")


@query("pattern_search", f"WITH {TERMS} " + " UNION ALL ".join(f"SELECT {i} AS pattern, term, count(*) AS docs FROM bag WHERE regexp_matches(term, '{p}') GROUP BY term" for i, p in enumerate(PATTERNS)))
def pattern_search(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = PATTERNS) -> DataFrame:
    """Words of the corpus that match patterns, and how many documents have them; an index of pieces narrows each pattern first."""
    df = written(_bags(spark, sf_dir).groupBy("term").agg(F.count("*").alias("docs")), "index-terms")
    index = written(patterns.piece_index(df), "index-pieces")
    found = None
    for i, p in enumerate(wanted):
        rows = patterns.matching_terms(df, index, p).select(F.lit(i).alias("pattern"), "term")
        found = rows if found is None else found.unionByName(rows)
    return found.join(df, "term").select("pattern", "term", "docs")


@query("incremental_counts", f"WITH {TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM bag GROUP BY term")
def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the corpus as it was, made to follow it: a tenth came, a tenth changed and a tenth as many went."""
    docs = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 < 2, 1).otherwise(0).alias("version"), "text")
    kind = F.col("doc_id") % 10
    before = docs.where(kind > 0).select("doc_id", F.lit(0).alias("version"), F.when(kind == 1, F.lit("an older text")).otherwise(F.col("text")).alias("text"))
    gone = docs.where(kind == 2).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("version"), "text")
    kept = written(incremental.versioned_bags(before.unionByName(gone), stop_words=STOP_WORDS), "kept-bags")
    return incremental.totals(incremental.updated(kept, docs, stop_words=STOP_WORDS))


@query("logged_runs", "SELECT 'languages' AS processor, 'all' AS collection, 'done' AS status, count(DISTINCT lang) AS rows FROM documents UNION ALL SELECT 'sources', 'all', 'done', count(DISTINCT source) FROM documents UNION ALL SELECT 'sources', 'en', 'done', count(DISTINCT source) FROM documents WHERE lang = 'en'")
def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of three runs, one of them run twice and one failed before: the newest finished ones."""
    import uuid

    path = f"{shared_dir(spark)}/lexloom-runs-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    docs = _docs(spark, sf_dir)
    by = lambda c, rows: (lambda: rows.groupBy(c).agg(F.count("*").alias("n")))
    for k, (name, collection, build) in enumerate((("languages", "all", by("lang", docs)), ("sources", "all", by("source", docs)), ("sources", "all", by("source", docs)), ("sources", "en", by("source", docs.where("lang = 'en'"))))):
        runs.logged(spark, f"{path}/log", name, collection, build, f"{path}/{k}", least=1)
    return runs.latest(spark, f"{path}/log").select("processor", "collection", F.lit("done").alias("status"), "rows")


@query("index_search", f"WITH {TERMS} SELECT DISTINCT doc_id FROM bag WHERE term = 'with' OR regexp_matches(term, '^than.*ing$')")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.search(_bags(spark, sf_dir), ("with", "^than.*ing$"))


@query("library_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(source), 'src1')")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.library_search(_docs(spark, sf_dir), {"text": "tion THE", "source": "SRC1"}).select("doc_id", "lang")


#: SQL: every ' and ', also where two share a blank; a is where the word begins, b is past it.
_SPAN_SQL = """i AS (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS a FROM documents WHERE contains(text, ' and ')),
h AS (SELECT doc_id, text, a, a + 3 AS b FROM i WHERE substr(text, a, 5) = ' and ')"""


@query("context_window", rf"WITH {_SPAN_SQL} SELECT doc_id, regexp_replace(substr(text, greatest(a - 15, 0) + 1, least(b + 15, length(text)) - greatest(a - 15, 0)), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g') AS context FROM h")
def context_window(spark: SparkSession, sf_dir: str, word: str = "and", around: int = 15) -> DataFrame:
    rows = texts.surroundings(spread(_docs(spark, sf_dir)), word, around)
    return rows.select("doc_id", texts.signless(F.concat("left", "word", "right")).alias("context"))


@query("context_paragraph", rf"WITH {_SPAN_SQL} SELECT doc_id, regexp_extract(substr(text, 1, a), '([^\n]{{0,50}})$', 1) || substr(text, a + 1, b - a) || regexp_extract(substr(text, b + 1, 50), '^([^\n]*)', 1) AS context FROM h")
def context_paragraph(spark: SparkSession, sf_dir: str, word: str = "and", around: int = 50) -> DataFrame:
    rows = texts.surroundings(spread(_docs(spark, sf_dir)), word, around)
    return rows.select("doc_id", F.concat(F.substring_index("left", "\n", -1), "word", F.substring_index("right", "\n", 1)).alias("context"))


@query("stemmed_frequencies")
def stemmed_frequencies(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """Stems of all documents, each by the rules of its language."""
    return texts.stemmed_frequencies(frequency.term_frequencies(_docs(spark, sf_dir), "lang", stop_words=STOP_WORDS), least)


@query("stemmed_totals", f"WITH {TERMS} SELECT lang, count(DISTINCT term) AS n_terms, count(*) AS cf FROM term GROUP BY lang")
def stemmed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language its words in the stem table and their number in the texts: stemming loses none and repeats none."""
    by_term = frequency.term_frequencies(_docs(spark, sf_dir), "lang", stop_words=STOP_WORDS).groupBy("lang", "term").agg(F.sum("tf").alias("cf"))
    return texts.with_stems(by_term).where("stem IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("cf").alias("cf"))


@query("ris_export", f"""WITH {DATED} SELECT doc_id, 'TY  - GEN' || chr(10) || 'TI  - ' || text[:20] || chr(10) || 'AU  - ' || source || chr(10) || 'PY  - ' || strftime(doc_date, '%Y/%m/%d') || chr(10) || 'ID  - ' || doc_id || chr(10) || 'ER  - ' AS record FROM dated""")
def ris_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = texts.ris("GEN", F.substring("text", 1, 20), F.col("source"), F.date_format("doc_date", "yyyy/MM/dd"), F.col("doc_id").cast("string"))
    return dated(spark, sf_dir).select("doc_id", record.alias("record"))


@query("file_names", r"""SELECT doc_id, regexp_replace(regexp_replace(replace(source || '-' || lang || '-' || text[:90], '_', '-'), ' ', '_', 'g'), '[^A-Za-z0-9_\-]', '', 'g')[:64] AS name,
    regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9_]+', '_', 'g') AS key FROM documents""")  # fmt: skip
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = texts.file_name(F.col("source"), F.col("lang"), F.substring("text", 1, 90))
    return _docs(spark, sf_dir).select("doc_id", name.alias("name"), texts.key_name(F.concat("source", F.lit(" / "), "lang")).alias("key"))


@query("uri_names", """SELECT page_id, list_last(string_split(url, '/')) AS last, left(replace(replace(url_decode(replace(url, 'https://', '')), '_', ' '), '+', ' '), 20) AS name FROM pages""")
def uri_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.last_segment(F.col("url")).alias("last"), texts.display_name(F.col("url"), "https://").alias("name"))


@query("frequency_labels", f"""WITH {TERMS}, f AS (SELECT term, count(*) AS freq FROM term GROUP BY term)
    SELECT term, term || ': ' || freq AS label, round(12 + 36 * log2(1 + (freq - lo) / greatest(hi - lo, 1)), 6) AS size FROM f, (SELECT min(freq) AS lo, max(freq) AS hi FROM f)""")  # fmt: skip
def frequency_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    freqs = frequency.term_rows(_docs(spark, sf_dir), stop_words=STOP_WORDS).groupBy("term").agg(F.count("*").alias("freq"))
    ends = freqs.agg(F.min("freq").alias("lo"), F.max("freq").alias("hi"))
    size = 12 + 36 * F.log2(1 + (F.col("freq") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    return freqs.join(F.broadcast(ends)).select("term", F.format_string("%s: %d", "term", "freq").alias("label"), F.round(size, 6).alias("size"))  # one row
