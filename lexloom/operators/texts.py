"""Getting texts: extraction, joining parts, segments, unions, pruning, search, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.snowball import stem
from lexloom.operators import frequency
from lexloom.operators.layout import by_document, text_parts, written


def strip_html(html: Column) -> Column:
    """The character data of a page, run together: comments, tags and entity references go, script and style bodies stay."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    plain = F.regexp_replace(plain, r"<[!?/]?[A-Za-z][^>]*>", "")
    return F.regexp_replace(plain, r"&#?[A-Za-z0-9]+;?", "")


def concat_parts(parts: DataFrame, key: str, order: str, sep: str = "") -> DataFrame:
    """One text of all parts of a key, in order: ``(key, text, n_parts)``."""
    both = F.sort_array(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"))))
    joined = parts.groupBy(key).agg(both.alias("p"))
    return joined.select(key, F.array_join("p.text", sep).alias("text"), F.size("p").cast("bigint").alias("n_parts"))


def segments(docs: DataFrame, sep: str = "\n\n", min_blanks: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, segment_id, *keep, segment)``: parts of more than ``min_blanks`` blanks, numbered after that filter."""
    parts = F.filter(F.split("text", sep), lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) > min_blanks)
    rows = docs.select("doc_id", *keep, F.posexplode(parts).alias("i", "segment"))
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("i").cast("string")).alias("segment_id"), *keep, "segment")


def union_first(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """All frames' rows, of equal keys the first frame's first."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_source", order))
    return every.withColumn("_first", first).where(F.col("_first") == 1).drop("_first", "_source")


def word_count_corpus(counts: DataFrame, stop_words: tuple[str, ...] = (), least_chars: int = 20) -> DataFrame:
    """``(doc_id, word, weight)`` rows without stop words, of documents whose words would fill ``least_chars`` characters."""
    kept = counts.where(~F.col("word").isin(*stop_words)) if stop_words else counts
    long = kept.groupBy("doc_id").agg(F.sum((F.length("word") + 1) * F.col("weight")).alias("chars")).where(F.col("chars") >= least_chars)
    return kept.join(long.select("doc_id"), "doc_id", "left_semi")


def prune(bags: DataFrame, n_documents: int, min_count: int = 3, max_df: float = 0.3) -> DataFrame:
    """``(term, cf, df)`` of terms that are neither rare nor everywhere."""
    stats = bags.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return stats.where((F.col("cf") >= min_count) & (F.col("df") <= max_df * n_documents))


def topic_prefilter(docs: DataFrame, min_df: int = 5, min_length: int = 3, min_tokens: int = 25, stop_words: tuple[str, ...] = (), stemming: bool = False) -> DataFrame:
    """The bags that topic models train on: ``(doc_id, term, tf)``.

    Terms pass by length, document frequency and the inclusive tf-idf
    threshold; then documents of ``min_tokens`` tokens or fewer go.  With
    ``stemming`` terms are the stems of words in the document's ``lang``; stems are
written too, and their bags dealt by document once, for sums and lengths.  Bags
    are written with their document's length while they are dealt by document,
    and the terms that pass are written, so that their size is known before the
    join: few enough are sent to the bags, which then aren't shuffled again.
    """
    words = F.filter(X.tokens(F.col("text"), " "), lambda w: (F.length(w) >= min_length) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    keys = ["doc_id", "lang"] if stemming else ["doc_id"]
    parts = text_parts(docs)
    rows = by_document(docs, *keys[1:], "text", parts=parts).select(*keys, F.explode(words).alias("term"))
    counts = rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    if stemming:
        counts = written(counts, "unstemmed")
        stemmed = with_stems(counts, written(stems(counts), "stems")).where(F.length("stem") >= min_length).repartition(parts, "doc_id")
        counts = stemmed.groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    own = Window.partitionBy("doc_id")
    bags = written(counts.withColumn("len", F.sum("tf").over(own)), "bags")
    scored = written(frequency.relative_tfidf(bags.withColumn("rel", F.col("tf") / F.col("len")), docs.count()), "scored")
    kept = written(frequency.above_threshold(scored, frequency.score_threshold(scored), min_df, strict=False).select("term"), "kept-terms")
    rest = bags.join(kept, "term", "left_semi").withColumn("n", F.sum("tf").over(own))
    return rest.where(F.col("n") > min_tokens).select("doc_id", "term", "tf")


def inverted_index(bags: DataFrame) -> DataFrame:
    """``(term, doc_id)`` postings, a row each: a frequent term's documents are no single value."""
    return bags.select("term", "doc_id").distinct()


def search(bags: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """``(doc_id)`` of documents with any term; each is an exact word or, if it holds signs, a regular expression over all words."""
    hit = F.lit(False)
    for t in terms:
        hit |= (F.col("term") == t) if t.isalnum() else F.col("term").rlike(t)
    return bags.where(hit).select("doc_id").distinct()


def library_search(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows with, in either case, a column's text of ``wanted`` in any of these columns."""
    hit = F.lit(False)
    for c, query in wanted.items():
        hit |= F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
    return df.where(hit)


def spans(docs: DataFrame, word: str) -> DataFrame:
    """``(doc_id, text, a, b)``: every occurrence of ``word`` between blanks, from its first to past its last character."""
    parts = F.split("text", f" (?={re.escape(word)} )")  # each part but the first begins with the word
    rows = docs.select("doc_id", "text", parts.alias("parts")).where(F.size("parts") > 1)
    ends = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda x: F.length(x) + 1)
    at = F.aggregate(ends, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.when(F.size(out) > 0, F.element_at(out, -1)).otherwise(0))))
    return rows.select("doc_id", "text", F.explode(at).alias("a")).withColumn("b", F.col("a") + len(word))


def surroundings(docs: DataFrame, word: str, around: int) -> DataFrame:
    """``(doc_id, left, word, right)`` of every occurrence of ``word`` between blanks, with up to ``around`` characters on each side.

    Cut from the neighbouring parts of the text, so no occurrence carries the whole text.
    """
    parts = F.split("text", f" (?={re.escape(word)} )")  # each part but the first begins with the word
    n = len(word)
    ends = F.transform(parts, lambda x: F.right(x, F.lit(around)))
    begins = F.transform(parts, lambda x: F.substring(x, 1, n + around))
    rows = docs.select("doc_id", ends.alias("ends"), begins.alias("begins")).where(F.size("begins") > 1)

    def one(i: Column) -> Column:
        # a part and its blank are a character at least, so ``around`` parts are enough
        first = F.greatest(i - around, F.lit(1))
        left = F.right(F.concat(F.array_join(F.slice("ends", first, i - first), " "), F.lit(" ")), F.lit(around))
        right = F.substring(F.array_join(F.slice("begins", i, around + 1), " "), n + 1, around)
        return F.struct(left.alias("left"), right.alias("right"))

    found = rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("begins")), one)).alias("s"))
    return found.select("doc_id", "s.left", F.lit(word).alias("word"), "s.right")


def signless(cut: Column) -> Column:
    """A context with signs as blanks."""
    return F.regexp_replace(cut, r"[^\p{L}\p{N}_ ]", " ")


def stems(vocabulary: DataFrame) -> DataFrame:
    """``(lang, term, stem)``: each distinct word of a language is stemmed once, words of languages without a stemmer stay."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            pairs = list(zip(b.column("lang").to_pylist(), b.column("term").to_pylist()))
            found = [None if w is None else stem(w, lang) for lang, w in pairs]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("term"), pa.array(found, pa.string())], names=["lang", "term", "stem"])

    return vocabulary.select("lang", "term").distinct().mapInArrow(run, "lang string, term string, stem string")


def with_stems(counts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``counts`` with the ``stem`` of each row's ``term`` in its ``lang``; the vocabulary is stemmed, not the rows, unless ``table`` has its stems already."""
    table = (stems(counts) if table is None else table).withColumnRenamed("lang", "_lang").withColumnRenamed("term", "_term")
    return counts.join(table, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("term") == F.col("_term"))).drop("_lang", "_term")


def stemmed_frequencies(bags: DataFrame, least: int = 4) -> DataFrame:
    """``(lang, stem, cf)`` of ``(lang, term, tf)`` bags over stems of ``least`` letters or more."""
    by_term = bags.groupBy("lang", "term").agg(F.sum("tf").alias("cf"))
    return with_stems(by_term).where(F.length("stem") >= least).groupBy("lang", "stem").agg(F.sum("cf").alias("cf"))


def file_name(creator: Column, year: Column, title: Column) -> Column:
    """creator-year-title with ``_`` as ``-``, blanks as ``_`` and other signs left out, 64 characters at most."""
    joined = F.concat_ws("-", creator, year, title)
    return F.substring(F.regexp_replace(F.regexp_replace(F.replace(joined, F.lit("_"), F.lit("-")), " ", "_"), r"[^A-Za-z0-9_\-]", ""), 1, 64)


def key_name(text: Column) -> Column:
    return F.regexp_replace(text, r"\W+", "_")


def last_segment(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def display_name(uri: Column, prefix: str) -> Column:
    """A resource's name: prefix off, decoded, ``_`` as blank, 20 characters."""
    return F.substring(F.replace(F.url_decode(F.replace(uri, F.lit(prefix), F.lit(""))), F.lit("_"), F.lit(" ")), 1, 20)


def ris(kind: str, title: Column, author: Column, date: Column, key: Column) -> Column:
    """A bibliographic record."""
    lines = [F.lit(f"TY  - {kind}"), F.concat(F.lit("TI  - "), title), F.concat(F.lit("AU  - "), author), F.concat(F.lit("PY  - "), date), F.concat(F.lit("ID  - "), key), F.lit("ER  - ")]
    return F.concat_ws("\n", *lines)
