"""Term bags and the statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators.layout import by_document, spread, written


def _exploded(docs: DataFrame, *keep: str, n: int = 1, stop_words: tuple[str, ...] = (), sep: str = "") -> DataFrame:
    words = X.tokens(F.col("text"), sep)
    if n == 1:
        terms = F.filter(words, lambda w: X.admissible_word(w, stop_words))
    else:
        terms = F.transform(F.filter(X.ngrams(words, n), lambda g: X.admissible(g, stop_words)), lambda g: F.array_join(g, " "))
    return docs.select(*keep, F.explode(terms).alias("term"))


def term_rows(docs: DataFrame, *keep: str, n: int = 1, stop_words: tuple[str, ...] = (), sep: str = "") -> DataFrame:
    """One row ``(*keep, term)`` for each admissible n-gram occurrence."""
    return _exploded(spread(docs), *keep, n=n, stop_words=stop_words, sep=sep)


def term_frequencies(docs: DataFrame, *keep: str, **how) -> DataFrame:
    """The bag of each document: ``(doc_id, *keep, term, tf)``; rows stay dealt by document."""
    rows = _exploded(by_document(docs, *keep, "text"), "doc_id", *keep, **how)
    return rows.groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def relative(bags: DataFrame) -> DataFrame:
    """Bags with ``rel``, a term's share of its document."""
    return bags.withColumn("rel", F.col("tf") / F.sum("tf").over(Window.partitionBy("doc_id")))


def tfidf(bags: DataFrame, n_documents: int) -> DataFrame:
    """``(term, df, cf, score)``: largest relative frequency times log10 of N / df.  N counts empty documents too."""
    return relative_tfidf(relative(bags), n_documents)


def relative_tfidf(rel: DataFrame, n_documents: int) -> DataFrame:
    """``tfidf`` of bags that have their ``rel``."""
    stats = rel.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("rel").alias("top"))
    return stats.select("term", "df", "cf", (F.col("top") * F.log10(F.lit(float(n_documents)) / F.col("df"))).alias("score"))


def score_threshold(scored: DataFrame, most: int = 5000) -> float:
    """The score that the 70 % best, ``most`` at most, reach.

    A bounded top-k finds it: the vocabulary is never sorted whole.
    """
    v = scored.count()
    if not v:
        return 0.0
    k = min(most, v * 7 // 10, v - 1)
    return scored.select("score").orderBy(F.desc("score")).limit(k + 1).agg(F.min("score")).first()[0]


def above_threshold(scored: DataFrame, least: float, min_df: int = 3, strict: bool = True) -> DataFrame:
    """Word clouds keep ``score > least, df > 3``; topic models ``score >= least, df >= min_df``."""
    score, df = F.col("score"), F.col("df")
    return scored.where((score > least) & (df > min_df) if strict else (score >= least) & (df >= min_df))


def top_with_ties(df: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """Rows whose ``value`` is at least the n-th largest (of each ``by`` group).

    A window without keys would sort everything in one task, so without
    ``by`` the n-th largest value is found first and compared.
    """
    if by:
        ranked = df.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))))
        return ranked.where(F.col("_rank") <= n).drop("_rank")
    least = df.select(value).orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("_least"))
    return df.join(F.broadcast(least), F.col(value) >= F.col("_least"), "inner").drop("_least")  # one row


def most_extreme(df: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """Values from the n/2-th largest up, or below the (n/2 + 1)-th smallest (the largest, if there are fewer).

    Both edges come from the few most extreme rows of each group, which are
    cut before the exchange, so that no task sorts a whole group.
    """
    half, keys, df = n // 2, list(by), written(df, "ranked")
    first = lambda order, k: df.select(*keys, value).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= k)
    high = first(F.desc(value), half).groupBy(*keys).agg(F.min(value).alias("_high"))
    low = first(F.asc(value), half + 1).groupBy(*keys).agg(F.max(F.when(F.col("_n") == half + 1, F.col(value))).alias("_low"))
    most = df.groupBy(*keys).agg(F.max(value).alias("_most"))
    edges = most.join(high, keys).join(low, keys).select(*keys, "_high", F.coalesce("_low", "_most").alias("_low"))
    return df.join(edges, keys).where((F.col(value) >= F.col("_high")) | (F.col(value) < F.col("_low"))).drop("_high", "_low")


def word_cloud(docs: DataFrame, n: int = 50, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The corpus's ``n`` most frequent words, ties kept: ``(term, freq)``."""
    freqs = term_rows(docs, stop_words=stop_words).groupBy("term").agg(F.count("*").alias("freq"))
    return top_with_ties(freqs, "freq", n)


def word_cloud_tfidf(docs: DataFrame, n: int = 150, gram: int = 1, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent of the words that tf-idf keeps: ``(term, freq, score)``.  Texts are read once."""
    scored = written(tfidf(term_frequencies(docs, n=gram, stop_words=stop_words), docs.count()), "scored")
    kept = above_threshold(scored, score_threshold(scored))
    return top_with_ties(kept.select("term", F.col("cf").alias("freq"), "score"), "freq", n)


def label_clouds(docs: DataFrame, label: str, n: int = 20, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``(label, term, freq)``: the most frequent words of each label."""
    freqs = term_rows(docs, label, stop_words=stop_words).groupBy(F.col(label).alias("label"), "term").agg(F.count("*").alias("freq"))
    return top_with_ties(freqs, "freq", n, "label")


def label_clouds_tfidf(docs: DataFrame, label: str, n: int = 20, gram: int = 1, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Of each label's terms that the corpus's tf-idf keeps, those of the largest corpus frequency.  Texts are read once."""
    rel = relative(term_frequencies(docs, label, n=gram, stop_words=stop_words))
    own = written(rel.groupBy(F.col(label).alias("label"), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("rel").alias("top")), "label-terms")
    stats = own.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("top").alias("top"))
    scored = written(stats.select("term", "df", "cf", (F.col("top") * F.log10(F.lit(float(docs.count())) / F.col("df"))).alias("score")), "scored")
    kept = above_threshold(scored, score_threshold(scored)).select("term", F.col("cf").alias("freq"))
    return top_with_ties(own.select("label", "term").join(kept, "term"), "freq", n, "label")


def label_stats(docs: DataFrame, label: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``(label, term, freq, docs, top)``: occurrences and documents of each label's words, and the largest share that a word has of one."""
    rel = relative(term_frequencies(docs, label, stop_words=stop_words))
    return rel.groupBy(F.col(label).alias("label"), "term").agg(F.sum("tf").alias("freq"), F.count("*").alias("docs"), F.max("rel").alias("top"))


def scaled(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """``df`` with ``linear``, ``log`` and ``power``: ``value`` between ``low``, for the least, and ``high`` on each scale."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    rows = df.join(F.broadcast(ends))  # one row
    return rows.withColumns({"linear": low + (high - low) * x, "log": low + (high - low) * F.log2(1 + x), "power": low + (high - low) * F.sqrt(x)}).drop("_lo", "_hi")
