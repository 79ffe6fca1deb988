"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The stop words both engines share.
STOP_WORDS = ("the", "and", "of", "to", "in", "la", "de", "der", "die", "und", "le", "el", "que", "et", "en")
STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: SQL: tokens of each document as a list, then admissible terms as rows.
TOKEN_LIST = r"""toks AS (SELECT doc_id, lang, source, list_filter(string_split_regex(
    regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_ ]+', '', 'g'), ' +'), lambda w: w <> '') AS w FROM documents)"""
TERMS = rf"""{TOKEN_LIST}, term AS (SELECT * FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM toks)
    WHERE regexp_full_match(term, '\p{{L}}+') AND term NOT IN ({STOP_LIST})),
bag AS (SELECT doc_id, source, term, count(*) AS tf FROM term GROUP BY ALL)"""
#: SQL: (term, df, cf, score) of tf-idf, and the threshold of its k-th largest value.
TFIDF = """len AS (SELECT doc_id, sum(tf) AS len FROM bag GROUP BY doc_id),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf / len) * log10((SELECT count(*) FROM documents) / count(*)) AS score
    FROM bag JOIN len USING (doc_id) GROUP BY term),
cut AS (SELECT score AS least FROM (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS k, count(*) OVER () AS v FROM stats)
    WHERE k = least(5000, (v * 7) // 10, v - 1))"""
DATED = "dated AS (SELECT d.doc_id, d.text, d.source, d.lang, CAST(o.o_orderdate AS DATE) AS doc_date FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
