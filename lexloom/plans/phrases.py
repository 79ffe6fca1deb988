"""Queries over phrases: nets of matched words and multi-word units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import phrases
from lexloom.plans.registry import STOP_LIST, STOP_WORDS, query
from lexloom.sources.tables import table


def _found_sql(pattern: str) -> str:
    regex = phrases.compile_pattern(pattern).replace("\\ ", " ")
    return rf"""m AS (SELECT unnest(regexp_extract_all(text, '{regex}')) AS m FROM documents),
    pair AS (SELECT lower(regexp_extract(m, '{regex}', 1)) AS a, lower(regexp_extract(m, '{regex}', 2)) AS b FROM m),
    hit AS (SELECT * FROM pair WHERE a NOT IN ({STOP_LIST}) AND b NOT IN ({STOP_LIST})),
    edge AS (SELECT a AS source, b AS target, count(*) AS weight FROM hit GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 50)"""


_NODES = """used AS (SELECT source AS term FROM edge UNION SELECT target FROM edge),
    node AS (SELECT term, count(*) AS freq FROM (SELECT a AS term FROM hit UNION ALL SELECT b FROM hit) WHERE term IN (FROM used) GROUP BY term)"""


def _found(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return phrases.matches(table(spark, sf_dir, "documents"), pattern, STOP_WORDS)


@query("phrasenet_edges", f"WITH {_found_sql('x and y')} SELECT * FROM edge")
def phrasenet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edges(_found(spark, sf_dir, "x and y"))


@query("phrasenet_nodes", f"WITH {_found_sql('x and y')}, {_NODES} SELECT * FROM node")
def phrasenet_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, "x and y")
    return phrases.nodes(found, phrases.edges(found))


@query("phrasenet_x_of_the_y", f"WITH {_found_sql('x of the y')} SELECT * FROM edge")
def phrasenet_x_of_the_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edges(_found(spark, sf_dir, "x of the y"))


@query("phrasenet_custom", f"WITH {_found_sql('([a-z]+tion) ([a-z]+)')} SELECT * FROM edge")
def phrasenet_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edges(_found(spark, sf_dir, "([a-z]+tion) ([a-z]+)"))


@query("phrasenet_indexed", f"""WITH {_found_sql('x and y')}, {_NODES}, place AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM node)
    SELECT s.i AS source_index, t.i AS target_index, weight FROM edge JOIN place s ON s.term = source JOIN place t ON t.term = target""")  # fmt: skip
def phrasenet_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, "x and y")
    top = phrases.edges(found)
    return phrases.indexed(phrases.nodes(found, top), top)


def _mwu_sql(kind: str) -> str:
    def counts(n: int) -> str:
        return f"c{n} AS (SELECT w[i:i + {n - 1}] AS gram, count(*) AS f FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM line) GROUP BY 1)"

    def glued(n: int) -> str:
        p = [f"coalesce(p{k}.f, 1)::DOUBLE" for k in range(1, n)]
        s = [f"coalesce(s{k}.f, 1)::DOUBLE" for k in range(1, n)]
        joins = " ".join(f"LEFT JOIN c{k} p{k} ON p{k}.gram = g.gram[:{k}] LEFT JOIN c{k} s{k} ON s{k}.gram = g.gram[{n - k + 1}:]" for k in range(1, n))
        mean = lambda x: f"(({' + '.join(x)}) / {n - 1})"
        by = f"g.f * g.f / {mean([f'{a} * {b}' for a, b in zip(p, reversed(s))])}" if kind == "scp" else f"2 * g.f / ({mean(p)} + {mean(s)})"
        return f"g{n} AS (SELECT g.gram, g.f, {by} AS glue FROM c{n} g {joins})"

    def kept(n: int) -> str:
        below = "0.0" if n == 2 else f"greatest((SELECT glue FROM g{n - 1} b WHERE b.gram = g.gram[:{n - 1}]), (SELECT glue FROM g{n - 1} b WHERE b.gram = g.gram[2:]))"
        return f"""SELECT {n} AS n, array_to_string(g.gram, ' ') AS unit, g.f AS freq, round(g.glue, 9) AS glue FROM g{n} g LEFT JOIN (SELECT gram, max(glue) AS above FROM
            (SELECT gram[:{n}] AS gram, glue FROM g{n + 1} UNION ALL SELECT gram[2:], glue FROM g{n + 1}) GROUP BY gram) a ON a.gram = g.gram
            WHERE g.glue > ({below} + coalesce(above, 0.0)) / 2 AND g.f >= 2"""

    return rf"""WITH line AS (SELECT list_filter(string_split_regex(l, '[ \t\r\f\x0B]+'), lambda w: w <> '') AS w FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)),
    {', '.join(map(counts, (1, 2, 3, 4)))}, {', '.join(map(glued, (2, 3, 4)))} {kept(2)} UNION ALL {kept(3)}"""


@query("mwu_scp", _mwu_sql("scp"))
def mwu_scp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.multi_word_units(table(spark, sf_dir, "documents"), 3, "scp").withColumn("glue", F.round("glue", 9))


@query("mwu_dice", _mwu_sql("dice"))
def mwu_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.multi_word_units(table(spark, sf_dir, "documents"), 3, "dice").withColumn("glue", F.round("glue", 9))
