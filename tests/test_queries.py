"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from lexloom.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(value):
    if isinstance(value, float):
        return f"{value:.8g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(same, r)) for r in found.select(*columns).collect())
    wanted = duck.sql(oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert rows == sorted(tuple(same(r[i]) for i in at) for r in wanted.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["lda_topics", "geoparse", "stemmed_frequencies"])
def test_rows_only(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entities_of_whole_texts(spark):
    """All words of long texts, against a plain count."""
    import re
    from collections import Counter

    import numpy as np

    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for w in re.sub(r"[^\w ]+", "", (r["text"] or "").lower()).split(" "):
            if w:
                want["http://dbpedia.org/resource/" + w, r["doc_id"]] += 1
    assert {(r["uri"], r["doc_id"]): r["n"] for r in queries()["entity_counts_whole"](spark, SF).collect()} == want
    weight, docs = Counter(), Counter()
    for (uri, doc_id), n in want.items():
        weight[uri] += n
        docs[str(doc_id)] += n
    edge = sorted(weight.values(), reverse=True)[99]
    assert {r["uri"]: r["weight"] for r in queries()["entity_top_whole"](spark, SF).collect()} == {u: n for u, n in weight.items() if n > edge}
    least = np.quantile([*weight.values(), *docs.values()], 0.75)
    found = {(r["id"], r["kind"]): r["value"] for r in queries()["entity_quantile_whole"](spark, SF).collect()}
    assert found == {(d, "document"): n for d, n in docs.items()} | {(u, "entity"): n for u, n in weight.items() if n >= least}
