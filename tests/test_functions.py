import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions import text as X
from lexloom.functions.stem import porter2
from lexloom.operators import compare, frequency, geo, phrases, texts, topics


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'bigint'}" for n in names))
    return row.select(column.alias("x")).first()["x"]


def test_tokens_fuse_at_line_ends(spark):
    assert one(spark, X.tokens(F.col("t")), t="Café_1 au\nlait") == ["café_1", "aulait"]
    assert one(spark, X.tokens(F.col("t"), " "), t="Café_1 au\nlait") == ["café_1", "au", "lait"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 3), t="a b") == []
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 2), t="a b c") == [["a", "b"], ["b", "c"]]


@pytest.mark.parametrize("raw, day", [("1999-00-00", "1999-01-01"), ("", None), ("1999-12-31T10:00", "1999-12-31"), ("soon", None)])
def test_dates(spark, raw, day):
    found = one(spark, D.parse_date(F.col("t")), t=raw)
    assert (str(found) if found else None) == day


@pytest.mark.parametrize("raw, year", [("95", 1995), ("113", 1913), ("1905", 1905), ("n/a", None)])
def test_years(spark, raw, year):
    assert one(spark, D.repair_year(F.col("t")), t=raw) == year


@pytest.mark.parametrize("word, stem", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("sky", "sky"), ("cries", "cri"), ("ties", "tie"), ("consistency", "consist"), ("knightly", "knight")])
def test_stems(word, stem):
    assert porter2(word) == stem


def test_top_keeps_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "term string, freq int")
    assert {r["term"] for r in frequency.top_with_ties(df, "freq", 2).collect()} == {"a", "b", "c"}


def test_log_likelihood_sign_and_zero(spark):
    rows = spark.createDataFrame([(10.0, 10.0, 100.0, 1000.0), (1.0, 100.0, 100.0, 1000.0), (0.0, 5.0, 10.0, 10.0)], "a double, b double, c double, d double")
    g = [r[0] for r in rows.select(compare.log_likelihood(*map(F.col, "abcd"))).collect()]
    assert g[0] > 0 > g[1] and g[2] == 0


def test_mann_whitney_against_dense_ranks(spark):
    docs = [(i, "x" if i < 4 else "y", t) for i, t in enumerate(["a a b", "a b", "b b c", "c", "a c", "b", "c c", "a a a b"])]
    frame = spark.createDataFrame(docs, "doc_id bigint, label string, text string")
    bags = frequency.term_frequencies(frame, "label")
    got = {(r["label"], r["term"]): r["rho"] for r in compare.mann_whitney(bags, frame, "label", 1).collect()}
    for (label, term), rho in got.items():
        value = lambda t: t.split().count(term) / len(t.split())  # noqa: E731, B023
        a = [value(t) for _, own, t in docs if own == label]
        b = [value(t) for _, own, t in docs if own != label]
        u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
        assert math.isclose(rho, u / (len(a) * len(b)))


def test_phrases_do_not_overlap(spark):
    docs = spark.createDataFrame([("a and b and c, D and the",)], "text string")
    assert [tuple(r) for r in phrases.matches(docs, "x and y", ("the",)).collect()] == [("a", "b")]
    assert phrases.compile_pattern("x y x") == "x y x"


def test_places():
    rows = [dict(zip(("kind", "name", "country", "region", "population", "lat", "lon", "geonameid"), r)) for r in [
        ("country", "France", "FR", None, 0, 1.0, 1.0, 1), ("country", "United States", "US", None, 0, 1.0, 1.0, 2), ("region", "Texas", "US", "TX", 0, 1.0, 1.0, 3),
        ("city", "Paris", "FR", "IF", 2000, 1.0, 1.0, 4), ("city", "Paris", "US", "TX", 20, 1.0, 1.0, 5), ("city", "Paris", "FR", "XX", 5, 1.0, 1.0, 6)]]
    g = geo.Gazetteer.of(rows)
    ids = lambda t: [m["geonameid"] for m in geo.find_places(t, g)]
    assert ids("From Paris, France to Paris, Texas") == [4, 5]
    assert ids("in Texas") == [3] and ids("the Texas") == [] and ids("in texas") == []
    assert ids("the United States and france") == [2]
    assert ids("Texas, United States") == [3] and ids("") == [] and ids(None) == []
    assert geo.find_places("x Paris, France.", g)[0]["start"] == 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert frequency.word_cloud(none).count() == 0
    assert compare.dunning_clouds(frequency.term_frequencies(none, "source"), "source").count() == 0
    assert frequency.score_threshold(frequency.tfidf(frequency.term_frequencies(none), 0)) == 0.0
    assert texts.topic_prefilter(none).count() == 0


def test_html(spark):
    html = "<p>a<!-- no --><b>b</b>&amp;c<script>var x;</script></p>"
    assert one(spark, texts.strip_html(F.col("t")), t=html) == "abcvar x;"


def test_mutual_information(spark):
    same = [(i, label, 0, i % 2) for label in "xy" for i in range(4)]
    apart = [(9, "z", 5, 1)]
    rows = spark.createDataFrame(same + apart, "doc_id bigint, label string, interval int, topic int")
    got = {(r[0], r[1]): r[2] for r in topics.mutual_information(rows).collect()}
    assert got[("x", "z")] == 0 and math.isclose(got[("x", "y")], 0, abs_tol=1e-9)


def test_streaming_window(spark, tmp_path):
    from lexloom.streaming.windows import stream, tumbling

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    query = stream(spark, str(tmp_path / "in"), batch.schema).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == tumbling(batch, "1 hour").agg(F.sum("n")).first()[0]
