"""Operators on small frames: trees, parameters, classes, extremes, gazetteers, units and layouts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import catalog, frequency, geo, layout, phrases, texts, timeline, topics, views


def tree(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_deep_trees_are_whole(spark):
    chain = tree(spark, [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 150)])
    assert catalog.closure(chain).count() == 150 * 149 // 2
    rows = {r["child"]: r for r in catalog.preorder(chain).collect()}
    assert len(rows) == 150 and rows["n149"]["depth"] == 149 and rows["n149"]["path"].endswith("n148/n149")


def test_cycles_are_errors_and_strays_are_left_out(spark):
    for make in (catalog.closure, catalog.preorder):
        with pytest.raises(ValueError):
            make(tree(spark, [("r", None), ("a", "b"), ("b", "c"), ("c", "a")]))
    assert {r["child"] for r in catalog.preorder(tree(spark, [("r", None), ("a", "r"), ("x", "gone")])).collect()} == {"r", "a"}
    none = tree(spark, [("r", None)]).limit(0)
    assert catalog.closure(none).count() == 0 and catalog.preorder(none).count() == 0


def test_classes_may_be_names(spark):
    bags = spark.createDataFrame([(1, "a", 3), (2, "b", 2), (3, "a", 1), (4, "b", 1), (5, "z", 1)], "doc_id bigint, term string, tf bigint")
    labels = spark.createDataFrame([(1, "red"), (2, "blue")], "doc_id bigint, label string")
    found = {r["doc_id"]: r["label"] for r in topics.classify(bags, *topics.naive_bayes(bags, labels)).collect()}
    assert found == {1: "red", 2: "blue", 3: "red", 4: "blue", 5: "blue"}  # a tie goes to the first name


def test_days_and_years_of_parameters():
    assert timeline.day("1996-02-29") == "1996-02-29" and timeline.day("1996-02-30") is None and timeline.day("soon") is None and timeline.day(None) is None
    assert timeline.years("1990-1999") == (1990, 1999) and timeline.years(" 1995 ") == (1995, 1995) and timeline.years("x") is None


def test_extremes_of_few_and_tied_values(spark):
    rows = [("a", f"t{i}", float(v)) for i, v in enumerate([5, 5, 4, 3, 2, 1, 1, 0])] + [("b", "only", 1.0)]
    df = spark.createDataFrame(rows, "label string, term string, v double")

    def plain(values, half):
        high, low = sorted(values, reverse=True)[: half][-1], (sorted(values)[half] if len(values) > half else max(values))
        return Counter(v for v in values if v >= high or v < low)

    for n in (2, 4, 6, 20):
        got = frequency.most_extreme(df, "v", n, "label").collect()
        for label in ("a", "b"):
            assert Counter(r["v"] for r in got if r["label"] == label) == plain([v for x, _, v in rows if x == label], n // 2)


def test_every_occurrence_has_a_context(spark):
    docs = spark.createDataFrame([(1, "x and y and and z"), (2, "and"), (3, None), (4, " and  and ")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["a"], r["text"][r["a"] : r["b"]]) for r in texts.spans(docs, "and").collect()}
    assert got == {(1, 2, "and"), (1, 8, "and"), (1, 12, "and"), (4, 1, "and"), (4, 6, "and")}


def test_places_by_broadcast_and_by_join(spark):
    rows = [("country", "France", "France", None, 0, 1), ("country", "United States", "United States", None, 0, 2), ("region", "Texas", "United States", "Texas", 0, 3),
            ("city", "Paris", "France", "Île", 2_000_000, 4), ("city", "Paris", "United States", "Texas", 25_000, 5), ("city", "Paris", "France", "Île", 10, 6)]
    gazetteer = spark.createDataFrame([(k, n, c, r, p, 0.0, 0.0, i) for k, n, c, r, p, i in rows], "kind string, name string, country string, region string, population bigint, lat double, lon double, geonameid bigint")
    docs = spark.createDataFrame([(1, "France", "In Paris, France. Paris, Texas. the texas, in Texas, united states"), (2, None, "United States"), (3, "", None), (3, "", "Paris")], "doc_id bigint, place string, text string")
    both = [Counter(map(tuple, geo.geoparse(docs, gazetteer, most_rows=n).collect())) for n in (0, 100)]
    assert both[0] == both[1]
    assert Counter((r[0], r[1], r[6]) for r in both[0].elements()) == Counter([(1, 1, True), (1, 4, False), (1, 5, False), (1, 3, False), (2, 2, False)])


def slow_units(lines, max_n, min_freq):
    """Counts, glue and local maxima by the definition."""
    counts = Counter(tuple(w[i : i + n]) for line in lines for w in [line.split()] for n in range(1, max_n + 2) for i in range(len(w) - n + 1))

    def scp(g):
        return counts[g] ** 2 / (sum(counts[g[:k]] * counts[g[k:]] for k in range(1, len(g))) / (len(g) - 1))

    out = set()
    for g, f in counts.items():
        if 2 <= len(g) <= max_n and f >= min_freq:
            below = max(scp(g[1:]), scp(g[:-1])) if len(g) > 2 else 0.0
            above = max((scp(h) for h in counts if len(h) == len(g) + 1 and g in (h[1:], h[:-1])), default=0.0)
            if scp(g) > (below + above) / 2:
                out.add((len(g), " ".join(g), f, round(scp(g), 9)))
    return out


@pytest.mark.parametrize("min_freq", [1, 2])
def test_units_by_the_definition(spark, min_freq):
    lines = ["new york city is big", "new york is not new", "the city of new york", "a b a b a b", "one", ""]
    docs = spark.createDataFrame([(1, "\n".join(lines[:3])), (2, "\n".join(lines[3:])), (3, None)], "doc_id bigint, text string")
    got = {(r["n"], r["unit"], r["freq"], round(r["glue"], 9)) for r in phrases.multi_word_units(docs, 3, "scp", min_freq).collect()}
    assert got == slow_units(lines, 3, min_freq)


@pytest.mark.parametrize("kind", ["scp", "dice"])
def test_units_over_blocks_and_chunks(spark, kind):
    """Many blocks and chunks give the units of one, and texts that nothing repeats in send no grams beyond pairs of frequent words."""
    lines = ["new york city is big", "new york is not new", "the city of new york", "a b a b a b", "one", "", "new york city", "a b a"]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)] + [(8, None)], "doc_id bigint, text string")
    one, many = ({tuple(r) for r in phrases.multi_word_units(docs, 3, kind, 1, block_bytes=b, chunk_bytes=b).collect()} for b in (1 << 22, 12))
    assert one == many and len(one) > 3
    if kind == "scp":
        assert {(n, u, f, round(g, 9)) for n, u, f, g in many} == slow_units(lines, 3, 1)


def test_spread_only_few_partitions(spark):
    few = spark.range(100).coalesce(1)
    assert layout.spread(few).rdd.getNumPartitions() == 4 and layout.spread(spark.range(100, numPartitions=9)).rdd.getNumPartitions() == 9


def test_tasks_that_count_words_follow_the_texts(spark):
    """Tasks hold about 4 MB of text each, however many partitions a shuffle has by default."""
    from lexloom.operators.layout import by_document

    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    assert by_document(docs, "text").rdd.getNumPartitions() == 10
    assert by_document(docs.limit(0), "text").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_bags_of_topic_models_are_not_shuffled_again(spark, monkeypatch):
    """Scores need one exchange, by term, and of many words the few that pass are sent to the bags."""
    from lexloom.operators import texts

    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    seen, write = {}, texts.written
    monkeypatch.setattr(texts, "written", lambda df, what: (seen.setdefault(what, exchanges(df)), write(df, what))[1])
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 400), i -> translate(concat('w', id * 1000 + i), '0123456789', 'abcdefghij'))) || repeat(' common', 30) AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found = texts.topic_prefilter(docs.where("doc_id > 0").unionByName(spark.createDataFrame([(0, "other")], "doc_id bigint, text string")))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen["bags"] == seen["scored"] == 1 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_postings_send_their_few_terms_to_the_bags(spark):
    """Even where the terms' plan can't tell that they are few."""
    dated = spark.range(20).selectExpr("id AS doc_id", "concat('red ', IF(id % 2 = 0, 'blue', 'green')) AS text", "DATE '2000-01-01' AS doc_date")
    terms = spark.range(1 << 20).where("id % 7 = 0").select(F.lit("blue").alias("term")).distinct()
    found = timeline.postings(dated, 90, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 20, 2))


def test_coherence_of_zero_comes_last(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, -3.0), (2, -1.0), (3, -1.0)], "topic int, coherence double")
    assert [r["topic"] for r in views.by_coherence(rows, 4).collect()] == [2, 3, 1, 0]


def test_pairs_and_entries(spark):
    row = spark.range(1).select(views.paired(F.array(*map(F.lit, "abcde"))).alias("p"), views.paired(F.array().cast("array<string>")).alias("none"), views.entries(F.create_map(F.lit(2), F.lit("b"), F.lit(1), F.lit("a"))).alias("e")).first()
    assert [tuple(x) for x in row["p"]] == [("a", "b"), ("c", "d")] and row["none"] == [] and [tuple(x) for x in row["e"]] == [(1, "a"), (2, "b")]


def test_prior_gradient_against_differences():
    rng = np.random.default_rng(1)
    weights, counts = rng.normal(0, 0.5, (3, 4)), rng.integers(0, 9, (5, 4)).astype(float)
    found = [[0], [0, 1], [0, 2], [0, 1, 2], [0]]

    def likelihood(w):
        total = 0.0
        for f, c in zip(found, counts):
            prior = np.exp(w[f].sum(axis=0))
            total += math.lgamma(prior.sum()) - math.lgamma(prior.sum() + c.sum()) + sum(math.lgamma(p + n) - math.lgamma(p) for p, n in zip(prior, c))
        return total

    got = topics.dirichlet_gradient(weights, found, counts)
    for i in range(3):
        for t in range(4):
            up, down = weights.copy(), weights.copy()
            up[i, t] += 1e-5
            down[i, t] -= 1e-5
            assert got[i, t] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, rel=1e-4, abs=1e-6)


def test_features_raise_their_topics(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for d in range(200):
        mark = "ab"[d % 2]
        marks.append((d, mark))
        for t, n in enumerate(rng.multinomial(50, rng.dirichlet([4.0, 0.5, 1.0] if mark == "a" else [0.5, 4.0, 1.0]))):
            rows.append((d, t, float(n)))
    found = {(r["topic"], r["feature"]): r["weight"] for r in topics.feature_weights(spark.createDataFrame(rows, "doc_id bigint, topic int, n double"), spark.createDataFrame(marks, "doc_id bigint, feature string"), 3).collect()}
    assert found[0, "a"] - found[0, "b"] > 1 and found[1, "b"] - found[1, "a"] > 1 and abs(found[2, "a"] - found[2, "b"]) < 0.5
    assert len(found) == 9


def test_large_texts_lie_in_few_blocks_that_ask_for_counts(spark, monkeypatch):
    lines = []

    def written(df, what):
        out = plain_written(df, what)
        if what == "lines":
            lines.append(out.where(f"kind = {phrases.LINES}").count())
        return out

    plain_written = phrases.written
    monkeypatch.setattr(phrases, "written", written)
    text = "\n".join(f"{'a' * 5000} {'b' * 5000}" for _ in range(100))
    docs = spark.createDataFrame([(i, text) for i in range(36)], "doc_id bigint, text string")
    found = [(r["n"], r["freq"], r["glue"]) for r in phrases.multi_word_units(docs).collect()]
    assert found == [(2, 3600, 1.0)]
    assert lines[0] <= 4  # 36 MB on 4 cores


def test_segments_keep_columns_without_a_join(spark):
    docs = spark.createDataFrame([(1, "en", "a b c d e f g\nshort one\nh i j k l m n"), (1, "de", "o p q r s t u"), (2, None, None)], "doc_id bigint, lang string, text string")
    found = texts.segments(docs, "\n", keep=("lang",))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "1.0", "de", "o p q r s t u"), (1, "1.0", "en", "a b c d e f g"), (1, "1.1", "en", "h i j k l m n")]


def test_stemmed_bags_are_dealt_by_document_once(spark, monkeypatch):
    """The plan of the bags of stems, as they are written: one exchange for their sums and their documents' lengths, none to meet the stems."""
    plans, plain = {}, texts.written
    monkeypatch.setattr(texts, "written", lambda df, what: (plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString()), plain(df, what))[1])
    docs = spark.createDataFrame([(d, "en", "walking walks walked houses " * 10) for d in range(8)], "doc_id bigint, lang string, text string")
    found = texts.topic_prefilter(docs, 1, stemming=True).collect()
    assert {(r["doc_id"], r["term"], r["tf"]) for r in found} <= {(d, t, n) for d in range(8) for t, n in (("walk", 30), ("hous", 10))}
    assert plans["bags"].count("Exchange hashpartitioning") == 1
    assert "REPARTITION_BY_NUM" in plans["bags"]  # as many tasks as count words, whatever their bytes
