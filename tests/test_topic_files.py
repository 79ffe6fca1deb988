"""Files of topic models, written and read again, and odd lines in them."""

import gzip

import pytest

from lexloom.operators import gibbs
from lexloom.sources import topic_files


@pytest.fixture(scope="module")
def model(spark):
    rows = [(d, f"w{(d * 7 + i) % 13}", 1 + i % 3) for d in range(20) for i in range(6)]
    features = spark.createDataFrame([(d, "ab"[d % 2]) for d in range(20)], "doc_id bigint, feature string")
    return gibbs.fit(spark.createDataFrame(rows, "doc_id bigint, term string, tf bigint"), k=3, alpha_sum=3.0, iterations=4, burn_in=1, optimize_every=2, features=features)


def test_round_trips(spark, model, tmp_path):
    topic_files.write_state(model, f"{tmp_path}/state")
    assert sorted(map(tuple, topic_files.read_state(spark, f"{tmp_path}/state").collect())) == sorted(map(tuple, model.state().collect()))
    priors = topic_files.read_priors(spark, f"{tmp_path}/state")
    assert {(r["name"], r["topic"]): r["prior"] for r in priors.collect()} == {("alpha", t): float(a) for t, a in enumerate(model.alpha)} | {("beta", None): float(model.beta)}
    topic_files.write_doc_topics(model.doc_topics(), f"{tmp_path}/shares")
    assert {(r["doc_id"], r["topic"]): r["prop"] for r in topic_files.read_doc_topics(spark, f"{tmp_path}/shares").collect()} == {(r["doc_id"], r["topic"]): r["prop"] for r in model.doc_topics().collect()}
    words = spark.createDataFrame([(0, 1, "b"), (0, 2, "a"), (1, 1, "c")], "topic int, rank int, term string")
    topic_files.write_keys(words, priors.where("name = 'alpha'"), f"{tmp_path}/keys")
    assert sorted((r["topic"], r["rank"], r["term"]) for r in topic_files.read_keys(spark, f"{tmp_path}/keys").collect()) == [(0, 1, "b"), (0, 2, "a"), (1, 1, "c")]
    topic_files.write_weights(model.feature_weights(), f"{tmp_path}/weights")
    assert sorted(map(tuple, topic_files.read_weights(spark, f"{tmp_path}/weights").collect())) == sorted(map(tuple, model.feature_weights().collect()))


def test_files_of_other_programs(spark, tmp_path):
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write("#doc source pos typeindex type topic\n#alpha : 0.5 0.25 \n#beta : 0.01\n0 NA 0 0 word 1\n0 NA 1 5 été 0\n\nnot a token\n1 x 0 0 word z\n")
    assert sorted(map(tuple, topic_files.read_state(spark, str(tmp_path / "s.gz")).collect())) == [(0, 0, "word", 1), (0, 1, "été", 0)]
    assert sorted((r["name"], r["prior"]) for r in topic_files.read_priors(spark, str(tmp_path / "s.gz")).collect()) == [("alpha", 0.25), ("alpha", 0.5), ("beta", 0.01)]
    (tmp_path / "d.txt").write_text("#doc source topic proportion ...\n0\ta.txt\t2\t0.75\t0\t0.25\t\n1\tb.txt\t1\t1.0\n2\tc.txt\n")
    assert sorted(map(tuple, topic_files.read_doc_topics(spark, str(tmp_path / "d.txt")).where("topic IS NOT NULL").collect())) == [(0, "a.txt", 0, 0.25), (0, "a.txt", 2, 0.75), (1, "b.txt", 1, 1.0)]
    (tmp_path / "k.txt").write_text("0\t0.5\tone two \n1\t0.25\tthree\n")
    assert sorted(map(tuple, topic_files.read_keys(spark, str(tmp_path / "k.txt")).collect())) == [(0, 0.5, 1, "one"), (0, 0.5, 2, "two"), (1, 0.25, 1, "three")]
    (tmp_path / "p.txt").write_text("FEATURES FOR CLASS topic0\n <default> -1.5\n decade1990 0.25\nFEATURES FOR CLASS topic11\n <default> 2.0\n\n")
    assert sorted(map(tuple, topic_files.read_weights(spark, str(tmp_path / "p.txt")).collect())) == [(0, "<default>", -1.5), (0, "decade1990", 0.25), (11, "<default>", 2.0)]
