"""Exact near copies: the fingerprints' bound, forests, tiles of large groups, against all pairs."""

import numpy as np
import pytest

from lexloom.llm import components, near_copies, simhash


def plain(rows):
    """The smallest id of each component of the pairs with five-word Jaccard of 0.8 or more, by all pairs."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()}

    ids, own = [r[0] for r in rows], [grams(r[1]) for r in rows]
    near = [(i, j) for i in range(len(own)) for j in range(i + 1) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    return set(components.union_find(np.array([ids[i] for i, _ in near]), np.array([ids[j] for _, j in near]))[1].tolist())


def ball(rng, n, words=120, edits=9):
    """Copies of one text with up to so many words changed: some in one component, some out of it."""
    base = [f"w{i}" for i in rng.integers(0, 500, words)]
    for _ in range(n):
        new = list(base)
        for i in rng.integers(0, words, rng.integers(0, edits)):
            new[i] = f"x{rng.integers(0, 10_000)}"
        yield " ".join(new)


def test_fingerprints_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for size in (1, 30, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.r_[rng.choice(a, size // 2), rng.integers(0, 1 << 63, 1 + size // 4, dtype=np.uint64)])
            assert np.bitwise_count(near_copies.parities(a) ^ near_copies.parities(b)).sum() <= len(np.setxor1d(a, b))


def test_forest_spans_with_least_costs():
    rng = np.random.default_rng(4)
    a, b, cost = rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 9, 200)
    keep = near_copies.forest(a, b, cost, np.arange(60))
    for x, y in ((a, b), (a[keep], b[keep])):
        found = dict(zip(*(v.tolist() for v in components.union_find(x, y))))
        assert {k: v for k, v in found.items() if k != v} == {k: v for k, v in dict(zip(*(v.tolist() for v in components.union_find(a, b)))).items() if k != v}
    root, total = np.arange(60), 0
    for k in np.argsort(cost, kind="stable").tolist():  # Kruskal
        x, y = root[a[k]], root[b[k]]
        if x != y:
            root[root == x] = y
            total += cost[k]
    assert cost[keep].sum() == total


@pytest.mark.parametrize("most, tile_rows", [(48, 4096), (4, 4096), (4, 16)])
def test_balls_of_near_copies_against_all_pairs(spark, most, tile_rows):
    rng = np.random.default_rng(6)
    texts = [*ball(rng, 90), *ball(rng, 60, 40, 4), *ball(rng, 30, 300, 30)]
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"t{k}-{i}" for i in range(8 + k % 5)) for k in range(70)]  # much in common, but not enough
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "\n"), (1003, "two words"), (1004, "Two  words"), (1005, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert {r["doc_id"] for r in simhash.keep_one(docs, most=most, tile_rows=tile_rows).collect()} == plain(rows)


def test_frequent_shingles_and_copies_are_many_tasks(spark):
    """A third of the rows copies, a shingle of all other texts among their first: no task has much more than the others."""
    rng = np.random.default_rng(8)
    common = " ".join(f"c{i}" for i in range(12))
    texts = [common + " " + " ".join(f"w{v}" for v in rng.integers(0, 25, 2)) for _ in range(600)] + [f"{common} tail"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = near_copies.prefixes(docs, near_copies.common_shingles(docs, 900, 5), 5, 0.8)
        sets = rows.select("key", "sig").distinct().groupBy("key").count()
        assert sets.agg({"count": "max"}).first()[0] > 300  # a shingle that most sets have among their first
        for dealt in (rows, near_copies.components(docs)):
            sizes = sorted(dealt.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect())
            assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = list(enumerate(texts))
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == plain(rows)


def test_no_shingle_is_lost_by_its_salt(spark):
    """Salted and unsalted prefixes give the same keys for sets that have neighbours, and salted ones all of theirs."""
    rng = np.random.default_rng(9)
    texts = [*ball(rng, 80), *ball(rng, 40, 30, 3), "only once in this table of texts"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    common = near_copies.common_shingles(docs, len(texts), 5)
    told = lambda hot: {(r["key"], r["sig"]) for r in near_copies.shared_prefixes(near_copies.prefixes(docs, common, 5, 0.8, hot), 0.8).collect()}
    salted, plainly = told(4), told(1 << 30)
    assert plainly <= salted and len(told(0)) >= len(salted)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, row string, sig int, component string, key string")
    assert simhash.keep_one(none).count() == 0 and simhash.keep_one(none).columns == none.columns
    some = spark.createDataFrame([(1, "a b c d e f", "r", 1, "c", "k"), (2, "A b c d e f", "s", 2, "d", "l"), (None, "a b c d e f", "t", 3, None, None)], none.schema)
    assert sorted(map(str, simhash.keep_one(some).collect())) == sorted(map(str, some.where("doc_id = 1 OR doc_id IS NULL").collect()))


def test_later_rounds_read_the_written_rows_of_large_groups(spark, monkeypatch):
    """No round joins all members with the large groups again."""
    read = []

    def pairs(members, *how):
        read.append(" ".join(members.inputFiles()))
        return plain_pairs(members, *how)

    plain_pairs = near_copies._pairs
    monkeypatch.setattr(near_copies, "_pairs", pairs)
    rows = list(enumerate(ball(np.random.default_rng(9), 90)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = near_copies.components(docs, most=4).collect()
    assert {r["doc_id"]: r["component"] for r in found}.keys() == dict(rows).keys()
    assert len(read) > 1 and "lexloom-shared" in read[0]
    for later in read[1:]:
        assert "lexloom-large-groups" in later and "lexloom-shared" not in later and "lexloom-copies" not in later
