"""The pipeline's stages on odd rows, and the near-duplicate stage by its definition on a whole table."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import components, packing, quality, reply_trees, secret_scan, toxicity
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"
GOOD = " ".join(f"word{i % 37} and some{i % 11} more{i}" for i in range(80))
ODD = [
    (1, GOOD, "en", "s", 1), (1, GOOD, "en", "s", 1), (2, GOOD + " end", None, "s", 2), (3, None, "en", "s", 3), (4, "", "en", "s", 4), (None, GOOD + " password=abcdef123", "en", "s", 5),
    (5, GOOD + " token: qwertyuiop99", "de", "s", 6), (6, " \n\t ", "de", "s", 7), (7, "\n".join(f"line {i} of a very long text with word{i}" for i in range(20_000)), "fr", None, 8),
]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row bigint, _text_hash string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 0, "h") for r in ODD], KIND).repartition(3)


def texts(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    labels = table(spark, SF, "labels")
    kept = stages["toxicity"](spark, odd, SF)
    model = toxicity.train(odd, labels)
    assert kept.columns == odd.columns and texts(kept) == Counter((r[0], r[1]) for r in ODD if model.score(r[1]) < 0.3)
    good = stages["quality rules"](spark, odd, SF)
    refs = quality.references(odd)
    prepared = quality._prepared(refs)
    assert good.columns == odd.columns and texts(good) == Counter((r[0], r[1]) for r in ODD if quality.judged(r[1], prepared, r[2] in refs)["kept"])
    one = stages["near-duplicates"](spark, odd, SF)
    # 2, 5 and the copy are near copies of 1; null, empty and blank texts are one group; null ids stay
    assert one.columns == odd.columns and Counter(r["doc_id"] for r in one.collect()) == Counter([1, 3, None, 7])
    clean = stages["secret scan"](spark, odd, SF)
    assert clean.columns == odd.columns and texts(clean) == Counter((r[0], secret_scan.redact(r[1])) for r in ODD)
    packed = stages["packing"](spark, odd, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in ODD)
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_stages_on_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_near_duplicates_of_a_whole_table(spark):
    """By the definition: components of pairs with five-word Jaccard of 0.8 or more, the smallest id stays."""
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    grams = [set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()} for _, w in rows]
    ids = np.array([i for i, _ in rows])
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    a, b = np.array(near).T
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF).collect()}
    assert kept == set(components.union_find(ids[a], ids[b])[1].tolist())


def test_expected_pieces_follow_long_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, None), (3, "short")], "doc_id bigint, text string")
    assert packing.expected(docs) == 3 + 12 and packing.expected(docs.limit(0)) == 0


def test_bushy_trees_rank_every_branch(spark):
    """All root-to-leaf paths of random trees, against plain walks."""
    rng = np.random.default_rng(3)
    rows, text = [], "t" * 300_000
    for tree in range(12):
        n = int(rng.integers(1, 40))
        for i in range(n):
            rows.append((tree, i, None if i == 0 else int(rng.integers(max(0, i - 6), i)), "user", text if (tree, i) == (0, 0) else f"{tree}-{i}", float(rng.integers(0, 4))))
    rows += [(99, i, (i + 1) % 5, "user", "cycle", 0.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, role string, text string, score double")
    want = {}
    for tree in range(12):
        own = {r[1]: r for r in rows if r[0] == tree}
        branches = []
        for leaf in own.keys() - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(own[at])
                at = own[at][2]
            branches.append((-sum(r[5] for r in path) / len(path), leaf, [r[4] for r in reversed(path)]))
        want |= {(tree, k + 1): b[2] for k, b in enumerate(sorted(branches)[:3])}
    got = {(r["tree_id"], r["rank"]): [t for _, t in reply_trees.parse(r["formatted"])] for r in reply_trees.format_trees(frame, best=3).collect()}
    assert got == want
