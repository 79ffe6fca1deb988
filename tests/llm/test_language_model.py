"""The recurrent language model against plain loops, other layouts of the same table and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import gru_lm
from lexloom.llm.common import table

SF01 = "/root/testdata/sf0.01"


@pytest.fixture
def tiny():
    rng = np.random.default_rng(1)
    net = gru_lm.Net(rng.normal(0, 0.3, 2 + gru_lm.TAILS), rng.normal(0, 0.3, (2, gru_lm.CLASS)))
    net.flat[:] = rng.normal(0, 0.4, len(net.flat))
    codes = [rng.integers(0, 3 * gru_lm.CLASS, n).astype(np.uint16) for n in (40, 7, 3, 3, 1, 12)]
    for own in codes:
        own[-1] = 5
    return net, codes


def plain(net, codes, end=5):
    """A document's log probability, one token and one number at a time."""
    p, k, h, x, total = net.parts, gru_lm.HIDDEN, np.zeros(gru_lm.HIDDEN), end, 0.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for y in codes.tolist():
        a, u = p["inputs"][x].astype(float), h @ p["recur"].astype(float)
        z, r = sigmoid(a[:k] + u[:k]), sigmoid(a[k : 2 * k] + u[k : 2 * k])
        h = (1 - z) * np.tanh(a[2 * k :] + r * u[2 * k :]) + z * h
        by_class, by_word = np.r_[h, 1] @ p["to_class"], np.r_[h, 1] @ p["to_word"][y // gru_lm.CLASS]
        total += by_class[y // gru_lm.CLASS] - np.log(np.exp(by_class).sum()) + by_word[y % gru_lm.CLASS] - np.log(np.exp(by_word).sum())
        x = y
    return total


def test_scores_against_plain_loops(tiny):
    net, codes = tiny
    wanted = [plain(net, c) for c in codes]
    for most, window in ((1, 10), (2, 1), (6, 1000)):
        assert np.allclose(gru_lm.log_likelihoods(net, codes, 5, most, window), wanted, atol=1e-4)


def test_gradients_against_differences(tiny):
    net, codes = tiny
    docs, h, grad = gru_lm.Streams(codes, 5, 2), np.zeros((2, gru_lm.HIDDEN), dtype=np.float32), np.zeros_like(net.flat)
    parts = net.view(grad)
    for _, _, x, y, edges, fresh in docs.windows(1000):
        states, kept = net.forward(x, edges, fresh, h, keep=True)
        net.backward(x, edges, fresh, kept, net.outputs(states, y, parts)[1], parts)
    for i in np.random.default_rng(2).choice(np.flatnonzero(grad), 40).tolist():
        loss = []
        for change in (0.01, -0.01):
            moved = net.flat.copy()
            moved[i] += change
            loss.append(-sum(plain(gru_lm.Net(np.zeros(2 + gru_lm.TAILS), np.zeros((2, gru_lm.CLASS)), moved), c) for c in codes))
        assert abs((loss[0] - loss[1]) / 0.02 - grad[i]) < 0.02 * max(1, abs(grad[i]))



def test_streams_hold_every_token_once():
    codes = [np.arange(n, dtype=np.uint16) for n in (1, 1, 2, 50, 9, 9)]
    for most, seed in ((1, None), (3, 0), (100, 3)):
        docs = gru_lm.Streams(codes, 7, most, seed)
        assert sorted(i for s in docs.streams for i in s) == list(range(6)) and Counter(docs.y.tolist()) == Counter(np.concatenate(codes).tolist())
        assert sum(len(d) for d in docs.begun.values()) == 6
        assert sum(len(y) for _, _, _, y, _, _ in docs.windows(4)) == len(docs.y) == sum(len(y) for _, _, _, y, _, _ in docs.windows(most_tokens=5))


def test_every_window_is_learned_from(tiny):
    net, codes = tiny
    trainer = gru_lm.Trainer(net, 0.01, 4)
    trainer.documents(codes, 5, 2, longest=16)
    assert trainer.tokens == sum(map(len, codes)) and trainer.steps >= -(-trainer.tokens // 8)


def test_same_scores_by_any_layout_and_better_than_base(spark):
    docs = table(spark, SF01, "documents")
    a, b = ({r["doc_id"]: r for r in gru_lm.score(docs.repartition(n)).collect()} for n in (2, 16))
    assert a.keys() == b.keys() and len(a) == docs.count()
    assert all(math.isclose(a[k]["score"], b[k]["score"], rel_tol=1e-5) and a[k]["base_score"] == pytest.approx(b[k]["base_score"]) for k in a)
    held = [r for r in a.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in a.values())
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.2


def test_several_blocks_a_part_and_long_texts(spark):
    """Blocks of few tokens, a text longer than a block, copies, an empty and a null text."""
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 200))) for i in range(40)] + [(100, "long " * 30_000), (101, None), (102, ""), (None, "no id")] + [(200, "same text")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = gru_lm.score(docs, block_tokens=1000)
    got = found.collect()
    assert len(got) == len(rows) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 200}) <= 2 and {r["n_tokens"] for r in got if r["doc_id"] in (101, 102)} == {1}
    coded = spark.createDataFrame([(i, 3, bytes(6)) for i in range(100)], "doc_id bigint, n_tokens bigint, codes binary")
    dealt = gru_lm.blocks(coded, parts=2, block_tokens=30).select(F.sum(F.length("codes")), F.sum(F.length("lengths")), F.countDistinct("part"), F.count("*")).first()
    assert tuple(dealt)[:3] == (600, 400, 2) and dealt[3] >= 10


def test_texts_are_split_once(spark):
    """Chunks of any size give back all words of all rows, and count those of training documents only."""
    texts = {i: " ".join(f"W{i * k % 13}" for k in range(i % 9)) for i in range(60)} | {100: None, 101: "", None: "no id"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    for size in (1, 40, 1 << 20):
        chunks, got = gru_lm.split(docs, size), {}
        for r in chunks.collect():
            found, codes = gru_lm.chunk_words(bytes(r["words"])), np.frombuffer(r["codes"], dtype=np.int32)
            for doc_id, own in zip(r["doc_ids"], np.split(codes, np.cumsum(np.frombuffer(r["lengths"], dtype=np.int32))[:-1])):
                got[doc_id] = [found[i] for i in own]
        wanted = {i: (t or "").lower().encode().split() + [gru_lm.END] for i, t in texts.items()}
        assert got == wanted
        learned = Counter(w for i, own in wanted.items() if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
        assert {bytes(r["word"]): r["n"] for r in gru_lm.word_counts(chunks).collect()} == learned


def test_windows_reuse_memory(tiny):
    """Later windows take over the arrays of the first."""
    net, codes = tiny
    docs, h, seen = gru_lm.Streams(codes, 5, 2), np.zeros((2, gru_lm.HIDDEN), dtype=np.float32), set()
    for _, _, x, y, edges, fresh in docs.windows(4):
        states, _ = net.forward(x, edges, fresh, h, keep=True)
        seen.add((states.__array_interface__["data"][0], net.outputs(states, y, net.view(np.zeros_like(net.flat)))[1].base.__array_interface__["data"][0]))
    assert len(seen) <= 2
