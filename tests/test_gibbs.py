"""Topic models by sampling: planted topics and links, priors against plain sums, the same at any layout."""

import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lexloom.operators import gibbs, topics


def planted(n_docs, length, k, seed, mix=0.2, prior=None):
    """``(rows, shares)``: topics of 20 own words each and 10 words that all share."""
    rng = np.random.default_rng(seed)
    rows, shares = [], []
    for d in range(n_docs):
        theta = rng.dirichlet([mix] * k if prior is None else prior[d])
        found = Counter()
        for t in rng.choice(k, length, p=theta):
            found[f"t{t}w{rng.integers(20)}" if rng.random() < 0.85 else f"c{rng.integers(10)}"] += 1
        rows += [(d, w, n) for w, n in found.items()]
        shares.append(theta)
    return rows, np.array(shares)


BAGS = "doc_id bigint, term string, tf bigint"


def test_planted_topics_are_found(spark):
    rows, shares = planted(250, 50, 4, 1)
    model = gibbs.fit(spark.createDataFrame(rows, BAGS), k=4, alpha_sum=4.0, iterations=30, burn_in=8, optimize_every=7, block_tokens=3000)
    found = {(r["topic"], r["term"]): r["n"] for r in model.counts().collect()}
    # each topic is made of one planted topic's words and the shared ones
    of = {}
    for t in range(4):
        own = Counter()
        for (topic, term), n in found.items():
            if topic == t and term[0] == "t":
                own[term[1]] += n
        best, n = own.most_common(1)[0]
        assert n >= 0.95 * sum(own.values())
        of[t] = int(best)
    assert sorted(of.values()) == [0, 1, 2, 3]
    props = {(r["doc_id"], of[r["topic"]]): r["prop"] for r in model.doc_topics().collect()}
    error = np.mean([abs(props[d, t] - shares[d, t]) for d in range(250) for t in range(4)])
    assert error < 0.06
    # the prior was fitted towards the planted 0.2 a topic
    assert 0.1 < model.alpha.min() and model.alpha.max() < 0.4


def test_state_holds_every_token(spark):
    rows = [(1, "a", 3), (1, "b", 1), (2, "a", 1), (None, "c", 2), (3, "d" * 1000, 70_000), (4, "x", 0)]
    model = gibbs.fit(spark.createDataFrame(rows, BAGS), k=3, iterations=2, burn_in=0, optimize_every=1, block_tokens=2)
    state = [tuple(r) for r in model.state().collect()]
    assert Counter((d, w) for d, _, w, _ in state) == Counter({(d, w): n for d, w, n in rows if n})
    for d, n in ((1, 4), (2, 1), (None, 2), (3, 70_000)):
        assert sorted(p for x, p, *_ in state if x == d) == list(range(n))
    assert Counter({(r["topic"], r["term"]): r["n"] for r in model.counts().collect()}) == Counter((t, w) for _, _, w, t in state)
    assert {(r["doc_id"], r["topic"]): r["n"] for r in model.doc_counts().collect()} == Counter((d, t) for d, _, _, t in state)
    shares = model.doc_topics().collect()
    assert len(shares) == 12 and sum(r["prop"] for r in shares) == pytest.approx(4)


def test_no_bags_give_an_empty_model(spark):
    model = gibbs.fit(spark.createDataFrame([], BAGS), k=3, iterations=2, burn_in=0, optimize_every=1)
    assert model.state().count() == model.counts().count() == model.doc_topics().count() == 0


def test_models_do_not_depend_on_partitions(spark):
    rows, _ = planted(60, 30, 3, 4)
    found = []
    for n in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        model = gibbs.fit(spark.createDataFrame(rows, BAGS).repartition(n), k=3, iterations=5, burn_in=1, optimize_every=2, block_tokens=400)
        found.append((sorted(map(tuple, model.state().collect())), model.alpha.tolist(), model.beta))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1]) and found[0][2] == pytest.approx(found[1][2])


def test_sweeps_move_packed_rows(spark):
    """A block gives a row of topics and one a chunk of words, not one a word and topic; many chunks keep every token."""
    rows, _ = planted(60, 30, 3, 4)
    model = gibbs.fit(spark.createDataFrame(rows, BAGS), k=3, iterations=2, burn_in=5, block_tokens=400, chunk_tokens=300)
    kinds = Counter(r["kind"] for r in model.rows.select("kind").collect())
    blocks = model.docs.select("block").distinct().count()
    assert kinds[gibbs.TOPICS] == blocks == 5 and kinds[gibbs.COUNTS] <= blocks * 6 and sum(kinds.values()) == 5 + kinds[gibbs.COUNTS] + 5 * 3
    state = [tuple(r) for r in model.state().collect()]
    assert Counter((d, w) for d, _, w, _ in state) == Counter({(d, w): n for d, w, n in rows})
    assert Counter({(r["topic"], r["term"]): r["n"] for r in model.counts().collect()}) == Counter((t, w) for _, _, w, t in state)


def test_parts_of_several_blocks_send_their_counts_once(spark):
    """A part's blocks are drawn each for itself, so parts don't change the model; their counts move once a part and chunk."""
    rows, _ = planted(60, 30, 3, 4)
    found = []
    for part_tokens in (500, 10**6):
        model = gibbs.fit(spark.createDataFrame(rows, BAGS), k=3, iterations=3, burn_in=1, optimize_every=2, block_tokens=100, chunk_tokens=900, part_tokens=part_tokens)
        kinds = Counter(r["kind"] for r in model.rows.select("kind").collect())
        cores = spark.sparkContext.defaultParallelism
        assert model.n_parts == min(18, -(-1800 // (part_tokens * cores)) * cores) and kinds[gibbs.COUNTS] <= 2 * model.n_parts < 2 * kinds[gibbs.TOPICS]
        found.append(sorted(map(tuple, model.state().collect())))
    assert found[0] == found[1] and len(found[0]) == 1800


def test_sweeps_do_not_shuffle_bags(spark):
    """Shares and counts of documents need no join by document either."""
    rows, _ = planted(60, 30, 3, 4)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    model = gibbs.fit(spark.createDataFrame(rows, BAGS), k=3, iterations=1, burn_in=5, block_tokens=400)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    for df in (model.doc_topics(), model.doc_counts()):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    held = model.packs.select("part", "data").repartition(model.n_parts, "part").persist()
    plan = model._met(held, model.rows.select("part", "data"), lambda a, b: a, "part int, data binary")._jdf.queryExecution().executedPlan().toString()
    held.unpersist()
    cogrouped, kept = plan.split("InMemoryRelation")[0], plan
    assert "InMemoryTableScan" in kept and cogrouped.count("Exchange") <= 1


def test_written_rows_leave_no_shuffle_files(spark, tmp_path):
    """A sweep's shuffles would else lie on disk until the driver's garbage is collected."""
    import time

    from lexloom.operators.layout import forget, written

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    status = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.name() for b in (found.apply(i) for i in range(found.size())) if b.name().startswith("shuffle_")} if (found := status.getAllBlocks()) else set()
    old = shuffles()
    out = written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "shuffled")
    for _ in range(50):
        if not (left := shuffles() - old):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    forget(out)


def test_only_given_terms_are_in_the_model(spark):
    rows = [(1, "a", 2), (1, "b", 1), (None, "a", 1), (2, "c", 4)]
    bags = spark.createDataFrame(rows, BAGS)
    model = gibbs.fit(bags, k=2, iterations=2, burn_in=5, terms=bags.where("term <> 'c'").groupBy("term").agg({"tf": "sum"}).toDF("term", "cf"))
    assert Counter((r["doc_id"], r["term"]) for r in model.state().collect()) == {(1, "a"): 2, (1, "b"): 1, (None, "a"): 1}
    assert model.n_words == 2


def test_packing_is_reversible():
    arrays = [np.array([], dtype=np.int64), np.array([0, 255, 3]), np.array([70_000, 1 << 40, 2]), np.array([5])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, gibbs.unpacked(gibbs.packed(*arrays))))
    values, sizes = np.array([3, 3, 9, 0, 7, 2]), np.array([3, 0, 2, 1])
    assert (gibbs.walked(gibbs.steps(values, sizes), sizes) == values).all() and gibbs.steps(values, sizes).min() >= 0


def test_draws_follow_the_conditional_distribution():
    """One token beside fixed others: how often each topic is drawn, against the formula."""
    word_counts, totals, alpha, beta, n_words = np.array([[5.0, 1.0, 0.0], [2.0, 2.0, 6.0]]), np.array([40.0, 30.0, 20.0]), np.array([0.5, 0.3, 0.2]), 0.1, 9
    rng, seen = np.random.default_rng(0), Counter()
    for _ in range(20_000):
        topics_ = np.array([1])
        draw_counts = word_counts.copy()
        gibbs.draw(np.array([1]), topics_, np.array([0]), np.array([0]), draw_counts, totals.copy(), alpha, beta, n_words, rng)
        seen[int(topics_[0])] += 1
        assert draw_counts.sum() == word_counts.sum()
    without = word_counts[1] - [0, 1, 0]
    p = alpha * (without + beta) / (totals - [0, 1, 0] + n_words * beta)
    assert [seen[t] / 20_000 for t in range(3)] == pytest.approx((p / p.sum()).tolist(), abs=0.012)


def test_counts_stay_right_while_drawing():
    rng = np.random.default_rng(1)
    docs = np.repeat(np.arange(5), [1, 300, 7, 129, 40])
    places = np.concatenate([np.arange(n) for n in (1, 300, 7, 129, 40)])
    words, topics_ = rng.integers(0, 12, len(docs)), rng.integers(0, 4, len(docs))
    counts = np.zeros((12, 4))
    np.add.at(counts, (words, topics_), 1)
    counts, totals = counts + 3, counts.sum(axis=0) + 36
    gibbs.draw(words, topics_, docs, places, counts, totals, np.full(4, 0.5), 0.01, 12, rng)
    after = np.zeros((12, 4))
    np.add.at(after, (words, topics_), 1)
    assert (counts == after + 3).all() and (totals == after.sum(axis=0) + 36).all()


# priors


def test_gamma_functions():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 7, 30, 1e4])
    assert gibbs.log_gamma(x).tolist() == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)
    assert gibbs.digamma(x).tolist() == pytest.approx([(math.lgamma(v * (1 + 1e-5)) - math.lgamma(v * (1 - 1e-5))) / (2e-5 * v) for v in x], rel=1e-4, abs=1e-4)


def plain_likelihood(alpha, counts):
    total = sum(alpha)
    return sum(math.lgamma(total) - math.lgamma(total + sum(c)) + sum(math.lgamma(a + n) - math.lgamma(a) for a, n in zip(alpha, c)) for c in counts)


def as_histograms(counts):
    one = lambda values: tuple(np.array(x, dtype=float) for x in zip(*sorted(Counter(values).items())))
    return [one([int(v) for v in counts[:, t] if v] or [0]) for t in range(counts.shape[1])], one(counts.sum(axis=1).astype(int).tolist())


@pytest.mark.parametrize("symmetric", [False, True])
def test_priors_never_lose_likelihood(symmetric):
    rng = np.random.default_rng(3)
    counts = np.array([rng.multinomial(int(rng.integers(1, 60)), rng.dirichlet([0.1, 0.4, 2.0])) for _ in range(300)])
    shares, lengths = as_histograms(counts)
    alpha, last = np.full(3, 5.0), -np.inf
    for _ in range(40):
        value = plain_likelihood(alpha, counts)
        assert value == pytest.approx(gibbs.dirichlet_likelihood(alpha, shares, lengths), rel=1e-9)
        assert value >= last - 1e-9
        last, alpha = value, gibbs.fitted_prior(alpha, shares, lengths, symmetric, rounds=1)
    best = gibbs.fitted_prior(alpha, shares, lengths, symmetric, rounds=2000)
    if symmetric:
        assert len(set(best.round(9))) == 1
    else:
        assert best.tolist() == pytest.approx([0.1, 0.4, 2.0], rel=0.35)
        # no nearby prior is likelier
        for t in range(3):
            for f in (0.97, 1.03):
                near = best.copy()
                near[t] *= f
                assert plain_likelihood(near, counts) <= plain_likelihood(best, counts) + 1e-6


def test_large_counts_are_classed_closely(spark):
    rng = np.random.default_rng(6)
    counts = np.array([[int(v) for v in rng.pareto(0.7, 3) * 20] for _ in range(400)])
    shares, lengths = as_histograms(counts)
    rows = [(t, int(v), int(n)) for t, (vs, ns) in enumerate(shares) for v, n in zip(vs, ns)]
    classed = gibbs.histograms(spark.createDataFrame(rows, "topic int, value bigint, n bigint"), "topic").collect()
    assert len(classed) < len(rows) and sum(r["n"] for r in classed) == sum(n for *_, n in rows)
    found = gibbs._collected(classed, 3)
    alpha = np.array([0.3, 1.0, 2.0])
    assert gibbs.dirichlet_likelihood(alpha, found, lengths) == pytest.approx(gibbs.dirichlet_likelihood(alpha, shares, lengths), rel=1e-4)


# features


def test_gradient_of_the_prior():
    rng = np.random.default_rng(7)
    weights, counts, x = rng.normal(size=(4, 3)), rng.integers(0, 9, (6, 3)).astype(float), [[1], [], None, [1, 3], [2], [2, 3]]
    _, gradient = gibbs.prior_value_and_gradient(weights, x, counts)
    for i in range(4):
        for t in range(3):
            step = np.zeros_like(weights)
            step[i, t] = 1e-5
            up, down = (gibbs.prior_value_and_gradient(weights + s * step, x, counts)[0] for s in (1, -1))
            assert gradient[i, t] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-5)


def test_climbing_reaches_the_top():
    a = np.diag([1.0, 10.0, 100.0])
    top = np.array([[1.0], [-2.0], [0.5]])
    seen = []

    def objective(w):
        value = -0.5 * ((w - top).T @ a @ (w - top)).item()
        seen.append(value)
        return value, -a @ (w - top)

    assert gibbs.climb(objective, np.zeros((3, 1)), rounds=40).ravel().tolist() == pytest.approx(top.ravel().tolist(), abs=1e-3)
    assert gibbs.climb(objective, top).tolist() == top.tolist()


def test_joint_features_beat_later_ones(spark):
    """Short documents mostly of words that all topics share, where features tell more than words."""
    rng = np.random.default_rng(8)
    strong = {f: [3.0 if t == i else 0.05 for t in range(4)] for i, f in enumerate("abcd")}
    marks = [(d, "abcd"[int(rng.integers(4))]) for d in range(500)]
    rows = []
    for d, f in marks:
        theta = rng.dirichlet(strong[f])
        found = Counter(f"c{rng.integers(40)}" if rng.random() < 0.6 else f"t{t}w{rng.integers(10)}" for t in rng.choice(4, 5, p=theta))
        rows += [(d, w, n) for w, n in found.items()]
    bags, features = spark.createDataFrame(rows, BAGS), spark.createDataFrame([*marks, (999, "e"), (1, None)], "doc_id bigint, feature string")
    how = {"k": 4, "alpha_sum": 4.0, "iterations": 40, "burn_in": 7, "optimize_every": 8, "block_tokens": 1000}

    def error(model, weights):
        """How far the features' topics lie from the planted ones, topics matched to planted ones as well as can be."""
        links = np.array([[weights[t, "default"] + weights[t, f] for t in range(4)] for f in "abcd"])
        links = np.exp(links) / np.exp(links).sum(axis=1, keepdims=True)
        want = np.array([np.array(v) / sum(v) for v in strong.values()])
        return min(np.abs(links[:, list(o)] - want).sum() for o in permutations(range(4)))

    joint = gibbs.fit(bags, features=features, **how)
    assert joint.features == ["a", "b", "c", "d", "e"]
    later = gibbs.fit(bags, **how)
    weights = {(r["topic"], r["feature"]): r["weight"] for r in topics.feature_weights(later.doc_counts(), features.where("feature IS NOT NULL AND doc_id < 999"), 4).collect()}
    mine = {(r["topic"], r["feature"]): r["weight"] for r in joint.feature_weights().collect()}
    assert len(mine) == 24
    a, b = error(joint, mine), error(later, weights)
    assert a < 1.5 and a < 0.75 * b, (a, b)


def test_too_many_features_are_an_error(spark):
    features = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id bigint, feature string")
    with pytest.raises(ValueError, match="more than 1"):
        gibbs.fit(spark.createDataFrame([(1, "x", 2)], BAGS), k=2, iterations=1, features=features, most_features=1)


def test_words_of_topics_are_smoothed(spark):
    """Topics of fewer words than are shown go on with words they lack; one without any has the vocabulary's first."""
    counts = spark.createDataFrame([(0, "b", 3), (0, "d", 1), (1, "a", 2), (1, "b", 2), (1, "c", 1), (1, "e", 1)], "topic int, term string, n bigint")
    found = {(r["topic"], r["rank"]): (r["term"], round(r["prob"], 9)) for r in topics.smoothed_words(counts, 3, 0.5, 3).collect()}
    share = lambda n, total: round((n + 0.5) / (total + 2.5), 9)
    assert found == {
        (0, 1): ("b", share(3, 4)), (0, 2): ("d", share(1, 4)), (0, 3): ("a", share(0, 4)), (1, 1): ("a", share(2, 6)), (1, 2): ("b", share(2, 6)), (1, 3): ("c", share(1, 6)),
        (2, 1): ("a", 0.2), (2, 2): ("b", 0.2), (2, 3): ("c", 0.2),
    }
