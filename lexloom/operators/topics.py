"""Topic models and everything computed from them.

``doc_topics`` are rows ``(doc_id, topic, prop)``, whichever model made them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.gibbs import digamma
from lexloom.operators.layout import written
from lexloom.operators.timeline import moving


def word_shares(state: DataFrame, top: int = 20) -> DataFrame:
    """``(topic, rank, term, prob)`` from ``(doc_id, topic, term, n)`` counts: each topic's heaviest words."""
    counts = state.groupBy("topic", "term").agg(F.sum("n").alias("n"))
    total = state.groupBy("topic").agg(F.sum("n").alias("total"))
    # ranks over the limit are cut before the exchange, so no task sorts a topic's whole vocabulary
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= top)
    return ranked.join(total, "topic").select("topic", "rank", "term", (F.col("n") / F.col("total")).alias("prob"))


def smoothed_words(counts: DataFrame, k: int, beta: float, top: int = 20) -> DataFrame:
    """``(topic, rank, term, prob)`` of each topic's heaviest words from ``(topic, term, n)``: ``beta`` more of every word of the corpus.

    A topic of fewer than ``top`` words goes on with words it lacks, in their
    order: they are among the vocabulary's first ``2 * top``.
    """
    counts = written(counts, "topic-words")
    vocabulary = counts.select("term").distinct()
    n_words = vocabulary.count()
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("topic")
    lacking = vocabulary.orderBy("term").limit(2 * top).select("term", every).join(counts, ["topic", "term"], "left_anti").select("topic", "term", F.lit(0).cast("bigint").alias("n"))
    rows = counts.select("topic", "term", "n").unionByName(lacking)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= top)
    total = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return ranked.join(total, "topic", "left").select("topic", "rank", "term", ((F.col("n") + beta) / (F.coalesce("total", F.lit(0)) + n_words * beta)).alias("prob"))


def doc_shares(state: DataFrame, alpha: float = 0.0, topics: int = 1) -> DataFrame:
    """``(doc_id, topic, prop)`` of the topics a document has: ``(alpha + n) / (topics * alpha + length)``."""
    counts = state.groupBy("doc_id", "topic").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.select("doc_id", "topic", ((F.col("n") + alpha) / (total + alpha * topics)).alias("prop"))


def coherence(words: DataFrame, bags: DataFrame) -> DataFrame:
    """``(topic, coherence)``: over pairs of a topic's top words, the log of (documents with both + 1) to documents with the better-ranked one."""
    tops = written(words.select("topic", "rank", "term"), "top-words")  # a few words a topic
    # of each document its top words only; a word's topics and ranks come with it
    found = bags.select("doc_id", "term").join(tops, "term")
    own = found.groupBy("doc_id", "topic").agg(F.collect_set("rank").alias("ranks"))  # top words of a topic at most
    one = own.select("topic", F.explode("ranks").alias("ra"), "ranks")
    both = one.select("topic", "ra", F.explode(F.filter("ranks", lambda r: r >= F.col("ra"))).alias("rb")).groupBy("topic", "ra", "rb").agg(F.count("*").alias("both"))
    both = written(both, "co-counts")  # with ra = rb a word's documents
    df = both.where("ra = rb").select("topic", "ra", F.col("both").alias("df"))
    pairs = tops.select("topic", F.col("rank").alias("ra")).join(tops.select("topic", F.col("rank").alias("rb")), "topic").where("ra < rb")
    rows = pairs.join(df, ["topic", "ra"]).join(both, ["topic", "ra", "rb"], "left")
    return rows.groupBy("topic").agg(F.sum(F.log((F.coalesce("both", F.lit(0)) + 1) / F.col("df"))).alias("coherence"))


#: The shares at which documents are counted.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)


def allocation(doc_topics: DataFrame) -> DataFrame:
    """``(topic, n_0.01 ..., ratio)``: documents at or over each share; the ratio of those at 0.5 to those at 0.02, 0 if none."""
    counts = [F.count_if(F.col("prop") >= s).alias(f"at_{int(s * 100):02d}") for s in SHARES]
    found = doc_topics.groupBy("topic").agg(*counts)
    return found.withColumn("ratio", F.when(F.col("at_02") > 0, F.col("at_50") / F.col("at_02")).otherwise(0.0))


def dominant(doc_topics: DataFrame) -> DataFrame:
    """``(doc_id, topic)`` of the largest share, ties to the smallest topic."""
    best = F.max(F.struct("prop", (-F.col("topic")).alias("least")))
    return doc_topics.groupBy("doc_id").agg((-best["least"]).alias("topic"))


def segments_to_documents(segment_topics: DataFrame) -> DataFrame:
    """``(doc_id, topic, prop)`` from ``(doc_id, segment_id, topic, prop)``: sums made to add up to 1."""
    sums = segment_topics.groupBy("doc_id", "topic").agg(F.sum("prop").alias("p"))
    return sums.select("doc_id", "topic", (F.col("p") / F.sum("p").over(Window.partitionBy("doc_id"))).alias("prop"))


def year_bins(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, bin)`` and all ``bin`` from ``(doc_id, date)`` of dates as text: the year of the repaired date, without gaps; what is no date has no bin."""
    from lexloom.functions.dates import parse_date

    own = written(docs.select("doc_id", F.year(parse_date(F.col("date"))).alias("bin")).where("bin IS NOT NULL"), "bins")
    ends = own.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a IS NOT NULL")
    return own, ends.select(F.explode(F.sequence("a", "b")).alias("bin"))


def stream(doc_topics: DataFrame, doc_bins: DataFrame, bins: DataFrame) -> DataFrame:
    """``(bin, topic, value, docs)``: each bin's summed shares over its documents, empty bins as 0."""
    counts = doc_bins.groupBy("bin").agg(F.count("*").alias("docs"))
    sums = doc_topics.join(doc_bins, "doc_id").groupBy("bin", "topic").agg(F.sum("prop").alias("total"))
    dense = bins.crossJoin(doc_topics.select("topic").distinct())  # bins by topics, both bounded by the model
    rows = dense.join(counts, "bin", "left").join(sums, ["bin", "topic"], "left")
    return rows.select("bin", "topic", F.coalesce(F.col("total") / F.col("docs"), F.lit(0.0)).alias("value"), F.coalesce("docs", F.lit(0)).alias("docs"))


def smoothed(stream_: DataFrame, w: int = 2) -> DataFrame:
    return moving(stream_, "value", w, "bin", "topic")


def zscores(stream_: DataFrame) -> DataFrame:
    """``(bin, topic, z)``; 0 where a topic doesn't vary."""
    own = Window.partitionBy("topic")
    spread = F.stddev_samp("value").over(own)
    return stream_.select("bin", "topic", F.when(spread > 0, (F.col("value") - F.avg("value").over(own)) / spread).otherwise(0.0).alias("z"))


def prevalence(stream_: DataFrame) -> DataFrame:
    """``(topic, mean, spread, peak)`` over bins, empty ones too; ``peak`` is the largest smoothed value."""
    return smoothed(stream_).groupBy("topic").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.max("smoothed").alias("peak"))


def label_means(doc_topics: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, topic, mean)``: summed shares over all documents of the label."""
    sizes = labels.groupBy("label").agg(F.countDistinct("doc_id").alias("docs"))
    sums = doc_topics.join(labels, "doc_id").groupBy("label", "topic").agg(F.sum("prop").alias("total"))
    return sums.join(sizes, "label").select("label", "topic", (F.col("total") / F.col("docs")).alias("mean"))


def stacked(stream_: DataFrame) -> DataFrame:
    """``(bin, topic, low, high, share)``: where each topic lies on the pile of its bin, and its share of it."""
    up_to = Window.partitionBy("bin").orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("value").over(Window.partitionBy("bin"))
    high = F.sum("value").over(up_to)
    return stream_.select("bin", "topic", (high - F.col("value")).alias("low"), high.alias("high"), F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("share"))


def mutual_information(placed: DataFrame) -> DataFrame:
    """``(label_x, label_y, mi)`` in bits, of ``(doc_id, label, interval, topic)`` dominant topics.

    Two labels' documents meet where their intervals agree.  Counts by
    interval are multiplied, so documents are never paired.  Pairs of labels
    that share no interval have 0.
    """
    counts = placed.groupBy("label", "interval", "topic").agg(F.count("*").alias("n"))
    x = counts.select(F.col("label").alias("label_x"), "interval", F.col("topic").alias("tx"), F.col("n").alias("nx"))
    y = counts.select(F.col("label").alias("label_y"), "interval", F.col("topic").alias("ty"), F.col("n").alias("ny"))
    met = x.join(y, "interval").where("label_x < label_y").groupBy("label_x", "label_y", "tx", "ty").agg(F.sum(F.col("nx") * F.col("ny")).alias("n"))  # labels by topics in an interval
    pair = ["label_x", "label_y"]
    total, px, py = (F.sum("n").over(Window.partitionBy(*pair, *more)) for more in ([], ["tx"], ["ty"]))
    shares = met.select(*pair, (F.col("n") / total).alias("p"), (px / total).alias("px"), (py / total).alias("py"))
    found = shares.groupBy(*pair).agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    names = placed.select(F.col("label").alias("label_x")).distinct()
    every = names.join(names.withColumnRenamed("label_x", "label_y"), F.col("label_x") < F.col("label_y"))  # labels only
    return every.join(found, pair, "left").select(*pair, F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))


def correlations(doc_topics: DataFrame, n_documents: int, top: int = 5) -> DataFrame:
    """``(topic_x, topic_y, r)`` of the most correlated pairs; a topic a document lacks counts 0."""
    n = float(n_documents)
    own = doc_topics.groupBy("topic").agg(F.sum("prop").alias("s"), F.sum(F.col("prop") ** 2).alias("q"))
    x, y = doc_topics.select("doc_id", F.col("topic").alias("topic_x"), F.col("prop").alias("a")), doc_topics.select("doc_id", F.col("topic").alias("topic_y"), F.col("prop").alias("b"))
    joint = x.join(y, "doc_id").where("topic_x < topic_y").groupBy("topic_x", "topic_y").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))  # a document's topics
    rows = joint.join(own.select(F.col("topic").alias("topic_x"), F.col("s").alias("sx"), F.col("q").alias("qx")), "topic_x").join(own.select(F.col("topic").alias("topic_y"), F.col("s").alias("sy"), F.col("q").alias("qy")), "topic_y")
    r = (n * F.col("ab") - F.col("sx") * F.col("sy")) / F.sqrt((n * F.col("qx") - F.col("sx") ** 2) * (n * F.col("qy") - F.col("sy") ** 2))
    return rows.select("topic_x", "topic_y", F.round(r, 9).alias("r")).orderBy(F.desc("r"), "topic_x", "topic_y").limit(top)


def dirichlet_gradient(weights: np.ndarray, found: list[list[int]], counts: np.ndarray) -> np.ndarray:
    """The gradient by ``weights`` (feature, topic) of the log likelihood of topic ``counts`` under the priors ``exp`` of the summed weights of each document's features."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.array([i for f in found for i in f], dtype=np.int64)
    logs = np.zeros(counts.shape)
    np.add.at(logs, rows, weights[cols])
    prior = np.exp(np.clip(logs, -20, 20))
    total = prior.sum(axis=1, keepdims=True)
    change = prior * (digamma(total) - digamma(total + counts.sum(axis=1, keepdims=True)) + digamma(prior + counts) - digamma(prior))
    out = np.zeros_like(weights)
    np.add.at(out, cols, change[rows])
    return out


def feature_weights(topic_counts: DataFrame, features: DataFrame, k: int, rounds: int = 30, rate: float = 0.2, spread: float = 1.0, most_features: int = 10_000) -> DataFrame:
    """``(topic, feature, weight)`` of the log-linear prior of feature-conditioned topics, and of its ``default``.

    ``topic_counts``: (doc_id, topic, n), the words of each topic in a
    document; ``features``: (doc_id, feature).  The prior of a document's topic
    is the exponential of its features' summed weights.  The weights maximise the
    likelihood of the counts, with a normal penalty of deviation ``spread``, by
    Adam: each round is one pass whose gradients are summed by task and
    feature, so the driver sees topics by features only.  More than
    ``most_features`` features are an error, since the weights are sent to all
    tasks.
    """
    import pyarrow as pa

    spark = topic_counts.sparkSession
    names = [r["feature"] for r in features.select("feature").distinct().orderBy("feature").limit(most_features + 1).collect()]
    if len(names) > most_features:
        raise ValueError(f"more than {most_features} features")
    numbers = spark.createDataFrame([(f, i + 1) for i, f in enumerate(names)], "feature string, i int")
    own = features.distinct().join(numbers, "feature").groupBy("doc_id").agg(F.sort_array(F.collect_list("i")).alias("x"))
    bags = topic_counts.groupBy("doc_id").agg(F.collect_list(F.struct("topic", "n")).alias("c"))
    rows = written(bags.join(own, "doc_id", "left").select("c", F.concat(F.array(F.lit(0)), F.coalesce("x", F.array().cast("array<int>"))).alias("x")), "priors")
    weights = np.zeros((len(names) + 1, k))
    weights[0] = np.log(1 / k)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches, shared=shared):
            total = np.zeros_like(shared.value)
            for b in batches:
                counts = np.zeros((b.num_rows, k))
                for i, c in enumerate(b.column("c").to_pylist()):
                    for x in c:
                        counts[i, x["topic"]] += x["n"]
                total += dirichlet_gradient(shared.value, b.column("x").to_pylist(), counts)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.float64()))], names=["i", "g"])

        sums = rows.mapInArrow(gradient, "i int, g array<double>").groupBy("i").agg(F.array(*(F.sum(F.get("g", F.lit(t))) for t in range(k))).alias("g")).collect()  # a row a feature
        grad = -weights / spread**2
        grad[0] = 0
        for r in sums:
            grad[r["i"]] += r["g"]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        shared.unpersist()
    return spark.createDataFrame([(t, f, float(weights[i, t])) for i, f in enumerate(["default", *names]) for t in range(k)], "topic int, feature string, weight double")


def naive_bayes(bags: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes: ``(label, docs, tokens, terms)`` of classes and ``(label, term, n)`` of words."""
    rows = bags.join(labels, "doc_id")
    words = rows.groupBy("label", "term").agg(F.sum("tf").alias("n"))
    terms = words.select("term").distinct().agg(F.count("*").alias("terms"))
    classes = labels.groupBy("label").agg(F.count("*").alias("docs")).join(words.groupBy("label").agg(F.sum("n").alias("tokens")), "label", "left")
    return classes.select("label", "docs", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(F.broadcast(terms)), words  # one row


def classify(bags: DataFrame, classes: DataFrame, words: DataFrame, most_classes: int = 10_000) -> DataFrame:
    """``(doc_id, label, score)`` of each document's best class, ties to the smallest label; unknown words don't count.

    A word comes with the gains of the classes that have it; these are summed by
    document and class, and a document's best class is looked for within its row,
    so no bag meets a class that lacks its word.  More than ``most_classes`` classes are an error.
    """
    if classes.limit(most_classes + 1).count() > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    model = words.groupBy("term").agg(F.collect_list(F.struct("label", F.log(F.col("n") + 1.0).alias("gain"))).alias("gains"))  # a class each
    kind = words.schema["label"].dataType
    met = bags.join(model, "term", "left")
    length = F.struct(F.lit(None).cast(kind).alias("label"), F.when(F.col("gains").isNotNull(), F.col("tf")).otherwise(0).cast("double").alias("gain"))
    own = F.transform(F.coalesce("gains", F.array().cast(model.schema["gains"].dataType)), lambda g: F.struct(g["label"].alias("label"), (F.col("tf") * g["gain"]).alias("gain")))
    sums = met.select("doc_id", F.explode(F.array_append(own, length)).alias("g")).groupBy("doc_id", "g.label").agg(F.sum("g.gain").alias("gain"))
    held = F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "gain")))
    rows = sums.groupBy("doc_id").agg(F.max(F.when(F.col("label").isNull(), F.col("gain"))).alias("len"), F.map_from_entries(held).alias("gains"))  # a class each
    every = classes.agg(F.sum("docs").alias("all_docs"), F.collect_list(F.struct("label", "docs", "tokens", "terms")).alias("classes"))  # checked above
    start = lambda c: F.log(c["docs"] / F.col("all_docs")) - F.col("len") * F.log(c["tokens"] + c["terms"])
    score = lambda c: F.round(start(c) + F.coalesce(F.try_element_at("gains", c["label"]), F.lit(0.0)), 6)
    best = F.array_min(F.transform("classes", lambda c: F.struct((-score(c)).alias("below"), c["label"].alias("label"))))
    found = rows.join(F.broadcast(every)).select("doc_id", best.alias("b"))  # one row
    return found.select("doc_id", F.col("b.label").alias("label"), (-F.col("b.below")).alias("score"))
