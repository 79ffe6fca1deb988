"""Toxicity by a counterfactually regularised classifier.

A logistic model over which words and word stems (beginnings of 3 to 6
letters) a text has, presence only, so long texts aren't outvoted by their
neutral words.  Features are those that labelled toxic texts have
significantly more often, and all identity terms.  In training, each labelled
text with identity terms is paired with its counterfactual, terms swapped
within their group, and the squared difference of the two scores is added to
the loss: mentioning one group rather than another cannot carry a score.  The
penalty's weight is large, since a small one shares a name's weight among the
names of its group rather than taking it away.

Scale.  The model is fitted on at most about ``most_rows`` labelled rows,
chosen by a hash of their id, then of their text; feature counts are summed in each batch.
Scoring is one pass over the texts without a shuffle, with a model of at most
``most_features`` features.

Rows.  A null or empty text has the model's base score.  Labels repeated for
an id count as toxic if any is; null labels and ids without a text are left
out; equal rows of an id train once.  Without labels of both kinds every score is the share of toxic labels
(0 if there are none).  Repeated rows come back once each, null ids too.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_keep, arrow_map, held_out, written

#: Groups of terms that can stand for each other.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("africans", "europeans", "americans", "asians"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
EDGES = ".,;:!?\"'()[]{}*%$#&|<>+=~`@^\\/_-…«»„“”‘’"
STEMS = (3, 4, 5, 6)
_TERM = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word itself, and its stems as ``stem-``."""
    word = word.strip(EDGES)
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)] if word else []


def features(text: str | None) -> set[str]:
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def swapped(text: str) -> str | None:
    """The lower-cased text with identity terms swapped, None if it has none."""
    low = text.lower()
    if not any(t in low for t in SWAP):
        return None
    out = _TERM.sub(lambda m: SWAP.get(m[0], m[0]), low)
    return out if out != low else None


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``(text, toxic)`` of about ``most_rows`` labelled documents at most, held-out ids left out."""
    ours = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(4)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most_rows / max(1, ours.count()))
    chosen = ours.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])  # about most_rows ids
    rows = written(found.select("text", "toxic", F.xxhash64("doc_id", "text").alias("at")), "labelled")
    share = min(1.0, most_rows / max(1, rows.count()))  # less than 1 if ids have several texts
    return rows.where(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("text", "toxic")


def select_features(rows: DataFrame, most_features: int = 4096, least_g2: float = 12.0, least_docs: int = 3) -> list[str]:
    """Features that toxic rows have significantly more often, the strongest first; then the identity terms."""

    def count(texts, toxic):
        by = Counter(), Counter()
        for t, y in zip(texts, toxic):
            by[y > 0].update(features(t))
        names = [*(by[0].keys() | by[1].keys())]
        return {"feature": names, "n0": [by[0][f] for f in names], "n1": [by[1][f] for f in names]}

    n = rows.agg(F.count_if(F.col("toxic") > 0).alias("n1"), F.count_if(F.col("toxic") <= 0).alias("n0")).first()
    if not n["n1"] or not n["n0"]:
        return []
    found = arrow_map(rows, "feature string, n0 bigint, n1 bigint", count, "text", "toxic", rows=None).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    both, all_ = n0 + n1, float(n["n0"] + n["n1"])
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(n1, both * (n["n1"] / all_)) + part(n0, both * (n["n0"] / all_)) + part(n["n1"] - n1, (all_ - both) * (n["n1"] / all_)) + part(n["n0"] - n0, (all_ - both) * (n["n0"] / all_)))
    strong = found.where((n1 >= least_docs) & (n1 / n["n1"] > n0 / n["n0"])).withColumn("g2", g2).where(F.col("g2") >= least_g2)
    names = [r["feature"] for r in strong.orderBy(F.desc("g2"), "feature").limit(most_features).collect()]
    return names + [t for t in SWAP if t not in set(names)]


class Model:
    """Weights by feature, and the base score."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights, self.bias = weights, bias
        self.memory: dict[str, tuple[int, ...]] = {}

    def active(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in set((text or "").lower().split()):
            own = self.memory.get(w)
            if own is None:
                own = tuple(i for f in word_features(w) if (i := self.index.get(f)) is not None)
                if len(self.memory) < 100_000:
                    self.memory[w] = own
            out.update(own)
        return out

    def score(self, text: str | None) -> float:
        at = self.bias + sum(self.weights[i] for i in sorted(self.active(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, at))))

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}


def fit(active: list, toxic: np.ndarray, pairs: list, n_features: int, l2: float = 1e-4, fairness: float = 30.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam.

    ``active``: feature numbers of each row; ``pairs``: (row, feature numbers
    of its counterfactual); ``fairness`` weighs the mean squared score change.
    """

    def matrix(lists):
        return np.repeat(np.arange(len(lists)), list(map(len, lists))), np.array([i for own in lists for i in own], dtype=np.int64)

    rows, cols = matrix(active)
    signed = [[(i, 1.0) for i in set(active[r]) - set(other)] + [(i, -1.0) for i in set(other) - set(active[r])] for r, other in pairs]
    p_rows = np.repeat(np.arange(len(signed)), list(map(len, signed)))
    p_cols = np.array([i for own in signed for i, _ in own], dtype=np.int64)
    p_sign = np.array([v for own in signed for _, v in own])
    y, n = (toxic > 0).astype(float), len(toxic)
    w = np.zeros(n_features + 1)
    w[-1] = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        score = np.bincount(rows, weights=w[cols], minlength=n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - y) / n
        grad = np.append(np.bincount(cols, weights=error[rows], minlength=n_features) + l2 * w[:-1], error.sum())
        if len(signed):
            change = np.bincount(p_rows, weights=p_sign * w[p_cols], minlength=len(signed))
            grad[:-1] += 2 * fairness / len(signed) * np.bincount(p_cols, weights=p_sign * change[p_rows], minlength=n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 4096, fairness: float = 30.0) -> Model:
    rows = training_rows(docs, labels, most_rows)
    names = select_features(rows, most_features)
    if not names:
        share = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
        return Model([], np.zeros(0), math.log((share + 1e-9) / (1 - share + 1e-9)))
    blank = Model(names, np.zeros(len(names)), 0.0)

    def encode(texts, toxic):
        other = [swapped(t) if t else None for t in texts]
        return {"active": [sorted(blank.active(t)) for t in texts], "other": [None if o is None else sorted(blank.active(o)) for o in other], "toxic": toxic}

    found = arrow_map(rows, "active array<int>, other array<int>, toxic int", encode, "text", "toxic").toPandas()  # about most_rows short lists
    active = [list(a) for a in found["active"]]
    pairs = [(i, list(o)) for i, o in enumerate(found["other"]) if o is not None]
    weights, bias = fit(active, found["toxic"].to_numpy(), pairs, len(names), fairness=fairness)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        scores = [shared.value.score(t) for t in texts]
        return {"doc_id": ids, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    scored = arrow_map(docs, "doc_id bigint, score double, predicted int", run, "doc_id", "text")
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the model calls toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return arrow_keep(docs, lambda text: shared.value.score(text) < threshold)
