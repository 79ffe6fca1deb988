"""Topic models by collapsed Gibbs sampling over a distributed table of tokens.

Documents are dealt to blocks by their id.  A sweep is one job: each block meets
the counts of its own words over the whole corpus, draws every token's topic anew
and gives the new topics and its words' new counts, which are summed by word for
the next sweep.  Within a block, tokens that stand at the same place of
different stretches are drawn at once, all others one after another.

Nothing depends on how rows are partitioned: blocks, the order within them and
the random numbers follow from ids, words and the seed.

Scale.  Every word is kept: words are dealt to chunks by hash, a chunk sums its
words' counts over all blocks, and a block gets those of its own words.  A block has
about ``block_tokens`` tokens and there is a chunk to ``chunk_tokens`` of them, so
tasks are bounded.  A task has a part, blocks of about ``part_tokens`` tokens together, whose
counts are sent and got once for all of them.  What a sweep shuffles grows with the tokens: a
block's topics and a part's counts by chunk are one packed row each, and bags, which don't
change, stay where they are.  The driver sees
topics, not words: their totals, the prior over topics, and histograms of count values
whose classes above 255 are 64 to a doubling.  Sweeps are written, so a lost executor
costs a re-read, and deleted once the next one is.

Priors.  After ``burn_in`` sweeps, every ``optimize_every`` sweeps the prior over
topics, one weight each, and that over words are fitted by fixed-point rounds
that never lower the likelihood of the counts.  With ``features`` each document's
prior is the exponential of its features' summed weights, which are fitted
instead, by limited-memory BFGS, so sampling and weights inform each other.

Rows.  Bags are ``(doc_id, term, tf)``; documents without tokens aren't in the
model.  A null id is one document.  No bags give an empty model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.layout import forget, written

#: Kinds of rows: a block's topics, a part's own counts and their sums over all parts by chunk, counts by topic, and histograms.
TOPICS, COUNTS, SUMS, TOTALS, SHARES, LENGTHS = range(6)
_ROWS = "part int, block int, kind tinyint, chunk int, data binary, w bigint, topic int, n bigint"
_PACKS = "part int, data binary, ids array<{id}>"
_DOCS = "block int, doc_id {id}, x array<int>, words array<bigint>, topics array<int>"
_COUNTED = "doc_id {id}, x array<int>, counts array<bigint>"


@dataclass
class Model:
    """A fitted model.

    ``rows`` are a sweep's, ``packs`` the parts' documents with their tokens' words, packed,
    ``words`` all words: ``(w, term)``.
    """

    rows: DataFrame
    packs: DataFrame
    words: DataFrame
    k: int
    alpha: np.ndarray
    beta: float
    n_words: int
    n_parts: int = 1
    weights: np.ndarray | None = None
    features: list[str] = field(default_factory=list)

    def _met(self, packs: DataFrame, rows: DataFrame, tell: Callable, ddl: str) -> DataFrame:
        """Parts and the rows of a sweep that belong to each; parts that lie so already stay."""
        return packs.groupBy("part").cogroup(rows.repartition(self.n_parts, "part").groupBy("part")).applyInArrow(tell, ddl)

    def _shown(self, tell: Callable[[Callable], Callable], ddl: str) -> DataFrame:
        """Documents, unpacked from bags and topics."""
        ddl = ddl.format(id=self.packs.schema["ids"].dataType.elementType.simpleString())
        topics = self.rows.where(F.col("kind") == TOPICS).select("part", "block", "data")
        return self._met(self.packs.repartition(self.n_parts, "part"), topics, tell(_arrow(ddl)), ddl)

    @property
    def docs(self) -> DataFrame:
        """``(block, doc_id, x, words, topics)``: documents with their features and their tokens' words and topics."""
        return self._shown(_told, _DOCS)

    def counted(self) -> DataFrame:
        """``(doc_id, x, counts)``: documents with their features and how many tokens of each topic they have."""
        return self._shown(lambda schema: _counted(schema, self.k), _COUNTED)

    def state(self) -> DataFrame:
        """``(doc_id, position, term, topic)`` of every token; positions go by word."""
        tokens = self.docs.select("doc_id", F.posexplode(F.arrays_zip("words", "topics")).alias("position", "t")).select("doc_id", "position", F.col("t.words").alias("w"), F.col("t.topics").alias("topic"))
        return tokens.join(self.words, "w").select("doc_id", "position", "term", "topic")

    def word_counts(self) -> DataFrame:
        """``(w, topic, n)``: the parts' counts, summed."""
        return self.rows.where(F.col("kind") == COUNTS).select("chunk", "part", "data").groupBy("chunk").applyInArrow(_summed(self.k, False), "w bigint, topic int, n bigint")

    def counts(self) -> DataFrame:
        """``(topic, term, n)`` of the words of each topic."""
        return self.word_counts().join(self.words, "w").select("topic", "term", "n")

    def doc_counts(self) -> DataFrame:
        """``(doc_id, topic, n)`` of the topics that a document has."""
        return self.counted().select("doc_id", F.posexplode("counts").alias("topic", "n")).where("n > 0")

    def doc_topics(self) -> DataFrame:
        """``(doc_id, topic, prop)`` of all topics: counts and prior weights over their sum."""
        docs = self.counted().select("doc_id", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("len"), F.posexplode("counts").alias("topic", "n"))
        prior = F.get(F.array(*(F.lit(float(a)) for a in self.alpha)), F.col("topic"))
        return docs.select("doc_id", "topic", ((F.col("n") + prior) / (F.col("len") + float(self.alpha.sum()))).alias("prop"))

    def feature_weights(self) -> DataFrame:
        """``(topic, feature, weight)`` of a model with features, ``default`` being every document's."""
        rows = [(t, f, float(self.weights[i, t])) for i, f in enumerate(["default", *self.features]) for t in range(self.k)]
        return self.rows.sparkSession.createDataFrame(rows, "topic int, feature string, weight double")


# within a block


def draw(words: np.ndarray, topics: np.ndarray, docs: np.ndarray, places: np.ndarray, word_counts: np.ndarray, totals: np.ndarray, alpha: np.ndarray, beta: float, n_words: int, rng: np.random.Generator, stretch: int = 128) -> None:
    """Draws every token's topic anew, in place.

    ``words``, ``docs``, ``places`` are a token's word, document and place in it;
    ``word_counts`` (word, topic) and ``totals`` (topic) count the whole corpus;
    ``alpha`` has a row for each document or is one for all.
    """
    k = len(totals)
    doc_counts = np.bincount(docs * k + topics, minlength=(docs[-1] + 1 if len(docs) else 0) * k).reshape(-1, k) + alpha
    of_docs, of_words = doc_counts.reshape(-1), word_counts.reshape(-1)  # the same cells
    column = (places % stretch).astype(np.min_scalar_type(stretch))
    order = np.argsort(column, kind="stable")
    ends = np.cumsum(np.bincount(column, minlength=1)).tolist()
    all_words, all_docs, drawn = words[order], docs[order], topics[order]
    word_cells, doc_cells = all_words * k, all_docs * k
    for a, b in zip([0, *ends], ends):
        in_docs, in_words, z = doc_cells[a:b], word_cells[a:b], drawn[a:b]
        np.subtract.at(of_docs, in_docs + z, 1.0)
        np.subtract.at(of_words, in_words + z, 1.0)
        totals -= np.bincount(z, minlength=k)
        p = word_counts.take(all_words[a:b], axis=0)
        p += beta
        p *= doc_counts.take(all_docs[a:b], axis=0)
        p /= totals + n_words * beta
        p = np.ascontiguousarray(p.T)  # by topic: sums and comparisons then run over tokens
        for t in range(1, k):
            p[t] += p[t - 1]
        at, z = rng.random(b - a) * p[-1], np.zeros(b - a, dtype=np.int64)
        for t in range(k - 1):
            z += p[t] < at
        drawn[a:b] = z
        np.add.at(of_docs, in_docs + z, 1.0)
        np.add.at(of_words, in_words + z, 1.0)
        totals += np.bincount(z, minlength=k)
    topics[order] = drawn


def log_priors(x: list, weights: np.ndarray) -> np.ndarray:
    """The sum of each document's features' weights, by topic."""
    out = np.tile(weights[0], (len(x), 1))
    rows = np.repeat(np.arange(len(x)), [len(f or ()) for f in x])
    np.add.at(out, rows, weights[[i for f in x for i in f or ()]])
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up, each in the narrowest type that holds it, byte planes apart, compressed."""
    import pyarrow as pa

    parts = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        parts += [np.array([a.itemsize, len(a)], "<i8").tobytes(), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    data, at, out = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(data):
        width, n = np.frombuffer(data, "<i8", 2, at).tolist()
        planes = np.frombuffer(data, np.uint8, width * n, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 16 + width * n
    return out


def steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of ascending values the first value and the steps to the next ones."""
    out = np.diff(values, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[starts] = values[starts]
    return out


def walked(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ``steps``."""
    through = np.cumsum(found)
    starts = np.cumsum(sizes) - sizes
    return through - np.repeat(np.where(starts > 0, through[starts - 1], 0) if len(through) else starts, sizes)


def _arrow(ddl: str):
    """A DDL schema as Arrow's."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _rows(schema, many: int, **columns):
    import pyarrow as pa

    return pa.table([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)


def _lists(values, sizes: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _gathered(schema) -> Callable:
    """The bags of a part's documents, by block and id, and its words, one packed row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def gather(rows, features=None):
        if not rows.num_rows:  # features only
            return schema.empty_table()
        found = pc.dictionary_encode(rows.column("doc_id").combine_chunks(), null_encoding="encode")
        ids, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        block, w, tf = (rows.column(c).to_numpy() for c in ("block", "w", "tf"))
        of = np.zeros(len(ids), dtype=np.int64)
        of[code] = block
        order = pc.sort_indices(pa.table({"block": of, "id": ids}), sort_keys=[("block", "ascending"), ("id", "ascending")]).to_numpy()
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        words, i = np.unique(w, return_inverse=True)
        at = np.argsort(rank[code] * len(words) + i, kind="stable")
        sizes = np.zeros(len(ids), dtype=np.int64)
        np.add.at(sizes, rank[code], tf.astype(np.int64))
        ids, n_features, x = ids.take(pa.array(order)), np.zeros(len(ids), dtype=np.int64), np.empty(0, dtype=np.int64)
        if features is not None and features.num_rows:
            own = features.column("x").combine_chunks().take(pc.index_in(ids, value_set=features.column("doc_id").combine_chunks()))
            n_features = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        blocks, n_docs = np.unique(of, return_counts=True)
        chunks, per = np.unique(words >> 32, return_counts=True)
        data = packed(blocks, n_docs, sizes, steps(np.repeat(i[at], tf[at]), sizes), n_features, x, chunks, per, steps(words & 0xFFFFFFFF, per))
        return _rows(schema, 1, part=rows.column("part")[:1].combine_chunks(), data=[data], ids=_lists(ids, np.array([len(ids)])))

    return gather


def _whole(gather: Callable) -> Callable:
    """``gather`` over partitions that hold parts whole, without sorting their rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        found = list(batches)
        if found:
            rows = pa.Table.from_batches(found)
            parts = pc.unique(rows.column("part"))
            for part in parts:
                yield from gather(rows if len(parts) == 1 else rows.filter(pc.equal(rows.column("part"), part))).to_batches()

    return run


def _opened(packs, rows) -> tuple[list[np.ndarray], np.ndarray]:
    """A part's arrays, words as they are, and the topics of its tokens."""
    blocks, n_docs, sizes, words, *rest = unpacked(packs.column("data")[0].as_py())
    by = dict(zip(rows.column("block").to_pylist(), rows.column("data").to_pylist()))
    return [blocks, n_docs, sizes, walked(words, sizes), *rest], np.concatenate([unpacked(by[b])[0] for b in blocks.tolist()])


def _told(schema) -> Callable:
    """A part's documents with their topics."""

    def tell(packs, rows):
        if not packs.num_rows:
            return schema.empty_table()
        (blocks, n_docs, sizes, words, n_features, x, chunks, per, r), topics = _opened(packs, rows)
        own = (np.repeat(chunks, per) << 32) + walked(r, per)
        return _rows(schema, len(sizes), block=np.repeat(blocks, n_docs), doc_id=packs.column("ids").combine_chunks().flatten(), x=_lists(x, n_features), words=_lists(own[words], sizes), topics=_lists(topics, sizes))

    return tell


def _counted(schema, k: int) -> Callable:
    """The features and topic counts of a part's documents."""

    def tell(packs, rows):
        if not packs.num_rows:
            return schema.empty_table()
        (_, _, sizes, _, n_features, x, *_), topics = _opened(packs, rows)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * k + topics, minlength=len(sizes) * k)
        return _rows(schema, len(sizes), doc_id=packs.column("ids").combine_chunks().flatten(), x=_lists(x, n_features), counts=_lists(counts, np.full(len(sizes), k)))

    return tell


def _summed(k: int, back: bool) -> Callable:
    """The sums of a chunk's counts over all parts: by word and topic, or ``back`` to each part for its own words."""
    import pyarrow as pa

    def total(rows):
        chunk = rows.column("chunk")[0].as_py()
        parts, places, sums = rows.column("part").to_pylist(), [], np.zeros((0, k), dtype=np.int64)
        for data in rows.column("data"):
            steps_, n = unpacked(data.as_py())
            r = np.cumsum(steps_)
            if r[-1] >= len(sums):
                sums = np.concatenate([sums, np.zeros((max(int(r[-1]) + 1, 2 * len(sums)) - len(sums), k), dtype=np.int64)])
            sums[r] += n.reshape(-1, k)
            places.append(r.astype(np.int32))
        if back:
            return pa.table({"part": pa.array(parts, pa.int32()), "chunk": pa.array([chunk] * len(parts), pa.int32()), "data": pa.array([packed(sums[r].reshape(-1)) for r in places], pa.binary())})
        r, topic = np.nonzero(sums)
        return pa.table({"w": pa.array((chunk << 32) + r, pa.int64()), "topic": pa.array(topic, pa.int32()), "n": pa.array(sums[r, topic], pa.int64())})

    return total


def _swept(schema, k: int, alpha: np.ndarray, beta: float, n_words: int, weights: np.ndarray | None, totals: np.ndarray, seed: int, step: int, histograms: bool) -> Callable:
    """A sweep over one part, block by block: each starts from the last sweep's counts."""
    import pyarrow as pa

    def sweep(packs: pa.Table, rows: pa.Table | None = None) -> pa.Table:
        if not packs.num_rows:
            return schema.empty_table()
        part, by = packs.column("part")[0].as_py(), {}
        blocks, n_docs, sizes, words, n_features, x, chunks, own, r = unpacked(packs.column("data")[0].as_py())
        words, n_own = walked(words, sizes), int(own.sum())
        for kind, block, chunk, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "block", "chunk", "data"))) if rows else ():
            by[kind, block if kind == TOPICS else chunk] = data
        if step:
            counts = np.concatenate([unpacked(by[SUMS, c])[0] for c in chunks.tolist()]).reshape(-1, k).astype(float)
            owned = None if weights is None else np.split(x, np.cumsum(n_features)[:-1])
        drawn, ends, docs_ends = [], np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(n_docs)))
        for block, first, last in zip(blocks.tolist(), docs_ends.tolist(), docs_ends[1:].tolist()):
            own_sizes, own_words = sizes[first:last], words[ends[first] : ends[last]]
            rng = np.random.Generator(np.random.Philox(key=[seed, (step << 32) + block]))
            if step == 0:
                drawn.append(rng.integers(0, k, len(own_words)))
                continue
            topics, here = unpacked(by[TOPICS, block])[0], np.zeros(n_own, dtype=bool)
            here[own_words] = True
            docs = np.repeat(np.arange(last - first), own_sizes)
            places = np.arange(len(docs)) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
            prior = alpha if weights is None else np.exp(np.clip(log_priors([f.tolist() for f in owned[first:last]], weights), -20, 20))
            draw((np.cumsum(here) - 1)[own_words], topics, docs, places, counts[here], totals.copy(), prior, beta, n_words, rng)
            drawn.append(topics)
        many, topics = len(blocks), np.concatenate(drawn)
        out = [_rows(schema, many, part=np.full(many, part), block=blocks, kind=np.full(many, TOPICS), data=[packed(z) for z in drawn])]
        counts, upto = np.bincount(words * k + topics, minlength=n_own * k), np.cumsum(own)
        data = [packed(r[a:b], counts[a * k : b * k]) for a, b in zip((upto - own).tolist(), upto.tolist())]
        out.append(_rows(schema, len(chunks), part=np.full(len(chunks), part), kind=np.full(len(chunks), COUNTS), chunk=chunks, data=data))
        out.append(_rows(schema, many * k, kind=np.full(many * k, TOTALS), topic=np.tile(np.arange(k), many), n=np.concatenate([np.bincount(z, minlength=k) for z in drawn])))
        if histograms:  # in ``w`` the value, in ``n`` how many documents have it
            pairs, per = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + topics, return_counts=True)
            pairs, n = np.unique(pairs % k + per * k, return_counts=True)
            out.append(_rows(schema, len(n), kind=np.full(len(n), SHARES), w=pairs // k, topic=pairs % k, n=n))
            value, n = np.unique(sizes, return_counts=True)
            out.append(_rows(schema, len(n), kind=np.full(len(n), LENGTHS), w=value, n=n))
        return pa.concat_tables(out)

    return sweep


# priors


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive ``x``: raised above 6 by its recurrence, then its asymptotic series."""
    x = np.array(x, dtype=float)
    low = np.zeros(np.shape(x))
    for _ in range(6):
        small = x < 6
        low -= np.where(small, 1 / np.where(small, x, 1.0), 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of gamma for positive ``x``, in the same way."""
    x = np.array(x, dtype=float)
    low = np.zeros(np.shape(x))
    for _ in range(8):
        small = x < 8
        low -= np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y / 1260)) / x


#: (value, how many have it), both arrays.
Histogram = tuple[np.ndarray, np.ndarray]


def dirichlet_likelihood(alpha: np.ndarray, counts: list[Histogram], lengths: Histogram) -> float:
    """The log likelihood of counts under a Dirichlet prior of weights ``alpha``, but for what doesn't depend on it."""
    found = sum(float((n * (log_gamma(v + a) - log_gamma(a))).sum()) for a, (v, n) in zip(alpha, counts))
    return found - float((lengths[1] * (log_gamma(lengths[0] + alpha.sum()) - log_gamma(alpha.sum()))).sum())


def fitted_prior(alpha: np.ndarray, counts: list[Histogram], lengths: Histogram, symmetric: bool = False, rounds: int = 100, least: float = 1e-6) -> np.ndarray:
    """Weights of a better, or equal, likelihood by fixed-point rounds; ``symmetric`` keeps them equal."""
    alpha = np.array(alpha, dtype=float)
    for _ in range(rounds):
        total = alpha.sum()
        below = float((lengths[1] * (digamma(lengths[0] + total) - digamma(total))).sum())
        above = np.array([float((n * (digamma(v + a) - digamma(a))).sum()) for a, (v, n) in zip(alpha, counts)])
        if below <= 0:
            break
        new = np.maximum(alpha * ((alpha * above).sum() / total if symmetric else above) / below, least)
        if np.abs(new - alpha).max() <= 1e-5 * new.max():
            return new
        alpha = new
    return alpha


def histograms(values: DataFrame, *by: str) -> DataFrame:
    """``(*by, value, n)`` of ``(*by, value, n)``: values to 255 as they are, larger ones by classes, 64 to a doubling, as their mean."""
    level = F.when(F.col("value") < 256, F.col("value").cast("double")).otherwise(256 + F.floor(F.log2("value") * 64).cast("double"))
    found = values.groupBy(*by, level.alias("level")).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return found.select(*by, F.col("mean").alias("value"), "n")


def _collected(rows: list, keys: int | None) -> list[Histogram]:
    """Rows of ``(key, value, n)`` as one histogram a key."""
    found: list[tuple[list, list]] = [([], []) for _ in range(keys or 1)]
    for r in rows:
        at = found[r["topic"] if keys else 0]
        at[0].append(r["value"])
        at[1].append(r["n"])
    return [(np.array(v, dtype=float), np.array(n, dtype=float)) for v, n in found]


def _totals(rows: DataFrame, k: int) -> np.ndarray:
    """A sweep's tokens by topic."""
    out = np.zeros(k)
    for r in rows.where(F.col("kind") == TOTALS).groupBy("topic").agg(F.sum("n").alias("n")).collect():  # a row a topic
        out[r["topic"]] = r["n"]
    return out


def _optimized(model: Model, symmetric: bool) -> None:
    """Both priors, fitted to the counts of the last sweep."""
    rows = model.rows
    own = rows.where(F.col("kind").isin(SHARES, LENGTHS)).select(F.coalesce("topic", F.lit(-1)).alias("topic"), F.col("w").alias("value"), "n")
    found = histograms(own, "topic").collect()  # classes of values, a topic each
    shares, lengths = _collected([r for r in found if r["topic"] >= 0], model.k), _collected([r for r in found if r["topic"] < 0], None)[0]
    if model.weights is None:
        model.alpha = fitted_prior(model.alpha, shares, lengths, symmetric)
    words = model.word_counts().withColumnRenamed("n", "value")
    of_words = _collected(histograms(words.select("value", F.lit(1).alias("n"))).collect(), None)[0]
    sums = _totals(rows, model.k)
    if not sums.any():
        return
    # one weight for every word: its histogram holds all words' counts, and a prior of equal weights sums to their number
    beta = model.beta
    for _ in range(100):
        above = float((of_words[1] * (digamma(of_words[0] + beta) - digamma(beta))).sum())
        below = model.n_words * float((digamma(sums + model.n_words * beta) - digamma(model.n_words * beta)).sum())
        if below <= 0:
            break
        beta, old = max(beta * above / below, 1e-6), beta
        if abs(beta - old) <= 1e-6 * beta:
            break
    model.beta = beta


def prior_value_and_gradient(weights: np.ndarray, x: list, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """The log likelihood of documents' topic counts under the priors of their features, and its gradient by ``weights`` (feature, topic)."""
    prior = np.exp(np.clip(log_priors(x, weights), -20, 20))
    total, length = prior.sum(axis=1), counts.sum(axis=1)
    value = (log_gamma(total) - log_gamma(total + length)).sum() + (log_gamma(prior + counts) - log_gamma(prior)).sum()
    change = prior * ((digamma(total) - digamma(total + length))[:, None] + digamma(prior + counts) - digamma(prior))
    out = np.zeros_like(weights)
    out[0] = change.sum(axis=0)
    rows = np.repeat(np.arange(len(x)), [len(f or ()) for f in x])
    np.add.at(out, [i for f in x for i in f or ()], change[rows])
    return float(value), out


def feature_objective(docs: DataFrame, k: int, spread: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The penalised likelihood of documents' features and topic counts, ``(x, counts)``, as a function of the weights; each call is a pass whose sums are by task and feature."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.select("x", "counts")

    def call(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights)  # topics by features, whose number is checked

        def part(batches):
            value, total = 0.0, np.zeros_like(shared.value)
            for b in batches:
                counts = b.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
                v, g = prior_value_and_gradient(shared.value, b.column("x").to_pylist(), counts)
                value, total = value + v, total + g
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([[value] + [0.0] * (k - 1), *total[at].tolist()], pa.list_(pa.float64()))], names=["i", "g"])

        sums = docs.mapInArrow(part, "i int, g array<double>").groupBy("i").agg(F.array(*(F.sum(F.get("g", F.lit(t))) for t in range(k))).alias("g")).collect()  # a row a feature
        shared.unpersist()
        value, grad = -float((weights[1:] ** 2).sum()) / (2 * spread**2), -weights / spread**2
        grad[0] = 0
        for r in sums:
            if r["i"] < 0:
                value += r["g"][0]
            else:
                grad[r["i"]] += r["g"]
        return value, grad

    return call


def climb(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, rounds: int = 8, memory: int = 6) -> np.ndarray:
    """A point of a higher, or equal, objective by limited-memory BFGS: steps are halved until the objective rises enough."""
    value, grad = objective(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = grad.copy(), []
        for s, y in reversed(past):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            used.append(a)
        q *= (past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum() if past else 1 / max(1e-9, np.abs(grad).max())
        for (s, y), a in zip(past, reversed(used)):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        slope, size = float((grad * q).sum()), 1.0
        if slope <= 1e-9:
            break
        for _ in range(12):
            new = at + size * q
            new_value, new_grad = objective(new)
            if new_value >= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - at, grad - new_grad  # of the negative objective
        if (s * y).sum() > 1e-10:
            past = [*past[1 - memory :], (s, y)]
        gained, at, value, grad = new_value - value, new, new_value, new_grad
        if gained <= 1e-6 * abs(value):
            break
    return at


# the whole corpus


def _apart(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that is hashed to it: ``n`` groups by these numbers lie in a partition each."""
    number = F.col("id").cast("int").alias("i")
    found = spark.range(32 * n).select(number).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("p")).agg(F.min("i").alias("i")).collect()
    by = {r["p"]: r["i"] for r in found}
    return [by.get(p, 32 * n + p) for p in range(n)]


def fit(
    bags: DataFrame, k: int = 50, iterations: int = 1000, alpha_sum: float = 50.0, beta: float = 0.01, burn_in: int = 200, optimize_every: int = 10, symmetric_alpha: bool = False, seed: int = 7,
    block_tokens: int = 200_000, chunk_tokens: int = 8_000_000, part_tokens: int = 2_000_000, terms: DataFrame | None = None, features: DataFrame | None = None, spread: float = 1.0, most_features: int = 10_000, watch: Callable[[int, Model], None] | None = None,
) -> Model:
    """A model of ``(doc_id, term, tf)`` bags.

    ``terms``: ``(term, cf)``, the words of the bags that are in the model, and how often; all if not given.
    ``alpha_sum`` is the first prior over all topics together.  ``features``:
    ``(doc_id, feature)``, at most ``most_features`` different ones, since every
    task gets their weights; ``spread`` is the deviation of the weights' own
    normal prior.  ``watch`` is called after each sweep.
    """
    spark = bags.sparkSession
    bags = bags.select("doc_id", "term", "tf").where("tf > 0")
    scratch = []
    if terms is None:
        bags = written(bags, "model-bags")
        scratch.append(bags)
        terms = bags.groupBy("term").agg(F.sum("tf").alias("cf"))
    terms = written(terms.select("term", "cf"), "model-terms")
    scratch.append(terms)
    kind = bags.schema["doc_id"].dataType.simpleString()
    tokens = int(terms.agg(F.sum("cf")).first()[0] or 0)
    n_blocks, n_chunks = max(1, -(-tokens // block_tokens)), max(1, -(-tokens // chunk_tokens))
    cores = spark.sparkContext.defaultParallelism
    n_parts = min(n_blocks, -(-max(1, tokens) // (part_tokens * cores)) * cores)
    chunk = F.pmod(F.xxhash64("term"), F.lit(n_chunks))
    ranked = terms.select("term", chunk.alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("term")) - 1)
    vocabulary = written(ranked.select("term", (F.shiftleft("c", 32) + F.col("r")).alias("w")), "model-words")
    part_keys, chunk_keys = F.lit(_apart(spark, n_parts)), F.lit(_apart(spark, n_chunks))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")
    part = F.get(part_keys, F.pmod(block, F.lit(n_parts))).alias("part")
    placed = bags.join(vocabulary, "term").select(part, block.alias("block"), "doc_id", "w", F.col("tf").cast("int").alias("tf")).repartition(n_parts, "part")
    model = Model(terms, terms, vocabulary, k, np.full(k, alpha_sum / k), beta, vocabulary.count(), n_parts)
    ddl = _PACKS.format(id=kind)
    gather = _gathered(_arrow(ddl))
    if features is not None:
        features = written(features.select(F.col("doc_id").cast(kind).alias("doc_id"), "feature").where("feature IS NOT NULL").distinct(), "model-features")
        model.features = [r["feature"] for r in features.select("feature").distinct().orderBy("feature").limit(most_features + 1).collect()]
        if len(model.features) > most_features:
            raise ValueError(f"more than {most_features} features")
        model.weights = np.zeros((len(model.features) + 1, k))
        model.weights[0] = np.log(alpha_sum / k)
        numbers = spark.createDataFrame([(f, i + 1) for i, f in enumerate(model.features)], "feature string, number int")
        own = features.join(numbers, "feature").groupBy("doc_id").agg(F.sort_array(F.collect_list("number")).alias("x"))
        own = own.select(part, "doc_id", "x").repartition(n_parts, "part").groupBy("part")
        packs = placed.groupBy("part").cogroup(own).applyInArrow(gather, ddl)
    else:
        packs = placed.mapInArrow(_whole(gather), ddl)
    model.packs = written(packs, "model-parts")
    for old in scratch:
        forget(old)
    arrow = _arrow(_ROWS)
    # a part's bags lie where its sweeps run: only topics and counts are shuffled
    held = model.packs.select("part", "data").repartition(n_parts, "part").persist(StorageLevel.DISK_ONLY)
    try:
        for step in range(iterations + 1):  # the first one deals topics at random
            tuned = step > burn_in and step % max(1, optimize_every) == 0
            totals = _totals(model.rows, k) if step else np.zeros(k)
            sweep = _swept(arrow, k, model.alpha, model.beta, model.n_words, model.weights, totals, seed, step, tuned)
            if step:
                counts = model.rows.where(F.col("kind") == COUNTS).select(F.get(chunk_keys, F.col("chunk")).alias("key"), "chunk", "part", "data").repartition(n_chunks, "key")
                sums = counts.groupBy("key").applyInArrow(_summed(k, True), "part int, chunk int, data binary").select("part", F.lit(None).cast("int").alias("block"), F.lit(SUMS).cast("tinyint").alias("kind"), "chunk", "data")
                topics = model.rows.where(F.col("kind") == TOPICS).select("part", "block", "kind", "chunk", "data")
                swept = model._met(held, topics.unionByName(sums), sweep, _ROWS)
            else:
                swept = held.groupBy("part").applyInArrow(lambda packs: sweep(packs), _ROWS)  # of one table: a second would be the key
            before, model.rows = model.rows, written(swept, "model-sweep")
            forget(before)
            if tuned:
                _optimized(model, symmetric_alpha)
                if model.weights is not None:
                    shown = written(model.counted().select("x", "counts"), "model-shares")
                    model.weights = climb(feature_objective(shown, k, spread), model.weights)
                    forget(shown)
            if watch:
                watch(step, model)
    finally:
        held.unpersist()
    return model
