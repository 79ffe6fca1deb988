"""Document fingerprints by locally consistent parsing.

A text's code points are names of level 0.  On each level runs of one name
become one name, then deterministic coin tossing (the lowest bit in which a
name differs from its left neighbour, and that bit) shrinks the alphabet until
local maxima, at bounded distance, mark where phrases begin; a phrase's name
is a hash of its names.  A phrase depends on a few names around it alone, so
equal substrings get equal phrases inside, wherever they lie.

A document's fingerprint has the hash of its whole text and, of the phrases of
three levels, the ``size`` smallest hashes.  Likeness is the estimated Jaccard
index of two documents' phrase sets, 1 for equal texts.

Scale.  All documents of a block are parsed together in numpy.  To pair each
document with its successor in descending id order, ids are cut into ranges
of equal counts, a frequent id and null ids into several by text hash; texts
are dealt by range, one to a partition, and each range also gets the first
document of the next one, so no task sees more than a range and texts are
shuffled once.

Rows.  A null text is empty.  Equal ids follow each other by text hash; null
ids come last.  An empty text's phrases are none; two empty texts are alike
(1), an empty and another are not (0).  No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed odd multipliers of the name hash.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def _coin(own: np.ndarray, left: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which the two differ) + that bit of ``own``."""
    differ = own ^ left
    at = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1)).astype(own.dtype)
    return ((at << own.dtype.type(1)) | ((own >> at) & own.dtype.type(1))).astype(np.uint8)


#: The coin of two labels below 128, by label and left neighbour; equal ones don't occur.
_COIN = _coin(*(x.ravel().astype(np.uint8) for x in np.meshgrid(np.arange(128), np.arange(128), indexing="ij")))


def _labels(name: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Small labels, no two neighbours equal: 64 bits -> 128 -> 14 -> 8 of them; documents begin anew."""
    left = np.empty_like(name)
    left[1:] = name[:-1]
    left[heads] = ~name[heads]
    label = np.minimum(_coin(name, left), 127)  # equal neighbours, a chance of 2^-64, would give 128
    for _ in range(2):
        beside = np.empty_like(label)
        beside[1:] = label[:-1]
        beside[heads] = label[heads] ^ 1
        label = _COIN[(label.astype(np.int16) << 7) | beside]
    return label


def _fold(values: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each segment's values in order."""
    lengths = np.diff(np.r_[starts, len(values)])
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        spread = mix(values + (place.astype(np.uint64) + np.uint64(1)) * _M1)
        return mix(np.add.reduceat(spread, starts) + lengths.astype(np.uint64) * _M1 + np.uint64(salt))


def parse_level(name: np.ndarray, doc: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of the next level, and whose they are."""
    new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
    runs = np.flatnonzero(new)
    lengths = np.diff(np.r_[runs, len(name)]).astype(np.uint64)
    name, doc = name[runs], doc[runs]
    with np.errstate(over="ignore"):
        long = np.flatnonzero(lengths > 1)
        name[long] = mix(name[long] ^ mix(lengths[long]))  # not a sum: 'aaabb' must not give equal names
    first = np.r_[True, doc[1:] != doc[:-1]]
    heads = np.flatnonzero(first)
    label = _labels(name, heads)
    before, after = np.r_[np.uint8(99), label[:-1]], np.r_[label[1:], np.uint8(99)]
    before[heads] = 99
    after[np.r_[heads[1:], len(label)] - 1] = 99
    begins = np.flatnonzero(((label > before) & (label > after)) | first)
    return _fold(name, begins, level), doc[begins]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points as names, and whose they are."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(r) for r in raw])
    with np.errstate(over="ignore"):  # an odd factor keeps different characters apart
        return np.concatenate(raw).astype(np.uint64) * _M1 if raw else np.empty(0, dtype=np.uint64), doc


def sketches(texts: list[str], levels: tuple[int, ...] = (2, 3, 4), size: int = 64) -> list[np.ndarray]:
    """Of each text the ``size`` smallest distinct phrase hashes, sorted.  Short texts give their code points too."""
    name, doc = code_points(texts)
    found, owner = [], []
    for level in range(1, max(levels) + 1):
        if not len(name):
            break
        if level == 1:  # so that texts of one phrase still compare
            short = np.bincount(doc, minlength=len(texts))[doc] < 16
            found.append(name[short])
            owner.append(doc[short])
        name, doc = parse_level(name, doc, level)
        if level in levels:
            found.append(name)
            owner.append(doc)
    if not found:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    name, doc = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(name)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")] if len(texts) < 1 << 16 else np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    keep = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
    name, doc = name[keep], doc[keep]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [name[a : min(b, a + size)] for a, b in zip(edges, edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, size: int = 64) -> float:
    """The estimated Jaccard index of the sets that the sketches are of."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a[np.isin(a, b)]).sum() / len(both))


def told(text: str, sketch: np.ndarray) -> str:
    """The fingerprint as text: the whole text's hash and the sketch's."""
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return whole + hashlib.blake2b(sketch.astype("<u8").tobytes(), digest_size=16).hexdigest()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_number(edges: list[int], pieces: list[int], nulls: int) -> F.Column:
    """The number of a row's range: ids descend, rows of an edge's id are cut into its ``pieces`` by text hash, null ids into ``nulls``.

    ``edges`` ascend.  They are looked up in two steps, so a row is compared
    with about twice the root of their number.
    """
    share = lambda n: F.floor((F.xxhash64("text").cast("double") / float(1 << 64) + 0.5) * n).cast("int")
    within = lambda n: F.least(F.greatest(share(n), F.lit(0)), n - 1)
    if not edges:
        return F.when(F.col("doc_id").isNull(), 1 + within(F.lit(nulls))).otherwise(0)
    step = max(1, round(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    tops = F.array(*(F.lit(g[-1]) for g in groups))
    group = F.size(F.filter(tops, lambda e: e < F.col("doc_id")))  # whole groups below the id
    inner = F.try_element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group + 1)
    below = group * step + F.coalesce(F.size(F.filter(inner, lambda e: e < F.col("doc_id"))), F.lit(0))
    # of the edge at or above the id: its place from above, the ranges before its own, and how many rows of its id take
    up = F.lit(len(edges)) - F.least(below, F.lit(len(edges)))
    before, own = [0], [0]
    for n in reversed(pieces):
        before.append(before[-1] + own[-1] + 1)
        own.append(n)
    first, most = (F.element_at(F.array(*map(F.lit, x)), up + 1) for x in (before, own))
    edge = F.try_element_at(F.array(*map(F.lit, edges)), F.least(below, F.lit(len(edges) - 1)) + 1)
    at = first + F.when((up > 0) & (F.col("doc_id") == edge), within(most)).otherwise(most)
    return F.when(F.col("doc_id").isNull(), before[-1] + own[-1] + 1 + within(F.lit(nulls))).otherwise(at).cast("int")


def _ranges(docs: DataFrame, per_range: int) -> DataFrame:
    """``(doc_id, text, heads)``: a partition for each range of descending ids, in order; at its end the successor row with ``heads`` true."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    seen = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if seen["ids"] and n > 1 else []
    pieces = Counter(cuts or [])  # an id that several cuts fall on has that many ranges' rows
    edges = sorted(pieces)
    nulls = max(1, -(-(seen["n"] - seen["ids"]) * n // max(1, seen["n"])))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    placed = docs.select("doc_id", "text", _range_number(edges, [pieces[e] for e in edges], nulls).alias("at"), order.alias("o"))
    tops = placed.groupBy("at").agg(F.min("o").alias("top")).collect()  # a row for each range
    used = sorted(r["at"] for r in tops)
    if not used:
        return docs.withColumn("heads", F.lit(False))
    sends_to = dict(zip(used, [used[-1], *used[:-1]]))
    firsts = spark.createDataFrame([(*r["top"], sends_to[r["at"]]) for r in tops], "ha boolean, hb bigint, hc bigint, goes int")
    heads = placed.join(F.broadcast(firsts), (F.col("o.a") == F.col("ha")) & (F.col("o.b") == F.col("hb")) & (F.col("o.c") == F.col("hc")))  # a row for each range
    heads = heads.groupBy("goes").agg(F.first(F.struct("doc_id", "text", "o")).alias("x")).select(F.col("goes").alias("at"), "x.doc_id", "x.text", "x.o", F.lit(True).alias("heads"))
    both = placed.withColumn("heads", F.lit(False)).unionByName(heads)
    return both.repartitionById(used[-1] + 1, "at").sortWithinPartitions("heads", "o").select("doc_id", "text", "heads")


def compare_with_next(docs: DataFrame, levels: tuple[int, ...] = (2, 3, 4), size: int = 64, per_range: int = 200_000, block_chars: int = 150_000) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of each row."""
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(rows: list, following: tuple) -> pa.RecordBatch:
        """``following`` comes after the last of ``rows``."""
        texts = [t for _, t in rows] + [following[1]]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = sketches(texts, levels, size), sketches(changed, levels, size)
        out = [[] for _ in names]
        for i, (doc_id, text) in enumerate(rows):
            row = (
                doc_id, len(text), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), told(text, own[i]), told(changed[i], other[i]),
                1.0 if text == changed[i] else likeness(own[i], other[i], size), 1.0 if text == texts[i + 1] else likeness(own[i], own[i + 1], size),
            )
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]):
        held, chars = [], 0
        for batch in batches:
            for doc_id, text, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "heads"))):
                text = text or ""
                if held and (head or chars >= block_chars or len(held) >= 4096):
                    yield judged(held, (doc_id, text))
                    held, chars = [], 0
                if not head:
                    held.append((doc_id, text))
                    chars += len(text)
        assert not held, "every range ends with its successor"

    kind = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ranges(docs, per_range).mapInArrow(run, kind)
