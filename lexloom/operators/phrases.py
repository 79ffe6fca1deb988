"""Phrase nets and multi-word units."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.gibbs import packed, unpacked
from lexloom.operators.layout import spread, written

#: A word, by the same class in every engine.
WORD = r"([\p{L}\p{N}_]+)"
#: The patterns offered by name.
PRESETS = ("x and y", "x or y", "x of the y", "x of y", "x the y", "x a y", "x at y", "x is y")


def compile_pattern(pattern: str) -> str:
    """``x`` and ``y``, once each as words of their own, stand for words; anything else is a regular expression."""
    if len(re.findall(r"x", pattern)) == 1 and len(re.findall(r"y", pattern)) == 1:
        return "".join(WORD if c in "xy" else re.escape(c) if not c.isspace() else c for c in pattern)
    return pattern


def matches(docs: DataFrame, pattern: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b)`` of every match in the raw text, lower-cased after matching; matches with a stop word go."""
    regex = compile_pattern(pattern)
    found = spread(docs).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(regex), F.lit(0))).alias("m"))
    pairs = found.select(F.lower(F.regexp_extract("m", regex, 1)).alias("a"), F.lower(F.regexp_extract("m", regex, 2)).alias("b"))
    return pairs.where(~F.col("a").isin(*stop_words) & ~F.col("b").isin(*stop_words)) if stop_words else pairs


def edges(found: DataFrame, top: int = 50) -> DataFrame:
    """The heaviest ``top`` edges, ties in word order: ``(source, target, weight)``."""
    counts = found.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count("*").alias("weight"))
    return counts.orderBy(F.desc("weight"), "source", "target").limit(top)


def nodes(found: DataFrame, top_edges: DataFrame) -> DataFrame:
    """``(term, freq)`` of the words on the chosen edges, counted over all matches."""
    used = top_edges.select(F.col("source").alias("term")).union(top_edges.select("target")).distinct()
    counts = found.select(F.explode(F.array("a", "b")).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return counts.join(used, "term", "left_semi")


def indexed(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """``(source, target, weight)`` with 0-based places of the words among the nodes in word order."""
    from pyspark.sql import Window

    place = nodes_.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))  # 100 nodes at most
    a, b = place.withColumnsRenamed({"term": "source", "i": "source_index"}), place.withColumnsRenamed({"term": "target", "i": "target_index"})
    return edges_.join(a, "source").join(b, "target").select("source_index", "target_index", "weight")


def glue(freq, before: list, after: list, kind: str):
    """Of the counts of a gram, its beginnings and its ends, shortest first.  SCP: f^2 over the mean product of both parts; Dice: 2f over the sum of their means."""
    mean = lambda x: sum(x[1:], x[0]) / len(x)
    return freq * freq / mean([p * s for p, s in zip(before, reversed(after))]) if kind == "scp" else 2 * freq / (mean(before) + mean(after))


#: Kinds of rows: a block's lines, and the counts of its grams of one size by chunk.
LINES, FOUND = range(2)
_BLANKS = str.maketrans("\t\r\f\x0b", "    ")


def _packed_lines(rows):
    """The words of a block's lines, one packed row."""
    numbers, ids, sizes = {}, [], []
    for text in rows.column("text").to_pylist():
        for line in (text or "").translate(_BLANKS).split("\n"):
            found = [numbers.setdefault(w, len(numbers)) for w in line.split(" ") if w]
            if found:
                ids += found
                sizes.append(len(found))
    data = packed(np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64))
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "kind": pa.array([LINES], pa.int32()), "n": pa.array([0], pa.int32()), "chunk": pa.array([0], pa.int32()),
                     "data": pa.array([data], pa.binary()), "words": pa.array([zlib.compress("\n".join(numbers).encode())], pa.binary())})


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key (a, b), and each key's number among them."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])] if len(a) else np.empty(0, dtype=bool)
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class _Block:
    """A block's lines with the corpus's counts of the grams that start at each word, as far as they are known."""

    def __init__(self, rows, chunks: int, known: int):
        found = [dict(zip(rows.column_names, r)) for r in zip(*(c.to_pylist() for c in rows.columns))]
        lines = next(r for r in found if r["kind"] == LINES)
        self.ids, sizes = unpacked(lines["data"])
        self.words = zlib.decompress(lines["words"]).decode().split("\n")
        self.block, self.chunks = lines["block"], chunks
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.ids))  # words to the line's end
        hashes = [np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)[self.ids] if len(self.ids) else np.empty(0, dtype=np.uint64) for seed in (3, 5)]
        self.hashes, self.keys, self.counts = hashes, [], []
        for n in range(1, known + 1):
            at, _, number, order, _ = self.asked(n)
            told = np.concatenate([unpacked(r["data"])[0] for r in sorted((r for r in found if r["n"] == n), key=lambda r: r["chunk"])] or [np.empty(0, dtype=np.int64)])
            own = np.empty(len(order), dtype=np.int64)
            own[order] = told
            counts = (self.left >= n).astype(np.int64)  # what isn't asked for comes once
            counts[at] = own[number]
            self.counts.append(counts)

    def asked(self, n: int):
        """Where grams of ``n`` words start that may come more than once, whose parts all do; a place of each, their numbers, and these by chunk."""
        lanes = []
        for h, times in zip(self.hashes, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            before = self.keys[n - 2][len(lanes)] if n > 1 else np.zeros(len(h), dtype=np.uint64)
            key = (before ^ (before >> np.uint64(29))) * np.uint64(times) + np.r_[h[n - 1 :], np.zeros(min(n - 1, len(h)), dtype=np.uint64)]
            lanes.append(key ^ (key >> np.uint64(32)))
        self.keys.append(lanes)
        may = self.left >= n
        if n > 1:
            often = self.counts[n - 2] > 1
            may &= often & np.r_[often[1:], np.zeros(min(1, len(often)), dtype=bool)]
        at = np.flatnonzero(may)
        a, b = lanes[0][at], lanes[1][at] & np.uint64(0xFFFFFF)
        first, number = _distinct(a, b)
        chunk = (a[first] % np.uint64(self.chunks)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        return at, (a[first], b[first]), number, order, chunk[order]


def _asks(n: int, chunks: int) -> Callable:
    """A block's different grams of ``n`` words with its own counts, a row a chunk."""

    def ask(rows):
        block = _Block(rows, chunks, n - 1)
        _, (a, b), number, order, chunk = block.asked(n)
        counts = np.bincount(number, minlength=len(order))
        names, starts = np.unique(chunk, return_index=True)
        data = [packed(np.diff(a[x], prepend=np.uint64(0)), b[x], counts[x]) for x in np.split(order, starts[1:])] if len(names) else []  # keys ascend
        return pa.table({"chunk": pa.array(names, pa.int32()), "block": pa.array([block.block] * len(names), pa.int32()), "data": pa.array(data, pa.binary())})

    return ask


def _sums(n: int) -> Callable:
    """The counts of a chunk's grams over all blocks, back to each block."""

    def total(rows):
        found = [unpacked(d) for d in rows.column("data").to_pylist()]
        a, b, own = (np.concatenate(x) for x in zip(*((np.cumsum(a.view(np.uint64)), b, own) for a, b, own in found)))
        _, number = _distinct(a, b)
        sums = np.bincount(number, weights=own)[number].astype(np.int64)
        ends = np.cumsum([len(x[0]) for x in found])
        many = len(found)
        return pa.table({"block": rows.column("block"), "kind": pa.array([FOUND] * many, pa.int32()), "n": pa.array([n] * many, pa.int32()), "chunk": rows.column("chunk"),
                         "data": pa.array([packed(x) for x in np.split(sums, ends[:-1])], pa.binary()), "words": pa.nulls(many, pa.binary())})

    return total


def _candidates(max_n: int, kind: str, min_freq: int, chunks: int) -> Callable:
    """Of a block's grams those that stick together better wherever the block has them, and how often it does."""

    def tell(rows):
        block = _Block(rows, chunks, max_n + 1)
        many = len(block.ids)
        later = lambda x, by: np.r_[x[by:], np.zeros(min(by, many), dtype=x.dtype)]
        counts, values = [c.astype(float) for c in block.counts], {1: np.zeros(many)}
        for n in range(2, max_n + 2):
            with np.errstate(divide="ignore", invalid="ignore"):
                value = glue(counts[n - 1], [counts[k - 1] for k in range(1, n)], [later(counts[k - 1], n - k) for k in range(1, n)], kind)
            values[n] = np.where(block.left >= n, value, 0.0)
        inner = np.r_[np.zeros(min(1, many), dtype=bool), block.left[1:] == block.left[:-1] - 1]  # not a line's first word
        out = []
        for n in range(2, max_n + 1):
            below = np.maximum(values[n - 1], later(values[n - 1], 1)) if n > 2 else 0.0
            above = np.maximum(values[n + 1], np.where(inner, np.r_[np.zeros(min(1, many)), values[n + 1][:-1]], 0.0))
            at = np.flatnonzero(block.counts[n - 1] >= max(1, min_freq))
            ok = (values[n] > (below + above) / 2)[at]
            first, number = _distinct(block.keys[n - 1][0][at], block.keys[n - 1][1][at])
            own = np.bincount(number, minlength=len(first))
            first, own = (x[np.bincount(number, weights=ok, minlength=len(first)) == own] for x in (first, own))
            at = at[first]
            units = [" ".join([block.words[w] for w in g]) for g in np.stack([block.ids[at + k] for k in range(n)], axis=1).tolist()]
            out.append(pa.table({"n": pa.array([n] * len(at), pa.int32()), "unit": pa.array(units, pa.string()), "freq": pa.array(block.counts[n - 1][at], pa.int64()), "glue": pa.array(values[n][at], pa.float64()), "own": pa.array(own, pa.int64())}))
        return pa.concat_tables(out)

    return tell


def multi_word_units(docs: DataFrame, max_n: int = 3, kind: str = "scp", min_freq: int = 2, block_bytes: int = 1 << 24, chunk_bytes: int = 1 << 24) -> DataFrame:
    """``(n, unit, freq, glue)`` of the n-grams that stick together better than what they hold and what holds them.

    A gram is kept if its glue exceeds the mean of the largest glue of its
    (n-1)-grams and of the (n+1)-grams around it.  Bigrams hold none, and the
    largest glue of none is 0.  ``min_freq`` applies to the units shown.

    Lines lie in blocks.  Size by size each block asks for the counts of its
    grams over the corpus: by 88-bit keys, packed in a row for each chunk of
    keys, and only of grams all of whose parts come more than once, since any
    other comes once.  With them a block knows the glue of all its grams and of
    what is around them.  A unit has to stand the comparison at each of its
    occurrences, so blocks tell where it does, and these have to be ``freq`` in all.
    A block asks once for a gram that it has often, so large blocks send less; a
    corpus of few blocks is cut into one a core.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks, chunks = max(1, -(-size // block_bytes)), max(1, -(-size // chunk_bytes))
    blocks = max(blocks, min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (1 << 22))))
    schema = "block int, kind int, n int, chunk int, data binary, words binary"
    tasks = min(blocks, max(docs.sparkSession.sparkContext.defaultParallelism, blocks // 4))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "text").where("text IS NOT NULL").repartition(tasks, "block")
    known = written(dealt.groupBy("block").applyInArrow(_packed_lines, schema), "lines")
    by_block = lambda: known.repartition(tasks, "block").groupBy("block")
    for n in range(1, max_n + 2):
        asks = by_block().applyInArrow(_asks(n, chunks), "chunk int, block int, data binary")
        known = known.unionByName(written(asks.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(_sums(n), schema), "gram-counts"))
    found = by_block().applyInArrow(_candidates(max_n, kind, min_freq, chunks), "n int, unit string, freq bigint, glue double, own bigint")
    return found.groupBy("n", "unit").agg(F.max("freq").alias("freq"), F.max("glue").alias("glue"), F.sum("own").alias("own")).where("own = freq").drop("own")
