"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are compared in tiles: numpy exclusive-or and bit
counts of one tile against another, where tile pairs whose bit counts differ
by more than the radius are skipped, since such fingerprints cannot be that
near.  All pairs of a corpus would be quadratic, so tiles hold fingerprints
that agree in enough blocks: of ``m`` blocks at least ``m - radius`` are equal
in any two within the radius, so comparing those that share some such choice
of blocks finds every link exactly.  ``m`` grows with the number of
fingerprints, so groups stay about a tile in size.

Scale.  Copies collapse before comparison.  A group larger than a tile is
split by bit count and salt, and its tile pairs are dealt over tasks.  A tile
pair returns a spanning forest of its links, never all pairs of a group, and
components are joined by star rounds.

Rows.  Texts without words, empty or null, have fingerprint zero and link like
any other.  A component's id is its smallest document id, nulls aside; a row
with a null id gets its group's.  Repeated rows all come back.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import near_copies
from lexloom.llm.common import arrow_map, words, written
from lexloom.llm.components import stars, union_find


#: A text's hash beside the columns of documents.
_ROW = "_text_hash"


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    found = words(text)
    if not found:
        return 0
    grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)))) if len(found) >= shingle else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_ += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's bits as a signed long."""

    def run(ids, texts):
        fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return {"doc_id": ids, "fp": fps.view(np.int64)}

    return arrow_map(docs, "doc_id bigint, fp bigint", run, "doc_id", "text")


def near_links(fp: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (uint64), found tile by tile."""
    bits = np.bitwise_count(fp)
    order = np.argsort(bits, kind="stable")
    fp, bits = fp[order], bits[order].astype(np.int16)
    root = np.arange(len(fp))
    left, right = [], []
    for i in range(0, len(fp), tile):
        a = fp[i : i + tile]
        for j in range(i, len(fp), tile):
            if bits[j] - bits[min(i + tile, len(fp)) - 1] > radius:
                break  # bit counts only grow from here
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fp[None, j : j + tile]) <= radius)
            x, y = x + i, y + j
            new = root[x] != root[y]
            if new.any():
                nodes, least = union_find(root[x[new]], root[y[new]])
                moved = np.arange(len(fp))
                moved[nodes] = least
                gone = nodes != least
                left.append(nodes[gone])
                right.append(least[gone])
                root = moved[root]
    if not left:
        return fp[:0], fp[:0]
    return fp[np.concatenate(left)], fp[np.concatenate(right)]


def _near_in_small_groups(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[list, list]:
    """Links within runs of equal keys: every row against the next at each distance, all runs at once."""
    left, right, i, d = [], [], np.arange(len(key)), 1
    while True:
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            return left, right
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        left.append(fp[near])
        right.append(fp[near + d])
        d += 1


def block_masks(radius: int, m: int, bits: int = 64) -> list[int]:
    """Masks of every choice of ``m - radius`` of ``m`` blocks."""
    edges = [round(k * bits / m) for k in range(m + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, m - radius)]


def links(fps: DataFrame, n: int, radius: int = 3, tile: int = 512) -> DataFrame:
    """``(a, b)``: links among ``n`` distinct fingerprints (column fp) whose components are those of all links within the radius."""
    import pyarrow as pa

    m = radius + 1
    while m < radius + 5 and n / 2 ** (64 * (m - radius) / m) > tile:
        m += 1
    masks = block_masks(radius, m)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    each = F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(x).cast("bigint")).alias("part")) for k, x in enumerate(signed)))
    keyed = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(each).alias("x")).select("fp", "ones", F.xxhash64("x.block", "x.part").alias("key"))
    # equal keys of different blocks by chance cost a comparison, no more
    sizes = keyed.groupBy("key", "ones").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.ceil(F.max("n") / tile).cast("int").alias("salts"))
    large = written(sizes.where(F.col("size") > 2 * tile), "large-groups")
    small = keyed.join(large.select("key"), "key", "left_anti").select("key", "fp")
    # a large group's tiles are (bit count, salt); a row goes to each pair its tile forms with those at most the radius away
    tiles = keyed.join(large, "key").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    others = F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct((F.col("ones") + d).alias("ones"), s.alias("salt")))))
    own = F.struct(F.col("ones"), F.col("salt"))
    pair = tiles.select("key", "fp", own.alias("own"), F.explode(others).alias("other")).where("other.ones between 0 and 64")
    pairs = pair.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")

    def compare(batches):
        held_key, held_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def done(key, fp):
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lengths = np.diff(np.r_[starts, len(key)])
            is_small = np.repeat(lengths <= 48, lengths)
            a, b = _near_in_small_groups(key[is_small], fp[is_small], radius)
            for s, n in zip(starts[lengths > 48].tolist(), lengths[lengths > 48].tolist()):
                x, y = near_links(np.unique(fp[s : s + n]), radius, tile)
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, dtype=np.int64) for x in (a, b))
            apart = a != b
            nodes, root = union_find(a[apart], b[apart])
            gone = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[gone]), pa.array(root[gone])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            if len(key):
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield done(key[:cut], fp[:cut])
                held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield done(held_key, held_fp)

    both = small.unionByName(pairs)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) // 500_000))
    return both.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint")


def components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of each row."""
    found = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    near = stars(links(distinct, distinct.count(), radius))
    rooted = written(distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.join(labels, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component of near copies: that of the smallest id, once.

    Near copies have at least 0.8 of their five-word shingles in common.  An id
    may stand for several texts: rows are told apart by id and text, and of those
    of the smallest id in a component one stays.  Rows with null ids stay.
    """
    found = written(near_copies.components(docs, **options).where("doc_id IS NOT NULL"), "components")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a component may hold many rows: they are dealt over salts
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    told = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(16)).cast("int")).join(salted, ["component", "salt"])
    losers = told.where("doc_id <> first.doc_id OR row <> first.row").select("doc_id", "row").distinct()
    rows = docs.withColumn(_ROW, F.xxhash64("text"))
    same = losers.withColumnRenamed("row", _ROW).hint("merge")  # losers grow with the documents: one plan at every size
    kept = rows.join(same, ["doc_id", _ROW], "left_anti")
    again = found.groupBy("doc_id", "row").count().where("count > 1").select("doc_id", F.col("row").alias(_ROW))
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", _ROW], "left_semi").dropDuplicates(["doc_id", _ROW])
        kept = kept.join(again, ["doc_id", _ROW], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
