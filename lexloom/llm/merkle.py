"""Merkle manifest of a data set: a hash tree for each part, a tree over their roots, and a proof for each row.

A row's leaf is the digest of its columns.  A part's leaves ascend by id; every
``fanout`` consecutive nodes become their digest until one is left, the part's
root, and the parts' roots, in the parts' order, make the root likewise.

Superblocks.  Nodes are grouped by index divided by ``fanout ** k``.  One pandas
call collapses up to ``k`` levels of such a bucket; the buckets' roots are nodes
again and are collapsed in turn, so ``n`` leaves take about
``log(n) / log(fanout ** k)`` rounds.  Then proofs go down: a bucket meets the
proof of its own root and gives each of its nodes the siblings within the
bucket, then those above it.

Scale.  A bucket has at most ``fanout ** k`` rows, whatever a part's size, so a
part of a third of all rows is many tasks.  Indices come from a range partition
by part, id and leaf and a running sum of the ranges' row counts: no task
holds a part.  Texts are read once for their digests and never shuffled.  Every
round's nodes are written, so a lost executor costs a re-read.  The driver sees
the size of the largest part and the number of parts.

Rows.  Ids ascend with nulls first; equal ids go by leaf.  Repeated rows are
leaves of their own.  A null part is a part, the first one.  Null columns have a
mark of their own, other columns are ignored, no rows give no proofs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written


def field(column: F.Column) -> F.Column:
    """A value as ``bytes:value``, null as ``-``: no two rows of values read alike."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: F.Column) -> F.Column:
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def leaf(*columns: F.Column) -> F.Column:
    return digest(*map(field, columns))


def ranked(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place within equal ``by`` from 0, nulls first, and ``n``, how many there are.

    Rows lie in ranges of ``by`` and ``order``; equal rows are spread by their
    place in the table.  A range's counts tell where its rows begin.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in (by, *order, "_tie")]
    placed = written(tie.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy(by)  # a row for each range
    before = F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.col(by).alias("_by"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("n"))
    met = placed.join(starts.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_r", "_by", "_first", "_before")


def levels(n: int, fanout: int) -> int:
    """How often ``n`` nodes become fewer until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // fanout), found + 1
    return found


def collapse(digests: list[str], n: int, fanout: int, k: int) -> list[list[str]]:
    """A bucket's nodes, level by level, of a part that has ``n`` nodes where these are: ``k`` levels, fewer if one node is left sooner."""
    found = [digests]
    for _ in range(min(k, levels(n, fanout))):
        below = found[-1]
        found.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return found


def siblings(found: list[list[str]], i: int, fanout: int) -> tuple[str, list[int], list[int]]:
    """The proof of node ``i`` within its bucket: the other digests of its runs, lowest first, its place in each run, and the runs' sizes."""
    proof, places, sizes = [], [], []
    for level in found[:-1]:
        start = i - i % fanout
        run = level[start : start + fanout]
        places.append(i - start)
        sizes.append(len(run))
        proof += run[: i - start] + run[i - start + 1 :]
        i //= fanout
    return "".join(proof), places, sizes


_NODE = "grp bigint, idx bigint, n bigint, digest string"


def superblock_roots(nodes: DataFrame, fanout: int, k: int) -> DataFrame:
    """``(grp, idx, n, digest)`` of the buckets' roots, from nodes of the same columns."""
    import pandas as pd

    block = fanout**k

    def roots(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("idx"), int(rows["n"].iloc[0])
        top = collapse(rows["digest"].tolist(), n, fanout, k)[-1][0]
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "idx": [rows["idx"].iloc[0] // block], "n": [-(-n // block)], "digest": [top]})

    return nodes.select("grp", "idx", "n", "digest").groupBy("grp", F.floor(F.col("idx") / block).alias("bucket")).applyInPandas(roots, _NODE)


def superblock_proofs(nodes: DataFrame, above: DataFrame, fanout: int, k: int) -> DataFrame:
    """``nodes`` with ``proof``, ``places``, ``sizes``, ``subroot`` and ``root``: siblings within the bucket, then those of ``above``, the proofs of the buckets' roots."""
    import pandas as pd

    block = fanout**k
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    names = nodes.columns

    def proofs(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("idx"), upper.iloc[0]
        found = collapse(rows["digest"].tolist(), int(rows["n"].iloc[0]), fanout, k)
        own = [siblings(found, i, fanout) for i in range(len(rows))]
        rows = rows[names].reset_index(drop=True)
        rows["proof"] = [p + top["proof"] for p, _, _ in own]
        rows["places"] = [[*p, *top["places"]] for _, p, _ in own]
        rows["sizes"] = [[*s, *top["sizes"]] for _, _, s in own]
        rows["subroot"], rows["root"] = top["subroot"], top["root"]
        return rows

    bucket = F.floor(F.col("idx") / block)
    left = nodes.groupBy("grp", bucket.alias("bucket"))
    right = above.select("grp", "idx", "proof", "places", "sizes", "subroot", "root").groupBy("grp", F.col("idx").alias("bucket"))
    return left.cogroup(right).applyInPandas(proofs, kind + ", proof string, places array<int>, sizes array<int>, subroot string, root string")


def _rounds(nodes: DataFrame, fanout: int, k: int) -> list[DataFrame]:
    """The written nodes of every round, the last one a node for each group."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    found = [nodes]
    for _ in range(-(-levels(largest, fanout) // k)):
        found.append(written(superblock_roots(found[-1], fanout, k), "merkle-nodes"))
    return found


def prove(leaves: DataFrame, part: str = "source", key: str = "doc_id", fanout: int = 3, k: int = 6) -> DataFrame:
    """``leaves``, rows of ``part``, ``key``, ``leaf`` and others, with what proves each of them.

    ``proof`` holds the digests of the siblings one after another, from the leaf
    to the root, left to right; ``places`` and ``sizes`` the own place in each
    run and the run's size; ``subroot`` and ``root`` the part's root and the
    root over all parts.
    """
    leaves = written(leaves, "merkle-hashes")
    kinds = {f.name: f.dataType for f in leaves.schema}
    rows = ranked(leaves, part, key, "leaf")
    parts = ranked(leaves.select(part).distinct().withColumn("_one", F.lit(0)), "_one", part)
    parts = parts.select(F.col(part).alias("_part"), F.col("idx").alias("grp"), F.col("n").alias("_parts"))
    parts = written(parts, "merkle-parts")
    numbered = rows.join(parts.select("_part", "grp"), F.col(part).eqNullSafe(F.col("_part"))).drop("_part").withColumnRenamed("leaf", "digest")
    # as text, since pandas has no integers beside nulls
    carried = numbered.select(*(F.col(c).cast("string").alias(c) if c in kinds else c for c in numbered.columns))
    below = _rounds(written(carried, "merkle-leaves"), fanout, k)
    tops = below[-1].join(parts, "grp").select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("idx"), F.col("_parts").alias("n"), "digest")
    over = _rounds(written(tops, "merkle-parts-roots"), fanout, k)
    none = F.array().cast("array<int>")
    above = over[-1].select("grp", "idx", F.lit("").alias("proof"), none.alias("places"), none.alias("sizes"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        above = written(superblock_proofs(nodes, above, fanout, k), "merkle-proofs")
    if len(over) == 1:  # a single part: its root is the root
        above = above.withColumn("digest", F.col("root"))
    # a part's root is the top of its own tree
    above = above.select(F.col("idx").alias("grp"), F.lit(0).cast("bigint").alias("idx"), "proof", "places", "sizes", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(below[1:-1]):
        above = written(superblock_proofs(nodes, above, fanout, k), "merkle-proofs")
    if len(below) == 1:  # no part has two rows: leaves are their parts' roots
        proved = below[0].join(above.drop("idx"), "grp")
    else:
        proved = superblock_proofs(below[0], above, fanout, k)
    proved = proved.withColumnRenamed("digest", "leaf")
    return proved.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), "proof", "places", "sizes", "subroot", "root")


def fold(start: F.Column, proof: F.Column, places: F.Column, sizes: F.Column) -> F.Column:
    """The root that a leaf and its proof lead to."""
    width = 64  # of a digest's hexadecimal text

    def up(state: F.Column, run: F.Column) -> F.Column:
        at, mine = state["at"], state["digest"]
        left = F.substring(proof, at, run["place"] * width)
        right = F.substring(proof, at + run["place"] * width, (run["size"] - 1 - run["place"]) * width)
        return F.struct((at + (run["size"] - 1) * width).cast("int").alias("at"), digest(left, mine, right).alias("digest"))

    runs = F.zip_with(places, sizes, lambda p, s: F.struct(p.alias("place"), s.alias("size")))
    return F.aggregate(runs, F.struct(F.lit(1).alias("at"), start.alias("digest")), up, lambda s: s["digest"])


#: The columns of a document that its leaf covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, leaf, changed)``: a document's leaf, and that of its tampered copy where there is one and it differs.

    Copies are tampered with where the id's crc32 is even, by deleting the line ends of the text; null ids have none.
    """
    own = leaf(*map(F.col, COLUMNS))
    changed = leaf(*(F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return docs.select("source", "doc_id", own.alias("leaf"), F.when(hit, changed).alias("changed"))


def manifest(docs: DataFrame, fanout: int = 3, k: int = 6) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of each row."""
    proved = prove(document_leaves(docs), fanout=fanout, k=k)
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"), F.col("places"), F.col("sizes"))
    rows = proved.select("doc_id", "leaf", "subroot", "root", digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
