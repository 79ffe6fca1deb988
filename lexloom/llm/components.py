"""Connected components of an edge table, without collecting any group.

Alternating large-star and small-star rounds (each node hooks its neighbours
to the smallest node it knows) make every component a star around its
smallest node.  Mins are partial aggregates and the joins are sort-merge joins
that adaptive execution may split, so a hub is never one task's work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import forget, written


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and each one's smallest reachable node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _fold(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: no more rows than its nodes, same components."""
    import pyarrow as pa

    def run(batches):
        found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            nodes, root = union_find(a, b)
            keep = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def stars(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b: bigint) that is not its component's smallest."""
    now = written(_fold(edges).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = written(small.where("a > b").distinct(), "edges")
        state = [F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))]
        if new.agg(*state).first() == now.agg(*state).first():
            forget(new)
            break
        forget(now)
        now = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
