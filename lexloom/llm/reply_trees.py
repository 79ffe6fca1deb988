"""Chat formatting of reply trees.

``nodes`` are ``(tree_id, node_id, parent_id, role, text, score)``.  Iterative
self-joins double the reach of each node's ancestor link, so a tree of depth d
takes about log2(d) rounds; every leaf ends up with all nodes of its
root-to-leaf path.  Branches are ranked by mean node score and each chosen one
is formatted as one conversation with a loss mask over the assistant's texts.

Template, per turn: ``### role: text</turn>`` and a line end.  In roles and
texts ``\\``, ``#``, ``<`` and (in roles) ``:`` get a ``\\`` before them, so no
text can pose as a mark and ``parse`` gives every text back.

Rows.  Null roles and texts are empty, null scores 0.  A parent that does not
exist makes its child a root.  Of repeated (tree, node) rows the smallest
(role, text) counts.  Nodes that lead up into a cycle have no root and belong
to no conversation.  Null tree ids are one tree.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_map, written

_MARK = re.compile(r"[\\#<]")
_ROLE_MARK = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans (code points) that bear loss."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head = "### " + _ROLE_MARK.sub(r"\\\g<0>", role) + ": "
        body = _MARK.sub(r"\\\g<0>", text)
        if role == loss_role:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; raises on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _linked(nodes: DataFrame) -> DataFrame:
    """``(tree_id, node_id, above)``: the links to parents that exist."""
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"))
    on = [F.col("tree_id").eqNullSafe(F.col("t")), F.col("parent_id") == F.col("p")]
    return nodes.select("tree_id", "node_id", "parent_id").join(known, on).select("tree_id", "node_id", F.col("parent_id").alias("above"))


def branch_scores(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(tree_id, leaf, branch_score)``: the mean score from each leaf up to its root; branches without a root go.

    Every node keeps the sum and the number of scores up to a node above it, and
    each round joins that node's own, so that there is one row a node and the
    reach doubles.
    """
    above = links.select(F.col("tree_id").alias("t"), F.col("node_id").alias("c"), "above")
    on = [F.col("tree_id").eqNullSafe(F.col("t")), F.col("node_id") == F.col("c")]
    rows = written(nodes.join(above, on, "left").select("tree_id", "node_id", F.col("above").alias("top"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n")), "sums")
    step, most = 1, rows.count()
    while step <= most and not rows.where("top IS NOT NULL").isEmpty():
        higher = rows.select(F.col("tree_id").alias("t"), F.col("node_id").alias("c"), F.col("top").alias("next"), F.col("total").alias("more"), F.col("n").alias("m"))
        met = rows.where("top IS NOT NULL").join(higher, [F.col("tree_id").eqNullSafe(F.col("t")), F.col("top") == F.col("c")])
        grown = met.select("tree_id", "node_id", F.col("next").alias("top"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        rows = written(rows.where("top IS NULL").unionByName(grown), "sums")
        step *= 2
    parents = links.select(F.col("tree_id").alias("t"), F.col("above").alias("c")).distinct()
    leaves = rows.where("top IS NULL").join(parents, on, "left_anti")
    return leaves.select("tree_id", F.col("node_id").alias("leaf"), (F.col("total") / F.col("n")).alias("branch_score"))


def paths(leaves: DataFrame, links: DataFrame) -> DataFrame:
    """``(tree_id, leaf, node_id, up)``: every node of the path from each of ``leaves`` to its root, ``up`` links above the leaf."""
    jump = links
    reach = written(leaves.select("tree_id", "leaf", F.col("leaf").alias("node_id"), F.lit(0).cast("bigint").alias("up")), "reach")
    step = 1
    while not jump.isEmpty():
        j = jump.select(F.col("tree_id").alias("t"), F.col("node_id").alias("c"), "above")
        grown = reach.join(j, [F.col("tree_id").eqNullSafe(F.col("t")), F.col("node_id") == F.col("c")]).select("tree_id", "leaf", F.col("above").alias("node_id"), (F.col("up") + step).alias("up"))
        if grown.isEmpty():
            break  # no path is longer; what is left of the links lies on cycles or other branches
        further = jump.withColumnRenamed("above", "mid").join(j, [F.col("tree_id").eqNullSafe(F.col("t")), F.col("mid") == F.col("c")])
        reach = written(reach.unionByName(grown), "reach")
        jump = written(further.select("tree_id", "node_id", "above"), "jump")
        step *= 2
    return reach


def format_trees(nodes: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """``(tree_id, leaf, rank, score, formatted, loss_mask)`` of each tree's ``best`` branches."""
    one = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent_id"), F.coalesce("score", F.lit(0.0)).alias("score")))
    nodes = written(nodes.groupBy("tree_id", "node_id").agg(one.alias("x")).select("tree_id", "node_id", "x.*"), "nodes")
    links = written(_linked(nodes), "links")
    scores = branch_scores(nodes, links)
    ranks = written(scores.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf"))).where(F.col("rank") <= best), "ranks")
    # only the chosen branches are listed node by node
    members = paths(ranks, links)
    named = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "role", "text")
    chosen = ranks.select(F.col("tree_id").alias("ct"), F.col("leaf").alias("cl"), "rank", "branch_score")
    turns = members.join(chosen, [F.col("tree_id").eqNullSafe(F.col("ct")), F.col("leaf") == F.col("cl")]).join(named, [F.col("tree_id").eqNullSafe(F.col("t")), F.col("node_id") == F.col("n")])
    grouped = turns.groupBy("tree_id", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    kind = f"tree_id {grouped.schema['tree_id'].dataType.simpleString()}, leaf {grouped.schema['leaf'].dataType.simpleString()}, rank int, score double, formatted string, loss_mask array<struct<start:bigint,end:bigint>>"

    def rendered(tree, leaf, rank, score, turns):
        done = [render([(x["role"], x["text"]) for x in t], loss_role) for t in turns]
        return {"tree_id": tree, "leaf": leaf, "rank": rank, "score": score, "formatted": [f for f, _ in done], "loss_mask": [[{"start": a, "end": b} for a, b in m] for _, m in done]}

    return arrow_map(grouped, kind, rendered, "tree_id", "leaf", "rank", "branch_score", "turns")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    kind = f"conv_id {formatted.schema['tree_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(tree, text, mask):
        turns = [parse(t) for t in text]
        loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in m) for t, m in zip(text, mask)]
        return {"conv_id": tree, "n_turns": [len(t) for t in turns], "turns_sha256": [sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns], "loss_chars": [len(x) for x in loss], "loss_sha256": [sha(x) for x in loss], "formatted_chars": [len(t) for t in text]}

    return arrow_map(formatted, kind, read, "tree_id", "formatted", "loss_mask")


def chain_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it in (turn, role, text) order."""
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("node_id", seq).select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
