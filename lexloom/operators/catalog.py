"""Catalog queries: collection trees, membership, runs, tags and edits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.layout import written


def closure(parents: DataFrame) -> DataFrame:
    """``(ancestor, child)`` of every node and all above it, from ``(child, parent)``; roots have a null parent.

    Each round joins the pairs found with themselves, which doubles their
    reach, and writes them; there are as many rounds as the depth has binary
    digits.  A node above itself is an error.
    """
    links = parents.where("parent IS NOT NULL").select(F.col("parent").alias("ancestor"), "child").distinct()
    found, n = written(links, "tree"), -1
    while (size := found.count()) > n:
        if not found.where("ancestor = child").isEmpty():
            raise ValueError("the tree has a cycle")
        n = size
        further = found.select("ancestor", F.col("child").alias("by")).join(found.select(F.col("ancestor").alias("by"), "child"), "by").select("ancestor", "child")
        found = written(found.unionByName(further).distinct(), "tree")
    return found


def members(items: DataFrame, tree: DataFrame, collection: str) -> DataFrame:
    """Rows of ``items`` in the collection or any below it."""
    inside = tree.where(F.col("ancestor") == collection).select(F.col("child").alias("collection"))
    own = tree.sparkSession.createDataFrame([(collection,)], "collection string")
    return items.join(inside.unionByName(own).distinct(), "collection", "left_semi")


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` whose keys it lacks, one for each key."""
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys]))
    fresh = new.join(table.select(*keys), keys, "left_anti").withColumn("_n", one).where("_n = 1").drop("_n")
    return table.unionByName(fresh)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in place of its own of the same keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def set_field(df: DataFrame, column: str, value: Column, force: bool = False) -> DataFrame:
    """Fill an empty field, or set it anyway if ``force``."""
    empty = F.col(column).isNull() | (F.col(column) == "")
    return df.withColumn(column, F.when(F.lit(force) | empty, value).otherwise(F.col(column)))


def latest(runs: DataFrame, collection: str, tree: DataFrame, processor: str, when: str) -> DataFrame:
    """The newest time of: the processor's runs on the collection, or any run on a collection below it."""
    below = tree.where(F.col("ancestor") == collection).select(F.col("child").alias("collection"))
    own = runs.where((F.col("processor") == processor) & (F.col("collection") == collection))
    return own.unionByName(runs.join(below, "collection", "left_semi").select(*runs.columns)).agg(F.max(when).alias("latest"))


def tag_counts(tagged: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    """``(tag, n)`` of tags on at least so many items."""
    return tagged.join(tags, "tag_id").groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_tag(docs: DataFrame, tagged: DataFrame) -> DataFrame:
    """Documents with their first tag as label; untagged ones go."""
    return docs.join(tagged.groupBy("doc_id").agg(F.min("tag").alias("label")), "doc_id")


def largest_by_name(cities: DataFrame) -> DataFrame:
    """Of cities of one name the most populous, ties to the smallest id."""
    best = F.max(F.struct("population", (-F.col("id")).alias("_least"), *[c for c in cities.columns if c not in ("population", "name")]))
    return cities.groupBy("name").agg(best.alias("x")).select("name", "x.population", "x.id")


def preorder(parents: DataFrame) -> DataFrame:
    """``(child, depth, path)`` of the tree, ``path`` sorting it so that parents come before children.

    Nodes that no root is above are left out.  Each round puts the path of the
    node above before a path, so paths double in length; a cycle, whose paths
    never reach a root, is an error.
    """
    rows = written(parents.select("child", F.col("parent").alias("top"), F.array("child").alias("steps")), "paths")
    done = rows.where("top IS NULL")
    rounds = math.ceil(math.log2(max(2, rows.count()))) + 1
    for k in range(rounds + 1):
        waiting = rows.where("top IS NOT NULL")
        if waiting.isEmpty():
            break
        if k == rounds:
            raise ValueError("the tree has a cycle")
        above = rows.select(F.col("child").alias("top"), F.col("top").alias("higher"), F.col("steps").alias("before"))
        longer = waiting.join(above, "top").select("child", F.col("higher").alias("top"), F.concat("before", "steps").alias("steps"))
        rows = written(rows.where("top IS NULL").unionByName(longer), "paths")
        done = rows.where("top IS NULL")
    return done.select("child", (F.size("steps") - 1).alias("depth"), F.array_join("steps", "/").alias("path"))


def with_outfiles(files: DataFrame, folder: str) -> DataFrame:
    """A manifest ``(filename, itemID, collection)`` with ``outfile``, where a file's text goes: its own path below ``folder`` with the ending txt."""
    stem = F.regexp_replace("filename", r"\.[^./]*$", "")
    return files.withColumn("outfile", F.concat(F.lit(folder.rstrip("/") + "/"), stem, F.lit(".txt")))
