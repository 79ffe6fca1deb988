"""What views ask of topics, labels, items and nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def import_tokens(text: Column, plain: bool = False) -> Column:
    """The words a topic model imports: runs of letters and marks, or after a prefilter (``plain``) of non-blanks."""
    return F.regexp_extract_all(text, F.lit(r"\S+" if plain else r"[\p{L}\p{M}]+"), F.lit(0))


def relabelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, label, ...) with the label of ``classes`` (doc_id, label) where a document has one."""
    own = classes.groupBy("doc_id").agg(F.min("label").alias("_class"))
    return rows.join(own, "doc_id", "left").withColumn("label", F.coalesce("_class", "label")).drop("_class")


def graph(information: DataFrame, least: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label)`` and edges ``(source, target, mi)`` of the pairs of labels with more than ``least``; ids are places in label order."""
    names = information.select(F.col("label_x").alias("label")).union(information.select("label_y")).distinct()
    nodes = names.select((F.row_number().over(Window.orderBy("label")) - 1).alias("id"), "label")  # labels only
    x, y = nodes.toDF("source", "label_x"), nodes.toDF("target", "label_y")
    return nodes, information.where(F.col("mi") > least).join(x, "label_x").join(y, "label_y").select("source", "target", "mi")


def by_coherence(coherence: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` topics of the highest coherence, those of exactly zero last, ties to the smallest topic."""
    return coherence.orderBy((F.col("coherence") == 0).cast("int"), F.desc("coherence"), "topic").limit(k)


def silhouette(stacked: DataFrame) -> DataFrame:
    """``(bin, topic, low, high)`` of a pile (topics.stacked) moved so that each bin lies around the middle of the highest."""
    heights = stacked.groupBy("bin").agg(F.max("high").alias("top"))
    most = heights.agg(F.max("top").alias("most"))
    rows = stacked.join(heights, "bin").join(F.broadcast(most))  # one row
    shift = (F.col("most") - F.col("top")) / 2
    return rows.select("bin", "topic", (F.col("low") + shift).alias("low"), (F.col("high") + shift).alias("high"))


def root_stream(stream: DataFrame) -> DataFrame:
    """The stream's summed shares over the root of the bin's documents instead of their number."""
    return stream.select("bin", "topic", F.when(F.col("docs") > 0, F.col("value") * F.sqrt("docs")).otherwise(0.0).alias("value"))


def paired(items: Column) -> Column:
    """A flat list as pairs of neighbours; an odd last one is left out."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(items))), lambda i: F.struct(F.get(items, i).alias("a"), F.get(items, i + 1).alias("b")))


def entries(series: Column) -> Column:
    """A map as ``[{x, y}]`` in the order of x."""
    return F.array_sort(F.transform(F.map_entries(series), lambda e: F.struct(e["key"].alias("x"), e["value"].alias("y"))))


def item_metadata(items: DataFrame, owners: DataFrame, default: str = "library") -> DataFrame:
    """Items with ``year``, the first four characters of ``date``, and ``label``, the name of the first collection that has them.

    ``owners``: (item_id, collection); of several the first in name order.
    """
    first = owners.groupBy("item_id").agg(F.min("collection").alias("_own"))
    return items.join(first, "item_id", "left").select(*items.columns, F.substring("date", 1, 4).alias("year"), F.coalesce("_own", F.lit(default)).alias("label"))


def manifest(parts: list[DataFrame], kinds: DataFrame) -> DataFrame:
    """``(item_id, name, mime)`` of all ``parts`` whose type is among ``kinds`` (mime), the first part's row for each (item_id, name)."""
    every = None
    for i, part in enumerate(parts):
        rows = part.select("item_id", "name", "mime").withColumn("_part", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    kept = every.join(kinds.distinct(), "mime", "left_semi")
    return kept.groupBy("item_id", "name").agg(F.min(F.struct("_part", "mime")).alias("_first")).select("item_id", "name", "_first.mime")
