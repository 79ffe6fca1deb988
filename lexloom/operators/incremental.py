"""Word counts that follow a corpus: only new and changed documents are counted again.

Kept bags are ``(doc_id, version, term, tf)``; a document without words has one
row with a null term.  ``version`` says when, or from what, a document's text was
last extracted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import frequency
from lexloom.operators.layout import written


def versioned_bags(docs: DataFrame, **how) -> DataFrame:
    """The kept form of ``docs``, ``(doc_id, version, text)``."""
    bags = frequency.term_frequencies(docs, "version", **how)
    return docs.select("doc_id", "version").join(bags, ["doc_id", "version"], "left").select("doc_id", "version", "term", "tf")


def changes(kept: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, version)`` of documents to be counted and of those that stay as they are, from what is kept and ``(doc_id, version)`` of the corpus."""
    known = kept.select("doc_id", "version").distinct()
    return manifest.join(known, ["doc_id", "version"], "left_anti"), manifest.join(known, ["doc_id", "version"], "left_semi")


def updated(kept: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """``kept`` made to follow ``docs``: documents that went are dropped, new and changed ones counted.

    Only the texts of those are read: the corpus is first narrowed to the range
    of their versions, which reaches the scan, then to their ids.
    """
    fresh, same = changes(kept, docs.select("doc_id", "version"))
    fresh = written(fresh, "changed")
    ends = fresh.agg(F.min("version").alias("a"), F.max("version").alias("b")).first()
    stay = kept.join(same, ["doc_id", "version"], "left_semi")
    if ends["a"] is None:
        return stay
    texts = docs.where(F.col("version").between(ends["a"], ends["b"])).join(fresh, ["doc_id", "version"], "left_semi")
    return stay.unionByName(versioned_bags(texts.select("doc_id", "version", "text"), **how))


def totals(kept: DataFrame) -> DataFrame:
    """``(term, df, cf)`` of kept bags."""
    return kept.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def merged(kept: DataFrame, batch: DataFrame, **how) -> DataFrame:
    """``kept`` after a batch ``(doc_id, version, text, deleted)`` of changes alone: of several for a document the newest counts."""
    newest = batch.groupBy("doc_id").agg(F.max_by(F.struct("version", "text", "deleted"), "version").alias("x")).select("doc_id", "x.*")
    stay = kept.join(newest.select("doc_id"), "doc_id", "left_anti")
    return stay.unionByName(versioned_bags(newest.where("NOT coalesce(deleted, false)").select("doc_id", "version", "text"), **how))


def follow(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], **how) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of changes is merged into what ``read`` gives and handed to ``write``.

    A batch that comes again gives the same result, so a restarted stream doesn't count twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        write(written(merged(read(), batch, **how), "followed"))

    return step
