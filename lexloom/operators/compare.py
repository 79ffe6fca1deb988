"""Comparing labels of a corpus: log-likelihood and rank sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.frequency import most_extreme, relative
from lexloom.operators.layout import written

#: Fixed value: the chi-squared quantile of p < 0.001.
SIGNIFICANT = 15.13


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed G2 of counts a of c against b of d; negative if a's share is smaller, 0 if any count is 0."""
    e1, e2 = c * (a + b) / (c + d), d * (a + b) / (c + d)
    g2 = 2 * (a * F.log(a / e1) + b * F.log(b / e2))
    usual = F.when(a / c < b / d, -g2).otherwise(g2)
    return F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), F.lit(0.0)).otherwise(usual)


def dunning(bags: DataFrame, label: str, held_out: bool = False) -> DataFrame:
    """``(label, term, freq, g2)`` of every term of each label against the whole corpus, or against the rest of it."""
    own = written(bags.groupBy(F.col(label).alias("label"), "term").agg(F.sum("tf").alias("a")), "label-counts")
    corpus = own.groupBy("term").agg(F.sum("a").alias("all"))
    totals = own.groupBy("label").agg(F.sum("a").alias("c"))
    everything = totals.agg(F.sum("c").alias("d_all"))
    rows = own.join(corpus, "term").join(totals, "label").join(F.broadcast(everything))  # one row
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    b, d = F.col("all").cast("double"), F.col("d_all").cast("double")
    if held_out:
        b, d = b - a, d - c
    return rows.select("label", "term", F.col("a").alias("freq"), log_likelihood(a, b, c, d).alias("g2"))


def dunning_clouds(bags: DataFrame, label: str, n: int = 20, held_out: bool = False) -> DataFrame:
    scored = dunning(bags, label, held_out).where(F.abs("g2") > SIGNIFICANT)
    return most_extreme(scored, "g2", n, "label")


def mann_whitney(bags: DataFrame, documents: DataFrame, label: str, min_df: int = 10) -> DataFrame:
    """``(label, term, rho)``: rank sums of relative frequencies, label against the rest.

    Zeros are never made: a term's z absent documents share rank (z + 1) / 2
    and the others rank above them, ties averaged.  Equal values of a term
    and label are counted before they are ranked, so a frequent term's window
    holds its distinct values rather than its documents.  ``rho`` is large
    where the label's values are low.
    """
    sizes = documents.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("na"))
    total = sizes.agg(F.sum("na").alias("n"))
    values = relative(bags).select("term", F.col(label).alias("label"), F.col("rel").alias("v"))
    counted = values.groupBy("term", "label", "v").agg(F.count("*").alias("k"))
    by_value = Window.partitionBy("term", "v")
    up_to = Window.partitionBy("term").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("same", F.sum("k").over(by_value)).withColumn("through", F.sum("k").over(up_to)).withColumn("df", F.sum("k").over(Window.partitionBy("term")))
    kept = ranked.where(F.col("df") >= min_df).join(F.broadcast(total))  # one row
    z = F.col("n") - F.col("df")
    mean_rank = z + F.col("through") - F.col("same") + (F.col("same") + 1) / 2
    sums = kept.withColumn("z", z).withColumn("rank", mean_rank * F.col("k")).groupBy("term", "label", "z", "n").agg(F.sum("rank").alias("t"), F.sum("k").alias("own"))
    rows = sums.join(sizes, "label")
    na, nb = F.col("na"), F.col("n") - F.col("na")
    t = F.col("t") + (na - F.col("own")) * (F.col("z") + 1) / 2
    u = na * nb + na * (na + 1) / 2 - t
    return rows.select("label", "term", F.when(nb > 0, u / (na * nb)).otherwise(0.0).alias("rho"))
