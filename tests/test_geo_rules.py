"""The place parser as a table function of SQL, and a large gazetteer."""

from collections import Counter

import pytest

from lexloom.operators import geo

KIND = "kind string, name string, country string, region string, population bigint, lat double, lon double, geonameid bigint"
ROWS = [("country", "France", "France", None, 0, 0.0, 0.0, 1), ("region", "Texas", "US", "Texas", 0, 0.0, 0.0, 2), ("city", "Paris", "US", "Texas", 5, 0.0, 0.0, 3), ("city", "Paris", "France", "x", 9, 0.0, 0.0, 4)]
DOCS = [(1, "France", "In Paris, France and Paris, Texas"), (2, None, None), (3, "", "in Texas. near Texas"), (4, "Paris, France", ""), (4, None, "nothing"), (None, None, "France")]


def test_table_function_gives_the_same_rows(spark):
    docs, gazetteer = spark.createDataFrame(DOCS, "doc_id bigint, place string, text string"), spark.createDataFrame(ROWS, KIND)
    geo.register_parser(spark, gazetteer, "places_here")
    found = spark.sql("SELECT d.doc_id, p.* FROM {docs} d, LATERAL places_here(d.place, d.text) p", docs=docs)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, geo.geoparse(docs, gazetteer).collect()))
    assert found.count() == 6
    with pytest.raises(ValueError, match="more than 3 rows"):
        geo.register_parser(spark, gazetteer, most_rows=3)


def test_a_million_names_are_joined(spark):
    """A gazetteer that isn't sent to the tasks: names of one to three words, of which texts hold a few."""
    from pyspark.sql import functions as F

    i = F.col("id")
    name = F.concat_ws(" ", F.concat(F.lit("Name"), i.cast("string")), F.when(i % 3 > 0, F.lit("Upon")), F.when(i % 3 > 1, F.lit("Sea")))
    names = spark.range(1_000_000).select(F.lit("country").alias("kind"), name.alias("name"), name.alias("country"), F.lit(None).cast("string").alias("region"), F.lit(0).cast("bigint").alias("population"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), i.alias("geonameid"))
    docs = spark.range(200).select(i.alias("doc_id"), F.lit(None).cast("string").alias("place"), F.concat(F.lit("from Name"), (i * 4999).cast("string"), F.lit(" Upon Sea to the name5")).alias("text"))
    found = geo.geoparse(docs, names)
    assert Counter((r["doc_id"], r["geonameid"], r["start"]) for r in found.collect()) == Counter((d, d * 4999, 5) for d in range(200))
