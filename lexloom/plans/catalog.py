"""Catalog queries over the region, nation and customer tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import catalog
from lexloom.plans.registry import query
from lexloom.sources.tables import table

#: SQL: the collection tree, its closure, and customers as items of nations.
TREE = """tree AS (SELECT 'library' AS child, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'library' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
clo AS (SELECT parent AS ancestor, child FROM tree WHERE parent IS NOT NULL UNION SELECT p.parent, c.child FROM clo c JOIN tree p ON p.child = c.ancestor WHERE p.parent IS NOT NULL),
item AS (SELECT c_custkey AS item_id, 'N' || c_nationkey AS collection, c_mktsegment AS kind, c_acctbal FROM customer)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.createDataFrame([("library", None)], "child string, parent string")
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("library").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    return root.unionByName(regions).unionByName(nations)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("collection"), F.col("c_mktsegment").alias("kind"), "c_acctbal")


@query("collection_closure", f"WITH RECURSIVE {TREE} SELECT DISTINCT ancestor, child FROM clo")
def collection_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.closure(_tree(spark, sf_dir))


@query("collection_members", f"WITH RECURSIVE {TREE} SELECT item_id, collection FROM item WHERE collection = 'R1' OR collection IN (SELECT child FROM clo WHERE ancestor = 'R1')")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.members(_items(spark, sf_dir), catalog.closure(_tree(spark, sf_dir)), "R1").select("item_id", "collection")


@query("collection_preorder", """WITH RECURSIVE tree AS (SELECT 'library' AS child, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'library' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
    walk AS (SELECT child, 0 AS depth, child AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.child, depth + 1, path || '/' || t.child FROM walk JOIN tree t ON t.parent = walk.child) SELECT * FROM walk""")  # fmt: skip
def collection_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.preorder(_tree(spark, sf_dir))


@query("distinct_items", f"WITH RECURSIVE {TREE} SELECT collection, count(DISTINCT item_id) AS items FROM item WHERE kind IN ('BUILDING', 'MACHINERY') GROUP BY collection")
def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "kind string")
    return _items(spark, sf_dir).join(kinds, "kind", "left_semi").groupBy("collection").agg(F.countDistinct("item_id").alias("items"))


@query("extraction_ratio", """SELECT (SELECT count(*) FROM documents WHERE length(text) > 500) * 100 / (SELECT count(*) FROM documents) AS ratio""")
def extraction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.length("text") > 500)
    return table(spark, sf_dir, "documents").agg((done * 100 / F.count("*")).alias("ratio"))


_RUNS = """run AS (SELECT o_orderkey AS run_id, 'N' || c_nationkey AS collection, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'wordcloud' ELSE 'classifier' END AS processor, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("collection"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    k = F.col("o_orderkey") % 3
    processor = F.when(k == 0, "extract").when(k == 1, "wordcloud").otherwise("classifier")
    return table(spark, sf_dir, "orders").join(nations, "o_custkey").select(F.col("o_orderkey").alias("run_id"), "collection", status.alias("status"), processor.alias("processor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("run_lookup", f"WITH {_RUNS} SELECT * FROM run WHERE run_id = 42")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("run_id = 42")


@query("finished_classifiers", f"WITH {_RUNS} SELECT run_id, collection FROM run WHERE status = 'done' AND processor = 'classifier'")
def finished_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("status = 'done' AND processor = 'classifier'").select("run_id", "collection")


@query("finished_runs", f"WITH {_RUNS} SELECT run_id, processor, day FROM run WHERE collection = 'N3' AND status = 'done' AND processor <> 'extract'")
def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("collection = 'N3' AND status = 'done' AND processor <> 'extract'").select("run_id", "processor", "day")


@query("run_exists", f"WITH {_RUNS} SELECT count(*) > 0 AS found FROM run WHERE collection = 'N3' AND status = 'running' AND processor = 'wordcloud'")
def run_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("collection") == "N3") & (F.col("status") == "running") & (F.col("processor") == "wordcloud")
    return _runs(spark, sf_dir).where(hit).limit(1).agg((F.count("*") > 0).alias("found"))


@query("latest_run", f"WITH RECURSIVE {TREE}, {_RUNS} SELECT max(day) AS latest FROM run WHERE processor = 'extract' AND collection = 'R1' OR collection IN (SELECT child FROM clo WHERE ancestor = 'R1')")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(_runs(spark, sf_dir), "R1", catalog.closure(_tree(spark, sf_dir)), "extract", "day")


_TAGS = """tag AS (SELECT doc_id, unnest(['quality' || quality, 'toxic' || toxic]) AS tag FROM labels)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(F.concat(F.lit("quality"), F.col("quality").cast("string")), F.concat(F.lit("toxic"), F.col("toxic").cast("string")))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(both).alias("tag"))


@query("tag_counts", f"WITH {_TAGS} SELECT tag, count(*) AS n FROM tag GROUP BY tag HAVING count(*) > 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _tagged(spark, sf_dir)
    names = tagged.select("tag").distinct().withColumn("tag_id", F.md5("tag"))
    return catalog.tag_counts(tagged.select("doc_id", F.md5("tag").alias("tag_id")), names).orderBy(F.desc("n"), "tag")


@query("tag_items", f"WITH {_TAGS} SELECT tag, doc_id FROM tag WHERE tag IN ('quality0', 'toxic1')")
def tag_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).where(F.col("tag").isin("quality0", "toxic1")).select("tag", "doc_id")


@query("tag_filter", f"WITH {_TAGS} SELECT doc_id, source, min(tag) AS label FROM documents JOIN tag USING (doc_id) WHERE tag IN ('quality0', 'toxic1') GROUP BY ALL")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _tagged(spark, sf_dir).where(F.col("tag").isin("quality0", "toxic1"))
    return catalog.first_tag(table(spark, sf_dir, "documents").select("doc_id", "source"), chosen)


@query("bulk_edit", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'moved' ELSE source END AS place FROM documents")
def bulk_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("place"))
    return catalog.set_field(blank, "place", F.lit("moved"))


@query("upsert", """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS kind FROM customer UNION ALL SELECT -1 - n_nationkey, 'new' FROM nation""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    extra = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("id"), F.lit("new").alias("kind"))
    return catalog.upsert(old, old.where("id % 10 = 0").select("id", F.lit("new").alias("kind")).unionByName(extra), ["id"])


@query("insert_or_ignore", "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT conv_id, 'conversation' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    return catalog.insert_or_ignore(old, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversation").alias("kind")), ["id"])


@query("delete_stale", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def delete_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("largest_city_per_name", """SELECT c_mktsegment || c_nationkey AS name, max(c_acctbal) AS population, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS id FROM customer GROUP BY 1""")
def largest_city_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("c_acctbal").alias("population"), F.col("c_custkey").alias("id"))
    return catalog.largest_by_name(cities)


@query("extraction_manifest", """SELECT 'page' AS kind, page_id AS id, url AS name FROM pages WHERE url LIKE 'https%' UNION ALL SELECT 'note', conv_id, role FROM conversations WHERE turn = 0 UNION ALL SELECT 'document', doc_id, source FROM documents""")
def extraction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.col("url").startswith("https")).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    notes = table(spark, sf_dir, "conversations").where("turn = 0").select(F.lit("note").alias("kind"), F.col("conv_id").alias("id"), F.col("role").alias("name"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return pages.unionByName(notes).unionByName(docs)


@query("collection_label", """SELECT c_custkey AS item_id, coalesce('N' || n_nationkey, 'library') AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 4""")
def collection_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("own"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").select(F.col("c_custkey").alias("item_id"), F.coalesce("own", F.lit("library")).alias("label"))
