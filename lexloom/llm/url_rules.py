"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule covers a host, its subdomains and a path prefix.  A host's key is its
labels from the right, so that a rule host's subdomains are an interval of
keys, and a path prefix is an interval of paths.  Two sorted sweeps follow each
other.  The first, over rule hosts and the distinct hosts of the URLs, keeps
the stack of rule hosts that enclose the last one begun; those of them that
still hold a host are the rule hosts it lies in, however they nest.  The
second, over a rule host's paths and its URLs' paths, does the same with
paths; the innermost rule that still holds the path is that host's longest
match, and the longest of a URL's matches wins.

Scale.  The first sweep sees each host once, in ranges of about
``hosts_per_range`` neighbouring hosts; a range is handed the stack that is
open where it begins, that of the last rule host before it.  In the second a
rule host with many URLs has salted sweeps of about ``rows_per_sweep`` URLs (or
four a rule), each with that host's rules, so no task holds more.  Counts are
pre-aggregated, nothing is broadcast by force but one row a range.

Rows.  Null urls and urls without ``://`` have host and path ''.  Such hosts
match no rule, unless a rule's host is ''.  Repeated rows stay repeated; rows
with null ids keep them.  Equal rules with different actions: ``block`` wins.
Other columns of ``pages`` are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

#: What a URL gets that no rule covers.
DEFAULT = "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (host, path prefix, action)."""
    return spark.createDataFrame(rules, "host string, path string, action string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the module's text says; '' for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the right: ``www.example.com`` -> ``[com, example, www]``.  Arrays sort label by label, so subdomains follow their host."""
    return F.reverse(F.split(host, r"\."))


def _enclosing_hosts(hosts: DataFrame, rule_hosts: DataFrame, hosts_per_range: int) -> DataFrame:
    """``(hk, enclosing)``: the rule hosts (column hk) that each of ``hosts`` (hk, distinct) is or lies below, if any."""
    spark = hosts.sparkSession
    # a rule host's stack: those of the rule hosts among its key's beginnings, outermost first
    begins = rule_hosts.select(F.col("hk").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size("hk")), lambda i: F.slice("hk", 1, i))).alias("hk"))
    stacks = begins.join(rule_hosts, "hk").groupBy("of").agg(F.array_sort(F.collect_list("hk")).alias("stack")).withColumnRenamed("of", "hk")
    # ranges of hosts: bounds are keys at even places of a sample chosen by hash
    n = hosts.count()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // hosts_per_range))
    bounds: list[list[str]] = []
    if parts > 1:
        some = sorted(r["hk"] for r in hosts.where(F.pmod(F.xxhash64("hk"), F.lit(max(1, n // (parts * 32)))) == 0).select("hk").collect())  # about 32 a range
        bounds = some[:: max(1, len(some) // parts)][1:]
    edges = F.array(*(F.array(*map(F.lit, b)) for b in bounds)) if bounds else F.array().cast("array<array<string>>")
    at = F.size(F.filter(edges, lambda e: e <= F.col("hk")))
    begun = stacks.withColumn("range", at)
    # the stack open at a range's beginning is that of the last rule host before it
    last = begun.groupBy("range").agg(F.max_by("stack", "hk").alias("stack"))
    every = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range")).join(last, "range", "left")
    handed = every.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("stack"))  # one row a range
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = (
        handed.select("range", F.lit(0).alias("kind"), F.lit(None).cast("array<string>").alias("hk"), "stack")
        .unionByName(begun.select("range", F.lit(1).alias("kind"), "hk", "stack"))
        .unionByName(hosts.select(at.alias("range"), F.lit(2).alias("kind"), "hk", none.alias("stack")))
    )
    order = Window.partitionBy("range").orderBy(F.col("hk").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("kind = 2")
    return swept.select("hk", F.filter("stack", lambda r: F.slice("hk", 1, F.size(r)) == r).alias("enclosing")).where(F.size("enclosing") > 0)


def _stacked(rules: DataFrame) -> DataFrame:
    """Each rule with its stack: the rules of its host whose paths begin its path, outermost first.

    Found by joining a rule's path prefixes to rule paths, so it's linear in
    the rules' total length rather than in pairs of rules.
    """
    one = rules.select(
        host_key(F.coalesce("host", F.lit(""))).alias("hk"), F.coalesce("path", F.lit("")).alias("rpath"), F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"), "action"
    ).groupBy("hk", "rpath", "rule").agg(F.max("action").alias("action"))
    prefixes = one.select("hk", F.col("rpath").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.length("rpath")), lambda i: F.substring(F.col("rpath"), F.lit(1), i))).alias("rpath"))
    return prefixes.join(one, ["hk", "rpath"]).groupBy("hk", F.col("of").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rpath", "rule", "action"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = DEFAULT, rows_per_sweep: int = 1_000, hosts_per_range: int = 50_000) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    # what several steps read is written once
    urls = written(pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path")).groupBy("id", "host", "path").agg(F.count("*").alias("n")), "url-rows")
    stacks = written(_stacked(rules), "url-stacks")
    distinct = written(urls.select(host_key(F.col("host")).alias("hk")).distinct(), "url-hosts")
    found = _enclosing_hosts(distinct, stacks.select("hk").distinct(), hosts_per_range)
    keyed = urls.select("id", "host", "path", host_key(F.col("host")).alias("own"))
    looked_up = written(keyed.join(found.withColumnRenamed("hk", "own"), "own").select("id", "host", "path", F.explode("enclosing").alias("hk")), "url-rule-hosts")
    hosts = stacks.groupBy("hk").agg(F.count("*").alias("rules"))
    # a sweep repeats its host's rules, so it takes four URLs for each of them at least
    loads = looked_up.join(hosts.select("hk"), "hk").groupBy("hk").agg(F.count("*").alias("urls")).join(hosts, "hk")
    sweeps = written(loads.select("hk", F.ceil(F.col("urls") / F.greatest(F.lit(rows_per_sweep), 4 * F.col("rules"))).cast("int").alias("sweeps")), "url-sweeps")
    # the few salts are spread by id, host and path: equal rows were merged above
    salted = looked_up.join(sweeps, "hk").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.col("sweeps")))
    events = salted.select("hk", "salt", F.col("path").alias("key"), F.lit(1).alias("kind"), "id", "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("begun"))
    begun = stacks.join(sweeps, "hk").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)))
    begun = begun.select("hk", F.col("salt").cast("bigint").alias("salt"), "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.col("stack").alias("begun"))
    sweep = F.struct("hk", "salt")
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(begun).withColumn("sweep", sweep).withColumn("stack", F.last("begun", ignorenulls=True).over(order)).where("kind = 1")
    active = F.filter("stack", lambda r: F.startswith(F.col("key"), r["rpath"]))
    hits = swept.select("id", "host", F.col("key").alias("path"), F.try_element_at(active, F.lit(-1)).alias("hit")).where("hit IS NOT NULL")
    best = F.struct(F.length("hit.rule").alias("len"), F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"))
    base = urls.select("id", "host", "path", "n", F.lit(None).cast("struct<len:int,rule:string,action:string>").alias("best"))
    both = base.unionByName(hits.select("id", "host", "path", F.lit(0).cast("bigint").alias("n"), best.alias("best")))
    judged = both.groupBy("id", "host", "path").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    return judged.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), copies.alias("_copy")).drop("_copy")

