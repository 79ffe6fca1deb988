"""A log of runs: when a query began and ended, with what, how many rows it gave and where they are.

The log is a Parquet folder that is only appended to; a run's last event tells
its state.  Rows are counted while they are written, not by a second pass.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.writers import run_key

EVENT = "run_id string, processor string, collection string, params string, run_key string, status string, at timestamp, rows bigint, outfile string"


def _event(spark: SparkSession, log: str, **values) -> None:
    names = [c.split()[0] for c in EVENT.split(", ")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names if n != "at")], ", ".join(c for c in EVENT.split(", ") if not c.startswith("at ")))
    row.withColumn("at", F.lit(time.time()).cast("timestamp")).select(*names).coalesce(1).write.mode("append").parquet(log)


def logged(spark: SparkSession, log: str, processor: str, collection: str, build: Callable[[], DataFrame], outfile: str, **params) -> DataFrame:
    """What ``build`` gives, written to ``outfile`` and read back; its beginning, end or failure are events of ``log``."""
    told = {"run_id": uuid.uuid4().hex, "processor": processor, "collection": collection, "params": json.dumps(params, sort_keys=True, default=str), "run_key": run_key(processor, params), "outfile": outfile}
    _event(spark, log, status="running", **told)
    try:
        seen, found = Observation(), build()
        found.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(outfile)
        rows = seen.get["rows"]
    except Exception:
        _event(spark, log, status="failed", **told)
        raise
    _event(spark, log, status="done", rows=rows, **told)
    return spark.read.schema(found.schema).parquet(outfile)


def runs(spark: SparkSession, log: str) -> DataFrame:
    """``(run_id, processor, collection, params, run_key, status, started, ended, rows, outfile)``: a row for each run."""
    events = spark.read.schema(EVENT).parquet(log)
    last = F.max_by(F.struct("status", "rows"), F.struct("at", F.col("status") != "running"))  # a run's two events
    found = events.groupBy("run_id", "processor", "collection", "params", "run_key", "outfile").agg(F.min("at").alias("started"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("ended"), last.alias("x"))
    return found.select("run_id", "processor", "collection", "params", "run_key", "x.status", "started", "ended", "x.rows", "outfile")


def latest(spark: SparkSession, log: str) -> DataFrame:
    """The newest finished run of each processor, collection and parameters."""
    done = runs(spark, log).where("status = 'done'")
    return done.groupBy("processor", "collection", "run_key").agg(F.max_by(F.struct("run_id", "ended", "rows", "outfile"), F.struct("ended", "run_id")).alias("x")).select("processor", "collection", "run_key", "x.*")
