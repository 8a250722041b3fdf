"""Decisions on streams: gating is map-only and the same as for batches; counts are windowed.

Late rows are dropped behind a watermark; replays of a decision are dropped within it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate as G
from ..plans import workloads as W


def decide_stream(scored: DataFrame, policy: G.ThresholdPolicy = G.ThresholdPolicy(), time: str = "ts", delay: str = "1 hour", key: str = "case_id") -> DataFrame:
    """Decisions of a streaming DataFrame, each key once within the watermark's delay."""
    timed = scored.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return G.decide(timed, policy).dropDuplicatesWithinWatermark([key])


def windowed_counts(decided: DataFrame, time: str = "ts", window: str = "1 day") -> DataFrame:
    """Decisions by window, action and reason."""
    return decided.groupBy(F.window(time, window).alias("w"), "action", "reason_code").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "reason_code", "n")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of scored cases."""
    path = f"{sf_dir}/events.parquet"
    table = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(table.schema)
    # a stream reads folders; the table may be one, or a single file of one
    single = any(f.endswith(f"/{name}") for f in table.inputFiles())
    rows = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    listed, w = W._weighted(W.EVENT_TYPES, "event_id", "user_id", "event_type")
    return rows.select(F.col("event_id").alias("case_id"), listed.alias("candidates"), W.S.distribution(listed, W.S.normalised(w)).alias("scores"), "ts")


def daily_counts(spark: SparkSession, sf_dir: str, policy: G.ThresholdPolicy) -> DataFrame:
    """Run the stream over what is there now, in complete mode, and return day, action and count.

    The in-memory sink holds one row for each day and action, however many events there are.
    """
    day = F.date_format(F.window(F.col("ts").cast("timestamp"), "1 day")["start"], "yyyy-MM-dd").alias("day")
    counts = G.decide(events_stream(spark, sf_dir), policy).groupBy(day, "action").agg(F.count(F.lit(1)).alias("n"))
    name = f"decisions_{uuid.uuid4().hex}"
    running = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)
