"""Structured Streaming forms of the batcher and the idempotent write."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time must be a timestamp with zone for watermarks."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def session_batches(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions of each key: (key, start, end, n)."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_writes(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: a repeated write is a hit and has no effect."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in the shared folder and reads it."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
