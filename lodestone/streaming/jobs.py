"""Structured Streaming: dedup and tumbling counts; what needs a state of its own is in keyed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.storage import fresh_path

from .keyed import rocks

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream with `at`, a time that watermarks accept."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available now, through the exactly-once file sink, read back as a table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    with rocks(spark):
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; state is kept as long as a replay may be late."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Closed windows' counts: start, event_type, n."""
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")
