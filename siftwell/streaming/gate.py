"""A streaming quality gate: daily counts of readings and of those within limits, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import workspace


def gate_counts(events: DataFrame, limit: float = 60.0, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """day, event_type, n, passed of a stream ``(ts, event_type, value)``; state is kept no longer than ``late`` allows."""
    day = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count(F.when(F.abs("value") <= limit, 1)).alias("passed")).select(F.col("w.start").alias("day"), "event_type", "n", "passed")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the events table through the stream to its end and returns the counts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = workspace(spark, "stream")
    # every micro-batch replaces the counts it changes; the last batch's table is complete
    query = gate_counts(stream).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/state")
    query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/counts")).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts")
