"""Incremental profiles of a stream: an extension, as the reference has no streams.

A profile is kept as sums that can be merged, so that a new batch costs its own
rows only.  Late rows are held back by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, key, n, nulls, least, most, total of each window; works on streams and on tables alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(time, late)
    g = e.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("nulls"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))
    return g.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), key, "n", "nulls", "least", "most", F.round("total", 4).alias("total"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, into Parquet files."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
