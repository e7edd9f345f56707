"""Streaming forms of the aggregate and of the keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key so far; state holds one row a key."""
    rest = [c for c in stream.columns if c != key]
    latest = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return latest.select(*(F.col(c) if c == key else F.col("_row")[c].alias(c) for c in stream.columns))


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Rows and minimum and maximum of ``value`` for each key and time window; windows close behind a watermark."""
    grouped = stream.withWatermark(time, lateness).groupBy(F.window(time, width), key)
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "least", "most")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished rows to a folder, each once, until the input is used up."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
