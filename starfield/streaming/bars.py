"""Time-bucket aggregates over a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from starfield.operators.timeseries import bars, buckets, features_of


def streaming_bars(trades: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream, final once the watermark has passed their bucket (append mode)."""
    return bars(trades.withWatermark("ts", late), seconds)


def write_buckets(trades: DataFrame, path: str, checkpoint: str, seconds: int = 10, late: str = "10 minutes") -> StreamingQuery:
    """Stores the buckets of a stream, each once and whole, when the watermark has passed it. Ticks that come later than
    that are left out, however micro-batches cut the stream."""
    final = buckets(trades.withWatermark("ts", late), seconds)
    return final.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def stored_features(spark: SparkSession, path: str, seconds: int = 10) -> DataFrame:
    """Features of all buckets stored so far; those that look back see all earlier buckets."""
    return features_of(spark.read.parquet(path), seconds)
