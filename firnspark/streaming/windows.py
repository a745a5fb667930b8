"""Streams of observations: windowed quantiles and counts, and the latest value of each key.

The batch operators have no streaming counterpart to match; these are for feeds of the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_quantiles(stream: DataFrame, t: str, keys: list[str], value: str, window: str = "1 hour", late: str = "2 hours", qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles and counts by window and key; rows later than ``late`` behind the newest don't count. The time may lack a zone."""
    s = stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(F.window("__t", window).alias("w"), *keys).agg(F.percentile(value, list(qs)).alias("quantiles"), F.count(value).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "quantiles", "n")


def session_counts(stream: DataFrame, t: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = stream.withColumn("__t", F.col(t).cast("timestamp")).withWatermark("__t", late)
    g = s.groupBy(F.session_window("__t", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
