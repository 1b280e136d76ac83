"""Patterns over streams: every native expression is row-wise, so it runs unchanged in a streaming select or where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Pattern


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def matching(stream: DataFrame, text_col: str, pattern: Pattern) -> DataFrame:
    return stream.where(pattern.is_match(F.col(text_col)))


def match_rates(stream: DataFrame, time_col: str, text_col: str, pattern: Pattern, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, matches: matches in event-time windows; rows later than the watermark are left out."""
    counted = stream.withWatermark(time_col, late).select(F.col(time_col), pattern.count(F.col(text_col)).alias("n")).where("n > 0")
    slot = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return counted.groupBy(slot.alias("w")).agg(F.sum("n").alias("matches")).select(F.col("w.start").alias("window_start"), "matches")
