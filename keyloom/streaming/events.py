"""Streams: findings of arriving files, each told once, and limits by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect


def stream_table(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def stream_findings(files: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Findings of a stream ``files(file, content, ts)``; a repeat within ``late`` is left out, and the state bounded by it."""
    key = ["file", "line", "col", "rule_id"]
    if not files.isStreaming:
        return detect.regex_findings(files, keep=(at,)).dropDuplicates(key)
    return detect.regex_findings(files.withWatermark(at, late), keep=(at,)).dropDuplicatesWithinWatermark(key)


def rate_limits(events: DataFrame, key: str, at: str = "ts", limit: int = 60, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """``window_start, key, n, limited`` of fixed windows: over ``limit`` events of a key in one are too many.

    Works on a batch and, with a watermark, on a stream. Counts are summed
    before the shuffle, so a hot key is a row per task.
    """
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("limited"))
