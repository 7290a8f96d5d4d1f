"""Watermarked stream aggregations in append mode (T1): a window's row comes out
once, when the watermark has passed its end; rows older than the watermark with which the
micro-batch before theirs ended are dropped, and counted by Spark's metric
``numRowsDroppedByWatermark``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_scores(decisions: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Per (user, tumbling window): max / average score and decisions."""
    g = decisions.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), "user_id").agg(
        F.max("risk_score").alias("max_score"), F.round(F.avg("risk_score"), 6).alias("avg_score"), F.count(F.lit(1)).alias("decisions"))
    return g.select(F.unix_millis("w.start").alias("window_start_ms"), "user_id", "max_score", "avg_score", "decisions")


def once(rows: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Rows whose key has not come within the watermark delay before (replays of a source)."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def throughput(rows: DataFrame, width: str, delay: str, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """A10: records per window and per second, redelivered ones once."""
    g = once(rows, [key], ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("records"))
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / 1000.0
    return g.select(F.unix_millis("w.start").alias("window_start_ms"), "records", F.round(F.col("records") / seconds, 6).alias("per_second"))
