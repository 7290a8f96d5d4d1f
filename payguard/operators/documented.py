"""Capabilities the reference documents without code (D1-D9), built as
user-level Spark operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.operators.windows import _B, _localize, local_bucket_ms
from payguard.session import cut_lineage


def sequence_pattern(events: DataFrame, first_type: str, second_type: str, third_type: str,
                     within_ms: int, third_min_amount: int = 0, bucket_ms: int = 86_400_000) -> DataFrame:
    """A ``third_type`` event (amount >= ``third_min_amount``) preceded,
    within ``within_ms`` of it, by a ``second_type`` event that is itself
    preceded (after the window start) by a ``first_type`` event; order is
    (ms, seq) and strict. Rows are localised to (user, bucket) groups with
    copies of the preceding window, so a hot user is split by time.

    The latest second-step event before t carries the latest first-step time
    before it, which is non-decreasing; so one running max per step decides.
    """
    loc = _localize(events, ["user_id"], "ms", within_ms, local_bucket_ms(within_ms, bucket_ms))
    before = (Window.partitionBy("user_id", _B).orderBy("ms", "seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    loc = loc.withColumn("_last_first", F.max(F.when(F.col("event_type") == first_type, F.col("ms"))).over(before))
    carried = F.when(F.col("event_type") == second_type, F.struct(F.col("ms"), F.col("_last_first")))
    loc = loc.withColumn("_last_second", F.max(carried).over(before))
    hit = ((F.col("event_type") == third_type) & (F.col("amount_cents") >= third_min_amount)
           & (F.col("_last_second._last_first") >= F.col("ms") - within_ms))
    return (loc.filter(F.col("_pg_real") & hit)
            .select("event_id", "user_id", "ms", F.col("_last_second.ms").alias("second_ms"),
                    F.col("_last_second._last_first").alias("first_ms")))


def tumbling_user_score(decisions: DataFrame, width_ms: int = 86_400_000) -> DataFrame:
    """Per (user, tumbling window): max / average score and decisions."""
    start = (F.floor(F.col("ms") / width_ms) * width_ms).cast("long")
    return decisions.groupBy("user_id", start.alias("window_start_ms")).agg(
        F.max("risk_score").alias("max_score"), F.round(F.avg("risk_score"), 6).alias("avg_score"),
        F.count(F.lit(1)).alias("decisions"))


def user_profile(events: DataFrame, decisions: DataFrame, txn_window_ms: int = 30 * 86_400_000) -> DataFrame:
    """D3: risk_score (latest decision), last_ip, device_count, txn_30d
    (TRANSACTION events in the 30 days up to the user's last event),
    last_seen."""
    last = events.groupBy("user_id").agg(
        F.max("ms").alias("last_seen_ms"), F.max_by("ip_address", F.struct("ms", "seq")).alias("last_ip"),
        F.count_distinct("device_fp").alias("device_count"))
    txn = (events.filter(F.col("event_type") == "TRANSACTION").select("user_id", "ms")
           .join(last.select("user_id", "last_seen_ms"), "user_id")
           .filter(F.col("ms") > F.col("last_seen_ms") - txn_window_ms)
           .groupBy("user_id").agg(F.count(F.lit(1)).alias("txn_30d")))
    score = decisions.groupBy("user_id").agg(F.max_by("risk_score", F.struct("ms", "seq")).alias("risk_score"))
    return (last.join(txn, "user_id", "left").join(score, "user_id", "left")
            .withColumn("txn_30d", F.coalesce("txn_30d", F.lit(0)).cast("long")))


def reason_daily(decisions: DataFrame) -> DataFrame:
    """Compliance report: decisions per (day, reason) (``explode``)."""
    day = (F.floor(F.col("ms") / 86_400_000) * 86_400_000).cast("long")
    return (decisions.select(day.alias("day_start_ms"), F.explode("reasons").alias("reason"), "user_id")
            .groupBy("day_start_ms", "reason").agg(F.count(F.lit(1)).alias("decisions"),
                                          F.count_distinct("user_id").alias("users")))


def block_rate_vs_baseline(decisions: DataFrame, width_ms: int = 3_600_000, baseline_windows: int = 24,
                           factor: float = 2.0) -> DataFrame:
    """Block rate per window against the mean rate of the preceding
    ``baseline_windows`` windows; alert when above ``factor`` x baseline.
    The trailing mean is computed by copying each window's rate forward to
    the windows it is a baseline for and aggregating (no global window)."""
    start = (F.floor(F.col("ms") / width_ms) * width_ms).cast("long")
    w = decisions.groupBy(start.alias("window_start_ms")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("decision") == "BLOCK", 1).otherwise(0)).alias("blocks"))
    w = cut_lineage(w.withColumn("block_rate", F.col("blocks") / F.col("total")), "rates")  # a row per window, read twice below
    fwd = w.select(F.explode(F.sequence(F.col("window_start_ms") + width_ms,
                                        F.col("window_start_ms") + baseline_windows * width_ms,
                                        F.lit(width_ms))).alias("window_start_ms"), "block_rate")
    base = fwd.groupBy("window_start_ms").agg(F.avg("block_rate").alias("baseline_rate"),
                                              F.count(F.lit(1)).alias("baseline_windows"))
    out = w.join(base, "window_start_ms", "left")
    return out.select("window_start_ms", "total", "blocks", F.round("block_rate", 6).alias("block_rate"),
                      F.round("baseline_rate", 6).alias("baseline_rate"),
                      F.coalesce(F.col("block_rate") > factor * F.col("baseline_rate"), F.lit(False)).alias("alert"))
