"""Row-wise risk rules R1-R7 and the decision / high-risk / alert
projections (P5-P8). Pure column expressions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard import config as C
from payguard.functions import (clamp_score, decision_for, join_reasons, reasons_array,
                                severity_for, stable_id)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rule_hits(params: dict[str, Column], cfg: C.RiskConfig, blacklisted: str = "blacklisted",
              velocity: str = "velocity_7d", burst: str = "merchant_users"):
    """(fired Column, reason, delta Column) in rule order; null-safe."""
    p = params
    return [
        (F.coalesce(F.col(blacklisted), F.lit(False)), C.REASON_BLACKLISTED, _c(cfg.blacklist_score)),
        (F.coalesce(F.col(velocity) >= p["velocity_threshold"], F.lit(False)), C.REASON_VELOCITY,
         p["velocity_score"]),
        (F.coalesce(F.col("amount_cents") >= p["large_amount_cents"], F.lit(False)),
         C.REASON_LARGE_AMOUNT, p["large_amount_score"]),
        (F.coalesce((F.col("event_type") == "WITHDRAWAL") & F.col("device_fp").isNull(), F.lit(False)),
         C.REASON_NO_DEVICE, p["withdrawal_score"]),
        (F.coalesce(F.col("merchant_id").isNotNull() & (F.col(burst) >= p["burst_threshold"]), F.lit(False)),
         C.REASON_BURST, p["burst_score"]),
    ]


def evaluate(df: DataFrame, params: dict[str, Column], cfg: C.RiskConfig, **cols) -> DataFrame:
    """Add ``raw_score`` (unclamped), ``risk_score`` (clamped), ``decision``
    (on the unclamped score), ``reasons`` and ``decision_id``."""
    hits = rule_hits(params, cfg, **cols)
    raw = sum((F.when(c, d).otherwise(F.lit(0)) for c, _, d in hits), F.lit(0)).cast("int")
    return (df.withColumn("raw_score", raw)
            .withColumn("risk_score", clamp_score("raw_score", cfg.score_cap).cast("int"))
            .withColumn("decision", decision_for("raw_score", params["review_threshold"],
                                                 params["block_threshold"]))
            .withColumn("reasons", reasons_array([(c, r) for c, r, _ in hits]))
            .withColumn("decision_id", stable_id(C.SOURCE_ENGINE, "event_id")))


def decisions(evaluated: DataFrame) -> DataFrame:
    """P5: decision record; created_at = event time."""
    return evaluated.select(
        "decision_id", "event_id", "request_id", "user_id", "decision", "risk_score", "reasons",
        F.col("ts").alias("created_at"), F.lit(C.SOURCE_ENGINE).alias("source"),
        "merchant_id", "seq", "ms", "raw_score")


def high_risk(decs: DataFrame, threshold: int) -> DataFrame:
    """Clamped score >= threshold."""
    return decs.filter(F.col("risk_score") >= threshold).select(
        stable_id("high-risk", "decision_id").alias("high_risk_event_id"), "decision_id", "event_id",
        "request_id", "user_id", "merchant_id", "risk_score", "reasons", "created_at", "source", "seq", "ms")


def alerts(decs: DataFrame, threshold: int) -> DataFrame:
    """Clamped score >= threshold; severity F7; summary F9."""
    return decs.filter(F.col("risk_score") >= threshold).select(
        stable_id("alert", "decision_id").alias("alert_id"), "decision_id", "event_id", "user_id",
        "risk_score", severity_for("risk_score").alias("severity"),
        join_reasons("reasons").alias("reason_summary"), "created_at", "source", "seq", "ms")


def two_rule_decisions(events: DataFrame, cfg: C.RiskConfig) -> DataFrame:
    """Large amount + withdrawal without device only; BLOCK at 80 else
    ALLOW; no hit -> ["no_async_rule_hit"]. created_at = event time so a
    replay is byte-equal."""
    large = F.col("amount_cents") >= cfg.worker_large_amount_cents
    nodev = (F.col("event_type") == "WITHDRAWAL") & F.col("device_fp").isNull()
    score = (F.when(large, 80).otherwise(0) + F.when(nodev, 30).otherwise(0)).cast("int")
    reasons = reasons_array([(large, C.REASON_LARGE_AMOUNT), (nodev, C.REASON_NO_DEVICE)])
    return events.select(
        stable_id(C.SOURCE_WORKER, "event_id").alias("decision_id"), "event_id", "request_id", "user_id",
        F.when(score >= 80, "BLOCK").otherwise("ALLOW").alias("decision"),
        clamp_score(score).cast("int").alias("risk_score"),
        F.when(F.size(reasons) == 0, F.array(F.lit(C.REASON_NO_ASYNC_HIT))).otherwise(reasons).alias("reasons"),
        F.col("ts").alias("created_at"), F.lit(C.SOURCE_WORKER).alias("source"), "seq", "ms")
