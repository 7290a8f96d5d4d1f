"""Alert service as a batch job (Q4 / T11): insert-if-absent log (J4),
duplicate check against the stored log (J7), per-(user, severity) cool-down
(T10), severity routing (J9), log update (J6) and the sends table (F27).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.config import RiskConfig
from payguard.operators.recurrence import greedy_accept

CHANNELS = ("email", "sms", "push")


def routing_map(cfg: RiskConfig) -> Column:
    """J9 lookup as a literal map; an unknown channel in the config is an
    error (the reference fails on a channel with no sender)."""
    for _, chans in cfg.routing:
        for c in chans:
            if c not in CHANNELS:
                raise ValueError(f"no notification channel registered for {c}")
    return F.create_map(*[x for sev, chans in cfg.routing
                          for x in (F.lit(sev), F.array(*[F.lit(c) for c in chans]))])


def route(severity: Column, cfg: RiskConfig) -> Column:
    """Severity (upper-cased) -> ordered channel list; unknown -> empty."""
    return F.coalesce(F.element_at(routing_map(cfg), F.upper(severity)), F.array().cast("array<string>"))


def cooldown(alerts: DataFrame, cfg: RiskConfig, method: str = "auto", passed: DataFrame | None = None) -> DataFrame:
    """First alert of (user, SEVERITY) passes; later ones pass only when
    at least ``alert_cooldown_ms`` after the last one that passed (not sliding).
    ``passed`` (user_id, severity, ms): alerts let through before this batch; the
    last one of each key holds into it. Adds ``allowed``."""
    keys = ["user_id", "_sev_key"]
    nodes = alerts.select("*", F.col("alert_id").alias("node_id"),
                          F.upper("severity").alias("_sev_key"),
                          F.lit(cfg.alert_cooldown_ms).cast("long").alias("_ttl"))
    held = None
    if passed is not None:
        last = passed.groupBy("user_id", F.upper("severity").alias("_sev_key")).agg(F.max("ms").alias("_last"))
        nodes = nodes.join(last, keys, "left").withColumn(
            "_held", F.coalesce(F.col("ms") - F.col("_last") < F.col("_ttl"), F.lit(False)))
        held = nodes.filter("_held").drop("_held", "_last").withColumn("allowed", F.lit(False))
        nodes = nodes.filter(~F.col("_held")).drop("_held", "_last")
    out = greedy_accept(nodes, keys, "_ttl", method=method, fold_max_group_rows=cfg.fold_max_group_rows)
    out = out.withColumnRenamed("accepted", "allowed").drop("until_ms")
    if held is not None:
        out = out.unionByName(held)
    return out.drop("node_id", "_sev_key", "_ttl")


def log_rows(limited: DataFrame, cfg: RiskConfig, *more: str) -> DataFrame:
    """Rows of the alert log (and the columns ``more``) from alerts with ``allowed``."""
    chans = F.when(F.col("allowed"), route(F.col("severity"), cfg)).otherwise(F.array().cast("array<string>"))
    return limited.select(
        "alert_id", "user_id", "severity", "reason_summary",
        F.when(F.col("allowed"), "PROCESSED").otherwise("RATE_LIMITED").alias("status"),
        chans.alias("channels_notified"), "created_at", F.col("created_at").alias("processed_at"), *more)


def process_alerts(deliveries: DataFrame, cfg: RiskConfig, alert_log: DataFrame | None = None,
                   method: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (alert_log', outcomes per delivery, sends).

    Deliveries are processed in (ms, seq, delivery) order. The first delivery
    of an alert id not yet in the log (or still PENDING there) is processed;
    every other delivery is a duplicate that reports the stored channels.
    ``processed_at`` is the alert time so replays are byte-equal. The alerts a prior
    log let through hold their cool-down into this batch, so consecutive
    batches with the log passed on equal one batch.
    """
    order = F.struct("ms", "seq", "delivery")
    first = deliveries.groupBy("alert_id").agg(F.min_by(F.struct(*deliveries.columns), order).alias("a")) \
        .select("a.*")
    if alert_log is not None:
        done = alert_log.filter(F.col("status") != "PENDING").select("alert_id")
        todo = first.join(done, "alert_id", "left_anti")
    else:
        todo = first
    passed = None
    if alert_log is not None:
        passed = alert_log.filter(F.col("status") == "PROCESSED").select(
            "user_id", "severity", F.unix_millis(F.coalesce("processed_at", "created_at")).alias("ms"))
    limited = cooldown(todo, cfg, method, passed)
    new_log = log_rows(limited, cfg, "ms", "seq", "delivery")
    if alert_log is not None:
        kept = alert_log.join(new_log.select("alert_id"), "alert_id", "left_anti")
        log_out = kept.unionByName(new_log.drop("ms", "seq", "delivery"), allowMissingColumns=True)
    else:
        log_out = new_log.drop("ms", "seq", "delivery")
    stored = log_out.select("alert_id", F.col("status").alias("stored_status"),
                            F.col("channels_notified").alias("stored_channels"))
    processed_key = new_log.select("alert_id", F.col("delivery").alias("_pd"), F.col("status").alias("_ps"))
    outcomes = (deliveries.join(processed_key, "alert_id", "left").join(stored, "alert_id", "left")
                .select("alert_id", "user_id", "severity", "delivery", "ms",
                        (F.col("_pd").isNull() | (F.col("_pd") != F.col("delivery"))).alias("duplicate"),
                        (F.col("_pd") == F.col("delivery")).alias("_mine"), "_ps", "stored_channels"))
    outcomes = outcomes.select(
        "alert_id", "user_id", "severity", "delivery", "ms", "duplicate",
        F.coalesce(F.col("_mine") & (F.col("_ps") == "RATE_LIMITED"), F.lit(False)).alias("rate_limited"),
        F.col("stored_channels").alias("channels"))
    sends = sends_table(limited.filter("allowed"), cfg)
    return log_out, outcomes, sends


def sends_table(allowed: DataFrame, cfg: RiskConfig, brand: str = "Risk") -> DataFrame:
    """One row per (alert, channel) in routing order with the message text a
    channel would send (F27). A disabled channel still counts as notified."""
    ex = allowed.select("*", F.posexplode(route(F.col("severity"), cfg)).alias("position", "channel"))
    subject = F.concat_ws(" ", F.lit(brand), F.col("severity"), F.lit("alert for"), F.col("user_id"))
    body = F.concat(F.lit("alertId="), F.col("alert_id"), F.lit("\nuserId="), F.col("user_id"),
                    F.lit("\nseverity="), F.col("severity"), F.lit("\nriskScore="),
                    F.col("risk_score").cast("string"), F.lit("\nreasonSummary="), F.col("reason_summary"),
                    F.lit("\nsource="), F.col("source"))
    push = F.concat(F.lit(brand + " "), F.col("severity"), F.lit(" alert\nuserId="), F.col("user_id"),
                    F.lit("\nreasonSummary="), F.col("reason_summary"), F.lit("\nalertId="), F.col("alert_id"))
    text = (F.when(F.col("channel") == "email", F.concat(subject, F.lit("\n\n"), body))
            .when(F.col("channel") == "push", push).otherwise(F.concat_ws(" ", F.lit("sms"), F.col("alert_id"))))
    return ex.select("alert_id", "user_id", "severity", "channel", "position", text.alias("message"), "ms")
