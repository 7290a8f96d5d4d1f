"""Admission (Q3): normalise (P1), allow-list (P2), validate (P3), ban gate
(J3), per-user sliding rate limit (W2) and the outcome precedence (P10).

Outcome precedence: invalid -> REJECTED; live ban -> BLOCKED,
``blacklist:<reason>``, count 0 (a banned call never enters the limiter
history); over the limit -> BLOCKED, ``rate_limit``, count; else ACCEPTED,
``passed_fast_path``, count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.config import ALLOWED_EVENT_TYPES, RiskConfig
from payguard.functions import blank_to_null, is_blank, stable_id
from payguard.operators import windows as W
from payguard.operators.bans import events_under_ban


def normalize_requests(req: DataFrame, now: Column | None = None) -> DataFrame:
    """Upper-case type and currency; blank ids -> deterministic ids (a
    name-based UUID of the request's content and position, so a replay gives
    the same id); missing timestamp -> ``received_at`` when present, else
    ``now`` (default: the query's start)."""
    seed = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "user_id", "event_type", "ts", "amount_cents", "currency", "merchant_id", "seq")])
    received = [F.col("received_at")] if "received_at" in req.columns else []
    ts = F.coalesce(F.col("ts"), *received, now if now is not None else F.current_timestamp())
    return (req.withColumn("event_type", F.upper("event_type"))
            .withColumn("currency", F.upper("currency"))
            .withColumn("event_id", F.coalesce(blank_to_null("event_id"), stable_id("event", seed)))
            .withColumn("request_id", F.coalesce(blank_to_null("request_id"), stable_id("request", seed)))
            .withColumn("ts", ts)
            .withColumn("ms", F.unix_millis("ts")))


def violations(req: DataFrame) -> DataFrame:
    """P2 + P3: ``violations`` array (empty = valid)."""
    def blank(c):
        return F.col(c).isNull() | is_blank(c)
    checks = [
        F.when(blank("user_id"), F.lit("user_id:blank")),
        F.when(blank("event_type"), F.lit("event_type:blank")),
        F.when(blank("currency"), F.lit("currency:blank")),
        F.when(blank("source"), F.lit("source:blank")),
        F.when(F.col("amount_cents").isNull() | (F.col("amount_cents") < 0), F.lit("amount_cents:min_0")),
        F.when(~blank("event_type") & ~F.col("event_type").isin(*ALLOWED_EVENT_TYPES),
               F.lit("event_type:unsupported")),
    ]
    return req.withColumn("violations", F.array_compact(F.array(*checks)))


def admit(requests: DataFrame, bans: DataFrame | None, cfg: RiskConfig, method: str = "auto",
          now: Column | None = None) -> DataFrame:
    """Q3: one outcome row per request (``status``, ``reason``,
    ``rate_limit_count``) plus the normalised request columns."""
    v = violations(normalize_requests(requests, now))
    if bans is not None:
        gated = events_under_ban(v, bans)
    else:
        gated = v.withColumn("ban_reason", F.lit(None).cast("string"))
    invalid = F.size("violations") > 0
    banned = F.col("ban_reason").isNotNull()
    # one pass: invalid and banned calls get a per-call key, so they never
    # enter a user's limiter history (and form no hot key)
    calls = gated.withColumn("_rl_key", F.when(invalid | banned, F.concat(F.lit("\u0000"), F.col("event_id")))
                             .otherwise(F.col("user_id")))
    limited = W.distinct_in_range(calls, ["_rl_key"], "request_id", cfg.rate_limit_window_ms - 1, "_rl_count",
                                  bucket_ms=cfg.bucket_ms, method=method, ties="arrival")
    over = F.col("_rl_count") > F.lit(cfg.rate_limit)
    return limited.select(
        *v.columns,
        F.when(invalid, "REJECTED").when(banned, "BLOCKED").when(over, "BLOCKED").otherwise("ACCEPTED")
        .alias("status"),
        F.when(invalid, F.array_join("violations", ",")).when(banned, F.concat(F.lit("blacklist:"), "ban_reason"))
        .when(over, "rate_limit").otherwise("passed_fast_path").alias("reason"),
        F.when(invalid | banned, F.lit(0)).otherwise(F.col("_rl_count")).cast("long").alias("rate_limit_count"))


def accepted_events(outcomes: DataFrame) -> DataFrame:
    """The admitted requests, published as raw events."""
    return outcomes.filter(F.col("status") == "ACCEPTED").drop("status", "reason", "rate_limit_count",
                                                              "violations")
