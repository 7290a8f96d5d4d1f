"""Bans: the severity ban store as time intervals (T9), BLOCK decisions to
ban requests and audit rows (Q5: P9, F13, S8b), expired-ban reconciliation
(D4) and the ban ladder (D8).

Batch form of the key/value store: one row per *accepted* set call with
``valid_from_ms`` (call time), ``valid_to_ms`` (expiry, or the next accepted
call of the user if earlier; null = permanent). A set is accepted when no
ban is live or the live ban has a lower severity (ttl 0 = permanent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.config import BAN_LADDER, RiskConfig
from payguard.functions import ban_value
from payguard.operators.joins import interval_join
from payguard.operators.recurrence import _FOREVER, greedy_accept
from payguard.session import cut_lineage


def decisions_to_ban_requests(decisions: DataFrame, cfg: RiskConfig) -> DataFrame:
    """P9 + F13: BLOCK decisions -> set(user, 'ASYNC_RULE:<decision id>',
    severity 3, 24 h) at the decision time (replayable 'now')."""
    return decisions.filter(F.col("decision") == "BLOCK").select(
        "user_id", F.concat(F.lit("ASYNC_RULE:"), F.col("decision_id")).alias("reason"),
        F.lit(cfg.ban_severity).alias("severity"), F.lit(cfg.ban_ttl_seconds).cast("long").alias("ttl_seconds"),
        F.col("created_at").alias("ts"), F.col("decision_id").alias("request_key"), "seq")


def ban_intervals(requests: DataFrame, method: str = "auto", fold_max_group_rows: int = 2_000) -> DataFrame:
    """T9 over ban requests (user_id, reason, severity, ttl_seconds, ts,
    request_key[, seq]): every request with ``accepted``; accepted ones carry
    the interval they are the live ban for. Ties at one ms: by seq, then
    request_key."""
    nodes = requests.select(
        *[c for c in requests.columns if c != "seq"], F.unix_millis("ts").alias("ms"),
        (F.col("seq") if "seq" in requests.columns else F.lit(0).cast("long")).alias("seq"),
        F.col("request_key").alias("node_id"),
        F.when(F.col("ttl_seconds") > 0, F.col("ttl_seconds") * 1000).cast("long").alias("ttl_ms"))
    out = greedy_accept(nodes, ["user_id"], "ttl_ms", sev="severity", method=method,
                        fold_max_group_rows=fold_max_group_rows)
    return out.select(
        "user_id", "reason", "severity", "ttl_seconds", "ts", "request_key", "accepted",
        F.when(F.col("accepted"), F.col("ms")).alias("valid_from_ms"),
        F.when(F.col("accepted") & (F.col("until_ms") < _FOREVER), F.col("until_ms")).alias("valid_to_ms"),
        F.when(F.col("accepted"), F.col("ms") + F.col("ttl_ms")).alias("expires_ms"),
        F.when(F.col("accepted"), ban_value("reason", "severity")).alias("stored_value"))


def live_bans(intervals: DataFrame) -> DataFrame:
    """Accepted bans with ``gate_to_ms``, the first ms at which the gate no longer
    sees the ban: its expiry, or one past its replacement (a call at that
    very instant reads the store before the stronger ban is written)."""
    replaced = F.col("valid_to_ms") < F.coalesce("expires_ms", F.lit(_FOREVER))
    gate_to = F.when(replaced, F.col("valid_to_ms") + 1).otherwise(F.col("expires_ms"))
    return intervals.filter("accepted").select("user_id", "reason", "severity", "valid_from_ms", "valid_to_ms",
                                               gate_to.alias("gate_to_ms"))


def audit_bans(decisions: DataFrame, cfg: RiskConfig) -> DataFrame:
    """One audit row per BLOCK decision (also when the ban write was
    refused); first write per decision id wins; expiry = decision time + ttl."""
    blocks = decisions.filter(F.col("decision") == "BLOCK")
    first = blocks.groupBy("decision_id").agg(F.min_by(F.struct(
        "user_id", "created_at"), F.col("created_at")).alias("d"))
    return first.select(
        "decision_id", "d.user_id", F.concat(F.lit("ASYNC_RULE:"), F.col("decision_id")).alias("reason"),
        F.lit(cfg.ban_severity).alias("severity"),
        F.timestamp_millis(F.unix_millis("d.created_at") + cfg.ban_ttl_seconds * 1000).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("cleared_at"), F.col("d.created_at").alias("created_at"))


def reconcile_expired(audit: DataFrame, now_ms_col: str | None = None, now_ms: int | None = None) -> DataFrame:
    """``expires_at < now AND cleared_at IS NULL`` -> cleared at now, with
    an unban event; idempotent (already cleared rows are left alone)."""
    now = F.col(now_ms_col) if now_ms_col else F.lit(now_ms)
    due = (F.unix_millis("expires_at") < now) & F.col("cleared_at").isNull()
    return audit.withColumn("unban", due).withColumn(
        "cleared_at", F.when(due, F.timestamp_millis(now)).otherwise(F.col("cleared_at")))


def ladder_ttl(severity_col) -> F.Column:
    """Severity 1-5 -> ttl seconds (0 = permanent), null otherwise."""
    m = F.create_map(*[x for s, t in BAN_LADDER for x in (F.lit(s), F.lit(t).cast("long"))])
    return F.element_at(m, F.col(severity_col) if isinstance(severity_col, str) else severity_col)


def events_under_ban(events: DataFrame, bans: DataFrame) -> DataFrame:
    """Flag events of users with a live ban: set strictly before the
    event, not expired at it, and not replaced before it. Adds ``ban_reason`` (null = none)."""
    b = live_bans(bans).select("user_id", "valid_from_ms", "gate_to_ms", F.col("reason").alias("ban_reason"))
    # stored, as the join reads the bans for their last start and again for the rows
    j = interval_join(events, cut_lineage(b, "bans"), "ms", "valid_from_ms", "gate_to_ms", keys=("user_id",), how="left",
                      start_inclusive=False)
    return j.drop("valid_from_ms", "gate_to_ms")
