"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` over the
driver's test tables. Output columns are flat and aliased to match the DuckDB
oracle (arrays are joined to strings, timestamps are epoch ms)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.config import TESTDATA_CONFIG as CFG
from payguard.functions import join_reasons, stable_id
from payguard.operators import windows as W
from payguard.plans import scoring as Q
from payguard.session import cut_lineage
from payguard.sources import testdata as TD

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark, sf):
    return TD.risk_events(spark, sf)


def _profiles(events):
    return TD.user_profiles(events)


def scored(spark, sf, rules: bool = False) -> Q.Scored:
    ev = _events(spark, sf)
    return Q.score_events(ev, CFG, profiles=_profiles(ev),
                          rule_updates=TD.rule_updates(spark) if rules else None)


def f04_stable_ids(spark, sf):
    ev = _events(spark, sf)
    did = stable_id("flink-risk-engine", "event_id")
    return ev.select("event_id", did.alias("decision_id"),
                     stable_id("high-risk", did).alias("high_risk_event_id"),
                     stable_id("alert", did).alias("alert_id"),
                     stable_id("risk-worker", "event_id").alias("worker_decision_id"))


def q2_two_rule_decisions(spark, sf):
    d = Q.score_two_rule(_events(spark, sf), CFG)
    return d.select("decision_id", "event_id", "user_id", "decision", "risk_score",
                    join_reasons("reasons").alias("reason_summary"), F.col("ms").alias("created_at_ms"))


def w1_merchant_burst(spark, sf):
    ev = _events(spark, sf).select("event_id", "merchant_id", "user_id", "ms", "seq")
    ev = W.merchant_burst(ev, CFG.burst_window_ms, bucket_ms=CFG.bucket_ms)
    return ev.select("event_id", "merchant_id", "merchant_users")


def w2_rate_limit(spark, sf):
    ev = _events(spark, sf).select("event_id", "user_id", "request_id", "ms", "seq")
    ev = W.rate_limit(ev, CFG.rate_limit_window_ms, CFG.rate_limit, bucket_ms=CFG.bucket_ms)
    return ev.select("event_id", "user_id", "request_id", "rate_count", "rate_blocked")


def w2_rate_limit_ties(spark, sf):
    """W2 where calls share their ms: at whole six hours."""
    six = 6 * 3_600_000
    ev = _events(spark, sf).select("event_id", "user_id", "request_id", (F.floor(F.col("ms") / six) * six).alias("ms"), "seq")
    ev = W.rate_limit(ev, CFG.rate_limit_window_ms, CFG.rate_limit, bucket_ms=CFG.bucket_ms)
    return ev.select("event_id", "user_id", "request_id", "rate_count", "rate_blocked")


def w3_velocity_7d(spark, sf):
    ev = _events(spark, sf).select("event_id", "user_id", "ms")
    ev = W.velocity(ev, CFG.velocity_window_ms, bucket_ms=CFG.bucket_ms)
    return ev.select("event_id", "user_id", "velocity_7d")


def _decision_out(d):
    return d.select("decision_id", "event_id", "request_id", "user_id", "decision", "risk_score",
                    join_reasons("reasons").alias("reason_summary"), F.col("ms").alias("created_at_ms"))


def q1_decisions(spark, sf):
    return _decision_out(scored(spark, sf).decisions)


def p06_high_risk(spark, sf):
    h = scored(spark, sf).high_risk
    return h.select("high_risk_event_id", "decision_id", "event_id", "user_id", "merchant_id", "risk_score",
                    join_reasons("reasons").alias("reason_summary"), F.col("ms").alias("created_at_ms"))


def p07_alerts(spark, sf):
    a = scored(spark, sf).alerts
    return a.select("alert_id", "decision_id", "event_id", "user_id", "risk_score", "severity",
                    "reason_summary", F.col("ms").alias("created_at_ms"))


QUERIES: dict[str, Query] = {
    "f04_stable_ids": f04_stable_ids,
    "q2_two_rule_decisions": q2_two_rule_decisions,
    "w1_merchant_burst": w1_merchant_burst,
    "w2_rate_limit": w2_rate_limit,
    "w2_rate_limit_ties": w2_rate_limit_ties,
    "w3_velocity_7d": w3_velocity_7d,
    "q1_decisions": q1_decisions,
    "p06_high_risk": p06_high_risk,
    "p07_alerts": p07_alerts,
}


# --- dynamic rules -------------------------------------------------------------
from payguard.operators import alerts as A  # noqa: E402
from payguard.operators import bans as BN  # noqa: E402
from payguard.operators import ingest as ING  # noqa: E402
from payguard.operators import rules as R  # noqa: E402


def _rule_asof(ev, log):
    j = R.apply_rule_log(ev, log, CFG)
    return j.select("event_id", "rule_version_ms", *[F.col(f"rp_{p}").alias(p) for p in R.PARAMS])


def j1_rule_asof(spark, sf):
    return _rule_asof(_events(spark, sf), TD.rule_updates(spark))


def j1_rule_asof_large(spark, sf):
    """J1 with a rule log as long as a tenth of the events."""
    ev = _events(spark, sf)
    return _rule_asof(ev, TD.rule_log_from_events(ev))


def q1_decisions_rules(spark, sf):
    return _decision_out(scored(spark, sf, rules=True).decisions)


# --- bans and admission ----------------------------------------------------------
def _ban_requests(spark, sf):
    ev = _events(spark, sf)
    s = Q.score_events(ev, CFG, profiles=_profiles(ev))
    return ev, TD.ban_requests(s.decisions, ev)


def q5_ban_intervals(spark, sf):
    _, req = _ban_requests(spark, sf)
    b = BN.ban_intervals(req, fold_max_group_rows=CFG.fold_max_group_rows)
    return b.select("request_key", "user_id", "severity", "accepted", "valid_from_ms", "valid_to_ms",
                    "stored_value")


def q5_bans_any_severity(spark, sf):
    """T9 with severities outside 1-5, ties, and a hot user who goes the long way."""
    b = BN.ban_intervals(TD.ban_requests_any_severity(_events(spark, sf)), fold_max_group_rows=300)
    return b.select("request_key", "user_id", "severity", "accepted", "valid_from_ms", "valid_to_ms", "stored_value")


def q5_audit_bans(spark, sf):
    a = BN.audit_bans(scored(spark, sf).decisions, CFG)
    return a.select("decision_id", "user_id", "reason", "severity",
                    F.unix_millis("expires_at").alias("expires_at_ms"),
                    F.unix_millis("created_at").alias("created_at_ms"))


def q3_admission(spark, sf):
    ev, req = _ban_requests(spark, sf)
    bans = BN.ban_intervals(req, fold_max_group_rows=CFG.fold_max_group_rows)
    out = ING.admit(ev, bans, CFG)
    return out.select("event_id", "user_id", "status", "reason", "rate_limit_count")


def q3_admission_raw(spark, sf):
    """Q3 over requests as they arrive: every request has one outcome."""
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    out = ING.admit(TD.raw_requests(_events(spark, sf)), None, CFG, now=now)
    return out.select("event_id", "user_id", "ms", "status", "reason", "rate_limit_count")


# --- alerts ----------------------------------------------------------------------
def _stored_alerts(alerts):
    """The alert topic: alerts are read several times, and scored once."""
    return cut_lineage(alerts, "alerts")


def _alerts_processed(spark, sf):
    deliveries = TD.alert_deliveries(_stored_alerts(scored(spark, sf).alerts))
    return A.process_alerts(deliveries, CFG)


def t10_cooldown(spark, sf):
    a = A.cooldown(scored(spark, sf).alerts, CFG)
    return a.select("alert_id", "user_id", "severity", "allowed", F.col("ms").alias("created_at_ms"))


def q4_alert_log(spark, sf):
    log, _, _ = _alerts_processed(spark, sf)
    return log.select("alert_id", "user_id", "severity", "status",
                      F.array_join("channels_notified", ",").alias("channels"),
                      F.unix_millis("created_at").alias("created_at_ms"))


def q4_outcomes(spark, sf):
    _, out, _ = _alerts_processed(spark, sf)
    return out.select("alert_id", "delivery", "duplicate", "rate_limited",
                      F.array_join("channels", ",").alias("channels"))


def j9_sends(spark, sf):
    _, _, sends = _alerts_processed(spark, sf)
    return sends.select("alert_id", "channel", "position", "message")


def q4_two_batches(spark, sf):
    """Q4 in two halves of the alerts, the log of the first passed on: equals one batch."""
    deliveries = TD.alert_deliveries(_stored_alerts(scored(spark, sf).alerts))
    half = F.lit("2024-01-16 00:00:00").cast("timestamp")
    first, _, _ = A.process_alerts(deliveries.filter(F.col("created_at") < half), CFG)
    log, _, _ = A.process_alerts(deliveries.filter(F.col("created_at") >= half), CFG, alert_log=cut_lineage(first))
    return log.select("alert_id", "user_id", "severity", "status",
                      F.array_join("channels_notified", ",").alias("channels"),
                      F.unix_millis("created_at").alias("created_at_ms"))


def _spread_alerts(spark, sf):
    cfg = CFG.with_(**TD.SEVERITY_SPREAD)
    ev = _events(spark, sf)
    return cfg, Q.score_events(ev, cfg, profiles=_profiles(ev)).alerts


def p07_alert_severities(spark, sf):
    _, a = _spread_alerts(spark, sf)
    return a.select("alert_id", "user_id", "risk_score", "severity", "reason_summary", F.col("ms").alias("created_at_ms"))


def j9_sends_all_severities(spark, sf):
    cfg, a = _spread_alerts(spark, sf)
    _, _, sends = A.process_alerts(TD.alert_deliveries(_stored_alerts(a)), cfg)
    return sends.select("alert_id", "channel", "position", "message")


QUERIES.update({
    "q4_two_batches": q4_two_batches,
    "p07_alert_severities": p07_alert_severities,
    "j9_sends_all_severities": j9_sends_all_severities,
    "q3_admission_raw": q3_admission_raw,
    "q5_bans_any_severity": q5_bans_any_severity,
    "j1_rule_asof_large": j1_rule_asof_large,
    "j1_rule_asof": j1_rule_asof,
    "q1_decisions_rules": q1_decisions_rules,
    "q5_ban_intervals": q5_ban_intervals,
    "q5_audit_bans": q5_audit_bans,
    "q3_admission": q3_admission,
    "t10_cooldown": t10_cooldown,
    "q4_alert_log": q4_alert_log,
    "q4_outcomes": q4_outcomes,
    "j9_sends": j9_sends,
})
