"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: window frames use DuckDB's native
``count(DISTINCT ...) OVER (... RANGE ...)`` and recurrences use recursive
CTEs. Every query starts from the pre-registered ``events`` view through the
same deterministic binding as ``payguard.sources.testdata.risk_events``.
"""

from __future__ import annotations

from payguard.config import TESTDATA_CONFIG as CFG


def uuid3(expr: str) -> str:
    h = f"md5({expr})"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||"
            f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h},17,1)), 1)||"
            f"substr({h},18,3)||'-'||substr({h},21,12))")


RISK_EVENTS = """
risk_events AS (
  SELECT 'evt-' || CAST(event_id AS VARCHAR) AS event_id,
         event_id AS seq,
         epoch_us(ts) // 1000 AS ms,
         'req-' || CAST(user_id AS VARCHAR) || '-' || CAST((epoch_us(ts) // 1000) // 3600000 AS VARCHAR) AS request_id,
         'user-' || CAST(user_id AS VARCHAR) AS user_id,
         user_id AS user_num,
         CASE event_type WHEN 'purchase' THEN 'TRANSACTION' WHEN 'signup' THEN 'LOGIN'
              WHEN 'error' THEN 'WITHDRAWAL' WHEN 'click' THEN 'BEHAVIOUR' WHEN 'view' THEN 'TRANSFER'
              ELSE upper(event_type) END AS event_type,
         CAST(round(value * 100) AS BIGINT) AS amount_cents,
         CASE WHEN event_id % 5 > 0 THEN '10.' || CAST(user_id % 200 AS VARCHAR) || '.0.' || CAST(event_id % 250 AS VARCHAR) END AS ip_address,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'dev-' || CAST(user_id % 50 AS VARCHAR) END AS device_fp,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
              ELSE 'm-' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 AS VARCHAR) END AS merchant_id
  FROM events)"""

FEATURES = f"""
features AS (
  SELECT e.*,
         CASE WHEN merchant_id IS NULL THEN 0 ELSE count(DISTINCT user_id) OVER (
           PARTITION BY merchant_id ORDER BY ms RANGE BETWEEN {CFG.burst_window_ms} PRECEDING AND CURRENT ROW) END
           AS merchant_users,
         count(*) OVER (PARTITION BY user_id ORDER BY ms
           RANGE BETWEEN {CFG.velocity_window_ms} PRECEDING AND CURRENT ROW) AS velocity_7d,
         (user_num % 37 = 0) AS blacklisted
  FROM risk_events e)"""


def scored_cte(params: dict[str, str] | None = None, source: str = "features") -> str:
    p = {k: str(getattr(CFG, k)) for k in (
        "large_amount_cents", "large_amount_score", "withdrawal_score", "burst_threshold",
        "burst_score", "velocity_threshold", "velocity_score", "review_threshold", "block_threshold")}
    p.update(params or {})
    hits = [
        ("blacklisted", "blacklisted_user", str(CFG.blacklist_score)),
        (f"velocity_7d >= {p['velocity_threshold']}", "high_velocity_7d", p["velocity_score"]),
        (f"amount_cents >= {p['large_amount_cents']}", "large_amount", p["large_amount_score"]),
        ("event_type = 'WITHDRAWAL' AND device_fp IS NULL", "withdrawal_without_device", p["withdrawal_score"]),
        (f"merchant_id IS NOT NULL AND merchant_users >= {p['burst_threshold']}", "merchant_multi_user_burst",
         p["burst_score"]),
    ]
    raw = " + ".join(f"(CASE WHEN {c} THEN {d} ELSE 0 END)" for c, _, d in hits)
    reasons = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r, _ in hits)
    return f"""
raw AS (
  SELECT *, CAST({raw} AS INTEGER) AS raw_score, concat_ws(',', {reasons}) AS reason_summary
  FROM {source}),
scored AS (
  SELECT *, CAST(least(raw_score, 100) AS INTEGER) AS risk_score,
         CASE WHEN raw_score >= {p['block_threshold']} THEN 'BLOCK'
              WHEN raw_score >= {p['review_threshold']} THEN 'REVIEW' ELSE 'ALLOW' END AS decision,
         {uuid3("'flink-risk-engine:' || event_id")} AS decision_id
  FROM raw)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


Q2_TWO_RULE = with_(RISK_EVENTS) + f"""
SELECT {uuid3("'risk-worker:' || event_id")} AS decision_id, event_id, user_id,
       CASE WHEN (CASE WHEN amount_cents >= {CFG.worker_large_amount_cents} THEN 80 ELSE 0 END
                 + CASE WHEN event_type = 'WITHDRAWAL' AND device_fp IS NULL THEN 30 ELSE 0 END) >= 80
            THEN 'BLOCK' ELSE 'ALLOW' END AS decision,
       CAST(least(CASE WHEN amount_cents >= {CFG.worker_large_amount_cents} THEN 80 ELSE 0 END
                 + CASE WHEN event_type = 'WITHDRAWAL' AND device_fp IS NULL THEN 30 ELSE 0 END, 100) AS INTEGER)
         AS risk_score,
       coalesce(nullif(concat_ws(',',
         CASE WHEN amount_cents >= {CFG.worker_large_amount_cents} THEN 'large_amount' END,
         CASE WHEN event_type = 'WITHDRAWAL' AND device_fp IS NULL THEN 'withdrawal_without_device' END), ''),
         'no_async_rule_hit') AS reason_summary,
       ms AS created_at_ms
FROM risk_events"""

F04_IDS = with_(RISK_EVENTS) + f"""
SELECT event_id, {uuid3("'flink-risk-engine:' || event_id")} AS decision_id,
       {uuid3("'high-risk:' || " + uuid3("'flink-risk-engine:' || event_id"))} AS high_risk_event_id,
       {uuid3("'alert:' || " + uuid3("'flink-risk-engine:' || event_id"))} AS alert_id,
       {uuid3("'risk-worker:' || event_id")} AS worker_decision_id
FROM risk_events"""

W1_BURST = with_(RISK_EVENTS) + f"""
SELECT event_id, merchant_id,
       CAST(CASE WHEN merchant_id IS NULL THEN 0 ELSE count(DISTINCT user_id) OVER (
         PARTITION BY merchant_id ORDER BY ms
         RANGE BETWEEN {CFG.burst_window_ms} PRECEDING AND CURRENT ROW) END AS BIGINT) AS merchant_users
FROM risk_events"""

W3_VELOCITY = with_(RISK_EVENTS) + f"""
SELECT event_id, user_id,
       CAST(count(*) OVER (PARTITION BY user_id ORDER BY ms
         RANGE BETWEEN {CFG.velocity_window_ms} PRECEDING AND CURRENT ROW) AS BIGINT) AS velocity_7d
FROM risk_events"""

def rate_sql(calls: str) -> str:
    """Every call against the user's calls of the window that came before it (or itself)."""
    return f"""
SELECT e.event_id, e.user_id, e.request_id, count(DISTINCT p.request_id) AS rate_count,
       count(DISTINCT p.request_id) > {CFG.rate_limit} AS rate_blocked
FROM {calls} e JOIN {calls} p ON p.user_id = e.user_id AND p.ms > e.ms - {CFG.rate_limit_window_ms}
     AND (p.ms < e.ms OR p.ms = e.ms AND p.seq <= e.seq)
GROUP BY e.event_id, e.user_id, e.request_id"""


W2_RATE = with_(RISK_EVENTS) + rate_sql("risk_events")

W2_RATE_TIES = with_(RISK_EVENTS, """
calls AS (SELECT * REPLACE (ms // 21600000 * 21600000 AS ms) FROM risk_events)""") + rate_sql("calls")

Q1_DECISIONS = with_(RISK_EVENTS, FEATURES, scored_cte()) + """
SELECT decision_id, event_id, request_id, user_id, decision, risk_score, reason_summary,
       ms AS created_at_ms
FROM scored"""

P06_HIGH_RISK = with_(RISK_EVENTS, FEATURES, scored_cte()) + f"""
SELECT {uuid3("'high-risk:' || decision_id")} AS high_risk_event_id, decision_id, event_id, user_id,
       merchant_id, risk_score, reason_summary, ms AS created_at_ms
FROM scored WHERE risk_score >= {CFG.high_risk_threshold}"""

P07_ALERTS = with_(RISK_EVENTS, FEATURES, scored_cte()) + f"""
SELECT {uuid3("'alert:' || decision_id")} AS alert_id, decision_id, event_id, user_id, risk_score,
       CASE WHEN risk_score >= 95 THEN 'CRITICAL' WHEN risk_score >= 90 THEN 'HIGH' ELSE 'MEDIUM' END
         AS severity,
       reason_summary, ms AS created_at_ms
FROM scored WHERE risk_score >= {CFG.alert_threshold}"""

def all_sql() -> dict[str, str]:
    return {
        "f04_stable_ids": F04_IDS,
        "q2_two_rule_decisions": Q2_TWO_RULE,
        "w1_merchant_burst": W1_BURST,
        "w2_rate_limit": W2_RATE,
        "w2_rate_limit_ties": W2_RATE_TIES,
        "w3_velocity_7d": W3_VELOCITY,
        "q1_decisions": Q1_DECISIONS,
        "p06_high_risk": P06_HIGH_RISK,
        "p07_alerts": P07_ALERTS,
    }
