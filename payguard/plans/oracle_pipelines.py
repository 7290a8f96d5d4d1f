"""DuckDB oracle SQL for the composite pipelines: rule versions (J1), bans
(T9), admission (Q3), alert cool-down and processing (T10, Q4, J9).

Recurrences are written as recursive CTEs that walk each key's rows in
order, an independent formulation of the Spark operators.
"""

from __future__ import annotations

import datetime as dt

from payguard.config import DEFAULT_ROUTING
from payguard.config import TESTDATA_CONFIG as CFG
from payguard.operators.rules import LONG_PARAMS, PARAMETER_KEYS, PARAMS
from payguard.plans.oracle import FEATURES, RISK_EVENTS, scored_cte, uuid3
from payguard.sources.testdata import RULE_LOG, SEVERITY_SPREAD


def _ms(s: str) -> int:
    return int(dt.datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp() * 1000)


def _rule_ctes(source: str | None = None) -> str:
    ups = ", ".join(f"('{r}', '{t}', {str(e).upper()}, {_ms(u)}, {o})" for r, t, e, _, u, o in RULE_LOG)
    prm = ", ".join(f"({o}, '{k}', '{v}')" for _, _, _, p, _, o in RULE_LOG for k, v in p.items())
    pmap = ", ".join(f"('{t}', '{k}', '{p}')" for t, k, p in PARAMETER_KEYS)
    fixed = f"""
rule_updates(rule_id, rule_type, enabled, updated_ms, log_offset) AS (VALUES {ups}),
rule_params(log_offset, pkey, pval) AS (VALUES {prm})"""
    cols = []
    for p in PARAMS:
        typ = "BIGINT" if p in LONG_PARAMS else "INTEGER"
        cols.append(f"coalesce(max(CASE WHEN param = '{p}' AND rk = 1 THEN CAST(pval AS {typ}) END), "
                    f"CAST({getattr(CFG, p)} AS {typ})) AS {p}")
    return f"""{source or fixed},
param_map(rule_type, pkey, param) AS (VALUES {pmap}),
ru AS (SELECT *, lead(updated_ms) OVER (PARTITION BY rule_id ORDER BY updated_ms, log_offset) AS next_upd
       FROM rule_updates),
contrib AS (SELECT ru.rule_id, pm.param, rp.pval, ru.updated_ms AS from_ms, ru.next_upd AS to_ms
            FROM ru JOIN rule_params rp ON rp.log_offset = ru.log_offset
                    JOIN param_map pm ON pm.rule_type = lower(ru.rule_type) AND pm.pkey = rp.pkey
            WHERE ru.enabled),
cps AS (SELECT DISTINCT updated_ms AS cp FROM rule_updates),
live AS (SELECT cp, param, pval,
                row_number() OVER (PARTITION BY cp, param ORDER BY from_ms DESC, rule_id DESC) AS rk
         FROM cps JOIN contrib ON from_ms <= cp AND (to_ms IS NULL OR cp < to_ms)),
versions0 AS (SELECT cp AS valid_from_ms, {", ".join(cols)}
              FROM cps LEFT JOIN live USING (cp) GROUP BY cp),
versions AS (SELECT *, lead(valid_from_ms) OVER (ORDER BY valid_from_ms) AS valid_to_ms FROM versions0)"""


def _asof() -> str:
    sel = ", ".join(f"coalesce(v.{p}, {getattr(CFG, p)}) AS p_{p}" for p in PARAMS)
    return f"""
fv AS (SELECT f.*, v.valid_from_ms AS rule_version_ms, {sel}
       FROM features f LEFT JOIN versions v
         ON v.valid_from_ms <= f.ms AND (v.valid_to_ms IS NULL OR f.ms < v.valid_to_ms))"""


#: The rule log that is derived from the events: every tenth is an update.
LOG_FROM_EVENTS = """
raw_log AS (
  SELECT 'rule-' || CAST(user_num % 60 AS VARCHAR) AS rule_id, seq % 7 > 0 AS enabled, ms AS updated_ms, seq AS log_offset,
         ['large_amount', 'merchant_multi_user_burst', 'global', 'high_velocity_7d', 'fraud_ring'][user_num % 5 + 1] AS rule_type,
         amount_cents
  FROM risk_events WHERE seq % 10 = 0),
bad_log AS (SELECT log_offset FROM raw_log WHERE log_offset % 110 = 0 AND rule_type = 'large_amount' AND enabled),
rule_updates AS (SELECT * FROM raw_log WHERE log_offset NOT IN (FROM bad_log)),
rule_params AS (
  SELECT log_offset, 'amount_cents' AS pkey, CAST(5000 + amount_cents % 20000 AS VARCHAR) AS pval FROM rule_updates WHERE rule_type = 'large_amount'
  UNION ALL SELECT log_offset, 'score_delta', CAST(log_offset % 90 AS VARCHAR) FROM rule_updates WHERE rule_type = 'large_amount' AND log_offset % 20 = 0
  UNION ALL SELECT log_offset, 'burst_threshold', CAST(5 + log_offset % 9 AS VARCHAR) FROM rule_updates WHERE rule_type = 'merchant_multi_user_burst'
  UNION ALL SELECT log_offset, 'review_threshold', CAST(40 + log_offset % 30 AS VARCHAR) FROM rule_updates WHERE rule_type = 'global'
  UNION ALL SELECT log_offset, 'velocity_threshold', CAST(10 + log_offset % 20 AS VARCHAR) FROM rule_updates WHERE rule_type = 'high_velocity_7d')"""

J1_LARGE = ("WITH " + RISK_EVENTS + "," + FEATURES + "," + _rule_ctes(LOG_FROM_EVENTS) + "," + _asof() + "\nSELECT event_id, "
            "rule_version_ms, " + ", ".join(f"p_{p} AS {p}" for p in PARAMS) + " FROM fv")

J1_RULE_ASOF = ("WITH " + RISK_EVENTS + "," + FEATURES + "," + _rule_ctes() + "," + _asof() + "\nSELECT event_id, "
                "rule_version_ms, " + ", ".join(f"p_{p} AS {p}" for p in PARAMS) + " FROM fv")

Q1_DECISIONS_RULES = ("WITH " + RISK_EVENTS + "," + FEATURES + "," + _rule_ctes() + "," + _asof() + ","
                      + scored_cte({p: f"p_{p}" for p in PARAMS}, source="fv") + """
SELECT decision_id, event_id, request_id, user_id, decision, risk_score, reason_summary, ms AS created_at_ms
FROM scored""")

_BANS = f"""
requests AS (
  SELECT user_id, 'ASYNC_RULE:' || decision_id AS reason, 3 AS severity, 86400000 AS ttl_ms, ms, seq,
         decision_id AS request_key
  FROM scored WHERE decision = 'BLOCK'
  UNION ALL
  SELECT user_id, 'ERROR_SPIKE', 4, 3600000, ms, seq, event_id
  FROM risk_events WHERE event_type = 'WITHDRAWAL' AND amount_cents > 20000),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, seq, request_key) AS rn FROM requests),
walk AS (
  SELECT user_id, rn, request_key, ms, severity, TRUE AS accepted, ms + ttl_ms AS cur_exp, severity AS cur_sev
  FROM q WHERE rn = 1
  UNION ALL
  SELECT q.user_id, q.rn, q.request_key, q.ms, q.severity,
         (q.ms >= w.cur_exp OR q.severity > w.cur_sev),
         CASE WHEN q.ms >= w.cur_exp OR q.severity > w.cur_sev THEN q.ms + q.ttl_ms ELSE w.cur_exp END,
         CASE WHEN q.ms >= w.cur_exp OR q.severity > w.cur_sev THEN q.severity ELSE w.cur_sev END
  FROM walk w JOIN q ON q.user_id = w.user_id AND q.rn = w.rn + 1),
acc AS (SELECT q.*, lead(q.ms) OVER (PARTITION BY q.user_id ORDER BY q.ms, q.seq, q.request_key) AS next_ms
        FROM q JOIN walk w USING (user_id, rn) WHERE w.accepted),
bans AS (
  SELECT q.request_key, q.user_id, q.severity, coalesce(w.accepted, FALSE) AS accepted,
         CASE WHEN w.accepted THEN q.ms END AS valid_from_ms,
         CASE WHEN w.accepted THEN least(q.ms + q.ttl_ms, coalesce(a.next_ms, q.ms + q.ttl_ms)) END AS valid_to_ms,
         CASE WHEN w.accepted THEN q.reason || ':' || CAST(q.severity AS VARCHAR) END AS stored_value,
         q.reason
  FROM q JOIN walk w USING (user_id, rn) LEFT JOIN acc a ON a.request_key = q.request_key)"""

Q5_BAN_INTERVALS = ("WITH RECURSIVE " + RISK_EVENTS + "," + FEATURES + "," + scored_cte() + "," + _BANS + """
SELECT request_key, user_id, severity, accepted, valid_from_ms, valid_to_ms, stored_value FROM bans""")

_WALK = _BANS[_BANS.index("q AS (SELECT"):]
Q5_ANY_SEVERITY = "WITH RECURSIVE " + RISK_EVENTS + """,
requests AS (
  SELECT CASE WHEN user_num % 3 = 0 THEN 'user-hot' ELSE user_id END AS user_id, 'R' AS reason,
         CAST(seq % 11 - 2 AS INTEGER) AS severity, CASE seq % 4 WHEN 0 THEN 1000 WHEN 1 THEN 3600000 WHEN 2 THEN 86400000 ELSE 600000 END AS ttl_ms,
         ms // 60000 * 60000 AS ms, seq, event_id AS request_key
  FROM risk_events WHERE seq % 3 = 0),""" + _WALK + """
SELECT request_key, user_id, severity, accepted, valid_from_ms, valid_to_ms, stored_value FROM bans"""

Q5_AUDIT_BANS = ("WITH " + RISK_EVENTS + "," + FEATURES + "," + scored_cte() + f"""
SELECT decision_id, user_id, 'ASYNC_RULE:' || decision_id AS reason, {CFG.ban_severity} AS severity,
       ms + {CFG.ban_ttl_seconds * 1000} AS expires_at_ms, ms AS created_at_ms
FROM scored WHERE decision = 'BLOCK'""")

Q3_ADMISSION = ("WITH RECURSIVE " + RISK_EVENTS + "," + FEATURES + "," + scored_cte() + "," + _BANS + f""",
held AS (
  SELECT q.user_id, q.ms, arg_max(q.reason, q.rn) AS reason, arg_max(q.ms + q.ttl_ms, q.rn) AS expires
  FROM q JOIN walk w USING (user_id, rn) WHERE w.accepted GROUP BY q.user_id, q.ms),
gate AS (
  SELECT e.*, CASE WHEN h.expires > e.ms THEN h.reason END AS ban_reason
  FROM risk_events e ASOF LEFT JOIN held h ON e.user_id = h.user_id AND e.ms > h.ms),
limited AS (
  SELECT e.event_id, e.user_id, e.ms, count(DISTINCT p.request_id) AS cnt
  FROM gate e JOIN gate p ON p.ban_reason IS NULL AND p.user_id = e.user_id AND p.ms > e.ms - {CFG.rate_limit_window_ms}
       AND (p.ms < e.ms OR p.ms = e.ms AND p.seq <= e.seq)
  WHERE e.ban_reason IS NULL GROUP BY e.event_id, e.user_id, e.ms)
SELECT event_id, user_id, CASE WHEN cnt > {CFG.rate_limit} THEN 'BLOCKED' ELSE 'ACCEPTED' END AS status,
       CASE WHEN cnt > {CFG.rate_limit} THEN 'rate_limit' ELSE 'passed_fast_path' END AS reason,
       CAST(cnt AS BIGINT) AS rate_limit_count
FROM limited
UNION ALL
SELECT event_id, user_id, 'BLOCKED', 'blacklist:' || ban_reason, CAST(0 AS BIGINT) FROM gate
WHERE ban_reason IS NOT NULL""")

Q3_RAW = "WITH " + RISK_EVENTS + f""",
raw AS (
  SELECT event_id, seq, request_id, CASE WHEN seq % 13 = 0 THEN '  ' ELSE user_id END AS user_id,
         CASE WHEN seq % 11 = 0 THEN 'REFUND' WHEN seq % 37 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN seq % 17 = 0 THEN -5 WHEN seq % 41 = 0 THEN NULL ELSE amount_cents END AS amount_cents,
         seq % 29 = 0 AS no_currency, seq % 31 = 0 AS no_source,
         CASE WHEN seq % 23 = 0 THEN epoch_ms(TIMESTAMP '2024-03-01 00:00:00') ELSE ms END AS ms
  FROM risk_events),
checked AS (
  SELECT *, list_filter([
    CASE WHEN trim(user_id) = '' THEN 'user_id:blank' END, CASE WHEN event_type IS NULL THEN 'event_type:blank' END,
    CASE WHEN no_currency THEN 'currency:blank' END, CASE WHEN no_source THEN 'source:blank' END,
    CASE WHEN amount_cents IS NULL OR amount_cents < 0 THEN 'amount_cents:min_0' END,
    CASE WHEN event_type = 'REFUND' THEN 'event_type:unsupported' END], lambda x: x IS NOT NULL) AS v FROM raw),
counted AS (
  SELECT e.event_id, count(DISTINCT p.request_id) AS cnt
  FROM checked e JOIN checked p ON len(p.v) = 0 AND p.user_id = e.user_id AND p.ms > e.ms - {CFG.rate_limit_window_ms}
       AND (p.ms < e.ms OR p.ms = e.ms AND p.seq <= e.seq)
  WHERE len(e.v) = 0 GROUP BY e.event_id)
SELECT event_id, user_id, ms, CASE WHEN len(v) > 0 THEN 'REJECTED' WHEN cnt > {CFG.rate_limit} THEN 'BLOCKED' ELSE 'ACCEPTED' END AS status,
       CASE WHEN len(v) > 0 THEN array_to_string(v, ',') WHEN cnt > {CFG.rate_limit} THEN 'rate_limit' ELSE 'passed_fast_path' END AS reason,
       CAST(coalesce(cnt, 0) AS BIGINT) AS rate_limit_count
FROM checked LEFT JOIN counted USING (event_id)"""

def _alerts(threshold: int, only: str = "TRUE") -> str:
    return f"""
alerts AS (
  SELECT {uuid3("'alert:' || decision_id")} AS alert_id, user_id, risk_score,
         CASE WHEN risk_score >= 95 THEN 'CRITICAL' WHEN risk_score >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         reason_summary, ms, seq
  FROM scored WHERE risk_score >= {threshold} AND {only}),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, upper(severity) ORDER BY ms, seq) AS rn FROM alerts),
cool AS (
  SELECT user_id, severity, rn, alert_id, ms, TRUE AS allowed, ms AS last_ms FROM a WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.severity, a.rn, a.alert_id, a.ms, a.ms - c.last_ms >= {CFG.alert_cooldown_ms},
         CASE WHEN a.ms - c.last_ms >= {CFG.alert_cooldown_ms} THEN a.ms ELSE c.last_ms END
  FROM cool c JOIN a ON a.user_id = c.user_id AND upper(a.severity) = upper(c.severity) AND a.rn = c.rn + 1),
routing(severity, channel, position) AS (VALUES {", ".join(
    f"('{s}', '{c}', {i})" for s, chans in DEFAULT_ROUTING for i, c in enumerate(chans))}),
chans AS (SELECT severity, string_agg(channel, ',' ORDER BY position) AS channels FROM routing GROUP BY severity),
log AS (
  SELECT a.alert_id, a.user_id, a.severity, a.risk_score, a.reason_summary, a.ms, a.seq, c.allowed,
         CASE WHEN c.allowed THEN 'PROCESSED' ELSE 'RATE_LIMITED' END AS status,
         CASE WHEN c.allowed THEN coalesce(ch.channels, '') ELSE '' END AS channels
  FROM a JOIN cool c USING (alert_id) LEFT JOIN chans ch ON ch.severity = upper(a.severity)),
deliveries AS (
  SELECT alert_id, 0 AS delivery FROM alerts
  UNION ALL SELECT alert_id, 1 FROM alerts WHERE seq % 10 = 0)"""

_ALERT_HEAD = "WITH RECURSIVE " + RISK_EVENTS + "," + FEATURES + "," + scored_cte() + "," + _alerts(CFG.alert_threshold)

#: Scores and threshold under which alerts of every severity occur.
SPREAD_SCORED = ("WITH RECURSIVE " + RISK_EVENTS + "," + FEATURES + ","
                 + scored_cte({k: str(v) for k, v in SEVERITY_SPREAD.items() if k != "alert_threshold"}))
_SPREAD_HEAD = SPREAD_SCORED + "," + _alerts(SEVERITY_SPREAD["alert_threshold"])

#: Of those the ones whose records can be decoded.
DECODED_HEAD = SPREAD_SCORED + "," + _alerts(SEVERITY_SPREAD["alert_threshold"], "seq % 7 <> 0")
DECODED_LOG = DECODED_HEAD + "\nSELECT alert_id, user_id, severity, status, channels, ms AS created_at_ms FROM log"
DECODED_OUTCOMES = DECODED_HEAD + """
SELECT alert_id, FALSE AS again, FALSE AS duplicate, NOT allowed AS rate_limited FROM log
UNION ALL SELECT alert_id, TRUE, TRUE, FALSE FROM log WHERE seq % 10 = 0"""

T10_COOLDOWN = _ALERT_HEAD + "\nSELECT alert_id, user_id, severity, allowed, ms AS created_at_ms FROM cool"

Q4_ALERT_LOG = _ALERT_HEAD + "\nSELECT alert_id, user_id, severity, status, channels, ms AS created_at_ms FROM log"

Q4_OUTCOMES = _ALERT_HEAD + """
SELECT d.alert_id, d.delivery, d.delivery <> 0 AS duplicate, (d.delivery = 0 AND NOT l.allowed) AS rate_limited,
       l.channels
FROM deliveries d JOIN log l USING (alert_id)"""

_SENDS = """
SELECT l.alert_id, r.channel, r.position,
       CASE r.channel
         WHEN 'email' THEN 'Risk ' || l.severity || ' alert for ' || l.user_id || chr(10) || chr(10)
              || 'alertId=' || l.alert_id || chr(10) || 'userId=' || l.user_id || chr(10) || 'severity='
              || l.severity || chr(10) || 'riskScore=' || CAST(l.risk_score AS VARCHAR) || chr(10)
              || 'reasonSummary=' || l.reason_summary || chr(10) || 'source=flink-risk-engine'
         WHEN 'push' THEN 'Risk ' || l.severity || ' alert' || chr(10) || 'userId=' || l.user_id || chr(10)
              || 'reasonSummary=' || l.reason_summary || chr(10) || 'alertId=' || l.alert_id
         ELSE 'sms ' || l.alert_id END AS message
FROM log l JOIN routing r ON r.severity = upper(l.severity)
WHERE l.allowed"""

J9_SENDS = _ALERT_HEAD + _SENDS
J9_SENDS_SPREAD = _SPREAD_HEAD + _SENDS
DECODED_SENDS = DECODED_HEAD + _SENDS
P07_SPREAD = _SPREAD_HEAD + """
SELECT alert_id, user_id, risk_score, severity, reason_summary, ms AS created_at_ms FROM alerts"""


def all_sql() -> dict[str, str]:
    return {
        "j1_rule_asof": J1_RULE_ASOF,
        "q1_decisions_rules": Q1_DECISIONS_RULES,
        "q5_ban_intervals": Q5_BAN_INTERVALS,
        "q5_audit_bans": Q5_AUDIT_BANS,
        "q3_admission": Q3_ADMISSION,
        "t10_cooldown": T10_COOLDOWN,
        "q4_alert_log": Q4_ALERT_LOG,
        "q4_outcomes": Q4_OUTCOMES,
        "j9_sends": J9_SENDS,
        "j9_sends_all_severities": J9_SENDS_SPREAD,
        "p07_alert_severities": P07_SPREAD,
        "q4_two_batches": Q4_ALERT_LOG,
        "q5_bans_any_severity": Q5_ANY_SEVERITY,
        "q3_admission_raw": Q3_RAW,
        "j1_rule_asof_large": J1_LARGE,
    }
