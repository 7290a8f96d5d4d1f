"""DuckDB oracle SQL for the DLQ, archive, health and documented-extra
queries."""

from __future__ import annotations

from payguard.config import TESTDATA_CONFIG as CFG
from payguard.plans.oracle import FEATURES, RISK_EVENTS, scored_cte, uuid3
from payguard.plans.oracle_pipelines import SPREAD_SCORED, _ALERT_HEAD, _BANS
from payguard.sources.testdata import SEVERITY_SPREAD

DAY, HOUR = 86_400_000, 3_600_000
BASE = "WITH " + RISK_EVENTS + "," + FEATURES + "," + scored_cte()

_ISO = ("CASE WHEN ms % 1000 = 0 THEN strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') "
        "ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END")

def _dlq(threshold: int) -> str:
    return f""",
alert_rows AS (SELECT {uuid3("'alert:' || decision_id")} AS alert_id, user_id, ms, seq,
                      CASE WHEN risk_score >= 95 THEN 'CRITICAL' WHEN risk_score >= 90 THEN 'HIGH' ELSE 'MEDIUM' END AS sev
               FROM scored WHERE risk_score >= {threshold}),
dlq AS (
  SELECT 'alert-events-dlq' AS topic,
         CAST((strpos('0123456789abcdef', substr(md5(user_id), 32, 1)) - 1) % 4 AS INTEGER) AS partition,
         seq AS "offset", user_id AS key, 'alert-events' AS original_topic, {_ISO} AS failed_at,
         CASE WHEN seq % 2 = 0 THEN '1' ELSE '{CFG.alert_max_retries + 1}' END AS retry_count,
         CASE WHEN seq % 3 = 2 THEN sev ELSE 'unknown' END AS severity,
         'payload could not be decoded as an alert' AS exception_message,
         CAST(CASE seq % 3 WHEN 0 THEN 30 + seq % 8 WHEN 1 THEN 3
              ELSE length('{{"severity":"' || sev || '","user_id":"' || user_id || '"}}') END AS INTEGER) AS value_bytes, ms, CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS extra_headers
  FROM alert_rows WHERE seq % 7 = 0)"""


_DLQ = _dlq(CFG.alert_threshold)

S11_STREAM = SPREAD_SCORED + _dlq(SEVERITY_SPREAD["alert_threshold"]) + """,
twice AS (SELECT *, CAST(0 AS BIGINT) AS later FROM dlq UNION ALL SELECT *, 1000000000000 FROM dlq WHERE "offset" % 10 = 0)
SELECT partition, "offset" + later AS "offset", key, severity, CAST(5 + extra_headers AS BIGINT) AS headers,
       CAST(value_bytes AS BIGINT) AS value_bytes FROM twice"""

S11_DLQ = BASE + _DLQ + """
SELECT topic, partition, "offset", key, original_topic, failed_at, retry_count, severity, exception_message,
       value_bytes FROM dlq"""

Q6_ALL = BASE + _DLQ + """
SELECT topic, partition, "offset", original_topic, failed_at, severity, retry_count,
       CAST(octet_length(encode(key)) AS INTEGER) AS key_bytes, value_bytes, 'ops' AS replayed_by,
       CAST(extra_headers + 7 AS INTEGER) AS header_count
FROM dlq
WHERE original_topic = 'alert-events' AND lower(severity) = 'unknown'
  AND ms >= epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND ms <= epoch_ms(TIMESTAMP '2024-01-25 00:00:00')"""
Q6_REPLAY = Q6_ALL + """
ORDER BY partition, "offset" LIMIT 100"""

Q7_ARCHIVE = "WITH " + RISK_EVENTS + f"""
SELECT event_id, user_id, ms FROM risk_events WHERE ms // {DAY} - 19723 >= 14"""

A04_MIX = BASE + f"""
SELECT (ms // {DAY}) * {DAY} AS window_start_ms, decision, count(*) AS decisions FROM scored GROUP BY ALL"""

A05_STATUS = _ALERT_HEAD + """
SELECT (ms // 300000) * 300000 AS window_start_ms, severity, status, count(*) AS alerts,
       round(count(*) / 300.0, 6) AS per_second
FROM log GROUP BY ALL"""

A06_SENDS = _ALERT_HEAD + """
SELECT r.channel, count(*) AS sends FROM log l JOIN routing r ON r.severity = upper(l.severity)
WHERE l.allowed GROUP BY ALL"""

A06_DLQ = BASE + _DLQ + "\nSELECT severity, count(*) AS dlq_records FROM dlq GROUP BY ALL"

_ADMISSION = "WITH RECURSIVE " + RISK_EVENTS + "," + FEATURES + "," + scored_cte() + "," + _BANS + f""",
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
  WHERE e.ban_reason IS NULL GROUP BY e.event_id, e.user_id, e.ms),
admission AS (
  SELECT event_id, user_id, ms, CASE WHEN cnt > {CFG.rate_limit} THEN 'BLOCKED' ELSE 'ACCEPTED' END AS status,
         CASE WHEN cnt > {CFG.rate_limit} THEN 'rate_limit' ELSE 'passed_fast_path' END AS reason
  FROM limited
  UNION ALL
  SELECT event_id, user_id, ms, 'BLOCKED', 'blacklist:' || ban_reason FROM gate WHERE ban_reason IS NOT NULL)"""

A07_OUTCOMES = _ADMISSION + f"""
SELECT (ms // {HOUR}) * {HOUR} AS window_start_ms, status,
       CASE WHEN starts_with(reason, 'blacklist:') THEN 'blacklist' ELSE reason END AS reason_class,
       count(*) AS requests
FROM admission GROUP BY ALL"""

A08_RATIO = _ADMISSION + f""",
w AS (SELECT (ms // {HOUR}) * {HOUR} AS window_start_ms, count(*) AS total,
             sum(CASE WHEN status = 'BLOCKED' THEN 1 ELSE 0 END) AS bad
      FROM admission GROUP BY 1),
r AS (SELECT window_start_ms, total, CAST(bad AS BIGINT) AS bad,
             round(bad / greatest(CAST(total AS DOUBLE), 0.001), 6) AS ratio FROM w)
SELECT a.window_start_ms, a.total, a.bad, a.ratio, a.ratio > 0.05 AS breached,
       a.ratio > 0.05 AND coalesce(p.ratio > 0.05, FALSE) AS firing
FROM r a LEFT JOIN r p ON p.window_start_ms = a.window_start_ms - {HOUR}"""

A09_LAG = "WITH " + RISK_EVENTS + """,
p AS (SELECT CAST((strpos('0123456789abcdef', substr(md5(user_id), 32, 1)) - 1) % 8 AS INTEGER) AS partition, ms
      FROM risk_events),
n AS (SELECT partition, max(ms) AS newest FROM p GROUP BY 1),
o AS (SELECT p.partition, count(*) AS latest, sum(CASE WHEN p.ms <= n.newest - 3600000 THEN 1 ELSE 0 END) AS committed
      FROM p JOIN n USING (partition) GROUP BY 1)
SELECT CAST(coalesce(sum(greatest(latest - committed, 0)), 0) AS BIGINT) AS lag, count(*) AS partitions
FROM o WHERE partition <> 3"""

A10_THROUGHPUT = "WITH " + RISK_EVENTS + """
SELECT (ms // 60000) * 60000 AS window_start_ms, count(*) AS records, round(count(*) / 60.0, 6) AS per_second
FROM risk_events GROUP BY 1"""

A11_PCT = "WITH " + RISK_EVENTS + """
SELECT event_type, round(quantile_cont(amount_cents, 0.5), 6) AS p50, round(quantile_cont(amount_cents, 0.95), 6) AS p95,
       round(quantile_cont(amount_cents, 0.99), 6) AS p99
FROM risk_events GROUP BY 1"""

A13_GAPS = "WITH " + RISK_EVENTS + f""",
n AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, seq) AS next_ms FROM risk_events)
SELECT user_id, ms AS silent_from_ms, next_ms AS silent_to_ms, next_ms - ms AS gap_ms
FROM n WHERE next_ms - ms > {2 * DAY}"""

def _d1(within: int, least: int) -> str:
    return "WITH " + RISK_EVENTS + f""",
o AS (SELECT *, max(CASE WHEN event_type = 'LOGIN' THEN ms END) OVER (
        PARTITION BY user_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_login
      FROM risk_events),
b AS (SELECT *, last_value(CASE WHEN event_type = 'BEHAVIOUR' THEN {{'ms': ms, 'lf': last_login}} END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb
      FROM o)
SELECT event_id, user_id, ms, sb.ms AS second_ms, sb.lf AS first_ms FROM b
WHERE event_type = 'WITHDRAWAL' AND amount_cents >= {least} AND sb.lf >= ms - {within}"""


D1_SEQ = _d1(6 * HOUR, CFG.large_amount_cents)
D1_WIDE = _d1(7 * DAY, 0)

A13_COUNTER = "WITH " + RISK_EVENTS + f""",
c AS (SELECT merchant_id, ms, count(*) OVER (PARTITION BY merchant_id ORDER BY ms) AS value FROM risk_events WHERE merchant_id IS NOT NULL)
SELECT merchant_id, (ms // {DAY}) * {DAY} AS window_start_ms, max(value) - min(value) AS increase, max(value) > min(value) AS alert
FROM c GROUP BY ALL"""

A13_INCREASE = "WITH " + RISK_EVENTS + f""",
c AS (SELECT merchant_id, ms, seq, count(*) OVER (PARTITION BY merchant_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) % 50 AS value
      FROM risk_events WHERE merchant_id IS NOT NULL),
g AS (SELECT *, lag(value) OVER (PARTITION BY merchant_id ORDER BY ms, seq) AS last FROM c),
d AS (SELECT *, CASE WHEN last IS NULL THEN 0 WHEN value < last THEN value ELSE value - last END AS gain FROM g),
i AS (SELECT merchant_id, ms, CAST(sum(gain) OVER w - first_value(gain) OVER w AS BIGINT) AS increase
      FROM d WINDOW w AS (PARTITION BY merchant_id ORDER BY ms RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW))
SELECT merchant_id, ms, increase, increase > 3 AS alert FROM i"""

A13_ABSENT = "WITH " + RISK_EVENTS + f""",
now AS (SELECT max(ms) AS now_ms FROM risk_events)
SELECT user_id, max(ms) AS silent_from_ms, now_ms - max(ms) AS gap_ms FROM risk_events, now GROUP BY user_id, now_ms HAVING now_ms - max(ms) > {2 * DAY}
UNION ALL SELECT 'never-' || event_id, NULL, NULL FROM risk_events WHERE seq % 100 = 0"""

D8_LADDER = "WITH " + RISK_EVENTS + """
SELECT event_id, seq % 7 AS severity, CASE seq % 7 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 WHEN 5 THEN 0 END AS ttl_seconds
FROM risk_events"""

F10_VELOCITY = "WITH " + RISK_EVENTS + """
SELECT event_id, user_num % 37 = 0 AS blacklisted,
       CASE user_num % 5 WHEN 0 THEN 0 WHEN 1 THEN user_num % 40 WHEN 2 THEN 0 WHEN 3 THEN -7 ELSE 0 END AS velocity_7d
FROM risk_events"""

D2_DAILY = BASE + f"""
SELECT user_id, (ms // {DAY}) * {DAY} AS window_start_ms, max(risk_score) AS max_score,
       round(avg(risk_score), 6) AS avg_score, count(*) AS decisions
FROM scored GROUP BY ALL"""

D3_PROFILE = BASE + f""",
last AS (SELECT user_id, max(ms) AS last_seen_ms, arg_max_null(ip_address, (ms, seq)) AS last_ip,
                count(DISTINCT device_fp) AS device_count FROM risk_events GROUP BY 1),
txn AS (SELECT e.user_id, count(*) AS txn_30d FROM risk_events e JOIN last l USING (user_id)
        WHERE e.event_type = 'TRANSACTION' AND e.ms > l.last_seen_ms - {30 * DAY} GROUP BY 1),
sc AS (SELECT user_id, arg_max(risk_score, ms) AS risk_score FROM scored GROUP BY 1)
SELECT l.user_id, l.last_seen_ms, l.last_ip, l.device_count, CAST(coalesce(t.txn_30d, 0) AS BIGINT) AS txn_30d,
       s.risk_score
FROM last l LEFT JOIN txn t USING (user_id) LEFT JOIN sc s USING (user_id)"""

D4_RECONCILE = BASE + f""",
now AS (SELECT max(ms) AS now_ms FROM risk_events)
SELECT decision_id, user_id, (ms + {CFG.ban_ttl_seconds * 1000} < now_ms) AS unban,
       CASE WHEN ms + {CFG.ban_ttl_seconds * 1000} < now_ms THEN now_ms END AS cleared_at_ms
FROM scored, now WHERE decision = 'BLOCK'"""


def _reason_rows() -> str:
    conds = [("blacklisted", "blacklisted_user"),
             (f"velocity_7d >= {CFG.velocity_threshold}", "high_velocity_7d"),
             (f"amount_cents >= {CFG.large_amount_cents}", "large_amount"),
             ("event_type = 'WITHDRAWAL' AND device_fp IS NULL", "withdrawal_without_device"),
             (f"merchant_id IS NOT NULL AND merchant_users >= {CFG.burst_threshold}", "merchant_multi_user_burst")]
    return "\nUNION ALL\n".join(
        f"SELECT (ms // {DAY}) * {DAY} AS day_start_ms, '{r}' AS reason, user_id FROM scored WHERE {c}"
        for c, r in conds)


D6_REASONS = BASE + f""",
rr AS ({_reason_rows()})
SELECT day_start_ms, reason, count(*) AS decisions, count(DISTINCT user_id) AS users FROM rr GROUP BY ALL"""

D9_BASELINE = BASE + f""",
w AS (SELECT (ms // {HOUR}) * {HOUR} AS window_start_ms, count(*) AS total,
             sum(CASE WHEN decision = 'BLOCK' THEN 1 ELSE 0 END) AS blocks FROM scored GROUP BY 1),
r AS (SELECT *, blocks / total AS block_rate FROM w),
b AS (SELECT *, avg(block_rate) OVER (ORDER BY window_start_ms
                 RANGE BETWEEN {24 * HOUR} PRECEDING AND {HOUR} PRECEDING) AS baseline_rate FROM r)
SELECT window_start_ms, total, CAST(blocks AS BIGINT) AS blocks, round(block_rate, 6) AS block_rate,
       round(baseline_rate, 6) AS baseline_rate, coalesce(block_rate > 2.0 * baseline_rate, FALSE) AS alert
FROM b"""


W1_SUPPLIER = f"""
WITH li AS (
  SELECT 'li-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS event_id,
         's-' || CAST(l.l_suppkey AS VARCHAR) AS merchant_id, 'cust-' || CAST(o.o_custkey AS VARCHAR) AS user_id,
         epoch_us(o.o_orderdate) // 1000 AS ms
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT event_id, merchant_id,
       CAST(count(DISTINCT user_id) OVER (PARTITION BY merchant_id ORDER BY ms
         RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS merchant_users
FROM li"""


def all_sql() -> dict[str, str]:
    return {
        "w1_supplier_burst": W1_SUPPLIER,
        "s11_dlq_records": S11_DLQ,
        "q6_dlq_replay": Q6_REPLAY,
        "q6_dlq_replay_all": Q6_ALL,
        "d1_sequence_wide": D1_WIDE,
        "a13_counter_increase": A13_COUNTER,
        "a13_increase": A13_INCREASE,
        "a13_absent": A13_ABSENT,
        "d8_ban_ladder": D8_LADDER,
        "f10_stored_velocity": F10_VELOCITY,
        "q7_archive_events": Q7_ARCHIVE,
        "a04_decision_mix": A04_MIX,
        "a05_alert_status": A05_STATUS,
        "a06_sends_by_channel": A06_SENDS,
        "a06_dlq_by_severity": A06_DLQ,
        "a07_ingest_outcomes": A07_OUTCOMES,
        "a08_block_ratio": A08_RATIO,
        "a09_consumer_lag": A09_LAG,
        "a10_throughput": A10_THROUGHPUT,
        "a11_amount_percentiles": A11_PCT,
        "a13_silence_gaps": A13_GAPS,
        "d1_sequence": D1_SEQ,
        "d2_user_daily_score": D2_DAILY,
        "d3_user_profile": D3_PROFILE,
        "d4_reconcile_bans": D4_RECONCILE,
        "d6_reason_daily": D6_REASONS,
        "d9_block_rate_baseline": D9_BASELINE,
    }
