"""Registered queries, part 3: rule administration (Q8) over requests derived
from the events, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from payguard import schemas
from payguard.functions import header_value_str, stable_id
from payguard.operators import alerts as A
from payguard.operators import dlq as DQ
from payguard.operators import rule_admin as RA
from payguard.plans import catalog as C
from payguard.plans.oracle import RISK_EVENTS, uuid3
from payguard.session import cut_lineage, run_folder
from payguard.sources import testdata as TD
from payguard.sources.tables import Tables

# every tenth event asks for a rule; every 35th disables one
KINDS = ("LARGE_AMOUNT", "global", "high_velocity_7d", "fraud_ring", None)


def _requests(spark, sf):
    ev = C._events(spark, sf)
    num, seq = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int"), F.col("seq")
    kind = F.element_at(F.array(*[F.lit(k).cast("string") for k in KINDS]), (seq / 10 % 5 + 1).cast("int"))
    rule = F.concat(F.lit("rule-"), num.cast("string"))
    ask = ev.filter(seq % 10 == 0).select(
        rule.alias("rule_id"), kind.alias("rule_type"),
        F.when(seq % 30 > 0, F.create_map(F.lit("score_delta"), (seq % 90).cast("string"))).alias("parameters"), F.col("ts").alias("at"))
    off = ev.filter(seq % 35 == 0).groupBy(rule.alias("rule_id")).agg(F.max("ts").alias("at"))
    return ask, off


def _tables(spark):
    return spark.createDataFrame([], schemas.RULE), spark.createDataFrame([], schemas.RULE_OUTBOX)


def _upserted(spark, sf):
    ask, off = _requests(spark, sf)
    rules, outbox, bad = RA.upsert_rules(*_tables(spark), ask)
    return rules, outbox, bad, off


def _rules_out(rules):
    return rules.select("rule_id", "rule_type", "enabled", F.coalesce(F.element_at("parameters", "score_delta"), F.lit("")).alias("score_delta"),
                        F.unix_millis("created_at").alias("created_ms"), F.unix_millis("updated_at").alias("updated_ms"))


def q8_upsert(spark, sf):
    return _rules_out(_upserted(spark, sf)[0])


def q8_rejected(spark, sf):
    bad = _upserted(spark, sf)[2]
    return bad.select("rule_id", "rule_type", F.unix_millis("at").alias("at_ms"))


def q8_disable(spark, sf):
    rules, outbox, _, off = _upserted(spark, sf)
    return _rules_out(RA.disable_rules(rules, outbox, off)[0])


def q8_not_found(spark, sf):
    rules, outbox, _, off = _upserted(spark, sf)
    return RA.disable_rules(rules, outbox, off)[2].select("rule_id")


def _relayed(spark, sf, batch_size=None):
    rules, outbox, _, off = _upserted(spark, sf)
    _, outbox, _ = RA.disable_rules(rules, outbox, off)
    return RA.relay_outbox(outbox, batch_size, F.lit("2024-06-01 00:00:00").cast("timestamp"))


def q8_relay(spark, sf):
    log, _ = _relayed(spark, sf)
    return log.select("log_offset", "rule_id", "rule_type", "enabled", F.unix_millis("updated_at").alias("updated_ms"))


def q8_relay_batch(spark, sf):
    """One relay batch (a top-k by id): what is published of the outbox then."""
    _, outbox = _relayed(spark, sf, 100)
    return outbox.select("id", "rule_id", F.col("published_at").isNotNull().alias("published"))


def a12_latest_state(spark, sf):
    log, _ = _relayed(spark, sf)
    return RA.latest_state(log).select("rule_id", "rule_type", F.unix_millis("updated_at").alias("updated_ms"))


def l01_rules(spark, sf):
    rules = RA.list_rules(_upserted(spark, sf)[0])
    return _rules_out(rules)


HALF = "2024-01-16 00:00:00"


def q8_upsert_again(spark, sf):
    """The second half of the requests meets the rules of the first; replaced ones keep created_at."""
    ask, _ = _requests(spark, sf)
    rules, outbox, _ = RA.upsert_rules(*_tables(spark), ask.filter(F.col("at") < F.lit(HALF).cast("timestamp")))
    rules, _, _ = RA.upsert_rules(rules, outbox, ask.filter(F.col("at") >= F.lit(HALF).cast("timestamp")))
    return _rules_out(rules)


def t14_committed_rules(spark, sf):
    """Rules and outbox committed together, then the disabling, and both read back: the rules, each
    with its number of outbox entries."""
    ask, off = _requests(spark, sf)
    tables = Tables(spark, run_folder(spark, "tables"), {"rules": ["rule_id"], "outbox": ["id"]})
    rules, outbox, _ = RA.upsert_rules(*_tables(spark), ask)
    version = tables.commit({"rules": rules, "outbox": outbox}, 0)
    rules, outbox, _ = RA.disable_rules(tables.read("rules"), tables.read("outbox"), off)
    tables.commit({"rules": rules, "outbox": outbox}, version)
    entries = tables.read("outbox").groupBy("rule_id").agg(F.count("*").alias("entries"))
    return _rules_out(tables.read("rules")).join(entries, "rule_id")


def j06_alert_log_update(spark, sf):
    """The status of some alerts set by key in the stored log; only their buckets are written."""
    log, _, _ = C._alerts_processed(spark, sf)
    tables = Tables(spark, run_folder(spark, "alert-log"), {"log": ["alert_id"]}, buckets=64)
    tables.commit({"log": log}, 0)
    some = tables.read("log").filter(F.unix_millis("created_at") % 3 == 0).select("alert_id", F.lit("ACKNOWLEDGED").alias("status"))
    tables.update_by_key("log", some, ["status"])
    return tables.read("log").select("alert_id", "user_id", "status", F.unix_millis("created_at").alias("created_at_ms"))


def j06_not_found(spark, sf):
    """Updates whose key isn't in the stored log (decisions below the alert threshold)."""
    log, _, _ = C._alerts_processed(spark, sf)
    tables = Tables(spark, run_folder(spark, "alert-log"), {"log": ["alert_id"]})
    tables.commit({"log": log}, 0)
    asked = C.scored(spark, sf).decisions.filter(F.col("seq") % 4 == 0).select(
        stable_id("alert", "decision_id").alias("alert_id"), F.lit("ACKNOWLEDGED").alias("status"))
    return tables.update_by_key("log", asked, ["status"])[1]


def j07_pending(spark, sf):
    """A third of the alerts lie in the log as PENDING (stored, never finished); they are processed
    as if new, and their redeliveries are duplicates."""
    alerts = C._stored_alerts(C.scored(spark, sf).alerts)
    pending = alerts.filter(F.col("seq") % 3 == 0).select(
        "alert_id", "user_id", "severity", "reason_summary", F.lit("PENDING").alias("status"),
        F.array().cast("array<string>").alias("channels_notified"), "created_at", F.lit(None).cast("timestamp").alias("processed_at"))
    log, _, _ = A.process_alerts(TD.alert_deliveries(alerts), C.CFG, alert_log=cut_lineage(pending))
    return log.select("alert_id", "user_id", "severity", "status", F.array_join("channels_notified", ",").alias("channels"),
                      F.unix_millis("created_at").alias("created_at_ms"))


def _change_log(spark, sf):
    """The relayed rule log with tombstones: every 70th event deletes its user's rule."""
    log, _ = _relayed(spark, sf)
    ev = C._events(spark, sf).filter(F.col("seq") % 70 == 0)
    rule = F.concat(F.lit("rule-"), F.regexp_extract("user_id", r"(\d+)$", 1))
    tomb = ev.select(rule.alias("rule_id"), F.lit(None).cast("string").alias("rule_type"), F.lit(None).cast("boolean").alias("enabled"),
                     F.lit(None).cast("map<string,string>").alias("parameters"), F.lit(None).cast("timestamp").alias("updated_at"),
                     (F.col("seq") + 10_000_000_000).alias("log_offset"))
    return log, tomb


def d5_tombstones(spark, sf):
    """Latest state of a log whose last records delete some rules."""
    log, tomb = _change_log(spark, sf)
    return RA.latest_state(log.unionByName(tomb)).select("rule_id", "rule_type", F.unix_millis("updated_at").alias("updated_ms"))


def d7_bootstrap(spark, sf):
    """Every live rule and a tombstone per deleted one emitted anew, after the log that they replace; what a
    fresh consumer holds then."""
    log, tomb = _change_log(spark, sf)
    rules = cut_lineage(RA.latest_state(log))
    again = RA.bootstrap(rules, tomb.select("rule_id").distinct(), log)
    state = RA.latest_state(log.unionByName(again.select(log.columns)))
    count = again.agg(F.count("*").alias("emitted"), (F.max("log_offset") - F.min("log_offset") + 1).alias("span"))
    return state.join(F.broadcast(count)).select("rule_id", "rule_type", "emitted", "span")  # one row


def t13_relay_stops(spark, sf):
    """The relay meets an entry that it cannot publish (a payload without its type) and stops before it."""
    _, outbox, _, _ = _upserted(spark, sf)
    broken = F.when(F.col("id") >= 250, F.lit('{"ruleId":"x"}')).otherwise(F.col("payload"))
    log, out = RA.relay_outbox(cut_lineage(outbox.withColumn("payload", broken)), None, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    sent = log.select(F.col("log_offset").alias("id"), "rule_type")
    return out.join(sent, "id", "left").select("id", "rule_id", "rule_type", F.col("published_at").isNotNull().alias("published"))


def f18_long_messages(spark, sf):
    """exception messages of any length, cut to 512 characters in the DLQ header."""
    records = TD.alert_records(C.scored(spark, sf).alerts)
    text = F.repeat(F.concat(F.lit("é#"), F.col("offset").cast("string"), F.lit(" ")), (F.col("offset") % 200).cast("int"))
    bad = DQ.publish_to_dlq(records, C.CFG, message=text)
    message = header_value_str("headers", "x-exception-message")
    return bad.select("partition", "offset", F.char_length(message).cast("long").alias("chars"), F.md5(F.encode(message, "UTF-8")).alias("md5"))


QUERIES = {f.__name__: f for f in (
    q8_upsert, q8_rejected, q8_disable, q8_not_found, q8_relay, q8_relay_batch, a12_latest_state, l01_rules, q8_upsert_again, t14_committed_rules,
    j06_alert_log_update, j06_not_found, j07_pending, d5_tombstones, d7_bootstrap, t13_relay_stops, f18_long_messages)}

_BASE = "WITH " + RISK_EVENTS + """,
ask AS (
  SELECT 'rule-' || CAST(user_num AS VARCHAR) AS rule_id, lower(['LARGE_AMOUNT', 'global', 'high_velocity_7d', 'fraud_ring', NULL][seq // 10 % 5 + 1]) AS rule_type,
         CASE WHEN seq % 30 > 0 THEN CAST(seq % 90 AS VARCHAR) ELSE '' END AS score_delta, ms
  FROM risk_events WHERE seq % 10 = 0),
good AS (FROM ask WHERE rule_type IS NOT NULL AND rule_type <> 'fraud_ring'),
rules AS (SELECT rule_id, arg_max(rule_type, ms) AS rule_type, TRUE AS enabled, arg_max(score_delta, ms) AS score_delta,
                 max(ms) AS created_ms, max(ms) AS updated_ms FROM good GROUP BY rule_id),
off AS (SELECT 'rule-' || CAST(user_num AS VARCHAR) AS rule_id, max(ms) AS ms FROM risk_events WHERE seq % 35 = 0 GROUP BY 1),
first_out AS (SELECT rule_id, rule_type, TRUE AS enabled, score_delta, ms FROM good),
second_out AS (SELECT rule_id, rule_type, FALSE AS enabled, score_delta, off.ms FROM rules JOIN off USING (rule_id)),
outbox AS (
  SELECT row_number() OVER (ORDER BY ms, rule_id) AS id, * FROM first_out
  UNION ALL
  SELECT (SELECT count(*) FROM first_out) + row_number() OVER (ORDER BY ms, rule_id) AS id, * FROM second_out)
"""
_ORACLE = {
    "q8_upsert": "SELECT * FROM rules",
    "q8_rejected": "SELECT rule_id, rule_type, ms AS at_ms FROM ask WHERE rule_type IS NULL OR rule_type = 'fraud_ring'",
    "q8_disable": """SELECT rule_id, rule_type, off.rule_id IS NULL AS enabled, score_delta, created_ms, coalesce(off.ms, updated_ms) AS updated_ms
FROM rules LEFT JOIN off USING (rule_id)""",
    "q8_not_found": "SELECT rule_id FROM off WHERE rule_id NOT IN (SELECT rule_id FROM rules)",
    "q8_relay": "SELECT id AS log_offset, rule_id, rule_type, enabled, ms AS updated_ms FROM outbox",
    "q8_relay_batch": "SELECT id, rule_id, id <= 100 AS published FROM outbox",
    "a12_latest_state": """SELECT rule_id, arg_max(rule_type, id) AS rule_type, max(ms) AS updated_ms
FROM outbox GROUP BY rule_id HAVING arg_max(enabled, id)""",
    "l01_rules": "SELECT * FROM rules",
}


_ORACLE |= {
    "q8_upsert_again": """SELECT r.rule_id, r.rule_type, r.enabled, r.score_delta,
       coalesce(f.first_half, r.created_ms) AS created_ms, r.updated_ms
FROM rules r LEFT JOIN (SELECT rule_id, max(ms) AS first_half FROM good WHERE ms < epoch_ms(TIMESTAMP '2024-01-16 00:00:00') GROUP BY 1) f USING (rule_id)""",
    "t14_committed_rules": """SELECT rule_id, rule_type, off.rule_id IS NULL AS enabled, score_delta, created_ms, coalesce(off.ms, updated_ms) AS updated_ms, entries
FROM rules LEFT JOIN off USING (rule_id) JOIN (SELECT rule_id, count(*) AS entries FROM outbox GROUP BY 1) USING (rule_id)""",
    "d5_tombstones": """SELECT rule_id, arg_max(rule_type, id) AS rule_type, max(ms) AS updated_ms
FROM outbox WHERE rule_id NOT IN (SELECT 'rule-' || CAST(user_num AS VARCHAR) FROM risk_events WHERE seq % 70 = 0)
GROUP BY rule_id HAVING arg_max(enabled, id)""",
    "d7_bootstrap": """SELECT rule_id, rule_type, (SELECT count(*) FROM live) + (SELECT count(*) FROM gone) AS emitted,
       (SELECT count(*) FROM live) + (SELECT count(*) FROM gone) AS span
FROM (SELECT rule_id, arg_max(rule_type, id) AS rule_type FROM outbox GROUP BY rule_id HAVING arg_max(enabled, id))
WHERE rule_id NOT IN (FROM gone)""",
    "t13_relay_stops": "SELECT id, rule_id, CASE WHEN id < 250 THEN rule_type END AS rule_type, id < 250 AS published FROM outbox WHERE enabled",
}
_MORE_CTES = """,
gone AS (SELECT DISTINCT 'rule-' || CAST(user_num AS VARCHAR) AS rule_id FROM risk_events WHERE seq % 70 = 0),
live AS (SELECT rule_id FROM outbox GROUP BY rule_id HAVING arg_max(enabled, id))
"""


def all_sql() -> dict[str, str]:
    from payguard.plans import oracle_ops as OO
    from payguard.plans import oracle_pipelines as OP
    sql = {k: _BASE + _MORE_CTES + v for k, v in _ORACLE.items()}
    log = OP.Q4_ALERT_LOG
    sql["j07_pending"] = log
    sql["j06_alert_log_update"] = ("SELECT alert_id, user_id, CASE WHEN created_at_ms % 3 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status, created_at_ms FROM ("
                                   + log + ")")
    sql["j06_not_found"] = OO.BASE + f"""
SELECT {uuid3("'alert:' || decision_id")} AS alert_id FROM scored WHERE seq % 4 = 0 AND risk_score < {C.CFG.alert_threshold}"""
    sql["f18_long_messages"] = OO.BASE + f"""
SELECT CAST((strpos('0123456789abcdef', substr(md5(user_id), 32, 1)) - 1) % 4 AS INTEGER) AS partition, seq AS "offset",
       length(substr(repeat('é#' || CAST(seq AS VARCHAR) || ' ', seq % 200), 1, 512)) AS chars,
       md5(substr(repeat('é#' || CAST(seq AS VARCHAR) || ' ', seq % 200), 1, 512)) AS md5
FROM scored WHERE risk_score >= {C.CFG.alert_threshold}"""
    return sql
