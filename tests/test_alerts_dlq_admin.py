"""Alerts (G23-G29), DLQ (G30, P13-P15), rule administration (G32-G34),
bans audit (G22) and archive idempotence (J4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0_MS, ts
from payguard import schemas
from payguard.config import DEFAULT_CONFIG as CFG
from payguard.operators import alerts as A
from payguard.operators import archive as AR
from payguard.operators import bans as BN
from payguard.operators import dlq as DQ
from payguard.operators import rule_admin as RA
from payguard.operators import scoring as S

ALERT_DDL = ("alert_id string, decision_id string, event_id string, user_id string, risk_score int, severity string, "
             "reason_summary string, created_at timestamp, source string, seq long, ms long, delivery int")


def alerts_df(spark, rows):
    return spark.createDataFrame(
        [(a, f"d-{a}", f"e-{a}", u, 95, sev, "large_amount", ts(T0_MS + ms), "flink-risk-engine", i, T0_MS + ms, dlv)
         for i, (a, u, sev, ms, dlv) in enumerate(rows)], ALERT_DDL)


def test_g23_g24_alert_projection(spark):
    d = spark.createDataFrame([("d1", "e1", "r1", "u1", "BLOCK", 95, ["large_amount", "merchant_multi_user_burst"],
                                ts(T0_MS), "flink-risk-engine", "m", 1, T0_MS, 150),
                               ("d2", "e2", "r2", "u1", "BLOCK", 90, [], ts(T0_MS), "flink-risk-engine", "m", 2,
                                T0_MS, 90)],
                              "decision_id string, event_id string, request_id string, user_id string, decision string, "
                              "risk_score int, reasons array<string>, created_at timestamp, source string, "
                              "merchant_id string, seq long, ms long, raw_score int")
    got = {r.decision_id: (r.severity, r.reason_summary) for r in S.alerts(d, 90).collect()}
    assert got == {"d1": ("CRITICAL", "large_amount,merchant_multi_user_burst"), "d2": ("HIGH", "")}


def test_g25_routing(spark):
    df = spark.createDataFrame([("MEDIUM",), ("high",), ("CRITICAL",), ("LOW",)], "s string")
    got = [list(r[0]) for r in df.select(A.route(F.col("s"), CFG)).collect()]
    assert got == [["email"], ["email", "sms"], ["email", "sms", "push"], []]


def test_unknown_channel_is_an_error():
    with pytest.raises(ValueError):
        A.routing_map(CFG.with_(routing=(("HIGH", ("pager",)),)))


def test_g26_g27_g28_processing(spark):
    m = 60_000
    rows = [("a1", "u", "HIGH", 0, 0), ("a2", "u", "HIGH", 5 * m, 0), ("a3", "u", "CRITICAL", 6 * m, 0),
            ("a1", "u", "HIGH", 7 * m, 1)]
    log, out, sends = A.process_alerts(alerts_df(spark, rows), CFG)
    st = {r.alert_id: (r.status, list(r.channels_notified)) for r in log.collect()}
    assert st == {"a1": ("PROCESSED", ["email", "sms"]), "a2": ("RATE_LIMITED", []),
                  "a3": ("PROCESSED", ["email", "sms", "push"])}
    o = {(r.alert_id, r.delivery): (r.duplicate, r.rate_limited, list(r.channels)) for r in out.collect()}
    assert o[("a1", 1)] == (True, False, ["email", "sms"])  # duplicate returns stored channels
    assert o[("a2", 0)] == (False, True, [])
    assert sends.count() == 5


def test_g27_g29_existing_log(spark):
    rows = [("a1", "u", "HIGH", 0, 0), ("a2", "v", "HIGH", 0, 0)]
    existing = spark.createDataFrame(
        [("a1", "u", "HIGH", "s", "PROCESSED", ["email"], ts(T0_MS), ts(T0_MS)),
         ("a2", "v", "HIGH", "s", "PENDING", None, ts(T0_MS), None)], schemas.ALERT_LOG)
    log, out, _ = A.process_alerts(alerts_df(spark, rows), CFG, alert_log=existing)
    o = {r.alert_id: (r.duplicate, list(r.channels or [])) for r in out.collect()}
    assert o["a1"] == (True, ["email"])  # known PROCESSED: duplicate, stored channels
    assert o["a2"] == (False, ["email", "sms"])  # known PENDING: processed again
    assert {r.alert_id: r.status for r in log.collect()} == {"a1": "PROCESSED", "a2": "PROCESSED"}


def test_g30_dlq_headers(spark):
    attempt = bytes([0, 0, 0, 3])
    rec = spark.createDataFrame(
        [("alert-events", 0, 7, b"user-1", b"payload", [("kafka_deliveryAttempt", attempt)],
          dt.datetime(2026, 5, 17, 23, 45, tzinfo=dt.timezone.utc), "payload exploded")],
        "topic string, partition int, offset long, key binary, value binary, "
        "headers array<struct<key:string,value:binary>>, record_ts timestamp, decode_error string")
    out = DQ.publish_to_dlq(rec.withColumn("headers", F.array_union("headers", F.array(F.struct(
        F.lit("severity").alias("key"), F.encode(F.lit("CRITICAL"), "UTF-8").alias("value"))))), CFG).first()
    h = {x.key: bytes(x.value).decode() for x in out.headers if x.key != "kafka_deliveryAttempt"}
    assert h == {"x-exception-message": "payload exploded", "x-retry-count": "3",
                 "x-original-topic": "alert-events", "x-failed-at": "2026-05-17T23:45:00Z", "severity": "CRITICAL"}
    assert bytes(out.key) == b"user-1" and bytes(out.value) == b"payload"


def test_g31_no_attempt_header_gives_max_retries_plus_one(spark):
    rec = spark.createDataFrame([("alert-events", 0, 1, None, None, [], ts(T0_MS), "bad")],
                                "topic string, partition int, offset long, key binary, value binary, "
                                "headers array<struct<key:string,value:binary>>, record_ts timestamp, decode_error string")
    out = DQ.publish_to_dlq(rec, CFG.with_(alert_max_retries=0)).first()
    h = {x.key: bytes(x.value).decode() for x in out.headers}
    assert h["x-retry-count"] == "1" and h["severity"] == "unknown" and bytes(out.value) == b""


def dlq_rows(spark):
    def hdr(**kv):
        return [(k.replace("_", "-"), v.encode()) for k, v in kv.items()]
    rows = [(0, 1, hdr(x_original_topic="alert-events", severity="HIGH", x_failed_at="2026-05-17T10:00:00Z")),
            (0, 2, hdr(x_original_topic="alert-events", severity="high", x_failed_at="2026-05-17T12:00:00Z")),
            (1, 1, hdr(x_original_topic="other", severity="HIGH", x_failed_at="2026-05-17T11:00:00Z")),
            (1, 2, hdr(x_original_topic="alert-events", x_failed_at="not-a-time")),
            (1, 3, hdr(x_original_topic="alert-events", severity="HIGH"))]
    return spark.createDataFrame([("dlq", p, o, b"k", b"v", h) for p, o, h in rows], schemas.KAFKA_RECORD)


def test_p13_filters_and_p14_summary(spark):
    d = dlq_rows(spark)
    s, _ = DQ.replay(d, "t", original_topic="alert-events", severity="HIGH",
                     failed_after="2026-05-17T10:00:00Z", failed_before="2026-05-17T12:00:00Z")
    assert sorted((r.partition, r.offset) for r in s.collect()) == [(0, 1), (0, 2)]  # inclusive, case-insensitive
    s, _ = DQ.replay(d, "t")
    got = {(r.partition, r.offset): (r.severity, r.failed_at) for r in s.collect()}
    assert got[(1, 2)] == ("-", "not-a-time") and got[(1, 3)] == ("HIGH", "-")
    s, _ = DQ.replay(d, "t", failed_after="2026-01-01T00:00:00Z")
    assert (1, 2) not in {(r.partition, r.offset) for r in s.collect()}  # unparseable fails when bounded


def test_p15_replay_requires_operator_and_upserts_headers(spark):
    d = dlq_rows(spark)
    with pytest.raises(ValueError):
        DQ.replay(d, "t", execute=True)
    _, rec = DQ.replay(d, "alert-events", execute=True, operator="ops", replayed_at="2026-06-01T00:00:00Z",
                       max_messages=2)
    rows = rec.collect()
    assert len(rows) == 2 and all(bytes(r.value) == b"v" for r in rows)
    h = {x.key: bytes(x.value).decode() for x in rows[0].headers}
    assert h["x-replayed-by"] == "ops" and h["x-replayed-at"] == "2026-06-01T00:00:00Z"


def rules_tables(spark):
    rules = spark.createDataFrame([], schemas.RULE)
    outbox = spark.createDataFrame([], schemas.RULE_OUTBOX)
    return rules, outbox


def test_g32_upsert_normalises_and_keeps_created_at(spark):
    rules, outbox = rules_tables(spark)
    t1 = dt.datetime(2026, 5, 20, 1, tzinfo=dt.timezone.utc)
    req = spark.createDataFrame([("r1", "LARGE_AMOUNT", {"amount_cents": "1"}, t1)],
                                "rule_id string, rule_type string, parameters map<string,string>, at timestamp")
    rules, outbox, bad = RA.upsert_rules(rules, outbox, req)
    r = rules.first()
    n1 = t1.replace(tzinfo=None)
    assert (r.rule_type, r.enabled, r.created_at, r.updated_at) == ("large_amount", True, n1, n1)
    t2 = t1 + dt.timedelta(hours=1)
    req2 = spark.createDataFrame([("r1", "large_amount", None, t2)],
                                 "rule_id string, rule_type string, parameters map<string,string>, at timestamp")
    rules, outbox, _ = RA.upsert_rules(rules, outbox, req2)
    r = rules.first()
    assert (r.created_at, r.updated_at, r.parameters) == (n1, t2.replace(tzinfo=None), {})
    assert [o.id for o in outbox.orderBy("id").collect()] == [1, 2] and bad.count() == 0


def test_g33_disable_unknown_rule_not_found(spark):
    rules, outbox = rules_tables(spark)
    req = spark.createDataFrame([("nope", dt.datetime(2026, 5, 20, tzinfo=dt.timezone.utc))], "rule_id string, at timestamp")
    _, _, missing = RA.disable_rules(rules, outbox, req)
    assert [r.rule_id for r in missing.collect()] == ["nope"]


def test_g34_outbox_stops_at_first_failure(spark):
    t = dt.datetime(2026, 5, 20, tzinfo=dt.timezone.utc)
    outbox = spark.createDataFrame([(1, "r1", "{broken", t, None), (2, "r2", '{"ruleId":"r2"}', t, None)],
                                   schemas.RULE_OUTBOX)
    log, out = RA.relay_outbox(outbox, 100, F.lit(t))
    assert log.count() == 0 and out.filter("published_at IS NOT NULL").count() == 0


def test_a12_d5_latest_state_with_tombstone(spark):
    log = spark.createDataFrame([("a", "large_amount", True, 1), ("a", None, None, 2), ("b", "global", True, 3),
                                 ("c", "global", True, 4), ("c", "global", False, 5)],
                                "rule_id string, rule_type string, enabled boolean, log_offset long")
    assert [r.rule_id for r in RA.latest_state(log).collect()] == ["b"]


def test_g22_audit_one_row_per_decision(spark):
    d = spark.createDataFrame([("decision-1", "user-1", "BLOCK", ts(T0_MS)), ("decision-1", "user-1", "BLOCK", ts(T0_MS))],
                              "decision_id string, user_id string, decision string, created_at timestamp")
    rows = BN.audit_bans(d, CFG).collect()
    assert len(rows) == 1 and rows[0].reason == "ASYNC_RULE:decision-1" and rows[0].severity == 3
    assert rows[0].expires_at == ts(T0_MS + 86_400_000).replace(tzinfo=None)


def test_j4_replay_appends_nothing(spark):
    batch = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "event_id string, seq long")
    first = AR.insert_if_absent(batch, None, ["event_id"], ["seq"])
    assert sorted((r.event_id, r.seq) for r in first.collect()) == [("e1", 1), ("e2", 3)]
    assert AR.insert_if_absent(batch, first, ["event_id"], ["seq"]).count() == 0
