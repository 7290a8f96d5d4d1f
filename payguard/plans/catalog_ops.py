"""Registered queries, part 2: DLQ and replay, archive, pipeline health and
the documented extras. Each reads the driver's tables through the same
binding and grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from payguard.config import TESTDATA_CONFIG as CFG
from payguard.functions import byte_length, header_value_str
from payguard.operators import archive as AR
from payguard.operators import bans as BN
from payguard.operators import documented as D
from payguard.operators import dlq as DQ
from payguard.operators import health as H
from payguard.plans import catalog as C
from payguard.session import cut_lineage
from payguard.sources import testdata as TD

DAY = 86_400_000
HOUR = 3_600_000


def _dlq(spark, sf):
    records = TD.alert_records(C.scored(spark, sf).alerts)
    _, bad = DQ.split_alert_records(records, CFG)
    return bad


def s11_dlq_records(spark, sf):
    d = _dlq(spark, sf)
    return d.select("topic", "partition", "offset", F.decode("key", "UTF-8").alias("key"),
                    header_value_str("headers", "x-original-topic").alias("original_topic"),
                    header_value_str("headers", "x-failed-at").alias("failed_at"),
                    header_value_str("headers", "x-retry-count").alias("retry_count"),
                    header_value_str("headers", "severity").alias("severity"),
                    header_value_str("headers", "x-exception-message").alias("exception_message"),
                    byte_length("value").alias("value_bytes"))


def _replayed(spark, sf, max_messages):
    # the DLQ is a stored topic the replay tool scans (S12): materialise it
    dlq = cut_lineage(_dlq(spark, sf))
    summary, records = DQ.replay(dlq, "alert-events", original_topic="alert-events",
                                 severity="UNKNOWN", failed_after="2024-01-05T00:00:00Z",
                                 failed_before="2024-01-25T00:00:00Z", max_messages=max_messages,
                                 execute=True, operator="ops", replayed_at="2024-02-01T00:00:00Z")
    rec = records.select(F.col("source_partition").alias("partition"), F.col("source_offset").alias("offset"),
                         header_value_str("headers", "x-replayed-by").alias("replayed_by"),
                         F.size("headers").alias("header_count"))
    return summary.join(rec, ["partition", "offset"])


def q6_dlq_replay(spark, sf):
    """The first hundred matches (the tool's default, a top-k report)."""
    return _replayed(spark, sf, CFG.replay_max_messages)


def q6_dlq_replay_all(spark, sf):
    return _replayed(spark, sf, None)


def q7_archive_events(spark, sf):
    ev = C._events(spark, sf)
    day = F.floor(F.col("ms") / DAY) - F.lit(19723)  # days since 2024-01-01
    archived = ev.filter(day < 14)
    batch = ev.filter(day >= 9).unionByName(ev.filter((day >= 9) & (F.col("seq") % 10 == 0)))
    new = AR.insert_if_absent(batch, archived, ["event_id"], ["ms", "seq"])
    return new.select("event_id", "user_id", "ms")


def a04_decision_mix(spark, sf):
    return H.decision_mix(C.scored(spark, sf).decisions)


def a05_alert_status(spark, sf):
    log, _, _ = C._alerts_processed(spark, sf)
    return H.alert_status_rate(log)


def a06_sends_by_channel(spark, sf):
    _, _, sends = C._alerts_processed(spark, sf)
    return H.sends_by_channel(sends)


def a06_dlq_by_severity(spark, sf):
    return H.dlq_by_severity(_dlq(spark, sf))


def _admission(spark, sf):
    ev, req = C._ban_requests(spark, sf)
    bans = BN.ban_intervals(req, fold_max_group_rows=CFG.fold_max_group_rows)
    from payguard.operators import ingest as ING
    return ING.admit(ev, bans, CFG)


def a07_ingest_outcomes(spark, sf):
    return H.ingest_outcomes(_admission(spark, sf))


def a08_block_ratio(spark, sf):
    out = _admission(spark, sf)
    return H.breach_windows(out, F.col("status") == "BLOCKED", width_ms=HOUR, threshold=0.05, hold_windows=2)


def a09_consumer_lag(spark, sf):
    off = TD.consumer_offsets(C._events(spark, sf))
    return H.consumer_lag(off.select("topic", "partition", "committed"), off.select("topic", "partition", "latest"))


def a10_throughput(spark, sf):
    return H.throughput(C._events(spark, sf))


def a11_amount_percentiles(spark, sf):
    return H.percentiles(C._events(spark, sf), "amount_cents", ["event_type"])


def a13_silence_gaps(spark, sf):
    return H.silences(C._events(spark, sf), ["user_id"], 2 * DAY)


def d1_sequence(spark, sf):
    return D.sequence_pattern(C._events(spark, sf), "LOGIN", "BEHAVIOUR", "WITHDRAWAL", 6 * HOUR,
                              third_min_amount=CFG.large_amount_cents)


def d2_user_daily_score(spark, sf):
    return D.tumbling_user_score(C.scored(spark, sf).decisions)


def d3_user_profile(spark, sf):
    ev = C._events(spark, sf)
    from payguard.plans import scoring as Q
    decs = Q.score_events(ev, CFG, profiles=C._profiles(ev)).decisions
    return D.user_profile(ev, decs)


def d4_reconcile_bans(spark, sf):
    ev = C._events(spark, sf)
    now = ev.agg(F.max("ms")).first()[0]  # scalar: the data's "now"
    audit = BN.audit_bans(C.scored(spark, sf).decisions, CFG)
    r = BN.reconcile_expired(audit, now_ms=now)
    return r.select("decision_id", "user_id", "unban", F.unix_millis("cleared_at").alias("cleared_at_ms"))


def d6_reason_daily(spark, sf):
    return D.reason_daily(C.scored(spark, sf).decisions)


def d9_block_rate_baseline(spark, sf):
    return D.block_rate_vs_baseline(C.scored(spark, sf).decisions)


def d1_sequence_wide(spark, sf):
    return D.sequence_pattern(C._events(spark, sf), "LOGIN", "BEHAVIOUR", "WITHDRAWAL", 7 * DAY)


def a13_counter_increase(spark, sf):
    """A cumulative counter per merchant (its events so far) and its increase a day."""
    from payguard.operators import windows as W
    ev = C._events(spark, sf).filter("merchant_id IS NOT NULL").select("merchant_id", "ms", F.lit(1).alias("one"))
    series = W.running_sum(ev, ["merchant_id"], "ms", "one", "value", DAY)
    return H.counter_increase(series, ["merchant_id"], DAY)


def a13_increase(spark, sf):
    """Increase over sliding six hours of a counter per merchant that starts anew every 50 events."""
    from payguard.operators import windows as W
    ev = C._events(spark, sf).filter("merchant_id IS NOT NULL").select("merchant_id", "ms", "seq", F.lit(1).alias("one"))
    n = W.running_sum(ev, ["merchant_id"], "ms", "one", "n", DAY, ["seq"])
    series = n.select("merchant_id", "ms", "seq", F.pmod(F.col("n"), F.lit(50)).alias("value"))
    return H.increase(series, ["merchant_id"], 6 * HOUR, threshold=3).drop("seq")


def a13_absent(spark, sf):
    """Users silent for two days or more at the end, and expected ones never seen."""
    ev = C._events(spark, sf)
    now = ev.agg(F.max("ms")).first()[0]  # scalar: the data's "now"
    expected = ev.select("user_id").distinct().unionByName(
        ev.filter(F.col("seq") % 100 == 0).select(F.concat(F.lit("never-"), "event_id").alias("user_id")))
    return H.absent(ev, ["user_id"], 2 * DAY, now, expected)


def d8_ban_ladder(spark, sf):
    return C._events(spark, sf).select("event_id", (F.col("seq") % 7).alias("severity"),
                                       BN.ladder_ttl((F.col("seq") % 7).cast("int")).alias("ttl_seconds"))


def f10_stored_velocity(spark, sf):
    """Profiles with a stored velocity, some blank, missing or no number."""
    from payguard.plans import scoring as Q
    ev = C._events(spark, sf)
    num = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int")
    raw = (F.when(num % 5 == 1, (num % 40).cast("string")).when(num % 5 == 2, " ").when(num % 5 == 3, "-7").when(num % 5 == 4, "many"))
    profiles = C._profiles(ev).withColumn("velocity_raw", raw)
    return Q.lookup_profiles(ev, profiles).select("event_id", "blacklisted", "velocity_7d")


def w1_supplier_burst(spark, sf):
    """W1 over the larger line-item source (day-granular times: many ties):
    distinct customers per supplier in the last 7 days."""
    from payguard.operators import windows as W

    ev = TD.risk_events_from_orders(spark, sf).select("event_id", "merchant_id", "user_id", "ms", "seq")
    out = W.merchant_burst(ev, 7 * DAY, bucket_ms=CFG.bucket_ms)
    return out.select("event_id", "merchant_id", "merchant_users")


QUERIES = {
    "w1_supplier_burst": w1_supplier_burst,
    "s11_dlq_records": s11_dlq_records,
    "q6_dlq_replay": q6_dlq_replay,
    "q6_dlq_replay_all": q6_dlq_replay_all,
    "d1_sequence_wide": d1_sequence_wide,
    "a13_counter_increase": a13_counter_increase,
    "a13_increase": a13_increase,
    "a13_absent": a13_absent,
    "d8_ban_ladder": d8_ban_ladder,
    "f10_stored_velocity": f10_stored_velocity,
    "q7_archive_events": q7_archive_events,
    "a04_decision_mix": a04_decision_mix,
    "a05_alert_status": a05_alert_status,
    "a06_sends_by_channel": a06_sends_by_channel,
    "a06_dlq_by_severity": a06_dlq_by_severity,
    "a07_ingest_outcomes": a07_ingest_outcomes,
    "a08_block_ratio": a08_block_ratio,
    "a09_consumer_lag": a09_consumer_lag,
    "a10_throughput": a10_throughput,
    "a11_amount_percentiles": a11_amount_percentiles,
    "a13_silence_gaps": a13_silence_gaps,
    "d1_sequence": d1_sequence,
    "d2_user_daily_score": d2_user_daily_score,
    "d3_user_profile": d3_user_profile,
    "d4_reconcile_bans": d4_reconcile_bans,
    "d6_reason_daily": d6_reason_daily,
    "d9_block_rate_baseline": d9_block_rate_baseline,
}
