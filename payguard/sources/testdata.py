"""Deterministic bindings of the driver's test tables to the risk schemas.

``risk_events`` maps the generic ``events`` table onto the RiskEvent record;
companion tables (profiles, rule log, ban requests, alert deliveries, DLQ,
offsets) are derived from it with Spark, so their size grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard import schemas
from payguard.config import TESTDATA_CONFIG, RiskConfig
from payguard.operators.bans import decisions_to_ban_requests

#: Scores under which alerts of every severity occur.
SEVERITY_SPREAD = {"large_amount_score": 92, "burst_score": 50, "withdrawal_score": 3, "alert_threshold": 50}

# Fixed values of the binding (FIXTURES §3): raw type -> risk event type.
EVENT_TYPE_MAP = (
    ("purchase", "TRANSACTION"),
    ("signup", "LOGIN"),
    ("error", "WITHDRAWAL"),
    ("click", "BEHAVIOUR"),
    ("view", "TRANSFER"),
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped_type(c):
    expr = None
    for raw, mapped in EVENT_TYPE_MAP:
        expr = (F.when(c == raw, mapped) if expr is None else expr.when(c == raw, mapped))
    return expr.otherwise(F.upper(c))


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RiskEvent rows plus ``seq`` (arrival order) and ``ms`` (epoch ms)."""
    ev = read_table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("req-"), F.col("user_id").cast("string"), F.lit("-"),
                 (ms.cast("long") / F.lit(3_600_000)).cast("long").cast("string")).alias("request_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        _mapped_type(F.col("event_type")).alias("event_type"),
        F.timestamp_millis(ms).alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("10."), (F.col("user_id") % 200).cast("string"), F.lit(".0."),
                                                   (F.col("event_id") % 250).cast("string"))).alias("ip_address"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("dev-"), (F.col("user_id") % 50).cast("string"))).alias("device_fp"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("m-"), (k % 25).cast("string"))).alias("merchant_id"),
        F.lit(None).cast("string").alias("counterparty"),
        F.lit("testdata").alias("source"),
        F.col("event_id").cast("long").alias("seq"),
        ms.alias("ms"),
    )


def risk_events_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, larger event source: one event per line item (day-granular
    timestamps, hence many ties). user = customer, merchant = supplier."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return j.select(
        F.concat(F.lit("li-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("event_id"),
        F.concat(F.lit("ord-"), F.col("l_orderkey").cast("string")).alias("request_id"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.lit("TRANSACTION").alias("event_type"),
        F.timestamp_millis(ms).alias("ts"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("ip_address"),
        F.concat(F.lit("dev-"), (F.col("o_custkey") % 97).cast("string")).alias("device_fp"),
        F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("merchant_id"),
        F.lit(None).cast("string").alias("counterparty"),
        F.lit("orders").alias("source"),
        seq.cast("long").alias("seq"),
        ms.alias("ms"),
    )


def user_profiles(events: DataFrame) -> DataFrame:
    """Profile store: one row per user; users whose number is a multiple of
    37 are blacklisted. ``velocity_raw`` is the stored string value."""
    num = F.regexp_extract("user_id", r"(\d+)$", 1).cast("long")
    return (events.select("user_id").distinct()
            .select("user_id",
                    F.when(num % 37 == 0, F.lit("FRAUD_CONFIRMED:4")).alias("blacklist_raw")))


def _ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s.replace("Z", "+00:00"))


# Fixed rule change log used with the test tables: enable, change, a second
# rule of the same type, an unknown type, a global override, and disables.
RULE_LOG = (
    ("r-large", "large_amount", True, {"amount_cents": "12000", "score_delta": "85"}, "2024-01-05T00:00:00Z", 1),
    ("r-burst", "merchant_multi_user_burst", True, {"burst_threshold": "8"}, "2024-01-08T00:00:00Z", 2),
    ("r-large", "large_amount", True, {"amount_cents": "20000"}, "2024-01-12T00:00:00Z", 3),
    ("r-ring", "fraud_ring", True, {"score_delta": "99"}, "2024-01-14T00:00:00Z", 4),
    ("r-global", "global", True, {"review_threshold": "50", "block_threshold": "90"}, "2024-01-16T00:00:00Z", 5),
    ("r-large-2", "large_amount", True, {"score_delta": "60"}, "2024-01-20T00:00:00Z", 6),
    ("r-burst", "merchant_multi_user_burst", False, {"burst_threshold": "8"}, "2024-01-24T00:00:00Z", 7),
    ("r-large-2", "large_amount", False, {"score_delta": "60"}, "2024-01-27T00:00:00Z", 8),
)


def rule_updates(spark: SparkSession, log=RULE_LOG) -> DataFrame:
    rows = [(r, t, e, p, _ts(u), o) for r, t, e, p, u, o in log]
    return spark.createDataFrame(rows, schemas.RULE_UPDATE)


def rule_log_from_events(events: DataFrame) -> DataFrame:
    """A rule log that grows with the events: every tenth is an update of one of 60
    rules (of known and unknown types, some disabled, some with a parameter that isn't a number)."""
    num = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int")
    seq = F.col("seq")
    kind = F.element_at(F.array(*[F.lit(t) for t in (
        "large_amount", "merchant_multi_user_burst", "global", "high_velocity_7d", "fraud_ring")]), num % 5 + 1)
    amount = F.when(seq % 110 == 0, "many").otherwise((5000 + F.col("amount_cents") % 20000).cast("string"))

    def one(key, value):
        return F.create_map(F.lit(key), value.cast("string"))
    large = F.when(seq % 20 == 0, F.map_concat(one("amount_cents", amount), one("score_delta", seq % 90))).otherwise(one("amount_cents", amount))
    params = (F.when(kind == "large_amount", large).when(kind == "merchant_multi_user_burst", one("burst_threshold", 5 + seq % 9))
              .when(kind == "global", one("review_threshold", 40 + seq % 30))
              .when(kind == "high_velocity_7d", one("velocity_threshold", 10 + seq % 20)))
    return events.filter(seq % 10 == 0).select(
        F.concat(F.lit("rule-"), (num % 60).cast("string")).alias("rule_id"), kind.alias("rule_type"), (seq % 7 > 0).alias("enabled"),
        params.alias("parameters"), F.col("ts").alias("updated_at"), seq.alias("log_offset"))


def raw_requests(events: DataFrame) -> DataFrame:
    """Admission requests as they arrive: blank users, unsupported and missing
    types, bad amounts, missing currency, source and timestamp."""
    seq = F.col("seq")
    kind = F.when(seq % 11 == 0, "refund").when(seq % 37 == 0, F.lit(None).cast("string")).otherwise(
        F.when(seq % 2 == 0, F.lower("event_type")).otherwise(F.col("event_type")))
    return events.select(
        "event_id", "request_id", F.when(seq % 13 == 0, "  ").otherwise(F.col("user_id")).alias("user_id"), kind.alias("event_type"),
        F.when((seq % 19 == 0) | (seq % 23 == 0), F.lit(None).cast("timestamp")).otherwise(F.col("ts")).alias("ts"),
        F.when(seq % 23 != 0, F.col("ts")).alias("received_at"),
        F.when(seq % 17 == 0, F.lit(-5)).when(seq % 41 == 0, F.lit(None).cast("long")).otherwise(F.col("amount_cents")).alias("amount_cents"),
        F.when(seq % 29 != 0, F.lit("usd")).alias("currency"), "merchant_id", F.when(seq % 31 == 0, " ").otherwise("gateway").alias("source"), "seq")


def ban_requests_any_severity(events: DataFrame) -> DataFrame:
    """Ban sets of severities -2 to 8 and holds of a second to a day, at whole minutes
    (ties); a third of the users are one hot user."""
    num, seq = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int"), F.col("seq")
    ttl = F.when(seq % 4 == 0, 1).when(seq % 4 == 1, 3_600).when(seq % 4 == 2, 86_400).otherwise(600)
    return events.filter(seq % 3 == 0).select(
        F.when(num % 3 == 0, "user-hot").otherwise(F.col("user_id")).alias("user_id"), F.lit("R").alias("reason"),
        (seq % 11 - 2).cast("int").alias("severity"), ttl.cast("long").alias("ttl_seconds"),
        F.timestamp_millis(F.floor(F.col("ms") / 60_000) * 60_000).alias("ts"), F.col("event_id").alias("request_key"), "seq")


def ban_requests(decisions: DataFrame, events: DataFrame, cfg: RiskConfig = TESTDATA_CONFIG) -> DataFrame:
    """BLOCK decisions (severity 3, 24 h) plus large WITHDRAWAL events
    (severity 4, 1 h)."""
    blocks = decisions_to_ban_requests(decisions, cfg)
    spikes = events.filter((F.col("event_type") == "WITHDRAWAL") & (F.col("amount_cents") > 20_000)).select(
        "user_id", F.lit("ERROR_SPIKE").alias("reason"), F.lit(4).alias("severity"),
        F.lit(3_600).cast("long").alias("ttl_seconds"), "ts", F.col("event_id").alias("request_key"), "seq")
    return blocks.unionByName(spikes)


def alert_deliveries(alerts: DataFrame) -> DataFrame:
    """The alert topic as delivered: every alert once, in event order, and a
    redelivery of every alert whose event number ends in 0."""
    base = alerts.withColumn("delivery", F.lit(0))
    redelivered = alerts.filter(F.col("seq") % 10 == 0).withColumn("delivery", F.lit(1))
    return base.unionByName(redelivered)


def alert_records(alerts: DataFrame, partitions: int = 4) -> DataFrame:
    """Alert deliveries shaped as topic records (key = user id, value = JSON
    bytes). Every 7th alert can't be decoded: its payload is cut, isn't UTF-8, or
    lacks the id."""
    payload = F.to_json(F.struct(*[F.col(c) for c in (
        "alert_id", "decision_id", "event_id", "user_id", "risk_score", "severity",
        "reason_summary", "created_at", "source")]))
    seq = F.col("seq")
    partial = F.concat(F.lit('{"severity":"'), F.col("severity"), F.lit('","user_id":"'), F.col("user_id"), F.lit('"}'))
    cut = F.when(seq % 3 == 0, F.substring(payload, 1, 30 + (seq % 8).cast("int"))).otherwise(partial)
    value = (F.when((seq % 7 == 0) & (seq % 3 == 1), F.unhex(F.lit("FFFEFD"))).when(seq % 7 == 0, F.encode(cut, "UTF-8"))
             .otherwise(F.encode(payload, "UTF-8")))
    attempt = F.when(F.col("seq") % 2 == 0, F.unhex(F.lit("00000001")))
    # partition by key: last hex digit of md5(user id)
    part = F.conv(F.substring(F.md5(F.col("user_id")), 32, 1), 16, 10).cast("int") % partitions
    return alerts.select(
        F.lit("alert-events").alias("topic"),
        part.alias("partition"),
        F.col("seq").alias("offset"),
        F.encode("user_id", "UTF-8").alias("key"),
        value.alias("value"),
        F.when(attempt.isNotNull(), F.array(F.struct(
            F.lit("kafka_deliveryAttempt").alias("key"), attempt.alias("value"))))
        .otherwise(F.array().cast(schemas.HEADERS)).alias("headers"),
        F.col("created_at").alias("record_ts"),
    )


def consumer_offsets(events: DataFrame, partitions: int = 8, lag_ms: int = 3_600_000) -> DataFrame:
    """Offsets of the raw-events topic as a consumer sees them: the topic is
    partitioned by user; ``latest`` counts every record in a partition,
    ``committed`` counts those older than ``lag_ms`` before the newest one; partition
    3 was never committed."""
    part = F.conv(F.substring(F.md5(F.col("user_id")), 32, 1), 16, 10).cast("int") % partitions
    ev = events.select(part.alias("partition"), "ms")
    newest = ev.groupBy("partition").agg(F.max("ms").alias("newest"))  # one row per partition
    return (ev.join(F.broadcast(newest), "partition")
            .groupBy("partition")
            .agg(F.count("*").alias("latest"),
                 F.sum(F.when(F.col("ms") <= F.col("newest") - lag_ms, 1).otherwise(0)).alias("committed"))
            .select(F.lit("raw-events").alias("topic"), "partition",
                    F.when(F.col("partition") != 3, F.col("committed")).cast("long").alias("committed"), F.col("latest").cast("long")))
