"""Dead letters: split undecodable alert records off to a DLQ table with
diagnostic headers (S11/T12), and the bounded replay tool (Q6: S12, P13,
L3, P14, P15).

Record-level failures are a column split (decode with ``from_json``, rows
whose required fields are missing go to the DLQ); infrastructure failures
are left to Spark's task retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.config import RiskConfig
from payguard.functions import (byte_length, header_last, header_upsert_many, header_value_str,
                                is_blank, iso_instant, parse_instant, retry_count_from_header,
                                severity_or_unknown, text_or_null, truncate_chars)

ALERT_PAYLOAD = T.StructType([T.StructField(n, t) for n, t in (
    ("alert_id", T.StringType()), ("decision_id", T.StringType()), ("event_id", T.StringType()),
    ("user_id", T.StringType()), ("risk_score", T.IntegerType()), ("severity", T.StringType()),
    ("reason_summary", T.StringType()), ("created_at", T.TimestampType()), ("source", T.StringType()))])
DELIVERY_ATTEMPT = "kafka_deliveryAttempt"


def decode_alerts(records: DataFrame) -> DataFrame:
    """Decode the value (PERMISSIVE: bad payload -> null fields);
    ``decode_error`` is null for good rows."""
    text = text_or_null(F.coalesce("value", F.lit(b"")))
    dec = records.withColumn("alert", F.from_json(text, ALERT_PAYLOAD, {"mode": "PERMISSIVE"}))
    ok = F.col("alert.alert_id").isNotNull() & F.col("alert.user_id").isNotNull() & F.col("alert.severity").isNotNull()
    return dec.withColumn("decode_error", F.when(~ok, F.lit("payload could not be decoded as an alert")))


def publish_to_dlq(failed: DataFrame, cfg: RiskConfig, dlq_topic: str = "alert-events-dlq",
                   failed_at: Column | None = None, message: Column | None = None) -> DataFrame:
    """Failed record -> DLQ record with the original key, value (null ->
    empty bytes) and headers, plus 5 upserted headers. ``failed_at``
    defaults to the record time so replays are byte-equal."""
    failed_at = failed_at if failed_at is not None else F.col("record_ts")
    message = message if message is not None else F.col("decode_error")
    value = F.coalesce(F.col("value"), F.lit(b""))
    from_payload = F.when(F.length(value) > 0, F.coalesce(
        header_value_str("headers", "severity"),
        F.get_json_object(text_or_null(value), "$.severity")))
    severity = severity_or_unknown(from_payload)
    attempt = header_last("headers", DELIVERY_ATTEMPT)
    staged = failed.select("*", severity.alias("_sev"), attempt.alias("_attempt"), value.alias("_value"))
    h = header_upsert_many("headers", [
        ("x-exception-message", truncate_chars(message, cfg.dlq_message_max_chars)),
        ("x-retry-count", retry_count_from_header(F.col("_attempt"), cfg.alert_max_retries).cast("string")),
        ("x-original-topic", F.col("topic")),
        ("x-failed-at", iso_instant(failed_at)),
        ("severity", F.col("_sev")),
    ])
    return staged.select(F.lit(dlq_topic).alias("topic"), "partition", "offset", "key",
                         F.col("_value").alias("value"), h.alias("headers"), F.col("_sev").alias("severity"))


def split_alert_records(records: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """(decoded good alerts, DLQ records)."""
    dec = decode_alerts(records)
    good = dec.filter(F.col("decode_error").isNull()).select("alert.*", "partition", "offset")
    bad = publish_to_dlq(dec.filter(F.col("decode_error").isNotNull()), cfg)
    return good, bad


def dlq_match(dlq: DataFrame, original_topic: str | None = None, severity: str | None = None,
              failed_after: str | None = None, failed_before: str | None = None) -> Column:
    """Null-safe DLQ filter; bounds are inclusive; a missing or
    unparseable failed-at header fails only when a bound is set."""
    cond = F.lit(True)
    if original_topic is not None:
        cond = cond & F.coalesce(header_value_str("headers", "x-original-topic") == F.lit(original_topic),
                                 F.lit(False))
    if severity is not None:
        cond = cond & F.coalesce(F.lower(header_value_str("headers", "severity")) == F.lit(severity.lower()),
                                 F.lit(False))
    if failed_after is not None or failed_before is not None:
        at = parse_instant(header_value_str("headers", "x-failed-at"))
        ok = at.isNotNull()
        if failed_after is not None:
            ok = ok & (at >= parse_instant(F.lit(failed_after)))
        if failed_before is not None:
            ok = ok & (at <= parse_instant(F.lit(failed_before)))
        cond = cond & F.coalesce(ok, F.lit(False))
    return cond


def _dash(c: Column) -> Column:
    return F.when(c.isNull() | is_blank(c), F.lit("-")).otherwise(c)


def summarize(dlq: DataFrame) -> DataFrame:
    """One summary row per DLQ record."""
    return dlq.select(
        "topic", "partition", "offset",
        _dash(header_value_str("headers", "x-original-topic")).alias("original_topic"),
        _dash(header_value_str("headers", "x-failed-at")).alias("failed_at"),
        _dash(header_value_str("headers", "severity")).alias("severity"),
        _dash(header_value_str("headers", "x-retry-count")).alias("retry_count"),
        byte_length("key").alias("key_bytes"), byte_length("value").alias("value_bytes"))


def replay(dlq: DataFrame, target_topic: str, *, original_topic: str | None = None,
           severity: str | None = None, failed_after: str | None = None, failed_before: str | None = None,
           max_messages: int | None = 100, execute: bool = False, operator: str | None = None,
           replayed_at: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Q6: scan -> filter -> first ``max_messages`` by (partition, offset), all
    if None -> (summaries, replay records or None on a dry run)."""
    if execute and (operator is None or not operator.strip()):
        raise ValueError("operator is required when executing a replay")
    picked = dlq.filter(dlq_match(dlq, original_topic, severity, failed_after, failed_before))
    if max_messages is not None:
        picked = picked.orderBy("partition", "offset").limit(max_messages)
    if not execute:
        return summarize(picked), None
    at = F.lit(replayed_at) if replayed_at else iso_instant(F.current_timestamp())
    h = header_upsert_many("headers", [("x-replayed-at", at), ("x-replayed-by", F.lit(operator))])
    records = picked.select(F.lit(target_topic).alias("topic"), "key", "value", h.alias("headers"),
                            F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"))
    return summarize(picked), records
