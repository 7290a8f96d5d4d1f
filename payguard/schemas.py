"""Declared record schemas (nothing is inferred) and ``conform``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
STR_ARRAY = T.ArrayType(S)
STR_MAP = T.MapType(S, S)
HEADERS = T.ArrayType(T.StructType([T.StructField("key", S), T.StructField("value", T.BinaryType())]))


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


RISK_EVENT = _st(
    ("event_id", S, False), ("request_id", S, False), ("user_id", S, False),
    ("event_type", S, False), ("ts", TS, False), ("amount_cents", L, False),
    ("currency", S, False), ("ip_address", S, True), ("device_fp", S, True),
    ("merchant_id", S, True), ("counterparty", S, True), ("source", S, False),
)

INGEST_REQUEST = _st(
    ("event_id", S, True), ("request_id", S, True), ("user_id", S, True),
    ("event_type", S, True), ("ts", TS, True), ("amount_cents", L, True),
    ("currency", S, True), ("ip_address", S, True), ("device_fp", S, True),
    ("merchant_id", S, True), ("counterparty", S, True), ("source", S, True),
)

DECISION = _st(
    ("decision_id", S, False), ("event_id", S, False), ("request_id", S, False),
    ("user_id", S, False), ("decision", S, False), ("risk_score", I, False),
    ("reasons", STR_ARRAY, False), ("created_at", TS, False), ("source", S, False),
)

HIGH_RISK_EVENT = _st(
    ("high_risk_event_id", S, False), ("decision_id", S, False), ("event_id", S, False),
    ("request_id", S, False), ("user_id", S, False), ("merchant_id", S, True),
    ("risk_score", I, False), ("reasons", STR_ARRAY, False), ("created_at", TS, False),
    ("source", S, False),
)

ALERT = _st(
    ("alert_id", S, False), ("decision_id", S, False), ("event_id", S, False),
    ("user_id", S, False), ("risk_score", I, False), ("severity", S, False),
    ("reason_summary", S, False), ("created_at", TS, False), ("source", S, False),
)

RULE_UPDATE = _st(
    ("rule_id", S, False), ("rule_type", S, False), ("enabled", B, False),
    ("parameters", STR_MAP, True), ("updated_at", TS, False), ("log_offset", L, True),
)

RULE = _st(
    ("rule_id", S, False), ("rule_type", S, False), ("parameters", STR_MAP, True),
    ("enabled", B, False), ("created_at", TS, False), ("updated_at", TS, False),
)

RULE_OUTBOX = _st(
    ("id", L, False), ("rule_id", S, False), ("payload", S, False),
    ("created_at", TS, False), ("published_at", TS, True),
)

USER_PROFILE = _st(("user_id", S, False), ("blacklisted", B, True), ("velocity_7d", I, True))

BAN_REQUEST = _st(
    ("user_id", S, False), ("reason", S, False), ("severity", I, False),
    ("ttl_seconds", L, False), ("ts", TS, False),
)

AUDIT_BAN = _st(
    ("id", L, True), ("decision_id", S, False), ("user_id", S, False), ("reason", S, False),
    ("severity", I, False), ("expires_at", TS, True), ("cleared_at", TS, True),
    ("created_at", TS, False),
)

ALERT_LOG = _st(
    ("alert_id", S, False), ("user_id", S, False), ("severity", S, False),
    ("reason_summary", S, True), ("status", S, False), ("channels_notified", STR_ARRAY, True),
    ("created_at", TS, False), ("processed_at", TS, True),
)

KAFKA_RECORD = _st(
    ("topic", S, False), ("partition", I, False), ("offset", L, False),
    ("key", T.BinaryType(), True), ("value", T.BinaryType(), True), ("headers", HEADERS, True),
)

OFFSETS = _st(("topic", S, False), ("partition", I, False), ("committed", L, True), ("latest", L, True))

def default_columns() -> dict[str, Column]:
    """Defaults filled by ``conform`` for columns that producers may omit."""
    return {"source": F.lit("api-gateway"), "parameters": F.create_map().cast(STR_MAP)}


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, fill missing
    nullable or defaulted ones, reject missing non-null columns.

    Backward-compatible evolution = new nullable or defaulted columns.
    """
    defaults = {**default_columns(), **(defaults or {})}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, defaults[f.name])
            cols.append(c.cast(f.dataType).alias(f.name))
        elif f.name in defaults:
            cols.append(defaults[f.name].cast(f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"missing non-null column {f.name!r} for schema")
    return df.select(*cols)
