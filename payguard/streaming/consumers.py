"""Independent stream consumers (T16), one query and checkpoint each:

* ``copy_stream`` (S3): raw events copied verbatim to the audit location;
* ``archive_stream`` (S4/S5): append new rows per key (J4) into an archive;
* ``ban_materializer_stream`` (S6): BLOCK decisions -> ban store state (T9)
  and audit rows (S8b);
* ``alert_stream`` (S7/T11): records -> decode, duplicate check, cool-down, routing;
* ``dead_letter_stream`` (S7/S11): records that can't be decoded -> DLQ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payguard.config import RiskConfig
from payguard.operators import alerts as A
from payguard.operators import archive as AR
from payguard.operators import bans as BN
from payguard.operators import dlq as DQ
from payguard.session import start_stream
from payguard.streaming import keyed_state as K
from payguard.streaming.processors import ban_stream


def _start(df: DataFrame, checkpoint: str, trigger: dict | None, sink) -> StreamingQuery:
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return start_stream(df.sparkSession, w.trigger(**(trigger or {"processingTime": "30 seconds"})))


def copy_stream(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """S3: pass-through copy with its own checkpoint (own consumer group)."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return start_stream(stream.sparkSession, q.trigger(**(trigger or {"processingTime": "30 seconds"})))


def archive_stream(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str,
                   trigger: dict | None = None, ts_col: str = "ts") -> StreamingQuery:
    """Idempotent archive by event date; a replayed batch appends nothing
    new, and only the dates it touches are read."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        AR.append_idempotent(batch.withColumn("event_date", F.to_date(ts_col)), path, key, order, ["event_date"])
    return _start(stream, checkpoint, trigger, sink)


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def ban_materializer_stream(decisions: DataFrame, cfg: RiskConfig, out: str, checkpoint: str,
                            trigger: dict | None = None) -> StreamingQuery:
    """BLOCK decisions -> ban set calls (stateful T9) in ``ban_sets``, and one
    audit row per decision in ``ban_audit`` (S8b), also where the set was refused."""
    sets = ban_stream(BN.decisions_to_ban_requests(decisions, cfg))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        _replace_batch(batch, f"{out}/ban_sets", batch_id)
        audit = batch.select(
            F.col("request_key").alias("decision_id"), "user_id", "reason", "severity",
            F.timestamp_millis(F.col("ms") + F.col("ttl_seconds") * 1000).alias("expires_at"),
            F.lit(None).cast("timestamp").alias("cleared_at"), F.timestamp_millis("ms").alias("created_at"))
        AR.append_idempotent(audit, f"{out}/ban_audit", ["decision_id"], ["created_at"])
        batch.unpersist()
    return _start(sets, checkpoint, trigger, sink)


def alert_stream(records: DataFrame, cfg: RiskConfig, out: str, checkpoint: str,
                 trigger: dict | None = None, keep_ms: int | None = None) -> StreamingQuery:
    """S7/T11 over topic records: decode, duplicate check and cool-down in keyed state (ids are kept
    for good, or for ``keep_ms``), routing. Writes ``alert_log``, ``outcomes`` (a row per delivery) and
    ``sends``, a partition per micro-batch that a retry replaces; nothing written is read again. Records
    that can't be decoded are ``dead_letter_stream``'s. An alert without a time has its record's."""
    good = DQ.decode_alerts(records).filter(F.col("decode_error").isNull())
    at = F.coalesce("alert.created_at", "record_ts")
    alerts = good.select("alert.*", "partition", "offset", at.alias("at")).withColumn("created_at", F.col("at")).select(
        *[f.name for f in DQ.ALERT_PAYLOAD.fields], "partition", "offset", F.unix_millis("at").alias("ms"))
    judged = K.cooldown(K.first_deliveries(alerts, keep_ms), cfg.alert_cooldown_ms)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        _replace_batch(A.sends_table(batch.filter("allowed"), cfg), f"{out}/sends", batch_id)
        limited = ~F.col("duplicate") & ~F.col("allowed")
        _replace_batch(batch.select("alert_id", "partition", "offset", "duplicate", limited.alias("rate_limited")),
                       f"{out}/outcomes", batch_id)
        _replace_batch(A.log_rows(batch.filter("NOT duplicate"), cfg), f"{out}/alert_log", batch_id)
        batch.unpersist()
    return _start(judged, checkpoint, trigger, sink)


def dead_letter_stream(records: DataFrame, cfg: RiskConfig, out: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Records that can't be decoded go to ``dlq`` with their diagnostic headers."""
    return copy_stream(DQ.split_alert_records(records, cfg)[1], f"{out}/dlq", checkpoint, trigger)


__all__ = ["copy_stream", "archive_stream", "ban_materializer_stream", "alert_stream", "dead_letter_stream"]
