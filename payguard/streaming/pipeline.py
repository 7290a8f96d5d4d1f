"""Streaming Q1: records in -> velocity per user and burst per merchant in keyed
state -> per-micro-batch profile lookup, rules, scoring -> decision / high-risk /
alert sinks.

* Source (S1): a file stream with the declared schema (the Kafka source and
  Avro functions are not on this classpath; ``readStream.format('kafka')``
  plugs in at the same place).
* State (T2, W3): ``keyed_state``, one shuffle by user and one by merchant. Rows without a key
  pass through them, so no branch reads the source again.
* Rules (S2, T3): either rule updates come as records of the same ordered stream
  (``RECORD_SCHEMA``), and each micro-batch starts from the latest state of each rule that the
  one before left, so an update in the middle of a micro-batch applies from its place on; or
  the rule log is a table, read again each micro-batch.
* Sinks (S8, T7): ``foreachBatch`` writes each output into a ``batch_id=N``
  partition with dynamic partition overwrite, so a retried batch replaces
  its own output (idempotent); ids are deterministic (F4) for downstream
  de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from payguard import schemas
from payguard.config import RiskConfig
from payguard.operators import rules as R
from payguard.operators import scoring as S
from payguard.plans.scoring import lookup_profiles
from payguard.session import path_exists, start_stream
from payguard.streaming import keyed_state as K

EVENT_STREAM_SCHEMA = T.StructType(schemas.RISK_EVENT.fields + [
    T.StructField("seq", T.LongType()), T.StructField("ms", T.LongType())])
#: An event, or a rule update as JSON in ``rule`` (then only ``ms`` and ``seq`` beside it).
RECORD_SCHEMA = T.StructType(EVENT_STREAM_SCHEMA.fields + [T.StructField("rule", T.StringType())])


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 watermark: str | None = None, schema: T.StructType = EVENT_STREAM_SCHEMA) -> DataFrame:
    """S1 (+ T1 when ``watermark`` is given, e.g. ``"5 seconds"``: bounded
    out-of-orderness on the event time, for windowed aggregations and
    de-duplication downstream; the keyed processors keep their own max)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:  # unset: a trigger takes all that has arrived
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(path)
    return df.withWatermark("ts", watermark) if watermark else df


def rule_records(updates: DataFrame) -> DataFrame:
    """Rule updates as records of the stream, at their time."""
    fields = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields}
    fields |= {"ts": F.col("updated_at").alias("ts"), "ms": F.unix_millis("updated_at").alias("ms"),
               "seq": F.col("log_offset").cast("long").alias("seq"),
               "rule": F.to_json(F.struct(*[f.name for f in schemas.RULE_UPDATE.fields])).alias("rule")}
    return updates.select(*fields.values())


def _write_partition(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _rules_so_far(spark: SparkSession, updates: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The state of each rule before this micro-batch, and its updates."""
    before = f"{path}/batch_id={batch_id - 1}"
    if batch_id and path_exists(spark, before):
        return spark.read.schema(schemas.RULE_UPDATE).parquet(before).unionByName(updates)
    return updates


def _keep_rules(known: DataFrame, path: str, batch_id: int) -> None:
    fields = [f.name for f in schemas.RULE_UPDATE.fields]
    latest = known.groupBy("rule_id").agg(F.max_by(F.struct(*fields), F.struct("updated_at", "log_offset")).alias("r"))
    latest.select("r.*").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def score_stream(spark: SparkSession, source: str, out_dir: str, cfg: RiskConfig, checkpoint: str,
                 profiles_path: str | None = None, rules_path: str | None = None,
                 lag_ms: int = 0, trigger: dict | None = None, rules_may_be_absent: bool = False,
                 rules_in_stream: bool = False, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Streaming Q1. With ``rules_in_stream`` the source holds records (events and rule updates in
    one order). Else the rule log at ``rules_path``, if given, is read each micro-batch; a
    missing one fails the query unless ``rules_may_be_absent`` (then the static rules apply until it exists)."""
    schema = RECORD_SCHEMA if rules_in_stream else EVENT_STREAM_SCHEMA
    records = event_stream(spark, source, max_files_per_trigger, schema=schema)
    # the processors carry the whole row, so no stream-stream join is needed
    names = tuple(f.name for f in schema.fields)
    fast = K.velocity(records, cfg.velocity_window_ms, names)
    stream = K.burst(fast, cfg.burst_window_ms, lag_ms, (*names, "velocity_7d"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        profiles = spark.read.parquet(profiles_path) if profiles_path else None
        events = batch.filter(F.col("rule").isNull()).drop("rule") if rules_in_stream else batch
        ev, params = lookup_profiles(events, profiles), R.dynamic_params()
        if rules_in_stream:
            updates = batch.filter(F.col("rule").isNotNull()).select(F.from_json("rule", schemas.RULE_UPDATE).alias("r")).select("r.*")
            known = _rules_so_far(spark, updates, f"{out_dir}/rule_state", batch_id)
            _keep_rules(known, f"{out_dir}/rule_state", batch_id)
            ev = R.apply_rule_log(ev, known, cfg)
        elif rules_path and not (rules_may_be_absent and not path_exists(spark, rules_path)):
            ev = R.apply_rule_log(ev, spark.read.parquet(rules_path), cfg)
        else:
            params = R.static_params(cfg)
        decs = S.decisions(S.evaluate(ev, params, cfg)).persist()
        _write_partition(decs, f"{out_dir}/decisions", batch_id)
        _write_partition(S.high_risk(decs, cfg.high_risk_threshold), f"{out_dir}/high_risk", batch_id)
        _write_partition(S.alerts(decs, cfg.alert_threshold), f"{out_dir}/alerts", batch_id)
        decs.unpersist()
        batch.unpersist()

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return start_stream(spark, w.trigger(**(trigger or {"processingTime": "30 seconds"})))
