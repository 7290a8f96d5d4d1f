"""Registered queries, part 5: point reads, archive layout, record codec, publish order
and the stored form of bans, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard import schemas
from payguard.functions import ban_value_reason, ban_value_severity, join_reasons, stable_id
from payguard.plans import catalog as C
from payguard.plans.oracle import RISK_EVENTS, uuid3
from payguard.session import cut_lineage, run_folder
from payguard.sources import io as IO
from payguard.sources.tables import Tables


def s13_point_reads(spark, sf):
    """The alert log looked up by the ids of all decisions to review or block; those without an alert have no status."""
    log, _, _ = C._alerts_processed(spark, sf)
    tables = Tables(spark, run_folder(spark, "alert-log"), {"log": ["alert_id"]}, buckets=64)
    tables.commit({"log": log}, 0)
    asked = C.scored(spark, sf).decisions.filter("decision <> 'ALLOW'").select(stable_id("alert", "decision_id").alias("alert_id"))
    asked = cut_lineage(asked)
    found = tables.lookup("log", asked).select("alert_id", "user_id", "status", F.unix_millis("created_at").alias("created_at_ms"))
    return asked.join(found, "alert_id", "left")


def s16_archive(spark, sf):
    """Events written to the archive and read back, with the day each lies under."""
    folder = run_folder(spark, "archive")
    IO.write_archive(C._events(spark, sf), folder)
    back = spark.read.parquet(folder)
    return back.select("event_id", "user_id", F.unix_millis("ts").alias("ts_ms"), F.col("event_date").cast("string").alias("event_date"))


def published(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of a keyed publish with ``position`` (of the record among its key's) and
    ``partitions`` (over which the key's records lie)."""
    sent = cut_lineage(IO.keyed_for_publish(df, key).withColumn("_at", F.monotonically_increasing_id())
                       .withColumn("_part", F.spark_partition_id()))
    by_key = Window.partitionBy(key)
    return (sent.withColumn("position", F.row_number().over(by_key.orderBy("_at")).cast("long"))
            .withColumn("partitions", F.size(F.collect_set("_part").over(by_key)).cast("long")).drop("_at", "_part"))


def t15_keyed_publish(spark, sf):
    """Each user's events lie in one partition of the topic, in order of time and arrival."""
    ev = C._events(spark, sf).select("event_id", "user_id", "ts", "seq")
    return published(ev).select("event_id", "user_id", "position", "partitions")


def s15_record_round_trip(spark, sf):
    """Decisions as records (key: the user, value: all fields) and decoded again."""
    d = C.scored(spark, sf).decisions
    names = [f.name for f in schemas.DECISION.fields]
    back = IO.from_records(IO.as_records(d, value_cols=names), schemas.DECISION)
    return back.select(F.decode("key", "UTF-8").alias("user_key"), "record.decision_id", "record.event_id", "record.decision",
                       "record.risk_score", join_reasons("record.reasons").alias("reason_summary"),
                       F.unix_millis("record.created_at").alias("created_at_ms"))


def f12_ban_values(spark, sf):
    """stored ban values read back: with colons in the reason, without a severity, with an empty or a bad one."""
    kind, sev = F.col("seq") % 6, (F.col("seq") % 5 + 1).cast("string")
    value = (F.when(kind == 0, F.concat(F.lit("ASYNC_RULE:"), "event_id", F.lit(":"), sev)).when(kind == 1, F.concat("user_id", F.lit(":"), sev))
             .when(kind == 2, F.col("user_id")).when(kind == 3, F.concat("user_id", F.lit(":"))).when(kind == 4, F.concat(F.lit(":"), sev))
             .otherwise(F.concat("user_id", F.lit(":severe"))))
    return C._events(spark, sf).select("event_id", value.alias("value")).select(
        "event_id", "value", ban_value_reason("value").alias("reason"), ban_value_severity("value").cast("int").alias("severity"))


QUERIES = {f.__name__: f for f in (s13_point_reads, s16_archive, t15_keyed_publish, s15_record_round_trip, f12_ban_values)}


def all_sql() -> dict[str, str]:
    from payguard.plans import oracle_ops as OO
    from payguard.plans import oracle_pipelines as OP
    events = "WITH " + RISK_EVENTS
    return {
        "s13_point_reads": "WITH asked AS (" + OO.BASE + f" SELECT {uuid3("'alert:' || decision_id")} AS alert_id FROM scored WHERE decision <> 'ALLOW'),"
                           + " log AS (" + OP.Q4_ALERT_LOG + ") SELECT alert_id, user_id, status, created_at_ms FROM asked LEFT JOIN log USING (alert_id)",
        "s16_archive": events + """
SELECT event_id, user_id, ms AS ts_ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS event_date FROM risk_events""",
        "t15_keyed_publish": events + """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, seq) AS position, CAST(1 AS BIGINT) AS partitions
FROM risk_events""",
        "s15_record_round_trip": OO.BASE + """
SELECT user_id AS user_key, decision_id, event_id, decision, risk_score, reason_summary, ms AS created_at_ms FROM scored""",
        "f12_ban_values": events + """,
v AS (
  SELECT event_id, CASE seq % 6
    WHEN 0 THEN 'ASYNC_RULE:' || event_id || ':' || CAST(seq % 5 + 1 AS VARCHAR) WHEN 1 THEN user_id || ':' || CAST(seq % 5 + 1 AS VARCHAR)
    WHEN 2 THEN user_id WHEN 3 THEN user_id || ':' WHEN 4 THEN ':' || CAST(seq % 5 + 1 AS VARCHAR) ELSE user_id || ':severe' END AS value
  FROM risk_events),
c AS (SELECT *, length(value) - strpos(reverse(value), ':') + 1 AS colon, strpos(value, ':') > 0 AS has FROM v)
SELECT event_id, value, CASE WHEN has AND colon > 1 AND colon < length(value) THEN substr(value, 1, colon - 1) ELSE value END AS reason,
       CAST(CASE WHEN has AND colon > 1 AND colon < length(value) THEN coalesce(TRY_CAST(substr(value, colon + 1) AS INTEGER), 0) ELSE 0 END AS INTEGER) AS severity
FROM c""",
    }
