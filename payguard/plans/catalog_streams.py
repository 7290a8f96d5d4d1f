"""Registered queries, part 4: streams. The given events are written as a
source of three time ranges, one after the other; after each, the stream is
started from its checkpoint and takes all that has arrived, so every row
passes through state that was stored and restored. Results are read from the streams'
sinks; their SQL works on whole tables, with rows of one instant in order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from payguard.config import TESTDATA_CONFIG as CFG
from payguard.functions import join_reasons
from payguard.operators import bans as BN
from payguard.operators import ingest as ING
from payguard.plans import catalog as C
from payguard.plans import catalog_ops as CO
from payguard.plans.oracle import RISK_EVENTS, scored_cte, uuid3, with_
from payguard.plans.oracle_pipelines import DECODED_LOG, DECODED_OUTCOMES, DECODED_SENDS, Q3_ADMISSION, _asof, _rule_ctes
from payguard.operators.rules import PARAMS
from payguard.session import cut_lineage, run_folder, start_stream
from payguard.sources import testdata as TD
from payguard.streaming import consumers as CS
from payguard.streaming import keyed_state as K
from payguard.streaming import pipeline as SP
from payguard.streaming import windowed as WS

TURNS = 3
NOW = {"availableNow": True}


def in_turns(rows: DataFrame, folder: str, start: Callable[[str, int], StreamingQuery], turns: int = TURNS, ms: str = "ms",
             last: DataFrame | None = None) -> None:
    """Write ``rows`` to ``folder``/src by time ranges (then ``last``), and after each run the stream
    that ``start(source, turn)`` starts until it has taken them. The rows are worked out once."""
    rows = cut_lineage(rows, "arrived")
    cuts = rows.agg(F.percentile_approx(ms, [k / turns for k in range(1, turns)], 10_000)).first()[0] or []
    turn = sum((F.when(F.col(ms) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    parts = [rows.filter(turn == k) for k in range(len(cuts) + 1)] + ([last] if last is not None else [])
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/src/turn-{k}")
        q = start(f"{folder}/src/*", k)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


def _to_files(df: DataFrame, folder: str) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    return start_stream(df.sparkSession, w.outputMode("append").trigger(**NOW))


def _source(spark: SparkSession, schema: T.StructType, source: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(source)


def _streamed(spark: SparkSession, label: str, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str,
              last: DataFrame | None = None) -> DataFrame:
    """Rows of ``operator`` over the stream of ``rows`` (of type ``out``)."""
    folder = run_folder(spark, label)
    in_turns(rows, folder, lambda source, k: _to_files(operator(_source(spark, rows.schema, source)), folder), last=last)
    return spark.read.schema(out).parquet(f"{folder}/out")


def t02_stream_burst(spark, sf):
    """W1 in keyed state with an entry per user."""
    ev = C._events(spark, sf).select("event_id", "merchant_id", "user_id", "ms", "seq")
    return _streamed(spark, "t02", ev, lambda s: K.burst(s, CFG.burst_window_ms, columns=("event_id", "merchant_id")),
                     "event_id string, merchant_id string, merchant_users long")


def w03_stream_velocity(spark, sf):
    """W3 in keyed state: the events of a user's last seven days."""
    ev = C._events(spark, sf).select("event_id", "user_id", "ms", "seq")
    return _streamed(spark, "w03", ev, lambda s: K.velocity(s, CFG.velocity_window_ms, ("event_id", "user_id")),
                     "event_id string, user_id string, velocity_7d long")


def t08_stream_limit(spark, sf):
    """W2 in keyed state with an entry per request id."""
    ev = C._events(spark, sf).select("event_id", "user_id", "request_id", "ms", "seq")
    return _streamed(spark, "t08", ev, lambda s: K.rate_limit(s, CFG.rate_limit_window_ms, CFG.rate_limit),
                     "event_id string, rate_count long, rate_blocked boolean")


def _scored_stream(spark, sf, label, rows, rules):
    folder = run_folder(spark, label)
    TD.user_profiles(C._events(spark, sf)).write.parquet(f"{folder}/profiles")
    in_turns(rows, folder, lambda source, k: SP.score_stream(
        spark, source, f"{folder}/out", CFG, f"{folder}/checkpoint", profiles_path=f"{folder}/profiles", trigger=NOW, rules_in_stream=rules))
    return folder


def _decisions(spark, folder):
    d = spark.read.parquet(f"{folder}/out/decisions")
    return d.select("decision_id", "event_id", "request_id", "user_id", "decision", "risk_score", join_reasons("reasons").alias("reason_summary"),
                    F.col("ms").alias("created_at_ms"))


def q1_stream(spark, sf):
    """Q1 as a stream: velocity, burst, profiles, scoring, sinks."""
    return _decisions(spark, _scored_stream(spark, sf, "q1", C._events(spark, sf), False))


def q1_stream_rules(spark, sf):
    """Q1 with rule updates in the stream of events."""
    none = F.lit(None).cast("string").alias("rule")
    records = C._events(spark, sf).select(*[f.name for f in SP.EVENT_STREAM_SCHEMA.fields], none).unionByName(SP.rule_records(TD.rule_updates(spark)))
    return _decisions(spark, _scored_stream(spark, sf, "q1-rules", records, True))


def q3_stream(spark, sf):
    """Q3 as a stream: ban sets and calls of a user in one order."""
    ev, req = C._ban_requests(spark, sf)
    nothing = F.lit(None)
    calls = ING.violations(ING.normalize_requests(ev)).select(
        "user_id", "event_id", "request_id", "ms", "seq", F.lit(False).alias("is_ban"), nothing.cast("int").alias("severity"),
        nothing.cast("string").alias("reason"), nothing.cast("long").alias("ttl_seconds"), F.array_join("violations", ",").alias("violations"))
    sets = req.select("user_id", F.col("request_key").alias("event_id"), nothing.cast("string").alias("request_id"), F.unix_millis("ts").alias("ms"),
                      "seq", F.lit(True).alias("is_ban"), F.col("severity").cast("int").alias("severity"), "reason",
                      F.col("ttl_seconds").cast("long").alias("ttl_seconds"), F.lit("").alias("violations"))
    return _streamed(spark, "q3", calls.unionByName(sets), lambda s: K.admission(s, CFG.rate_limit_window_ms, CFG.rate_limit),
                     "event_id string, user_id string, status string, reason string, rate_limit_count long")


def s09_accepted_events(spark, sf):
    """The admitted requests, published as raw events."""
    out = ING.accepted_events(CO._admission(spark, sf))
    return out.select("event_id", "request_id", "user_id", "event_type", "amount_cents", "ms")


def d1_stream(spark, sf):
    """D1 as a stream: an automaton per user, cleared by event-time timers."""
    ev = C._events(spark, sf).select("event_id", "user_id", "event_type", "amount_cents", "ts", "ms", "seq")
    return _streamed(spark, "d1", ev, lambda s: K.sequence(s.withWatermark("ts", "1 hour"), "LOGIN", "BEHAVIOUR", "WITHDRAWAL", 7 * CO.DAY),
                     "event_id string, user_id string, ms long, second_ms long, first_ms long")


def _ticks(rows: DataFrame, days: int) -> DataFrame:
    """A last record long after the others, without a user: it moves the watermark past every window."""
    end = rows.agg((F.max("ms") + days * CO.DAY).alias("ms"))
    known = {"ms": F.col("ms"), "ts": F.timestamp_millis("ms"), "created_at": F.timestamp_millis("ms")}
    return end.select(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields])


def d2_stream(spark, sf):
    """D2 as a stream: tumbling days in append mode, closed by the watermark."""
    d = C.scored(spark, sf).decisions.select("user_id", "risk_score", "created_at", "ms")
    out = _streamed(spark, "d2", d.unionByName(_ticks(d, 3)).unionByName(_ticks(d, 4)), lambda s: WS.user_scores(s, "created_at", "1 day", "1 hour"),
                    "window_start_ms long, user_id string, max_score int, avg_score double, decisions long", last=_ticks(d, 5))
    return out.filter("user_id IS NOT NULL")


def a10_stream(spark, sf):
    """A10 as a stream, each event delivered twice: duplicates go within the watermark, then
    records are counted per window."""
    ev = C._events(spark, sf).select("event_id", "ts", "ms")
    twice = ev.unionByName(ev.filter(F.xxhash64("event_id") % 2 == 0))
    out = _streamed(spark, "a10", twice.unionByName(_ticks(ev, 3)), lambda s: WS.throughput(s, "1 minute", "1 hour"),
                    "window_start_ms long, records long, per_second double", last=_ticks(ev, 4))
    first = ev.agg(F.max("ms")).first()[0]  # windows of the ticks go
    return out.filter(F.col("window_start_ms") <= first)


def s03_stream_copy(spark, sf):
    """S3: records copied verbatim by a consumer of their own."""
    records = TD.alert_records(C.scored(spark, sf).alerts)
    folder = run_folder(spark, "s03")
    in_turns(records.withColumn("ms", F.unix_millis("record_ts")), folder, lambda source, k: CS.copy_stream(
        _source(spark, records.schema, source), f"{folder}/out", f"{folder}/checkpoint", NOW))
    out = spark.read.schema(records.schema).parquet(f"{folder}/out")
    return out.select("topic", "partition", "offset", F.decode("key", "UTF-8").alias("key"), F.md5("value").alias("value_md5"))


def s04_stream_archive(spark, sf):
    """S4 as a stream, each turn with rows of earlier ones again: every event is archived once."""
    ev = C._events(spark, sf)
    folder = run_folder(spark, "s04")
    again = ev.filter(F.col("seq") % 10 == 0).withColumn("ms", F.col("ms") + 9 * CO.DAY)  # arrive nine days later
    in_turns(ev.unionByName(again), folder, lambda source, k: CS.archive_stream(
        _source(spark, ev.schema, source), f"{folder}/out", ["event_id"], ["ms", "seq"], f"{folder}/checkpoint", NOW))
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", F.unix_millis("ts").alias("ts_ms"))


def s05_stream_archive_decisions(spark, sf):
    """The decisions archive, with its array column."""
    d = C.scored(spark, sf).decisions
    folder = run_folder(spark, "s05")
    in_turns(d, folder, lambda source, k: CS.archive_stream(
        _source(spark, d.schema, source), f"{folder}/out", ["decision_id"], ["ms", "seq"], f"{folder}/checkpoint", NOW, ts_col="created_at"))
    return spark.read.parquet(f"{folder}/out").select("decision_id", "event_id", "decision", F.array_join("reasons", "|").alias("reasons"),
                                                      F.col("ms").alias("created_at_ms"))


def s06_stream_bans(spark, sf):
    """BLOCK decisions to ban sets in keyed state, and audit rows."""
    d = C.scored(spark, sf).decisions
    folder = run_folder(spark, "s06")
    in_turns(d, folder, lambda source, k: CS.ban_materializer_stream(
        _source(spark, d.schema, source), CFG, f"{folder}/out", f"{folder}/checkpoint", NOW))
    sets = spark.read.parquet(f"{folder}/out/ban_sets").select(F.col("request_key").alias("decision_id"), "accepted", "expires_ms")
    audit = spark.read.parquet(f"{folder}/out/ban_audit")
    return audit.join(sets, "decision_id").select("decision_id", "user_id", "reason", "accepted", "expires_ms",
                                                  F.unix_millis("expires_at").alias("audit_expires_ms"))


def _alert_streams(spark, sf, label, start):
    """Streams over the alert records, every tenth of them delivered again nine days later."""
    cfg, alerts = C._spread_alerts(spark, sf)
    records = TD.alert_records(alerts).withColumn("ms", F.unix_millis("record_ts"))
    # an explode, not a union, so that the records are worked out once
    times = F.when(F.col("offset") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    records = records.withColumn("_again", F.explode(times)).withColumn("offset", F.col("offset") + F.col("_again") * F.lit(AGAIN)).withColumn(
        "ms", F.col("ms") + F.col("_again") * F.lit(9 * CO.DAY)).drop("_again")
    folder = run_folder(spark, label)
    in_turns(records, folder, lambda source, k: start(
        _source(spark, records.drop("ms").schema, source), cfg, f"{folder}/out", f"{folder}/checkpoint", NOW))
    return f"{folder}/out"


def s07_stream_alerts(spark, sf):
    """The alert log of a stream of records."""
    log = spark.read.parquet(_alert_streams(spark, sf, "s07", CS.alert_stream) + "/alert_log")
    return log.select("alert_id", "user_id", "severity", "status", F.array_join("channels_notified", ",").alias("channels"),
                      F.unix_millis("created_at").alias("created_at_ms"))


def s07_stream_outcomes(spark, sf):
    """What became of each delivery of that stream."""
    out = spark.read.parquet(_alert_streams(spark, sf, "s07-outcomes", CS.alert_stream) + "/outcomes")
    return out.select("alert_id", (F.col("offset") >= AGAIN).alias("again"), "duplicate", "rate_limited")


def s07_stream_sends(spark, sf):
    """What that stream sends."""
    sends = spark.read.parquet(_alert_streams(spark, sf, "s07-sends", CS.alert_stream) + "/sends")
    return sends.select("alert_id", "channel", "position", "message")


def s11_stream_dlq(spark, sf):
    """The dead letters of that stream."""
    bad = spark.read.parquet(_alert_streams(spark, sf, "s11", CS.dead_letter_stream) + "/dlq")
    return bad.select("partition", "offset", F.decode("key", "UTF-8").alias("key"), "severity",
                      F.size("headers").cast("long").alias("headers"), F.length("value").cast("long").alias("value_bytes"))


AGAIN = 10 ** 12  # offsets of second deliveries start there


QUERIES = {f.__name__: f for f in (
    s07_stream_alerts, s07_stream_outcomes, s07_stream_sends, s11_stream_dlq,
    t02_stream_burst, w03_stream_velocity, t08_stream_limit, q1_stream, q1_stream_rules, q3_stream, s09_accepted_events, d1_stream, d2_stream,
    a10_stream, s03_stream_copy, s04_stream_archive, s05_stream_archive_decisions, s06_stream_bans)}


# --- SQL: rows of one instant count in order of arrival ------------------------------

_AT = "(ms - 1700000000000) * 10000000 + seq"

ARRIVED = f"""
features AS (
  SELECT e.*,
         CASE WHEN merchant_id IS NULL THEN 0 ELSE count(DISTINCT user_id) OVER (
           PARTITION BY merchant_id ORDER BY {_AT} RANGE BETWEEN {CFG.burst_window_ms * 10**7} + seq PRECEDING AND CURRENT ROW) END AS merchant_users,
         count(*) OVER (PARTITION BY user_id ORDER BY {_AT}
           RANGE BETWEEN {CFG.velocity_window_ms * 10**7} + seq PRECEDING AND CURRENT ROW) AS velocity_7d,
         (user_num % 37 = 0) AS blacklisted
  FROM risk_events e)"""

_DECISION_OUT = "\nSELECT decision_id, event_id, request_id, user_id, decision, risk_score, reason_summary, ms AS created_at_ms FROM scored"


def all_sql() -> dict[str, str]:
    from payguard.plans import oracle, oracle_ops
    ops = oracle_ops.all_sql()
    q1 = with_(RISK_EVENTS, ARRIVED, scored_cte())
    alerts = q1 + ", " + f"""
alerts AS (SELECT {uuid3("'alert:' || decision_id")} AS alert_id, * FROM scored WHERE risk_score >= {CFG.alert_threshold})"""
    blocks = "SELECT *, 'ASYNC_RULE:' || decision_id AS why, row_number() OVER (PARTITION BY user_id ORDER BY ms, seq, decision_id) AS rn FROM scored WHERE decision = 'BLOCK'"
    hold = CFG.ban_ttl_seconds * 1000
    return {
        "t02_stream_burst": with_(RISK_EVENTS, ARRIVED) + "\nSELECT event_id, merchant_id, CAST(merchant_users AS BIGINT) AS merchant_users FROM features",
        "w03_stream_velocity": with_(RISK_EVENTS, ARRIVED) + "\nSELECT event_id, user_id, velocity_7d FROM features",
        "t08_stream_limit": "SELECT event_id, rate_count, rate_blocked FROM (" + oracle.W2_RATE + ")",
        "q1_stream": q1 + _DECISION_OUT,
        "q1_stream_rules": "WITH " + RISK_EVENTS + "," + ARRIVED + "," + _rule_ctes() + "," + _asof() + "," + scored_cte(
            {p: f"p_{p}" for p in PARAMS}, source="fv") + _DECISION_OUT,
        "q3_stream": Q3_ADMISSION,
        "s09_accepted_events": "SELECT a.event_id, request_id, user_id, event_type, amount_cents, ms FROM (" + Q3_ADMISSION.replace(
            "SELECT event_id, user_id, CASE WHEN cnt", "SELECT event_id, CASE WHEN cnt").replace(
            "SELECT event_id, user_id, 'BLOCKED', 'blacklist:'", "SELECT event_id, 'BLOCKED', 'blacklist:'") + ") a JOIN ("
            + with_(RISK_EVENTS) + " SELECT * FROM risk_events) e USING (event_id) WHERE a.status = 'ACCEPTED'",
        "d1_stream": ops["d1_sequence_wide"],
        "d2_stream": ops["d2_user_daily_score"],
        "a10_stream": ops["a10_throughput"],
        "s03_stream_copy": None,
        "s07_stream_alerts": DECODED_LOG,
        "s07_stream_outcomes": DECODED_OUTCOMES,
        "s07_stream_sends": DECODED_SENDS,
        "s11_stream_dlq": oracle_ops.S11_STREAM,
        "s04_stream_archive": with_(RISK_EVENTS) + "\nSELECT event_id, user_id, ms AS ts_ms FROM risk_events",
        "s05_stream_archive_decisions": q1 + "\nSELECT decision_id, event_id, decision, replace(reason_summary, ',', '|') AS reasons, ms AS created_at_ms FROM scored",
        "s06_stream_bans": ("WITH RECURSIVE " + q1.removeprefix("WITH ") + f""",
b AS ({blocks}),
walk AS (
  SELECT user_id, rn, TRUE AS accepted, ms + {hold} AS until FROM b WHERE rn = 1
  UNION ALL
  SELECT b.user_id, b.rn, b.ms >= w.until, CASE WHEN b.ms >= w.until THEN b.ms + {hold} ELSE w.until END
  FROM walk w JOIN b ON b.user_id = w.user_id AND b.rn = w.rn + 1)
SELECT decision_id, user_id, why AS reason, accepted, CASE WHEN accepted THEN ms + {hold} END AS expires_ms, ms + {hold} AS audit_expires_ms
FROM b JOIN walk USING (user_id, rn)"""),
    }
