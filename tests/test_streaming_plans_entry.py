"""Streaming = batch for in-order input (T2, T8, T10, Q1 stream), restart from
checkpoint, plan shape (pruning, one exchange per window operator,
broadcast control data, no Python on the batch path) and the driver entry
contract against the DuckDB oracle on sf0.001."""

import datetime as dt
import os
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.config import TESTDATA_CONFIG as CFG
from payguard.operators import alerts as A
from payguard.operators import rules as R
from payguard.operators import scoring as S
from payguard.operators import windows as W
from payguard.plans import scoring as Q
from payguard.sources import testdata as TD
from payguard.streaming import keyed_state as K
from payguard.streaming import pipeline as SP
from payguard.streaming import processors as SPR

SF = "/root/testdata/sf0.001"


def _split_to_files(df, path, parts=3, order=("ms", "seq")):
    """Write ``df`` as ``parts`` time-ordered parquet files (one per trigger)."""
    pdf = df.orderBy(*order).toPandas()
    os.makedirs(path, exist_ok=True)
    n = len(pdf)
    for i in range(parts):
        chunk = pdf.iloc[i * n // parts:(i + 1) * n // parts]
        df.sparkSession.createDataFrame(chunk, schema=df.schema).coalesce(1).write.parquet(f"{path}/part={i}")
    return path


def _run(query_df, spark, name):
    d = tempfile.mkdtemp(dir="/tmp", prefix="pg-stream-")
    q = (query_df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{d}/ck").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def _stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(path)


def test_stream_burst_and_rate_equal_batch(spark):
    ev = TD.risk_events(spark, SF).cache()
    src = _split_to_files(ev, tempfile.mkdtemp(dir="/tmp", prefix="pg-src-"))
    stream = _stream_of(spark, src, ev.schema)
    keyed = stream.filter(F.col("merchant_id").isNotNull())
    got = _run(K.burst(keyed, CFG.burst_window_ms), spark, "burst_out")
    exp = W.merchant_burst(ev.filter(F.col("merchant_id").isNotNull()), CFG.burst_window_ms)
    assert {r.event_id: r.merchant_users for r in got.collect()} == {
        r.event_id: r.merchant_users for r in exp.collect()}
    got = _run(K.rate_limit(_stream_of(spark, src, ev.schema), CFG.rate_limit_window_ms, CFG.rate_limit), spark, "rate_out")
    exp = W.rate_limit(ev, CFG.rate_limit_window_ms, CFG.rate_limit)
    assert {r.event_id: (r.rate_count, r.rate_blocked) for r in got.collect()} == {
        r.event_id: (r.rate_count, r.rate_blocked) for r in exp.collect()}


def test_stream_cooldown_equals_batch(spark):
    ev = TD.risk_events(spark, "/root/testdata/sf0.01")
    alerts = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).alerts.cache()
    src = _split_to_files(alerts, tempfile.mkdtemp(dir="/tmp", prefix="pg-al-"), parts=4)
    deliveries = _stream_of(spark, src, alerts.schema).select(
        "alert_id", "user_id", "severity", "ms", F.lit(0).alias("partition"), F.col("seq").alias("offset"), F.lit(False).alias("duplicate"))
    got = _run(K.cooldown(deliveries, CFG.alert_cooldown_ms), spark, "cool")
    exp = A.cooldown(alerts, CFG)
    assert {r.alert_id: r.allowed for r in got.collect()} == {r.alert_id: r.allowed for r in exp.collect()}


def test_score_stream_end_to_end_and_restart(spark):
    ev = TD.risk_events(spark, SF).cache()
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-q1s-")
    src = f"{base}/src"
    os.makedirs(src)
    profiles = TD.user_profiles(ev)
    profiles.write.parquet(f"{base}/profiles")
    pdf = ev.orderBy("ms", "seq").toPandas()
    half = len(pdf) // 2
    spark.createDataFrame(pdf.iloc[:half], ev.schema).coalesce(1).write.parquet(f"{src}/a")
    q = SP.score_stream(spark, f"{src}/*", f"{base}/out", CFG, f"{base}/ck", profiles_path=f"{base}/profiles",
                        trigger={"availableNow": True})
    q.awaitTermination(300)
    spark.createDataFrame(pdf.iloc[half:], ev.schema).coalesce(1).write.parquet(f"{src}/b")
    q = SP.score_stream(spark, f"{src}/*", f"{base}/out", CFG, f"{base}/ck", profiles_path=f"{base}/profiles",
                        trigger={"availableNow": True})  # restarts from the checkpoint: keeps merchant state
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out/decisions")
    batch = W.merchant_burst(ev, CFG.burst_window_ms)
    batch = Q.lookup_profiles(W.velocity(batch, CFG.velocity_window_ms), profiles)
    exp = S.decisions(S.evaluate(batch, R.static_params(CFG), CFG))
    key = ["decision_id", "decision", "risk_score"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in exp.select(*key).collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_pruning_and_single_exchange(spark):
    from payguard.plans import catalog
    spark.catalog.clearCache()  # earlier tests cache the bound events
    ev = TD.risk_events(spark, SF)
    v = catalog.w3_velocity_7d(spark, SF)
    scan = [ln for ln in v._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln][0]
    assert "props" not in scan and "value" not in scan  # columns pruned through the window operator
    b = W.merchant_burst(ev.filter(F.col("merchant_id").isNotNull()), CFG.burst_window_ms)
    assert _plan(b.select("event_id", "merchant_users")).count("Exchange hashpartitioning") == 1


def test_plan_of_whole_scoring(spark):
    """Each key's rows are shuffled once, and no frame stays persisted."""
    spark.catalog.clearCache()
    ev = TD.risk_events(spark, SF)
    d = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).decisions
    plan = _plan(d)
    assert plan.count("FileScan") <= 3
    assert plan.count("hashpartitioning(_pg_mkey") == 1
    A.process_alerts(TD.alert_deliveries(Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).alerts), CFG)[0].collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_plan_no_python_and_broadcast_rules(spark):
    spark.catalog.clearCache()
    ev = TD.risk_events(spark, SF)
    s = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev), rule_updates=TD.rule_updates(spark))
    plan = _plan(s.decisions)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "FlatMapGroupsInPandas" not in plan  # the rules of a small log are literals
    assert "NestedLoop" not in plan and "SinglePartition" not in plan


def test_entry_and_oracle_contract(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(sqls) >= 36
    con = duckdb.connect()
    for t in ("events",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("q1_decisions", "w1_merchant_burst", "q5_ban_intervals", "t10_cooldown", "j1_rule_asof"):
        got = qs[name](spark, SF).toPandas()
        exp = con.execute(sqls[name]).df()
        assert len(got) == len(exp), name
        cols = sorted(got.columns)
        assert cols == sorted(exp.columns), name
        norm = [d[cols].astype(str).replace({"None": "NULL", "nan": "NULL", "<NA>": "NULL"}) for d in (got, exp)]
        for d in norm:
            for c in cols:
                d[c] = d[c].str.replace(r"\.0$", "", regex=True)
        a, b = (d.sort_values(cols).reset_index(drop=True) for d in norm)
        pd.testing.assert_frame_equal(a, b, check_dtype=False, obj=name)


@pytest.mark.parametrize("method", ["island", "naive"])
def test_orders_source_w1_runs(spark, method):
    ev = TD.risk_events_from_orders(spark, SF)
    out = W.merchant_burst(ev, 7 * 86_400_000, method=method)
    assert out.count() == ev.count()


def test_stream_bans_equal_batch(spark):
    from payguard.operators import bans as BN

    ev = TD.risk_events(spark, "/root/testdata/sf0.01")
    decs = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).decisions
    req = TD.ban_requests(decs, ev).cache()
    src = _split_to_files(req.withColumn("ms", F.unix_millis("ts")), tempfile.mkdtemp(dir="/tmp", prefix="pg-ban-"),
                          parts=3, order=("ms", "seq", "request_key"))
    schema = req.withColumn("ms", F.unix_millis("ts")).schema
    got = _run(SPR.ban_stream(_stream_of(spark, src, schema).drop("ms")), spark, "bans_out")
    exp = BN.ban_intervals(req)
    assert {r.request_key: r.accepted for r in got.collect()} == {r.request_key: r.accepted for r in exp.collect()}


def test_score_stream_rereads_rule_log_per_batch(spark):
    import datetime as dt

    from payguard import schemas

    ev = TD.risk_events(spark, SF).cache()
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-rules-")
    pdf = ev.orderBy("ms", "seq").toPandas()
    half = len(pdf) // 2
    spark.createDataFrame(pdf.iloc[:half], ev.schema).coalesce(1).write.parquet(f"{base}/src/a")
    q = SP.score_stream(spark, f"{base}/src/*", f"{base}/out", CFG, f"{base}/ck", rules_path=f"{base}/rules",
                        trigger={"availableNow": True}, rules_may_be_absent=True)
    q.awaitTermination(300)
    # an operator lowers the block threshold to 1: applies from the next micro-batch on
    t = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    spark.createDataFrame([("r-g", "global", True, {"block_threshold": "1"}, t, 1)], schemas.RULE_UPDATE) \
        .write.parquet(f"{base}/rules")
    spark.createDataFrame(pdf.iloc[half:], ev.schema).coalesce(1).write.parquet(f"{base}/src/b")
    q = SP.score_stream(spark, f"{base}/src/*", f"{base}/out", CFG, f"{base}/ck", rules_path=f"{base}/rules",
                        trigger={"availableNow": True}, rules_may_be_absent=True)
    q.awaitTermination(300)
    out = spark.read.parquet(f"{base}/out/decisions")
    first = out.filter(F.col("batch_id") == 0)
    later = out.filter(F.col("batch_id") > 0)
    assert first.filter("decision = 'BLOCK'").count() < first.count()
    assert later.filter("risk_score >= 1 AND decision <> 'BLOCK'").count() == 0


def _drain(q):
    q.awaitTermination(300)
    assert q.exception() is None


def test_missing_rule_log_fails_unless_allowed(spark):
    ev = TD.risk_events(spark, SF).limit(20)
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-norules-")
    ev.coalesce(1).write.parquet(f"{base}/src/a")
    q = SP.score_stream(spark, f"{base}/src/*", f"{base}/out", CFG, f"{base}/ck", rules_path=f"{base}/none",
                        trigger={"availableNow": True})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        q.awaitTermination(300)


def test_alert_consumer_keeps_its_state_without_its_log(spark):
    """Records in two batches, some delivered again to a stream that starts anew and writes elsewhere: decoding,
    DLQ, duplicates, cool-down across batches, sends. Nothing that was written is read again."""
    from payguard.operators import dlq as DQ
    from payguard.streaming import consumers as CS

    ev = TD.risk_events(spark, "/root/testdata/sf0.01")
    alerts = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).alerts.cache()
    records = TD.alert_records(alerts).cache()
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-cons-")
    src = _split_to_files(records, f"{base}/alerts", parts=2, order=("record_ts", "offset"))
    _drain(CS.alert_stream(_stream_of(spark, src, records.schema), CFG, f"{base}/out", f"{base}/ck",
                           trigger={"availableNow": True}))
    _drain(CS.dead_letter_stream(_stream_of(spark, src, records.schema), CFG, f"{base}/out", f"{base}/ck-dlq",
                                 trigger={"availableNow": True}))
    good, bad = DQ.split_alert_records(records, CFG)
    one, _, sends = A.process_alerts(good.withColumn("ms", F.unix_millis("created_at")).withColumn("seq", F.col("offset"))
                                     .withColumn("delivery", F.lit(0)), CFG)
    log = spark.read.parquet(f"{base}/out/alert_log")
    assert {r.alert_id: (r.status, tuple(r.channels_notified)) for r in log.collect()} == {
        r.alert_id: (r.status, tuple(r.channels_notified)) for r in one.collect()}
    assert log.select("batch_id").distinct().count() == 2
    assert spark.read.parquet(f"{base}/out/sends").count() == sends.count()
    assert spark.read.parquet(f"{base}/out/dlq").count() == bad.count() > 0
    again = records.filter(F.col("offset") % 3 == 0).withColumn("offset", F.col("offset") + 10 ** 9)
    again.coalesce(1).write.parquet(f"{src}/part=9")
    _drain(CS.alert_stream(_stream_of(spark, src, records.schema), CFG, f"{base}/out2", f"{base}/ck",
                           trigger={"availableNow": True}))
    out = spark.read.parquet(f"{base}/out2/outcomes")
    assert out.count() == out.filter("duplicate AND NOT rate_limited").count() == good.filter(F.col("offset") % 3 == 0).count() > 0
    assert not [n for n in os.listdir(f"{base}/out2/alert_log") if n.startswith("batch_id")]


def test_archive_and_ban_consumers(spark):
    from payguard.operators import bans as BN
    from payguard.streaming import consumers as CS

    ev = TD.risk_events(spark, "/root/testdata/sf0.01")
    decisions = Q.score_events(ev, CFG, profiles=TD.user_profiles(ev)).decisions.cache()
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-arch-")
    src = _split_to_files(decisions, f"{base}/decisions", parts=2)
    for run in range(2):  # replaying the same input appends nothing new
        _drain(CS.archive_stream(_stream_of(spark, src, decisions.schema), f"{base}/archive", ["decision_id"], ["ms", "seq"],
                                 f"{base}/ck-arch-{run}", trigger={"availableNow": True}, ts_col="created_at"))
    assert spark.read.parquet(f"{base}/archive").count() == decisions.count()
    for run in range(2):
        _drain(CS.ban_materializer_stream(_stream_of(spark, src, decisions.schema), CFG, f"{base}/bans", f"{base}/ck-ban-{run}",
                                          trigger={"availableNow": True}))
    audit = {r.decision_id: (r.severity, r.expires_at) for r in spark.read.parquet(f"{base}/bans/ban_audit").collect()}
    assert audit == {r.decision_id: (r.severity, r.expires_at) for r in BN.audit_bans(decisions, CFG).collect()}


def test_burst_state_survives_a_long_gap(spark):
    """A catch-up long after an outage still has its window: state expires by event time."""
    rows = [("e1", "m", "u1", 0, 1), ("e2", "m", "u2", 1_000, 2)], [("e3", "m", "u3", 2_000, 3), ("e4", "m", "u1", 90 * 86_400_000, 4)]
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-gap-")
    schema = "event_id string, merchant_id string, user_id string, ms long, seq long"
    got = {}
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        out = K.burst(stream, CFG.burst_window_ms)
        _drain(out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
               .trigger(availableNow=True).start())
    got = {r.event_id: r.merchant_users for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"e1": 1, "e2": 2, "e3": 3, "e4": 1}


NULLABLE = T.StructType([T.StructField(f.name, f.dataType) for f in SP.EVENT_STREAM_SCHEMA.fields])


def _event(i, user, merchant, ms, amount=100):
    return (f"e{i}", f"r{i}", user, "LOGIN", dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc), amount, "USD", None, "d", merchant, None, "s", i, ms)


def test_stream_keeps_events_without_user_merchant_or_order(spark):
    """Null users and merchants pass through; late events are scored against the window as it stands."""
    rows = [_event(1, "u1", "m", 1_000), _event(2, None, "m", 2_000), _event(3, "u2", None, 3_000), _event(4, "u2", " ", 4_000),
            _event(5, "u2", "m", 400_000), _event(6, "u1", "m", 350_000), _event(7, None, None, 5_000)]
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-odd-")
    spark.createDataFrame(rows, NULLABLE).coalesce(1).write.parquet(f"{base}/src/a")
    cfg = CFG.with_(burst_window_ms=300_000)
    got = _run(K.burst(_stream_of(spark, base, SP.EVENT_STREAM_SCHEMA), cfg.burst_window_ms, columns=("event_id",)), spark, "odd_burst")
    # e6 is in order within its micro-batch: e1's user is out of the window of e5
    assert {r.event_id: r.merchant_users for r in got.collect()} == {"e1": 1, "e2": 1, "e3": 0, "e4": 1, "e6": 1, "e5": 2, "e7": 0}
    got = _run(K.velocity(_stream_of(spark, base, SP.EVENT_STREAM_SCHEMA), 10_000, ("event_id",)), spark, "odd_velocity")
    assert {r.event_id: r.velocity_7d for r in got.collect()} == {"e1": 1, "e2": 1, "e3": 1, "e4": 2, "e6": 1, "e5": 1, "e7": 1}


def test_late_event_sees_the_window_of_the_greatest_time(spark):
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-late-")
    turns = [[_event(1, "u1", "m", 1_000), _event(2, "u2", "m", 500_000)], [_event(3, "u3", "m", 250_000), _event(4, "u1", "m", 500_001)]]
    for i, part in enumerate(turns):
        spark.createDataFrame(part, NULLABLE).coalesce(1).write.parquet(f"{base}/src/{i}")
        out = K.burst(_stream_of(spark, f"{base}/src", SP.EVENT_STREAM_SCHEMA), 300_000)
        _drain(out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    got = {r.event_id: r.merchant_users for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"e1": 1, "e2": 1, "e3": 2, "e4": 3}


def test_window_state_keeps_an_entry_per_member_in_chunks():
    """The state machine alone, over an in-memory state: chunks are read only as they expire."""
    class Value:
        v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Map:
        def __init__(self): self.d, self.reads = {}, 0
        def getValue(self, k):
            self.reads += 1
            return self.d.get(k)
        def updateValue(self, k, v): self.d[k] = v
        def removeKey(self, k): self.d.pop(k, None)
        def clear(self): self.d.clear()

    class Handle:
        def __init__(self): self.maps = {}
        def getValueState(self, n, *_): return Value()
        def getMapState(self, n, *_): return self.maps.setdefault(n, Map())

    import random
    rng, handle = random.Random(4), Handle()
    w, seen, at = K.Window(handle, "w", True), {}, 0
    for batch in range(60):
        w.open()
        for _ in range(rng.randint(1, 40)):
            at += rng.randint(0, 30)
            w.drop_before(at - 1_000)
            member = f"u{rng.randint(0, 50)}"
            w.put(member, at)
            seen[member] = at
            assert w.live == sum(t >= at - 1_000 for t in seen.values())
        w.close()
        chunks = handle.maps["w_chunks"].d
        assert len(handle.maps["w_seen"].d) == w.live == sum(len(c[0]) for c in chunks.values()) or sum(len(c[0]) for c in chunks.values()) >= w.live
    handle.maps["w_chunks"].reads = 0
    for batch in range(20):  # nothing expires: no chunk is read, whatever the window holds
        w.open()
        w.drop_before(at - 1_000)
        w.put("new", at)
        w.close()
    assert handle.maps["w_chunks"].reads <= 2


def test_rules_apply_from_their_place_in_the_stream(spark):
    """An update between two events of one micro-batch, and the state carried to the next."""
    from payguard import schemas

    t0 = 1_700_000_000_000
    at = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
    update = spark.createDataFrame([("r", "large_amount", True, {"amount_cents": "500", "score_delta": "90"}, at(t0 + 50), 1)], schemas.RULE_UPDATE)
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-place-")
    none = F.lit(None).cast("string").alias("rule")
    turns = [[_event(1, "u", "m", t0, 1_000), _event(2, "v", "m", t0 + 100, 1_000)], [_event(3, "w", "m", t0 + 200, 1_000), _event(4, "x", "m", t0 + 300, 10)]]
    for i, part in enumerate(turns):
        records = spark.createDataFrame(part, NULLABLE).select("*", none)
        if i == 0:
            records = records.unionByName(SP.rule_records(update))
        records.coalesce(1).write.parquet(f"{base}/src/{i}")
        _drain(SP.score_stream(spark, f"{base}/src/*", f"{base}/out", CFG, f"{base}/ck", trigger={"availableNow": True}, rules_in_stream=True))
    got = {r.event_id: r.risk_score for r in spark.read.parquet(f"{base}/out/decisions").collect()}
    assert got == {"e1": 0, "e2": 90, "e3": 90, "e4": 0}
    assert spark.read.parquet(f"{base}/out/rule_state").groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 1), (1, 1)]


def test_admission_stream_orders_bans_and_calls(spark):
    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-adm-")
    call = lambda i, ms, bad="": ("u", f"e{i}", f"r{i}", ms, i, False, None, None, None, bad)
    ban = lambda i, ms, sev, ttl: ("u", f"b{i}", None, ms, i, True, sev, f"B{i}", ttl, "")
    turns = [[call(1, 0), ban(2, 10, 2, 1), call(3, 10), call(4, 11), ban(5, 20, 1, 1_000)], [call(6, 1_009), call(7, 1_010), call(8, 1_011, "x"), call(9, 1_012), call(10, 1_013)],
             [ban(11, 1_100, 3, 0), call(12, 10**12)]]
    for i, part in enumerate(turns):
        spark.createDataFrame(part, K.ADMISSION_INPUT).coalesce(1).write.parquet(f"{base}/src/{i}")
        out = K.admission(_stream_of(spark, f"{base}/src", spark.createDataFrame([], K.ADMISSION_INPUT).schema), 60_000, 4)
        _drain(out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    got = {r.event_id: (r.reason, r.rate_limit_count) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"e1": ("passed_fast_path", 1), "e3": ("passed_fast_path", 2), "e4": ("blacklist:B2", 0), "e6": ("blacklist:B2", 0),
                   "e7": ("passed_fast_path", 3), "e8": ("x", 0), "e9": ("passed_fast_path", 4), "e10": ("rate_limit", 5), "e12": ("blacklist:B11", 0)}


def test_a_long_ban_outlives_the_idle_limit():
    day = 86_400_000
    assert SPR.ban_timeout_ms(60 * day, 0) > 60 * day and SPR.ban_timeout_ms(day, 0) == SPR.STATE_TTL_MS
    held = K.Admission(60_000, 4)
    held.ban = type("S", (), {"exists": lambda self: True, "get": lambda self: (60 * day, 3, "r")})()
    assert held.stays_until() == 60 * day
    held.ban = type("S", (), {"exists": lambda self: True, "get": lambda self: (-1, 3, "r")})()
    assert held.stays_until() > 10**18


def test_copy_stream_is_verbatim(spark):
    from payguard.plans import catalog_streams as ST

    got = ST.s03_stream_copy(spark, SF)
    records = TD.alert_records(Q.score_events(TD.risk_events(spark, SF), CFG, profiles=TD.user_profiles(TD.risk_events(spark, SF))).alerts)
    want = records.select("topic", "partition", "offset", F.decode("key", "UTF-8").alias("key"), F.md5("value").alias("value_md5"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10


def test_watermark_drops_and_counts_late_rows(spark):
    from payguard.streaming import windowed as WS

    base = tempfile.mkdtemp(dir="/tmp", prefix="pg-wm-")
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    schema = "event_id string, ts timestamp"
    turns = [[("a", at(0)), ("b", at(1)), ("b", at(1))], [("c", at(300))], [("d", at(301))], [("late", at(2)), ("e", at(900))], [("f", at(901))], [("g", at(902))]]
    dropped = 0
    for i, part in enumerate(turns):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/src/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        q = (WS.throughput(stream, "60 minutes", "30 minutes").writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
        _drain(q)
        dropped += sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    got = {r.window_start_ms // 3_600_000 % 24: r.records for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {0: 2, 5: 2} and dropped >= 1


def test_core_queries_without_the_training_data_package(monkeypatch):
    """A package that the training-data part needs is missing: the other queries stay."""
    import sys

    import __spark_entry__ as E

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("payguard.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    names = set(E.queries())
    assert "q1_decisions" in names and "q1_stream" in names and "pipeline" not in names
    assert set(E.oracle_sql()) <= names
