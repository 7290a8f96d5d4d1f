"""Golden cases of the gate, the limiter, recurrences across batches, and
input that must neither vanish nor kill a job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0_MS, event_row, ts
from payguard import schemas
from payguard.config import DEFAULT_CONFIG as CFG
from payguard.functions import parse_instant
from payguard.operators import alerts as A
from payguard.operators import archive as AR
from payguard.operators import bans as BN
from payguard.operators import dlq as DQ
from payguard.operators import health as H
from payguard.operators import ingest as ING
from payguard.operators import recurrence as RC
from payguard.operators import rule_admin as RA
from payguard.operators import rules as R
from payguard.operators import windows as W
from test_alerts_dlq_admin import alerts_df


def bans_df(spark, rows):
    return BN.ban_intervals(spark.createDataFrame(
        [("u", f"R{i}", sev, ttl, ts(T0_MS + ms), f"k{i}") for i, (ms, sev, ttl) in enumerate(rows)],
        "user_id string, reason string, severity int, ttl_seconds long, ts timestamp, request_key string"))


@pytest.mark.parametrize("sets, at, reason", [
    ([(0, 3, 60), (1_000, 4, 60)], 1_000, "R0"),    # the gate reads before the stronger ban is written
    ([(0, 3, 60), (1_000, 4, 60)], 1_001, "R1"),
    ([(0, 3, 60)], 0, None),                        # a ban doesn't hold for the call that set it
    ([(0, 3, 60)], 59_999, "R0"), ([(0, 3, 60)], 60_000, None),
    ([(0, 3, 60), (60_000, 3, 60)], 60_000, None),  # expired and set anew at one instant
    ([(0, 3, 0), (500, 9, 1)], 1_600, None),        # a short stronger ban replaces a permanent one
    ([(0, 3, 60), (0, 4, 60)], 1, "R1"), ([(0, 0, 60)], 10, "R0"),
])
def test_ban_gate_at_the_borders(spark, events_df, sets, at, reason):
    ev = events_df([event_row("e", user="u", ms=T0_MS + at)])
    assert BN.events_under_ban(ev, bans_df(spark, sets)).first().ban_reason == reason


@pytest.mark.parametrize("method", ["island", "prefix"])
def test_ten_calls_at_one_instant_five_pass(events_df, method):
    rows = [event_row(f"e{i}", request=f"r{i}", ms=T0_MS, seq=i) for i in range(10)]
    got = sorted((r.seq, r.rate_blocked) for r in W.rate_limit(events_df(rows), 2_000, 5, method=method).collect())
    assert [b for _, b in got] == [False] * 5 + [True] * 5


@pytest.mark.parametrize("method", ["island", "prefix"])
def test_arrival_ties_equal_a_walk(events_df, method):
    import random
    rng = random.Random(1)
    rows = [event_row(f"e{i}", user=f"u{rng.randrange(3)}", request=f"r{rng.randrange(6)}", ms=T0_MS + rng.randrange(8) * 1_000, seq=i)
            for i in range(200)]
    got = {r.event_id: r.n for r in W.distinct_in_range(events_df(rows), ["user_id"], "request_id", 2_999, "n", method=method,
                                                        ties="arrival", bucket_ms=5_000).collect()}
    for e in rows:
        seen = {p["request_id"] for p in rows if p["user_id"] == e["user_id"] and e["ms"] - 2_999 <= p["ms"]
                and (p["ms"], p["seq"]) <= (e["ms"], e["seq"])}
        assert got[e["event_id"]] == len(seen)


def walk(rows, severities):
    """(key, ms, seq, ttl, severity) rows in order; the ids accepted."""
    held, out = {}, set()
    for key, ms, seq, ttl, sev, i in sorted(rows):
        until, level = held.get(key, (None, None))
        if key not in held or (until is not None and ms >= until) or (severities and sev > level):
            held[key] = (None if ttl is None else ms + ttl, sev)
            out.add(i)
    return out


@pytest.mark.parametrize("severities", [True, False])
@pytest.mark.parametrize("method", ["fold", "doubling", "auto"])
def test_recurrence_any_severity_and_hold(spark, severities, method):
    import random
    rng = random.Random(7)
    rows = [(f"u{rng.randrange(3)}", rng.randrange(40) * 100, i, rng.choice([0, 0, 100, 700, 5_000, None] if severities else [0, 300, 900]),
             rng.randrange(-3, 9), f"n{i}") for i in range(150)]
    df = spark.createDataFrame([(i, k, ms, s, t, v) for k, ms, s, t, v, i in rows],
                               "node_id string, user_id string, ms long, seq long, ttl_ms long, sev int")
    got = RC.greedy_accept(df, ["user_id"], "ttl_ms", sev="sev" if severities else None, method=method, fold_max_group_rows=45, bucket_ms=1_000)
    assert {r.node_id for r in got.filter("accepted").collect()} == walk(rows, severities)


def test_cooldown_continues_across_batches(spark):
    rows = [(f"a{i}", "u", "HIGH", i * 60_000, 0) for i in range(40)]
    one, _, _ = A.process_alerts(alerts_df(spark, rows), CFG)
    log, _, _ = A.process_alerts(alerts_df(spark, rows[:17]), CFG)
    log, _, _ = A.process_alerts(alerts_df(spark, rows[17:30]), CFG, alert_log=log)
    log, _, _ = A.process_alerts(alerts_df(spark, rows[30:]), CFG, alert_log=log)
    status = [{r.alert_id: r.status for r in x.collect()} for x in (one, log)]
    assert status[0] == status[1] and list(status[0].values()).count("PROCESSED") == 3


def test_every_request_has_an_outcome(spark, events_df):
    rows = [event_row("a", seq=1), event_row(" ", seq=2), event_row(None, seq=3), event_row("d", user=None, seq=4)]
    df = events_df(rows).withColumn("ts", F.when(F.col("seq") != 1, F.col("ts")))
    out = ING.admit(df, None, CFG, now=F.lit(ts(T0_MS))).collect()
    assert len(out) == 4 and {r.status for r in out if r.seq != 4} == {"ACCEPTED"}
    assert [r.reason for r in out if r.seq == 4] == ["user_id:blank"] and all(r.event_id.strip() for r in out)
    assert len(ING.admit(df, None, CFG).collect()) == 4


def test_null_rule_type_is_rejected(spark):
    req = spark.createDataFrame([("r1", None, None, ts(T0_MS)), ("r2", "GLOBAL", None, ts(T0_MS))],
                                "rule_id string, rule_type string, parameters map<string,string>, at timestamp")
    rules, outbox, bad = RA.upsert_rules(spark.createDataFrame([], schemas.RULE), spark.createDataFrame([], schemas.RULE_OUTBOX), req)
    assert [r.rule_id for r in rules.collect()] == ["r2"] and [r.rule_id for r in bad.collect()] == ["r1"]


def test_bad_bytes_go_to_the_dead_letters(spark):
    rec = spark.createDataFrame([("t", 0, 1, b"k", bytes([0xFF, 0xFE, 0xFD]), [("severity", bytes([0xFF]))], ts(T0_MS)),
                                 ("t", 0, 2, None, None, None, ts(T0_MS))],
                                "topic string, partition int, offset long, key binary, value binary,"
                                " headers array<struct<key:string,value:binary>>, record_ts timestamp")
    good, bad = DQ.split_alert_records(rec, CFG)
    assert good.count() == 0 and sorted(r.severity for r in bad.collect()) == ["unknown", "unknown"]
    assert DQ.summarize(bad).count() == 2


@pytest.mark.parametrize("text, micros", [("2026-05-17T23:45:00Z", 0), ("2026-05-17T23:45:00.123456789Z", 123_456), ("2026-05-17T23:45:00.1Z", 100_000),
                                          ("2026-05-17", None), ("soon", None), (None, None)])
def test_instants_of_up_to_nine_digits(spark, text, micros):
    r = spark.createDataFrame([(text,)], "s string").select(parse_instant("s").alias("t")).first().t
    assert r == (None if micros is None else dt.datetime(2026, 5, 17, 23, 45, 0, micros))


def test_lag_counts_committed_partitions(spark):
    latest = spark.createDataFrame([("t", 0, 10), ("t", 1, 100), ("u", 0, 5)], "topic string, partition int, latest long")
    committed = spark.createDataFrame([("t", 0, 8), ("u", 0, 9), ("v", 0, 1)], "topic string, partition int, committed long")
    assert tuple(H.consumer_lag(committed, latest).first()) == (2, 2)
    assert tuple(H.consumer_lag(committed.filter("false"), latest).first()) == (0, 0)


def test_percentiles_equal_the_exact_ones(spark):
    import random
    rng = random.Random(3)
    df = spark.createDataFrame([(f"g{rng.randrange(3)}", rng.randrange(-500, 5_000)) for _ in range(500)] + [("one", 7), ("none", None)], "g string, v long")
    got = {r.g: tuple(r)[1:] for r in H.percentiles(df, "v", ["g"]).collect()}
    exp = {r.g: tuple(r)[1:] for r in df.filter("v IS NOT NULL").groupBy("g").agg(*[F.round(F.percentile("v", F.lit(q)), 6) for q in (0.5, 0.95, 0.99)]).collect()}
    assert got == exp


def test_rule_versions_equal_a_walk(spark):
    import random
    rng = random.Random(5)
    log = [(f"r{rng.randrange(6)}", rng.choice(["global", "large_amount", "fraud_ring"]), rng.random() < 0.7,
            {"block_threshold": str(rng.randrange(99)), "amount_cents": str(rng.randrange(9_999))}, ts(T0_MS + rng.randrange(60) * 1_000), i) for i in range(80)]
    got = {r.valid_from_ms: (r.valid_to_ms, r.block_threshold, r.large_amount_cents)
           for r in R.rule_versions(spark.createDataFrame(log, schemas.RULE_UPDATE), CFG).collect()}
    points = sorted({int(x[4].timestamp() * 1000) for x in log})
    for i, cp in enumerate(points):
        state = {}
        for x in sorted(log, key=lambda x: (x[4], x[5])):
            if x[4].timestamp() * 1000 <= cp:
                state[x[0]] = x
        def pick(kind, key, default):
            live = [(x[4], x[0], x[3][key]) for x in state.values() if x[2] and x[1] == kind]
            return int(max(live)[2]) if live else default
        assert got[cp] == (points[i + 1] if i + 1 < len(points) else None, pick("global", "block_threshold", CFG.block_threshold),
                           pick("large_amount", "amount_cents", CFG.large_amount_cents))


def test_rule_versions_by_time_buckets_equal_one_sweep(spark, monkeypatch):
    """Long-lived, short-lived and simultaneous updates over many buckets; no task holds the whole log."""
    import random
    rng = random.Random(6)
    log = [(f"r{rng.randrange(3) if i % 3 else rng.randrange(60)}", rng.choice(["global", "large_amount", "high_velocity_7d"]), rng.random() < 0.8,
            {"block_threshold": str(i), "amount_cents": str(i), "score_delta": str(i)}, ts(T0_MS + rng.choice([7_000, rng.randrange(200) * 1_000])), i)
           for i in range(400)]
    updates = spark.createDataFrame(log, schemas.RULE_UPDATE)
    whole = sorted(map(tuple, R.rule_versions(updates, CFG).collect()))
    sizes = spark.sparkContext.accumulator(0)
    sweep = R._sweep_bucket
    monkeypatch.setattr(R, "_sweep_bucket", lambda pdf, after: (sizes.add(1), sweep(pdf, after))[1])
    assert sorted(map(tuple, R.rule_versions(updates, CFG, points_per_bucket=9).collect())) == whole
    assert sizes.value > 10 and len(whole) == len({x[4] for x in log})
    assert R.rule_versions(updates.filter("false"), CFG).count() == 0


def test_archive_tells_a_missing_table_from_a_broken_one(spark, tmp_path):
    df = spark.createDataFrame([("e1", 1, "2026-01-01"), ("e2", 2, "2026-01-02")], "event_id string, seq long, event_date string")
    path = f"{tmp_path}/archive"
    assert AR.append_idempotent(df, path, ["event_id"], ["seq"], ["event_date"]) == 2
    assert AR.append_idempotent(df, path, ["event_id"], ["seq"], ["event_date"]) == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        AR.append_idempotent(df, str(broken), ["event_id"], ["seq"])


def test_update_by_key_and_bootstrap(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(tuple(r) for r in AR.update_by_key(target, updates, ["k"], ["v"]).collect()) == [("a", 1), ("b", 9)]
    assert [r.k for r in AR.missing_keys(target, updates, ["k"]).collect()] == ["c"]
    rules = spark.createDataFrame([("r1", "global", {}, True, ts(0), ts(0))], schemas.RULE)
    log = spark.createDataFrame([("r1", "global", False, {}, ts(0), 41), ("r2", "global", True, {}, ts(0), 42)], schemas.RULE_UPDATE)
    gone = spark.createDataFrame([("r2",)], "rule_id string")
    again = RA.bootstrap(rules, gone, log)
    assert again.agg(F.min("log_offset")).first()[0] > 42
    assert [r.rule_id for r in RA.latest_state(log.unionByName(again)).collect()] == ["r1"]


def test_rule_lookup_forms_agree(spark, monkeypatch):
    """Literals, a local log merged, and a log swept in buckets and merged give the same
    parameters; events before, after and without a time included."""
    import datetime as dt
    import random

    from payguard import schemas

    rng = random.Random(8)
    at = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
    log = [(f"r{rng.randint(0, 5)}", rng.choice(["large_amount", "global", "high_velocity_7d", "x"]), rng.random() < 0.8,
            {"score_delta": str(i), "block_threshold": str(50 + i)}, at(1_000_000 + rng.randint(0, 40) * 3_000), i) for i in range(45)]
    updates = spark.createDataFrame(log, schemas.RULE_UPDATE)
    ev = spark.createDataFrame([(f"e{i}", None if i == 7 else 990_000 + rng.randint(0, 150_000)) for i in range(400)], "event_id string, ms long")
    literal = sorted(map(tuple, R.apply_rule_log(ev, updates, CFG).collect()))
    monkeypatch.setattr(R, "SMALL_VERSIONS", 3)
    assert sorted(map(tuple, R.apply_rule_log(ev, updates, CFG).collect())) == literal
    monkeypatch.setattr(R, "SMALL_LOG_ROWS", 5)
    monkeypatch.setattr(R.small_versions, "__defaults__", (5,))
    assert sorted(map(tuple, R.apply_rule_log(ev, updates, CFG).collect())) == literal
    versions = R.rule_versions(updates, CFG, points_per_bucket=4)
    for bucket_ms, salts in ((1_000, 1), (7_000, 3), (10**9, 2)):
        got = R.asof_merge(ev, versions, R.change_span(updates), bucket_ms=bucket_ms, salts=salts)
        assert got.count() == 400
        assert {r.event_id: r.valid_from_ms for r in got.collect()} == {r[0]: r[2] for r in literal}
    none = updates.filter("false")
    assert R.apply_rule_log(ev, none, CFG).filter("rule_version_ms IS NULL").count() == 400
    assert R.attach_rule_params(ev, R.rule_versions(none, CFG), CFG, R.change_span(none)).count() == 400
    assert R.apply_rule_log(ev.filter("false"), updates, CFG).count() == 0


def test_counter_resets_and_keys_that_stop(spark):
    """A reset counts what came after it; open silences and keys never seen are absent."""
    rows = [("a", 0, 10), ("a", 60_000, 12), ("a", 120_000, 0), ("a", 180_000, 3), ("b", 0, 5), ("b", 170_000, 5), (None, 5, 1)]
    series = spark.createDataFrame([(k, ms, i, v) for i, (k, ms, v) in enumerate(rows)], "k string, ms long, seq long, value long")
    got = {r.k: (r.increase, r.alert) for r in H.counter_increase(series.filter("k IS NOT NULL"), ["k"], 600_000).collect()}
    assert got == {"a": (5, True), "b": (0, False)}
    for bucket in (1_000, 10**9):
        slid = {(r.k, r.ms): r.increase for r in H.increase(series, ["k"], 120_000, bucket_ms=bucket).collect()}
        assert slid == {("a", 0): 0, ("a", 60_000): 2, ("a", 120_000): 2, ("a", 180_000): 3, ("b", 0): 0, ("b", 170_000): 0}
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    gone = H.absent(series.filter("k IS NOT NULL"), ["k"], 100_000, 275_000, expected).collect()
    assert {(r.k, r.silent_from_ms, r.gap_ms) for r in gone} == {("b", 170_000, 105_000), ("c", None, None)}


def test_archive_reads_only_touched_partitions(spark, tmp_path):
    """Batches of one date read that date's folder, and its rows only where a key may be known."""
    path = f"{tmp_path}/archive"
    rows = [(f"e{i}", i, f"2026-01-{i % 20 + 1:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "event_id string, seq long, event_date string").withColumn("event_date", F.to_date("event_date"))
    assert AR.append_idempotent(df, path, ["event_id"], ["seq"], ["event_date"]) == 400
    one = df.filter("event_date = DATE'2026-01-05'")
    assert AR.append_idempotent(one.unionByName(one.withColumn("event_id", F.concat("event_id", F.lit("-new")))), path, ["event_id"], ["seq"], ["event_date"]) == 20
    plan = AR.of_partitions(spark.read.parquet(path), one, ["event_date"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "= 2026-01-05" in plan
    index = spark.read.parquet(f"{path}_index")
    fresh = one.withColumn("event_id", F.concat("event_id", F.lit("-other")))
    assert AR.maybe_members(one, index, ["event_id"], ["event_date"]).count() == one.count() == 20
    assert AR.maybe_members(fresh, index, ["event_id"], ["event_date"]).count() <= 1
    # a table without bitmaps (from before them) gets them, and loses nothing
    old = f"{tmp_path}/old"
    df.write.partitionBy("event_date").parquet(old)
    assert AR.append_idempotent(df.unionByName(fresh), old, ["event_id"], ["seq"], ["event_date"]) == 20
    assert spark.read.parquet(old).count() == 420
    # a commit lost between bitmaps and rows: the replay appends the rows
    half = df.withColumn("event_id", F.concat("event_id", F.lit("-lost")))
    AR.index_rows(half, ["event_id"], ["event_date"]).write.mode("append").partitionBy("event_date").parquet(f"{path}_index")
    assert AR.append_idempotent(half, path, ["event_id"], ["seq"], ["event_date"]) == 400
    assert AR.append_idempotent(half, path, ["event_id"], ["seq"], ["event_date"]) == 0


def test_tables_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    from payguard.sources import tables as TB

    t = TB.Tables(spark, str(tmp_path / "t"), {"rules": ["k"], "outbox": ["id"]}, buckets=8)
    rules = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v long")
    outbox = spark.createDataFrame([(1, "a")], "id long, p string")
    assert t.version() == 0 and t.commit({"rules": rules, "outbox": outbox}, 0) == 1
    # killed after the first table's folder is written: both tables stay as they were
    write, calls = TB.Tables._write, []

    def dies(self, name, df):
        if calls:
            raise RuntimeError("killed")
        calls.append(name)
        return write(self, name, df)
    monkeypatch.setattr(TB.Tables, "_write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        t.commit({"rules": rules.withColumn("v", F.lit(7).cast("long")), "outbox": outbox.unionByName(outbox)}, 1)
    monkeypatch.setattr(TB.Tables, "_write", write)
    assert t.version() == 1 and t.read("outbox").count() == 1 and t.read("rules").filter("v = 7").count() == 1
    # an update by key writes only the buckets of its keys
    before = t._manifest(1)["rules"]["buckets"]
    updates = spark.createDataFrame([("k3", 100), ("nobody", 5)], "k string, v long")
    version, missing = t.update_by_key("rules", updates, ["v"])
    after = t._manifest(version)["rules"]["buckets"]
    assert [r.k for r in missing.collect()] == ["nobody"] and sum(after[b] != before[b] for b in after) <= 2
    assert {r.k: r.v for r in t.read("rules").collect()} == {**{f"k{i}": i for i in range(50)}, "k3": 100}
    assert t.read("rules", 1).filter("k = 'k3'").first().v == 3
    # of two commits from one version the second fails
    with pytest.raises(TB.CommitConflict):
        t.commit({"outbox": outbox}, 1)
    empty = t.commit({"outbox": outbox.filter("false")}, version)
    assert t.read("outbox", empty).count() == 0
    assert t.update_by_key("outbox", outbox, ["p"])[1].count() == 1


def test_bootstrap_numbers_do_not_depend_on_partitions(spark):
    rules = spark.createDataFrame([(f"r{i}", "global", {}, True, ts(0), ts(0)) for i in range(300)], schemas.RULE)
    one = sorted((r.rule_id, r.log_offset) for r in RA.bootstrap(rules.repartition(1)).collect())
    assert one == sorted((r.rule_id, r.log_offset) for r in RA.bootstrap(rules.repartition(7)).collect())
    assert sorted(o for _, o in one) == list(range(300))
