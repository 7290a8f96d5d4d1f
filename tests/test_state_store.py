"""Streams on a session as Spark starts it: its default state store, many shuffle partitions."""

import os
import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from payguard.config import TESTDATA_CONFIG as CFG
from payguard.operators import windows as W
from payguard.plans import catalog_streams as ST
from payguard.sources import testdata as TD
from payguard.streaming import keyed_state as K

PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def test_keyed_state_on_the_default_store_with_few_partitions(spark):
    was = {k: spark.conf.get(k) for k in (PROVIDER, PARTITIONS)}
    folder = tempfile.mkdtemp(dir="/tmp", prefix="pg-store-")
    ev = TD.risk_events(spark, "/root/testdata/sf0.001").select("event_id", "user_id", "request_id", "ms", "seq").limit(300).cache()
    try:
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        spark.conf.set(PARTITIONS, "50")
        ST.in_turns(ev, folder, lambda source, k: ST._to_files(K.rate_limit(
            spark.readStream.schema(ev.schema).parquet(source), CFG.rate_limit_window_ms, CFG.rate_limit), folder), turns=2)
        assert spark.conf.get(PARTITIONS) == "50"
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    got = {r.event_id: r.rate_count for r in spark.read.parquet(f"{folder}/out").collect()}
    exp = W.rate_limit(ev, CFG.rate_limit_window_ms, CFG.rate_limit)
    assert got == {r.event_id: r.rate_count for r in exp.collect()}
    assert 0 < sum(d.isdigit() for d in os.listdir(f"{folder}/checkpoint/state/0")) <= 8  # two a core


class Value:
    v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d, self.reads = {}, 0

    def getValue(self, k):
        self.reads += 1
        return self.d.get(k)

    def updateValue(self, k, v):
        self.d[k] = v

    def removeKey(self, k):
        self.d.pop(k, None)

    def iterator(self):
        return iter(list(self.d.items()))


class Handle:
    def __init__(self):
        self.maps = {}

    def getValueState(self, n, *_):
        return Value()

    def getMapState(self, n, *_):
        return self.maps.setdefault(n, Map())


def test_a_window_shorter_than_its_batch_is_read_in_few_calls():
    """The same counts and state as by a look-up a member, also with late rows."""
    rng, whole, single = random.Random(7), Handle(), Handle()
    a, b, at = K.Window(whole, "w", True), K.Window(single, "w", True), 0
    for _ in range(80):
        rows = rng.randint(1, 200)
        a.open(rows), b.open()
        for _ in range(rows):
            at += rng.randint(0, 30)
            ms, member = at - rng.choice((0, 0, 700)), f"u{rng.randint(0, 90)}"
            for w in (a, b):
                w.drop_before(at - 1_000)
                w.put(member, ms)
            assert a.live == b.live
        a.close(), b.close()
        assert whole.maps["w_seen"].d == single.maps["w_seen"].d
    assert whole.maps["w_seen"].reads < single.maps["w_seen"].reads / 4


def test_a_key_of_distinct_times_is_sorted_by_time_alone(monkeypatch):
    import pandas as pd
    tied = pd.DataFrame({"ms": [5, 3, 3, 9], "seq": [1, 7, 2, 0]})
    assert K.in_order(iter([tied[:2], tied[2:]])).values.tolist() == [[3, 2], [3, 7], [5, 1], [9, 0]]
    gaps = pd.DataFrame({"ms": [5, None, 3], "seq": [1, 2, 3]})
    assert K.in_order(iter([gaps]))["seq"].tolist() == [3, 1, 2]
    assert not len(K.in_order(iter([tied[:0]])))
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert K.in_order(iter([tied[:2], tied[3:]])).values.tolist() == [[3, 7], [5, 1], [9, 0]]


@pytest.mark.parametrize("name", ("burst", "velocity", "rate_limit", "admission", "sequence", "first_deliveries", "cooldown"))
def test_every_keyed_operator_asks_for_a_store_with_column_families(spark, name):
    """On the default store each stream of these ended with an error."""
    was = spark.conf.get(PROVIDER)
    rows = spark.readStream.format("rate").load()
    none, columns = F.lit(None), "user_id string, event_id string, request_id string, merchant_id string, event_type string, ms long, seq long, " \
        "amount_cents long, ts timestamp, is_ban boolean, severity string, reason string, ttl_seconds long, violations string, alert_id string, " \
        "offset long, partition int, duplicate boolean"
    rows = rows.select(*[none.cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
    given = {"burst": (1,), "velocity": (1,), "rate_limit": (1, 1), "admission": (1, 1), "sequence": ("a", "b", "c", 1), "cooldown": (1,)}
    try:
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        assert getattr(K, name)(rows.withWatermark("ts", "1 hour"), *given.get(name, ())).isStreaming
        assert spark.conf.get(PROVIDER).endswith(".RocksDBStateStoreProvider")
    finally:
        spark.conf.set(PROVIDER, was)


@pytest.mark.parametrize("name", ("q1_stream", "q1_stream_rules"))
def test_scored_streams_equal_their_sql_on_the_default_store(spark, name):
    """the whole query, three turns with restarts, on a session that names no store."""
    was = spark.conf.get(PROVIDER)
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    exp = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in exp.description]
    try:
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        got = E.queries()[name](spark, "/root/testdata/sf0.001").select(*cols).collect()
    finally:
        spark.conf.set(PROVIDER, was)
    assert len(got) == 1000 and sorted(map(tuple, got)) == sorted(exp.fetchall())


def test_cooldown_takes_many_pairs_in_one_call():
    """A call of the processor for each pair of user and severity cost ten times its look-ups."""
    import pandas as pd
    state, processor = Map(), K.Cooldown(100, ["alert_id"])

    class Shard(Handle):
        def getMapState(self, name, key, value, ttl=None):
            assert ttl == K.IDLE_MS
            return state
    processor.init(Shard())

    def turn(*rows):
        frame = pd.DataFrame(rows, columns=["alert_id", "pg_pair", "ms", "duplicate"]).assign(offset=range(len(rows)), partition=0)
        out = pd.concat(processor.handleInputRows(("7",), iter([frame]), None))
        return dict(zip(out["alert_id"], out["allowed"]))
    assert turn(("a", "u1", 50, False), ("b", "u2", 10, False), ("c", "u1", 149, False), ("d", "u1", 150, False),
                ("e", "u2", 400, True)) == {"a": True, "b": True, "c": False, "d": True, "e": False}
    assert turn(("f", "u1", 249, False), ("g", "u2", 110, False), ("h", "u3", 0, False)) == {"f": False, "g": True, "h": True}
    assert state.d == {("u1",): (150,), ("u2",): (110,), ("u3",): (0,)} and state.reads == 5


class Timers:
    now = 1_000

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Shard(Handle):
    """The state of one shard, with the calls that it took."""

    def __init__(self):
        super().__init__()
        self.values, self.timers, self.writes = {}, [], 0

    def getValueState(self, n, *_):
        self.values[n] = value = Value()
        value.clear = lambda: setattr(value, "v", None)
        return value

    def getMapState(self, n, *_):
        state = super().getMapState(n)
        write = state.updateValue

        def count(k, v):
            self.writes += 1
            write(k, v)
        state.updateValue = count
        return state

    def registerTimer(self, ms):
        self.timers.append(ms)


def _turn(processor, rows, timers=Timers()):
    import pandas as pd
    return pd.concat(processor.handleInputRows(("7",), iter([pd.DataFrame(rows)]), timers))


@pytest.mark.parametrize("distinct", (True, False))
def test_a_dealt_window_counts_as_a_window_of_its_own(monkeypatch, distinct):
    """Many keys of a shard, some with more entries than a head holds, late rows, windows that empty."""
    monkeypatch.setattr(K, "CHUNK_ROWS", 8)
    rng, shard = random.Random(3), Shard()
    dealt, own = K.DealtWindow(shard, "w", distinct), {k: K.Window(Handle(), "w", distinct) for k in "abc"}
    at, most = 0, 0
    for turn in range(300):
        key = rng.choice("abc")
        dealt.open(key), own[key].open()
        at += 5_000 if turn % 60 == 59 else 0
        for _ in range(rng.randint(1, {"a": 3, "b": 40, "c": 200}[key])):
            at += rng.randint(0, 9)
            ms, member = at - rng.choice((0, 0, 300)), f"u{rng.randint(0, 150)}"
            for w in (dealt, own[key]):
                w.drop_before(at - 1_000)
                w.put(member if distinct else None, ms)
            assert dealt.live == own[key].live
        own[key].close()
        dealt.close(turn)
        most = max(most, dealt.buckets)
        head, seen = shard.maps["w_heads"].d[key,], {k: v for k, v in shard.maps.get("w_seen", Map()).d.items() if k[0] == key}
        assert len(head[5]) <= 8 and {k[1] for k in shard.maps["w_chunks"].d if k[0] == key} == set(head[2])
        if distinct:
            assert sum(len(v[0]) for v in seen.values()) == (dealt.live if head[7] else 0)
    assert not distinct or most > 8
    for key in "abc":
        head = shard.maps["w_heads"].d[key,]
        dealt.forget(key, head[2], head[7])
    assert not any(m.d for m in shard.maps.values())


def test_a_user_costs_one_look_up_and_one_write_a_turn():
    """Each user was a key of its own, with six calls of the state store or more and a frame a turn."""
    processor, shard = K.Velocity(1_000, ["event_id"], "n"), Shard()
    processor.init(shard)
    for turn in range(3):
        rows = [dict(pg_key=f"u{u}", event_id=f"{u}-{turn}-{k}", ms=turn * 600 + k, seq=k) for u in range(50) for k in (1, 0)]
        rows.append(dict(pg_key=None, event_id=f"x{turn}", ms=None, seq=9))
        heads = shard.maps["rows_heads"]
        heads.reads = shard.writes = 0
        got = dict(_turn(processor, rows).values.tolist())
        assert heads.reads == shard.writes == 50
        base = 2 * min(turn, 1)
        assert got == {f"x{turn}": 1} | {f"{u}-{turn}-{k}": base + k + 1 for u in range(50) for k in (0, 1)}
    assert shard.timers == [Timers.now + K.IDLE_MS]


def test_a_shard_forgets_idle_users_and_keeps_live_bans():
    """users of a shard come and go apart."""
    day, processor, shard = 86_400_000, K.Admission(60_000, 2), Shard()
    processor.init(shard)

    def row(user, event, ms, ttl=None):
        ban = ttl is not None
        return dict(pg_key=f"={user}", user_id=user, event_id=event, request_id=event, ms=ms, seq=0, is_ban=ban, severity=1 if ban else None,
                    reason="r" if ban else None, ttl_seconds=ttl, violations="")
    clock = Timers()
    clock.now = 0
    got = _turn(processor, [row("a", "a1", 5), row("b", "b1", 5), row("b", "b2", 6, 40 * 86_400), row("c", "c1", 7, 0), row("b", "b3", 7)], clock)
    assert sorted(got[["event_id", "reason"]].values.tolist()) == [["a1", "passed_fast_path"], ["b1", "passed_fast_path"], ["b3", "blacklist:r"]]
    heads = shard.maps["calls_heads"].d
    clock.now = 20 * day
    _turn(processor, [row("d", "d1", 9)], clock)
    left = {30 * day: {"=b", "=c", "=d"}, 41 * day: {"=c", "=d"}, 60 * day: {"=c"}}
    for clock.now, users in left.items():
        list(processor.handleExpiredTimer(("7",), clock, None))
        assert {k for k, in heads} == users
    assert shard.timers[:2] == [30 * day, 40 * day + 6] and processor.sweep.get() is None  # a ban for good needs no timer
    _turn(processor, [row("c", "c2", 10)], clock)
    assert shard.timers[-1] == 90 * day


def _deliveries(processor, ids, now, state):
    import pandas as pd
    processor.init(state)
    clock = Timers()
    clock.now = now
    frame = pd.DataFrame({"alert_id": ids, "ms": range(len(ids)), "offset": range(len(ids)), "partition": 0})
    out = pd.concat(processor.handleInputRows(("7",), iter([frame]), clock))
    return out["duplicate"].tolist()


class Kept(Shard):
    """A shard whose values outlive a restart of the stream."""

    def getValueState(self, n, *_):
        return self.values[n] if n in self.values else super().getValueState(n)

    def getMapState(self, n, *_):
        if n not in self.maps:
            state = super().getMapState(n)
            state.containsKey = lambda k: state.getValue(k) is not None
        return self.maps[n]


def test_deliveries_are_looked_up_many_in_a_call():
    """a look-up and a write for each id cost half of the query's time. The same flags as by a set of all ids."""
    rng, state, taken = random.Random(5), Kept(), set()
    for rows in (0, 1, 4_000, 30, 20_000, 1, 3_000):
        ids, want = [f"alert-{rng.randint(0, 30_000)}" for _ in range(rows)], []
        for a in ids:
            want.append(a in taken)
            taken.add(a)
        reads = sum(m.reads for m in state.maps.values())
        writes = state.writes
        if rows:
            assert _deliveries(K.FirstDelivery(["alert_id"], None), ids, 0, state) == want
        calls = sum(m.reads for m in state.maps.values()) - reads + state.writes - writes
        assert calls <= min(2 * rows, rows // 10 + 200) + len(taken) // 20
    parts = [part for m in state.maps.values() for part in m.d.values()]
    assert sorted(n for names, *_ in parts for n in names) == sorted(taken)
    assert max(len(names) for names, *_ in parts) < 4 * K.PACK_ROWS


def test_ids_are_forgotten_one_by_one():
    """Ids of one bucket that were taken at different times: each is kept for ``keep_ms`` from its own."""
    state, day = Kept(), K.DAY_MS

    def turn(now, *ids):
        return _deliveries(K.FirstDelivery(["alert_id"], 10 * day), list(ids), now, state)
    assert turn(0, "a", "b", "a") == [False, False, True]
    assert turn(4 * day, "c", "a") == [False, True]
    assert turn(10 * day - 1, "a") == [True]
    assert turn(10 * day, "a", "c") == [False, True]
    assert turn(14 * day, "b", "c", "a") == [False, False, True]


def test_alert_records_are_worked_out_once(spark, monkeypatch):
    """the second deliveries were a union, so that the scoring before them ran twice."""
    seen = []
    monkeypatch.setattr(ST, "in_turns", lambda rows, *_, **__: seen.append(rows))
    ST._alert_streams(spark, "/root/testdata/sf0.001", "once", None)
    rows = seen[0]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    first, again = rows.filter(F.col("offset") < ST.AGAIN), rows.filter(F.col("offset") >= ST.AGAIN)
    tenth = first.filter("offset % 10 = 0").withColumn("offset", F.col("offset") + ST.AGAIN).withColumn("ms", F.col("ms") + 9 * K.DAY_MS)
    assert again.count() > 0 and sorted(map(repr, again.collect())) == sorted(map(repr, tenth.collect()))
    assert first.select("offset").distinct().count() == first.count()
