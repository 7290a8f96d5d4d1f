"""Sliding windows (W1-W3, G17-G19, edges, ties, hot keys) and greedy
recurrences (T9 G20-G21, T10 G26), both evaluation paths."""

import random

from pyspark.sql import functions as F

from conftest import T0_MS, event_row, ts
from payguard.config import DEFAULT_CONFIG as CFG
from payguard.operators import bans as BN
from payguard.operators import windows as W
from payguard.operators.recurrence import greedy_accept


def random_events(n, seed=7, hot_share=0.34, span_ms=6 * 3_600_000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        merchant = "m-hot" if rnd.random() < hot_share else f"m-{rnd.randrange(5)}"
        user = f"u-{rnd.randrange(12)}"
        ms = T0_MS + rnd.randrange(span_ms)
        if i % 17 == 0 and rows:  # force ties across users
            ms = rows[-1]["ms"]
        rows.append(event_row(f"e{i}", user=user, merchant=merchant, ms=ms, seq=i,
                              request=f"r-{user}-{rnd.randrange(6)}"))
    return rows


def test_w1_island_equals_naive_with_hot_key_and_ties(events_df):
    df = events_df(random_events(600))
    for window in (60_000, 1_800_000, 3 * 3_600_000):
        a = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", window, "n",
                                                            bucket_ms=900_000).collect()}
        b = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", window, "n",
                                                            method="naive").collect()}
        assert a == b


def test_w1_window_edges(events_df):
    w = CFG.burst_window_ms
    rows = [event_row("a", user="u1", ms=T0_MS, seq=1), event_row("b", user="u2", ms=T0_MS + w, seq=2),
            event_row("c", user="u3", ms=T0_MS + w + 1, seq=3)]
    got = {r.event_id: r.merchant_users for r in W.merchant_burst(events_df(rows), w).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}  # lower bound inclusive: a counts at exactly t - window


def test_w1_null_and_blank_merchant(events_df):
    rows = [event_row("a", merchant=None, seq=1), event_row("b", merchant="  ", seq=2),
            event_row("c", merchant="m", user="x", seq=3), event_row("d", merchant="m", user="y", seq=4)]
    got = {r.event_id: r.merchant_users for r in W.merchant_burst(events_df(rows), 300_000).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}  # same ms: RANGE peers included


def test_w1_arrival_ties(events_df):
    rows = [event_row("a", user="u1", ms=T0_MS, seq=1), event_row("b", user="u2", ms=T0_MS, seq=2),
            event_row("c", user="u3", ms=T0_MS, seq=3), event_row("d", user="u1", ms=T0_MS + 10, seq=4)]
    df = events_df(rows)
    peers = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", 300_000, "n").collect()}
    arrival = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", 300_000, "n",
                                                             ties="arrival").collect()}
    assert peers == {"a": 3, "b": 3, "c": 3, "d": 3}
    assert arrival == {"a": 1, "b": 2, "c": 3, "d": 3}


def test_g17_ten_requests_limit_five(events_df):
    rows = [event_row(f"e{i}", request=f"req-{i}", ms=T0_MS + i, seq=i) for i in range(10)]
    got = sorted((r.seq, r.rate_blocked) for r in W.rate_limit(events_df(rows), 2_000, 5).collect())
    assert [b for _, b in got] == [False] * 5 + [True] * 5


def test_g18_same_request_counts_once(events_df):
    rows = [event_row("e1", request="same", ms=T0_MS, seq=1), event_row("e2", request="same", ms=T0_MS + 5, seq=2)]
    got = [(r.rate_count, r.rate_blocked) for r in W.rate_limit(events_df(rows), 2_000, 5).orderBy("seq").collect()]
    assert got == [(1, False), (1, False)]


def test_g19_window_expiry(events_df):
    rows = [event_row(f"e{i}", request=f"q{i}", ms=T0_MS + i, seq=i) for i in range(6)]
    rows.append(event_row("late", request="q-late", ms=T0_MS + 5 + 2_500, seq=99))
    got = {r.event_id: (r.rate_count, r.rate_blocked) for r in W.rate_limit(events_df(rows), 2_000, 5).collect()}
    assert got["e5"] == (6, True) and got["late"] == (1, False)
    # boundary: a member scored exactly now - window is dropped
    edge = [event_row("x", request="a", ms=T0_MS, seq=1), event_row("y", request="b", ms=T0_MS + 2_000, seq=2)]
    got = {r.event_id: r.rate_count for r in W.rate_limit(events_df(edge), 2_000, 5).collect()}
    assert got["y"] == 1


def test_w3_velocity_island_equals_naive(events_df):
    df = events_df(random_events(400, seed=3))
    a = {r.event_id: r.v for r in W.velocity(df, 3_600_000, out="v", bucket_ms=600_000).collect()}
    b = {r.event_id: r.v for r in W.velocity(df, 3_600_000, out="v", method="naive").collect()}
    assert a == b


def nodes_df(spark, rows):
    return spark.createDataFrame(rows, "node_id string, user_id string, ms long, seq long, ttl_ms long, sev int")


def test_t10_g26_cooldown(spark):
    m = 60_000
    df = nodes_df(spark, [("a", "u", 0, 1, 15 * m, 2), ("b", "u", 5 * m, 2, 15 * m, 2), ("c", "u", 15 * m, 3, 15 * m, 2),
                          ("d", "u", 16 * m, 4, 15 * m, 2)])
    for method in ("fold", "doubling"):
        got = {r.node_id: r.accepted for r in greedy_accept(df, ["user_id"], "ttl_ms", method=method).collect()}
        assert got == {"a": True, "b": False, "c": True, "d": False}  # not sliding; >= expires


def ban_requests(spark, rows):
    return spark.createDataFrame(
        [(u, r, s, t, ts(T0_MS + ms), k, i) for i, (u, r, s, t, ms, k) in enumerate(rows)],
        "user_id string, reason string, severity int, ttl_seconds long, ts timestamp, request_key string, seq long")


def test_g20_g21_ban_severity(spark):
    up = ban_requests(spark, [("u", "SUSPICIOUS", 1, 60, 0, "k1"), ("u", "FRAUD_CONFIRMED", 4, 3600, 10, "k2")])
    down = ban_requests(spark, [("u", "FRAUD_CONFIRMED", 4, 3600, 0, "k1"), ("u", "SUSPICIOUS", 1, 60, 10, "k2")])
    for method in ("fold", "doubling"):
        a = {r.request_key: r.accepted for r in BN.ban_intervals(up, method=method).collect()}
        b = {r.request_key: r.accepted for r in BN.ban_intervals(down, method=method).collect()}
        assert a == {"k1": True, "k2": True} and b == {"k1": True, "k2": False}


def test_short_severe_ban_replaces_long_mild_one(spark):
    req = ban_requests(spark, [("u", "mild", 3, 86_400, 0, "k1"), ("u", "severe", 4, 60, 1_000, "k2"),
                               ("u", "mild-again", 3, 86_400, 120_000, "k3"), ("u", "perm", 5, 0, 200_000, "k4"),
                               ("u", "later", 5, 60, 999_000_000, "k5")])
    for method in ("fold", "doubling"):
        got = {r.request_key: (r.accepted, r.valid_from_ms, r.valid_to_ms)
               for r in BN.ban_intervals(req, method=method).collect()}
        assert got["k1"] == (True, T0_MS, T0_MS + 1_000)  # ends when replaced
        assert got["k2"] == (True, T0_MS + 1_000, T0_MS + 61_000)  # severe but short
        assert got["k3"][0] is True  # the mild ban was replaced, so after expiry a new one is accepted
        assert got["k4"] == (True, T0_MS + 200_000, None)  # permanent
        assert got["k5"][0] is False  # same severity as a permanent live ban


def test_fold_equals_doubling_on_random_data(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(500):
        user = "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(8)}"
        ms = rnd.randrange(40 * 3_600_000)
        if i % 13 == 0 and rows:
            ms = rows[-1][2]
        rows.append((f"n{i}", user, ms, i, rnd.choice([600_000, 3_600_000, None]), rnd.randint(1, 5)))
    df = nodes_df(spark, rows)
    for sev in (None, "sev"):
        a = sorted((r.node_id, r.accepted, r.until_ms) for r in
                   greedy_accept(df, ["user_id"], "ttl_ms", sev=sev, method="fold").collect())
        b = sorted((r.node_id, r.accepted, r.until_ms) for r in
                   greedy_accept(df, ["user_id"], "ttl_ms", sev=sev, method="doubling",
                                 bucket_ms=3_600_000).collect())
        assert a == b


def test_prefix_path_equals_naive_with_small_buckets(events_df):
    df = events_df(random_events(500, seed=5))
    for window in (600_000, 3 * 3_600_000):
        a = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", window, "n",
                                                            bucket_ms=300_000, method="prefix").collect()}
        b = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", window, "n",
                                                            method="naive").collect()}
        assert a == b
        c = {r.event_id: r.v for r in W.count_in_range(df, ["user_id"], window, "v", bucket_ms=300_000,
                                                         method="prefix").collect()}
        d = {r.event_id: r.v for r in W.count_in_range(df, ["user_id"], window, "v", method="naive").collect()}
        assert c == d
    assert W.choose_method(300_000, 3_600_000) == "island" and W.choose_method(86_400_000, 3_600_000) == "island"
    assert W.choose_method(7 * 86_400_000, 3_600_000) == "prefix"


def test_interval_join_open_and_long_intervals_after_last_start(spark, events_df):
    from payguard.operators.joins import interval_join

    day = 86_400_000
    bans = spark.createDataFrame([("user-1", T0_MS, None, "perm"), ("user-2", T0_MS, T0_MS + 10 * day, "long"),
                                  ("user-3", T0_MS + day, T0_MS + day + 5, "short")],
                                 "user_id string, valid_from_ms long, valid_to_ms long, reason string")
    ev = events_df([event_row("a", user="user-1", ms=T0_MS + 40 * day, seq=1),
                    event_row("b", user="user-2", ms=T0_MS + 9 * day, seq=2),
                    event_row("c", user="user-2", ms=T0_MS + 10 * day, seq=3),
                    event_row("d", user="user-3", ms=T0_MS + day + 5, seq=4),
                    event_row("e", user="user-1", ms=T0_MS, seq=5)])
    got = {r.event_id: r.reason for r in interval_join(ev, bans, "ms", "valid_from_ms", "valid_to_ms",
                                                        keys=("user_id",), start_inclusive=False).collect()}
    assert got == {"a": "perm", "b": "long", "c": None, "d": None, "e": None}


def test_no_event_is_lost_without_user_merchant_or_time(spark, events_df):
    """Every event has exactly one decision (P8), whatever is missing from it."""
    from payguard.config import TESTDATA_CONFIG as CFG
    from payguard.plans import scoring as Q

    rows = []
    for i in range(200):
        r = event_row(event_id=f"e{i}", user=None if i % 10 == 0 else f"u{i % 7}", merchant=None if i % 9 == 0 else " " if i % 9 == 1 else f"m{i % 3}",
                      ms=T0_MS + i * 1_000, seq=i)
        if i % 11 == 0:
            r["ms"] = None
        rows.append(r)
    ev = events_df(rows)
    out = {}
    for method in ("island", "prefix"):
        from payguard.operators import windows as W
        v = W.velocity(W.merchant_burst(ev, 60_000, method=method), 60_000, method=method)
        out[method] = {r.event_id: (r.merchant_users, r.velocity_7d) for r in v.collect()}
    assert out["island"] == out["prefix"] and len(out["island"]) == 200

    def want(r):
        timed = [x for x in rows if x["ms"] is not None and r["ms"] is not None and r["ms"] - 60_000 <= x["ms"] <= r["ms"]]
        m = r["merchant_id"]
        users = 0 if m is None else 1 if m == " " or r["ms"] is None else len({x["user_id"] for x in timed if x["merchant_id"] == m} - {None})
        return users, 1 if r["user_id"] is None or r["ms"] is None else sum(x["user_id"] == r["user_id"] for x in timed)
    assert out["island"] == {r["event_id"]: want(r) for r in rows}
    assert Q.score_events(ev, CFG).decisions.count() == 200


def test_f26_near_rows_are_found_in_one_exchange(spark):
    """w1_supplier_burst: every neighbour nearer than the edge, across buckets too; no row is lost or doubled."""
    import random
    from collections import defaultdict
    rng, edge = random.Random(26), 50
    rows = [(f"k{rng.randint(0, 3)}", rng.choice((rng.randint(-2_000, 2_000), 400 * rng.randint(-4, 4) + rng.randint(-2, 2))), i)
            for i in range(600)]
    df = W.near_rows(spark.createDataFrame(rows, "k string, ms long, seq long"), ["k"], edge, "ms", "seq", 60)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.seq: (r._pg_prev, r._pg_next) for r in df.collect()}
    assert df.count() == len(got) == len(rows)
    by_key = defaultdict(list)
    for k, ms, seq in rows:
        by_key[k].append((ms, seq))
    near = lambda a, b: None if a is None or b is None or abs(a - b) >= edge else a
    for line in by_key.values():
        line.sort()
        times = [None, *(ms for ms, _ in line), None]
        for i, (ms, seq) in enumerate(line):
            assert (near(got[seq][0], ms), near(got[seq][1], ms)) == (near(times[i], ms), near(times[i + 2], ms))


def test_f26_long_windows_without_members(spark, events_df):
    rows = [event_row(f"e{i}", user=None if i % 3 else f"u{i % 2}", ms=T0_MS + 86_400_000 * i, seq=i) for i in range(40)]
    df = events_df(rows)
    a = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", 9 * 86_400_000, "n", method="prefix").collect()}
    b = {r.event_id: r.n for r in W.distinct_in_range(df, ["merchant_id"], "user_id", 9 * 86_400_000, "n", method="naive").collect()}
    assert a == b and len(a) == 40
