"""Sliding-window counts per key (W1 merchant burst, W2 rate limit,
W3 7-day velocity).

Exact semantics: for an event at ``t`` of group ``g`` the count is the
number of distinct members with an event of ``g`` in ``[t - span, t]``
(peers at the same ms included, as in a SQL RANGE frame).

Scalable form ("island"): a member's events cover ``[e, e + span]``; runs of
overlapping covers are merged, each run adds +1 at its first ms and -1 one ms
after its end, and the count is a running sum of these deltas.  Rows are
first copied into every time bucket (>= one window long) their cover reaches,
so each (key, bucket) group is self-contained: one exchange on (key, bucket)
serves both the per-member neighbour lookup and the running sum, and a hot
key (one merchant with a third of all rows) is spread over as many tasks as
it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payguard.config import HOUR_MS
from payguard.session import cut_lineage

_B = "_pg_bucket"


def _bucket(ms: Column, bucket_ms: int) -> Column:
    return F.floor(ms / F.lit(bucket_ms)).cast("long")


def prev_next_ms(df: DataFrame, keys: list[str], ms: str = "ms", seq: str = "seq",
                 bucket_ms: int = HOUR_MS, prev: str = "prev_ms", nxt: str = "next_ms") -> DataFrame:
    """Add the ms of the previous / next row of the same key (order ms, seq).

    Rows are hash-partitioned by (key, time bucket), so a hot key is split.
    Neighbours inside a bucket come from ``lag``/``lead``; across buckets
    from the last / first ms of the neighbouring non-empty bucket, a per-bucket
    aggregate that is combined before its (small) shuffle and reads only the key and
    time columns, stitched back with a join on (key, bucket).
    """
    raw = df.withColumn(_B, _bucket(F.col(ms), bucket_ms))
    b = raw.repartition(*keys, _B)
    w = Window.partitionBy(*keys, _B).orderBy(ms, seq)
    local = b.withColumn("_pg_lp", F.lag(ms).over(w)).withColumn("_pg_ln", F.lead(ms).over(w))
    ws = Window.partitionBy(*keys).orderBy(_B)
    edges = (raw.groupBy(*keys, _B).agg(F.min(ms).alias("_pg_bmin"), F.max(ms).alias("_pg_bmax"))
             .select(*keys, _B, F.lag("_pg_bmax").over(ws).alias("_pg_pb"),
                     F.lead("_pg_bmin").over(ws).alias("_pg_nb")))
    out = local.join(edges, on=[*keys, _B], how="inner")
    return (out.withColumn(prev, F.coalesce("_pg_lp", "_pg_pb"))
            .withColumn(nxt, F.coalesce("_pg_ln", "_pg_nb"))
            .drop("_pg_lp", "_pg_ln", "_pg_pb", "_pg_nb", _B))


def running_sum(df: DataFrame, keys: list[str], ms: str, value: str, out: str,
                bucket_ms: int = HOUR_MS, ties: list[str] | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same key with ms <= this
    row's ms (peers included; with ``ties``, peers up to this row in the order of
    those columns). Parallel prefix sum: local sums per
    (key, bucket) plus the total of all earlier buckets of the key (a small
    per-bucket table), so a hot key is spread over its buckets."""
    raw = df.withColumn(_B, _bucket(F.col(ms), bucket_ms))
    b = raw.repartition(*keys, _B)
    w = Window.partitionBy(*keys, _B)
    w = (w.orderBy(ms, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow) if ties
         else w.orderBy(ms).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumn("_pg_local", F.sum(value).over(w))
    ws = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    # totals are combined before their shuffle and read the key, time and value alone
    offs = (raw.groupBy(*keys, _B).agg(F.sum(value).alias("_pg_bs"))
            .select(*keys, _B, F.coalesce(F.sum("_pg_bs").over(ws), F.lit(0)).alias("_pg_off")))
    return (local.join(offs, on=[*keys, _B], how="inner")
            .withColumn(out, (F.col("_pg_off") + F.col("_pg_local")).cast("long"))
            .drop("_pg_local", "_pg_off", _B))


ISLAND_MAX_SPAN_MS = 86_400_000


def choose_method(span_ms: int, bucket_ms: int, island_max_span_ms: int = ISLAND_MAX_SPAN_MS) -> str:
    """``island`` (localised, one exchange, <= 2 copies per row, buckets one
    window long) for windows up to ``island_max_span_ms``; ``prefix`` (no
    copies, ``bucket_ms`` buckets, a few small extra exchanges) for longer
    windows, where a window-long bucket of a hot key would be too large for
    one task."""
    return "island" if span_ms <= max(bucket_ms, island_max_span_ms) else "prefix"


def _localize(df: DataFrame, keys: list[str], ms: str, span_ms: int, bucket_ms: int) -> DataFrame:
    """Copy every row into each time bucket its cover ``[ms, ms + span]``
    reaches. A row is *real* only in its own bucket. Afterwards every
    (key, bucket) group holds all rows any of its real rows can see, so the
    operator needs one exchange on (key, bucket) and no cross-bucket fix-up.
    Copies per row: at most ``1 + ceil(span / bucket)``."""
    own = _bucket(F.col(ms), bucket_ms)
    last = _bucket(F.col(ms) + F.lit(span_ms), bucket_ms)
    return (df.withColumn("_pg_own", own)
            .withColumn(_B, F.explode(F.sequence(own, last)))
            .withColumn("_pg_real", F.col(_B) == F.col("_pg_own"))
            .drop("_pg_own")
            .repartition(*keys, _B))


def local_bucket_ms(span_ms: int, bucket_ms: int) -> int:
    """Bucket used by the localised operators: at least one window long, so a
    row is copied at most twice, and for short windows at most four windows, so
    that a hot key spreads over many tasks."""
    return max(int(span_ms) + 1, min(int(bucket_ms), 4 * (int(span_ms) + 1)))


def distinct_in_range(df: DataFrame, keys: list[str], member: str, span_ms: int, out: str,
                      ms: str = "ms", seq: str = "seq", bucket_ms: int = HOUR_MS,
                      method: str = "auto", ties: str = "peers") -> DataFrame:
    """Add ``out`` = distinct ``member`` values of the same ``keys`` with an
    event in ``[ms - span_ms, ms]``. A null member counts as none. Rows must have non-null keys and times.
    ``ties="peers"`` counts every row at the current ms (SQL RANGE);
    ``ties="arrival"`` counts rows at the current ms only up to this one in
    ``seq`` order (the sequential reference behaviour).

    ``island``: rows are localised to (key, bucket) groups; per member, runs
    of overlapping covers give +1 at their first ms and -1 one ms after their
    end; the count is the running sum of those deltas in the group. One
    exchange; a hot key is split into as many groups as it has buckets.
    ``naive``: ``size(collect_set)`` over a RANGE frame per key (reference
    semantics check; one task per key).
    """
    if method == "auto":
        method = choose_method(span_ms, bucket_ms)
    if method == "naive":
        w = (Window.partitionBy(*keys).orderBy(ms).rangeBetween(-span_ms, Window.currentRow))
        return df.withColumn(out, F.size(F.collect_set(member).over(w)).cast("long"))
    if method == "prefix":
        return _distinct_prefix(df, keys, member, span_ms, out, ms, seq, bucket_ms, ties)
    if method != "island":
        raise ValueError(f"unknown method {method!r}")
    edge = span_ms + 1
    loc = _localize(df, keys, ms, span_ms, local_bucket_ms(span_ms, bucket_ms))
    wm = Window.partitionBy(*keys, _B, member).orderBy(ms, seq)
    loc = (loc.withColumn("_pg_prev", F.lag(ms).over(wm))
              .withColumn("_pg_next", F.lead(ms).over(wm)))
    known = F.col(member).isNotNull()
    start = known & (F.col("_pg_prev").isNull() | (F.col(ms) >= F.col("_pg_prev") + edge))
    stop = known & (F.col("_pg_next").isNull() | (F.col("_pg_next") >= F.col(ms) + edge))
    # one output row per input copy (delta 0 keeps real rows), plus an extra
    # -1 row when the run ends here; +1 rides on the row itself
    d_self = F.when(start, F.lit(1)).otherwise(F.lit(0))
    items = F.array(
        F.struct(F.col(ms).alias("t"), F.lit(1).alias("k"), d_self.alias("d"), F.col("_pg_real").alias("keep")),
        F.when(stop, F.struct((F.col(ms) + edge).alias("t"), F.lit(0).alias("k"), F.lit(-1).alias("d"),
                              F.lit(False).alias("keep"))))
    exp = loc.withColumn("_pg_it", F.explode(F.array_compact(items)))
    if ties == "arrival":
        # sequential semantics: peers at the same ms count only if they
        # arrived earlier (expiries at that ms apply first)
        wr = (Window.partitionBy(*keys, _B).orderBy(F.col("_pg_it.t"), F.col("_pg_it.k"), F.col(seq))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        wr = (Window.partitionBy(*keys, _B).orderBy(F.col("_pg_it.t"))
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = exp.withColumn(out, F.sum(F.col("_pg_it.d")).over(wr).cast("long"))
    return counted.filter(F.col("_pg_it.keep")).drop("_pg_it", "_pg_prev", "_pg_next", "_pg_real", _B)


SUM_BUCKET_MS = 7 * 86_400_000  # longest stretch of a key that one task sums
NEAR_SPANS = 8  # edges in a bucket of ``near_rows``: a quarter of the rows is copied


def near_rows(df: DataFrame, keys: list[str], edge: int, ms: str, seq: str, bucket_ms: int, prev: str = "_pg_prev",
              nxt: str = "_pg_next") -> DataFrame:
    """Add the ms of the previous / next row of the same key (order ms, seq) wherever that is less than
    ``edge`` away; one farther away may be missing. Rows are hash-partitioned by (key, bucket of ``NEAR_SPANS`` edges
    at least), and those less than ``edge`` from a bucket's ends are copied into the bucket beyond: one exchange, no join."""
    size = max(int(bucket_ms), NEAR_SPANS * edge)
    own, at = _bucket(F.col(ms), size), F.pmod(F.col(ms), F.lit(size))
    steps = F.array_compact(F.array(F.lit(0), F.when(at < edge, -1), F.when(at >= size - edge, 1)))
    w = Window.partitionBy(*keys, _B).orderBy(ms, seq)
    return (df.withColumn("_pg_step", F.explode(steps)).withColumn(_B, own + F.col("_pg_step")).repartition(*keys, _B)
            .withColumn(prev, F.lag(ms).over(w)).withColumn(nxt, F.lead(ms).over(w))
            .filter(F.col("_pg_step") == 0).drop("_pg_step", _B))


def _distinct_prefix(df: DataFrame, keys: list[str], member: str, span_ms: int, out: str, ms: str, seq: str,
                     bucket_ms: int, ties: str) -> DataFrame:
    """Island deltas from per-member neighbours (those nearer than the window matter) summed
    by a parallel prefix sum, for any window length. A row without a member has no neighbours."""
    edge, known = span_ms + 1, F.col(member).isNotNull()
    some = df.withColumn("_pg_member", F.coalesce(F.col(member).cast("string"), F.concat(F.lit("\u0000"), F.col(seq).cast("string"))))
    pn = near_rows(some, [*keys, "_pg_member"], edge, ms, seq, bucket_ms)
    start = known & (F.col("_pg_prev").isNull() | (F.col(ms) >= F.col("_pg_prev") + edge))
    stop = known & (F.col("_pg_next").isNull() | (F.col("_pg_next") >= F.col(ms) + edge))
    items = F.array(
        F.struct(F.col(ms).alias("t"), F.lit(1).alias("k"), F.when(start, 1).otherwise(0).alias("d"),
                 F.lit(True).alias("keep")),
        F.when(stop, F.struct((F.col(ms) + edge).alias("t"), F.lit(0).alias("k"), F.lit(-1).alias("d"),
                              F.lit(False).alias("keep"))))
    # a run's end needs its key alone
    rest = [F.when(F.col("_pg_it.keep"), F.col(c)).alias(c) for c in df.columns if c not in keys]
    exp = pn.withColumn("_pg_it", F.explode(F.array_compact(items))).select(
        *keys, *rest, F.col("_pg_it.t").alias("_pg_t"), F.col("_pg_it.d").alias("_pg_d"), F.col("_pg_it.k").alias("_pg_k"),
        F.col("_pg_it.keep").alias("_pg_keep"))
    exp = cut_lineage(exp)  # read twice below; the neighbours are found once
    size = max(int(bucket_ms), min(edge, SUM_BUCKET_MS))  # totals by bucket: few where times are coarse
    r = running_sum(exp, keys, "_pg_t", "_pg_d", out, size, ["_pg_k", seq] if ties == "arrival" else None)
    return r.filter(F.col("_pg_keep")).drop("_pg_t", "_pg_d", "_pg_k", "_pg_keep")


def count_in_range(df: DataFrame, keys: list[str], span_ms: int, out: str, ms: str = "ms",
                   bucket_ms: int = HOUR_MS, method: str = "auto") -> DataFrame:
    """Add ``out`` = rows of the same keys with ms in ``[ms - span_ms, ms]``
    (localised running sum of +1 at ms and -1 one ms after ms + span)."""
    if method == "auto":
        method = choose_method(span_ms, bucket_ms)
    if method == "naive":
        w = Window.partitionBy(*keys).orderBy(ms).rangeBetween(-span_ms, Window.currentRow)
        return df.withColumn(out, F.count(F.lit(1)).over(w))
    if method == "prefix":
        items = F.array(
            F.struct(F.col(ms).alias("t"), F.lit(1).alias("d"), F.lit(True).alias("keep")),
            F.struct((F.col(ms) + span_ms + 1).alias("t"), F.lit(-1).alias("d"), F.lit(False).alias("keep")))
        exp = (df.withColumn("_pg_it", F.explode(items)).withColumn("_pg_t", F.col("_pg_it.t"))
               .withColumn("_pg_d", F.col("_pg_it.d")).withColumn("_pg_keep", F.col("_pg_it.keep")).drop("_pg_it"))
        r = running_sum(exp, keys, "_pg_t", "_pg_d", out, bucket_ms)
        return r.filter(F.col("_pg_keep")).drop("_pg_t", "_pg_d", "_pg_keep")
    loc = _localize(df, keys, ms, span_ms, local_bucket_ms(span_ms, bucket_ms))
    items = F.array(
        F.struct(F.col(ms).alias("t"), F.lit(1).alias("d"), F.col("_pg_real").alias("keep")),
        F.struct((F.col(ms) + span_ms + 1).alias("t"), F.lit(-1).alias("d"), F.lit(False).alias("keep")))
    exp = loc.withColumn("_pg_it", F.explode(items))
    wr = (Window.partitionBy(*keys, _B).orderBy(F.col("_pg_it.t"))
          .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = exp.withColumn(out, F.sum(F.col("_pg_it.d")).over(wr).cast("long"))
    return counted.filter(F.col("_pg_it.keep")).drop("_pg_it", "_pg_real", _B)


# --- the three reference computations ----------------------------------------

def _keyed_or_alone(events: DataFrame, name: str, key: Column, alone: Column) -> DataFrame:
    """``name`` and ``_pg_ms``: rows without a key or a time get a key of their own
    (a one-row group each), so they are neither lost nor a hot key."""
    alone = alone | F.col("ms").isNull()
    return (events.withColumn(name, F.when(alone, F.concat(F.lit("\u0000"), F.col("event_id"))).otherwise(key))
            .withColumn("_pg_ms", F.coalesce("ms", F.lit(0).cast("long"))))


def merchant_burst(events: DataFrame, window_ms: int, out: str = "merchant_users",
                   bucket_ms: int = HOUR_MS, method: str = "auto", ties: str = "peers") -> DataFrame:
    """Distinct users per merchant in ``[t - window, t]``.

    Null merchant: 0 (rule not eligible). Blank merchant, or no time: 1. These are keyed
    per event, so they need no second scan and no union; the count is fixed
    afterwards. Events without a user see the merchant's users and add none.
    """
    from payguard.functions import is_blank

    m = F.col("merchant_id")
    keyed = _keyed_or_alone(events, "_pg_mkey", m, m.isNull() | is_blank(m))
    if method == "naive":
        counted = distinct_in_range(keyed, ["_pg_mkey"], "user_id", window_ms, out, ms="_pg_ms", method="naive")
    else:
        counted = distinct_in_range(keyed, ["_pg_mkey"], "user_id", window_ms, out, ms="_pg_ms",
                                    bucket_ms=bucket_ms, method=method, ties=ties)
    fixed = F.when(m.isNull(), F.lit(0)).when(is_blank(m) | F.col("ms").isNull(), F.lit(1)).otherwise(F.col(out)).cast("long")
    return counted.withColumn(out, fixed).drop("_pg_mkey", "_pg_ms")


def velocity(events: DataFrame, window_ms: int, out: str = "velocity_7d",
             bucket_ms: int = HOUR_MS, method: str = "auto") -> DataFrame:
    """Events of the user in ``[t - window, t]`` (the current one included). An event
    without a user or a time counts itself alone."""
    keyed = _keyed_or_alone(events, "_pg_ukey", F.col("user_id"), F.col("user_id").isNull())
    out_df = count_in_range(keyed, ["_pg_ukey"], window_ms, out, ms="_pg_ms", bucket_ms=bucket_ms, method=method)
    return out_df.drop("_pg_ukey", "_pg_ms")


def rate_limit(calls: DataFrame, window_ms: int, limit: int, count_col: str = "rate_count",
               blocked_col: str = "rate_blocked", bucket_ms: int = HOUR_MS,
               method: str = "auto", ties: str = "arrival") -> DataFrame:
    """Distinct request ids of the user with a call in ``(t - window, t]``, calls
    of one ms in order of ``seq``; blocked iff the count exceeds ``limit``. Blocked
    calls still count and a retry with the same request id moves that id forward."""
    out = distinct_in_range(calls, ["user_id"], "request_id", window_ms - 1, count_col,
                            bucket_ms=bucket_ms, method=method, ties=ties)
    return out.withColumn(blocked_col, F.col(count_col) > F.lit(limit))
