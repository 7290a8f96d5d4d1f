"""Dynamic rules: normalise and validate the rule log (P11, P12, F11),
latest state per rule (A12), the rule-set fold (A2) at every change point,
and the as-of join of events to the rule version live at their time (J1).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payguard.config import ALLOWED_RULE_TYPES, DAY_MS, RiskConfig
from payguard.functions import parse_int_strict

# Fixed values: (rule type, parameter key) -> scoring parameter it sets.
PARAMETER_KEYS = (
    ("large_amount", "amount_cents", "large_amount_cents"),
    ("large_amount", "score_delta", "large_amount_score"),
    ("withdrawal_without_device", "score_delta", "withdrawal_score"),
    ("merchant_multi_user_burst", "burst_threshold", "burst_threshold"),
    ("merchant_multi_user_burst", "score_delta", "burst_score"),
    ("high_velocity_7d", "velocity_threshold", "velocity_threshold"),
    ("high_velocity_7d", "score_delta", "velocity_score"),
    ("global", "review_threshold", "review_threshold"),
    ("global", "block_threshold", "block_threshold"),
)
PARAMS = tuple(p for _, _, p in PARAMETER_KEYS)
LONG_PARAMS = ("large_amount_cents",)


def param_type(name: str) -> str:
    return "long" if name in LONG_PARAMS else "int"


def static_params(cfg: RiskConfig) -> dict[str, Column]:
    return {p: F.lit(getattr(cfg, p)).cast(param_type(p)) for p in PARAMS}


def normalize_rule_updates(updates: DataFrame) -> DataFrame:
    """Lower-case type, null parameters -> empty map, flag known types."""
    return (updates
            .withColumn("rule_type", F.lower("rule_type"))
            .withColumn("parameters", F.coalesce("parameters", F.create_map().cast("map<string,string>")))
            .withColumn("known_type", F.col("rule_type").isin(*ALLOWED_RULE_TYPES)))


def _param_map_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARAMETER_KEYS), "rule_type string, pkey string, param string")


def split_valid_rules(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """an enabled update of a known type whose recognised parameter is not
    a clean integer is quarantined instead of failing the job."""
    u = normalize_rule_updates(updates)
    checks = [F.when(F.col("rule_type") == t, F.when(
        F.map_contains_key("parameters", k) & parse_int_strict(F.element_at("parameters", F.lit(k)),
                                                               param_type(p)).isNull(), F.lit(k)))
              for t, k, p in PARAMETER_KEYS]
    u = u.withColumn("bad_keys", F.array_compact(F.array(*checks)))
    bad = F.col("enabled") & F.col("known_type") & (F.size("bad_keys") > 0)
    return u.filter(~bad).drop("bad_keys"), u.filter(bad)




def fold_rule_set(active: DataFrame, cfg: RiskConfig) -> DataFrame:
    """A2 over one set of active rules: defaults, then each enabled rule of a
    known type overrides the keys it carries; several rules of one type:
    latest ``updated_at`` then greatest ``rule_id`` wins per key. One row."""
    pm = _param_map_df(active.sparkSession)
    kv = (active.filter("enabled").select("rule_id", "rule_type", "updated_at",
                                          F.explode("parameters").alias("pkey", "pval"))
          .join(F.broadcast(pm), ["rule_type", "pkey"]))  # literal 9-row table
    aggs = [F.max_by(F.when(F.col("param") == p, F.col("pval")),
                     F.when(F.col("param") == p, F.struct("updated_at", "rule_id"))).alias(p)
            for p in PARAMS]
    folded = kv.agg(*aggs)
    return folded.select(*[F.coalesce(parse_int_strict(p, param_type(p)),
                                      F.lit(getattr(cfg, p)).cast(param_type(p))).alias(p) for p in PARAMS])


POINTS_PER_BUCKET = 20_000  # change points of a time bucket
SMALL_LOG_ROWS = 2_000      # updates of a log that is swept on the driver
SMALL_VERSIONS = 64         # versions that are looked up as literals
SALTS = 16                  # tasks that share a time bucket of the as-of merge
_VERSION_TYPES = "valid_from_ms long, valid_to_ms long, " + ", ".join(f"{p} string" for p in PARAMS)


def _sweep_bucket(pdf: pd.DataFrame, after: dict[int, int]) -> pd.DataFrame:
    """One time bucket: of each parameter the contributions in order of start, a heap of those
    that may be live, latest (start, rule id) on top; at each change point the top live one wins.
    ``after``: the first change point after each bucket."""
    points = np.sort(pdf.loc[pdf["param"].isna(), "from_ms"].to_numpy(np.int64)).tolist()
    ends = [*points[1:], after.get(int(pdf["bucket"].iloc[0]))]
    out = {"valid_from_ms": pd.array(points, dtype="Int64"), "valid_to_ms": pd.array(ends[:len(points)], dtype="Int64")}
    by_param = {p: rows.sort_values(["from_ms", "rule_id"]) for p, rows in pdf.groupby("param")}
    for p in PARAMS:
        won: list = [None] * len(points)
        if p in by_param:
            starts = list(zip(*(by_param[p][c].tolist() for c in ("from_ms", "to_ms", "pval"))))
            heap: list[tuple] = []
            i = 0
            for k, cp in enumerate(points):
                while i < len(starts) and starts[i][0] <= cp:
                    # starts ascend, so the arrival number orders the heap by (start, rule id)
                    heapq.heappush(heap, (-i, starts[i][1], starts[i][2]))
                    i += 1
                while heap and heap[0][1] <= cp:
                    heapq.heappop(heap)
                won[k] = heap[0][2] if heap else None
        out[p] = pd.Series(won, dtype=object)
    return pd.DataFrame(out)


def _bucket_of(ms: str, bounds: list[int]) -> Column:
    """Index of the time bucket; ``bounds`` are the ascending first points of all but the
    first. A tree of comparisons."""
    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(F.col(ms) < bounds[mid], find(lo, mid)).otherwise(find(mid + 1, hi))
    return find(0, len(bounds))


def _spanning(contrib: DataFrame, top: Column, buckets: int) -> DataFrame:
    """bucket, param, win: the top contribution of those live throughout a bucket between
    their first and last. Each is cut into aligned blocks of 2^l buckets (at most two a level), a
    maximum per block, and the blocks' maxima go to their buckets."""
    lo, hi = F.col("first_b") + 1, F.col("last_b")
    blocks = []
    for level in range(buckets.bit_length()):
        a, b = F.shiftright(lo + ((1 << level) - 1), level), F.shiftright(hi, level)
        for fits, index in ((a % 2 == 1, a), (b % 2 == 1, b - 1)):
            blocks.append(F.when((a < b) & fits, F.struct(F.lit(level).alias("level"), index.alias("i"))))
    cut = contrib.filter(lo < hi).withColumn("block", F.explode(F.array_compact(F.array(*blocks))))
    best = cut.groupBy("param", "block").agg(F.max(top).alias("win"))
    width = F.expr("shiftleft(1L, block.level)")
    return (best.withColumn("bucket", F.explode(F.sequence(F.col("block.i") * width, (F.col("block.i") + 1) * width - 1)))
            .groupBy("bucket", "param").agg(F.max("win").alias("win")))


def _contributions(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid updates (rule_id, upd_ms), and the parameters they set with the time they do
    (``from_ms <= t < to_ms``, 2^62: open): each update of a rule is that rule's state
    until the rule's next one (A12 over time)."""
    valid, _bad = split_valid_rules(updates)
    u = valid.select("rule_id", "rule_type", "enabled", "known_type", "parameters", F.unix_millis("updated_at").alias("upd_ms"),
                     F.coalesce("log_offset", F.lit(0)).cast("long").alias("_ord"))
    nxt = F.lead("upd_ms").over(Window.partitionBy("rule_id").orderBy("upd_ms", "_ord"))
    pm = _param_map_df(updates.sparkSession)
    contrib = (u.withColumn("to_ms", F.coalesce(nxt, F.lit(2**62)))
               .filter(F.col("enabled") & F.coalesce("known_type", F.lit(False)))
               .select("rule_id", "rule_type", F.col("upd_ms").alias("from_ms"), "to_ms",
                       F.explode("parameters").alias("pkey", "pval"))
               .join(F.broadcast(pm), ["rule_type", "pkey"])  # literal 9-row table
               .select("param", "from_ms", "to_ms", "rule_id", "pval").filter("from_ms < to_ms"))
    return u, contrib


_NAMES = ["bucket", "param", "from_ms", "to_ms", "rule_id", "pval"]


def _point_rows(points: DataFrame, bucket: Column) -> DataFrame:
    return points.select(bucket.alias("bucket"), F.lit(None).cast("string").alias("param"), "from_ms",
                         F.lit(None).cast("long").alias("to_ms"), F.lit(None).cast("string").alias("rule_id"),
                         F.lit(None).cast("string").alias("pval"))


def _typed_versions(wide: DataFrame, cfg: RiskConfig) -> DataFrame:
    return wide.select("valid_from_ms", "valid_to_ms", *[
        F.coalesce(parse_int_strict(p, param_type(p)), F.lit(getattr(cfg, p)).cast(param_type(p))).alias(p) for p in PARAMS])


def small_versions(updates: DataFrame, cfg: RiskConfig, most_rows: int = SMALL_LOG_ROWS) -> list[dict] | None:
    """The versions of :func:`rule_versions` as local rows, by one job that reads the log
    once; None where the log has more than ``most_rows`` updates."""
    few = updates.limit(most_rows + 1).collect()
    if len(few) > most_rows:
        return None
    spark = updates.sparkSession
    local = spark.createDataFrame(few, updates.schema)
    u, contrib = _contributions(local)
    rows = _point_rows(u.select(F.col("upd_ms").alias("from_ms")).distinct(), F.lit(0).cast("long")).unionByName(
        contrib.withColumn("bucket", F.lit(0).cast("long")).select(*_NAMES)).toPandas()
    if not len(rows):
        return []
    swept = _sweep_bucket(rows, {})
    defaults = {p: getattr(cfg, p) for p in PARAMS}
    return [{"valid_from_ms": int(r["valid_from_ms"]), "valid_to_ms": None if pd.isna(r["valid_to_ms"]) else int(r["valid_to_ms"]),
             **{p: defaults[p] if r[p] is None else int(r[p]) for p in PARAMS}} for r in swept.to_dict("records")]


def rule_versions(updates: DataFrame, cfg: RiskConfig, points_per_bucket: int = POINTS_PER_BUCKET) -> DataFrame:
    """Effective-dated rule sets: one row per change point with
    ``valid_from_ms``, ``valid_to_ms`` (null = open) and the 9 parameters.

    Each update of a rule is that rule's state from its ``updated_at`` until
    the rule's next update (A12 over time). Its parameters are contributions
    live over that interval; at every change point the winner per parameter
    is the live contribution with the latest (updated_at, rule_id).

    Time is cut into buckets of about ``points_per_bucket`` change points, and each bucket is swept
    on its own. A contribution goes to the bucket of its start and, of those with the
    same end, the top one to the bucket of that end; of those live throughout a
    bucket only the top one does. So no task holds more of the log than its bucket's updates.
    """
    u, contrib = _contributions(updates)
    points = u.select(F.col("upd_ms").alias("from_ms")).distinct()
    n = points.count()
    buckets, bounds, after = -(-n // points_per_bucket), [], {}
    if buckets > 1:
        cuts = [k / buckets for k in range(1, buckets)]
        bounds = sorted(set(points.agg(F.percentile_approx("from_ms", cuts, max(10_000, 20 * buckets))).first()[0]))
        firsts = sorted(tuple(r) for r in points.groupBy(_bucket_of("from_ms", bounds).alias("b")).agg(F.min("from_ms")).collect())
        after = {b: first for (b, _), (_, first) in zip(firsts, firsts[1:])}
    rows = _point_rows(points, _bucket_of("from_ms", bounds))
    # of those with the same start only such that end after all with a greater rule id can win
    later = Window.partitionBy("param", "from_ms").orderBy(F.desc("rule_id")).rowsBetween(Window.unboundedPreceding, -1)
    contrib = (contrib.withColumn("_longest", F.max("to_ms").over(later)).filter("_longest IS NULL OR to_ms > _longest").drop("_longest")
               .withColumn("first_b", _bucket_of("from_ms", bounds)).withColumn("last_b", _bucket_of("to_ms", bounds)))
    rows = rows.unionByName(contrib.withColumnRenamed("first_b", "bucket").select(*_NAMES))
    if bounds:
        top = F.struct("from_ms", "rule_id", "to_ms", "pval")
        carried = contrib.filter("first_b < last_b").groupBy(F.col("last_b").alias("bucket"), "param", F.col("to_ms").alias("_end")).agg(
            F.max(top).alias("win")).drop("_end").unionByName(_spanning(contrib, top, len(bounds) + 1))
        rows = rows.unionByName(carried.select("bucket", "param", "win.*").select(*_NAMES))
    wide = rows.groupBy("bucket").applyInPandas(lambda pdf: _sweep_bucket(pdf, after), _VERSION_TYPES)
    return _typed_versions(wide, cfg)


def change_span(updates: DataFrame) -> tuple[int, int] | None:
    """Times of the rule log's first and last update (scalars); None: no update."""
    first, last = updates.agg(F.min(F.unix_millis("updated_at")), F.max(F.unix_millis("updated_at"))).first()
    return None if last is None else (int(first), int(last))


def asof_merge(events: DataFrame, versions: DataFrame, span: tuple[int, int] | None, ms: str = "ms",
               bucket_ms: int = DAY_MS, salts: int = SALTS) -> DataFrame:
    """J1 without pairs: events and versions are merged by time and each event takes
    the last version at or before it, by a running window.

    Time is cut into buckets. A version goes to the bucket it begins in and, as the first
    there, to each later bucket that it is live at the start of (versions follow one another, so that is
    one per bucket). A bucket's events are dealt over ``salts`` tasks, its versions go to each; events after the
    last change share its version and are dealt over as many tasks as all buckets. Rows grow with events and
    versions. Events without a time are before every version. ``span``: times that hold all
    changes (None: there are none).
    """
    if span is None:
        none = [F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in versions.columns if c != "valid_to_ms"]
        return events.select("*", *none)
    low, cap = span[0] // bucket_ms, span[1] // bucket_ms + 1
    deal = F.xxhash64(*[c for c, t in events.dtypes if not t.startswith("map")])
    own = F.floor(F.coalesce(F.col(ms), F.lit(-2**62)) / bucket_ms).cast("long")
    tail = max(1, min(1_000, cap - low))  # buckets of the time after the last change
    own = F.when(own < low, low - 1 - F.pmod(deal, F.lit(tail))).when(own >= cap, cap + F.pmod(F.shiftright(deal, 8), F.lit(tail))).otherwise(own)
    payload = [c for c in versions.columns if c not in ("valid_from_ms", "valid_to_ms")]
    many = events.withColumn("_pg_b", own).withColumn("_pg_s", F.pmod(deal, F.lit(salts)).cast("int")).withColumn("_pg_at", F.col(ms))
    begin = F.floor(F.col("valid_from_ms") / bucket_ms).cast("long")
    end = F.least(F.floor((F.col("valid_to_ms") - 1) / bucket_ms).cast("long"), F.lit(cap - 1))
    until = F.when(F.col("valid_to_ms").isNull(), F.lit(cap + tail - 1).cast("long")).otherwise(end)
    few = (versions.select("valid_from_ms", "valid_to_ms", F.struct("valid_from_ms", *payload).alias("_pg_v"))
           .select(F.explode(F.sequence(begin, F.greatest(begin, until))).alias("_pg_b"), F.col("valid_from_ms").alias("_pg_at"), "_pg_v")
           .withColumn("_pg_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    both = many.withColumn("_pg_v", F.lit(None).cast(few.schema["_pg_v"].dataType)).withColumn("_pg_e", F.lit(1)).unionByName(
        few.withColumn("_pg_e", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("_pg_b", "_pg_s").orderBy("_pg_at", "_pg_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_pg_v", F.last("_pg_v", ignorenulls=True).over(order)).filter("_pg_e = 1")
    return out.select(*events.columns, "_pg_v.*")


def _literal_lookup(events: DataFrame, versions: list[dict], cfg: RiskConfig, ms: str) -> DataFrame:
    """J1 for a few versions: their places are a tree of comparisons, their values literals."""
    froms = [v["valid_from_ms"] for v in versions]
    rows = [F.struct(F.lit(None).cast("long").alias("rule_version_ms"), *[F.lit(getattr(cfg, p)).cast(param_type(p)).alias(f"rp_{p}") for p in PARAMS])]
    rows += [F.struct(F.lit(v["valid_from_ms"]).cast("long").alias("rule_version_ms"), *[F.lit(v[p]).cast(param_type(p)).alias(f"rp_{p}") for p in PARAMS])
             for v in versions]
    at = F.coalesce(_bucket_of(ms, froms), F.lit(0)) if froms else F.lit(0).cast("long")
    at = F.when(F.col(ms).isNull(), 0).otherwise(at)
    found = F.element_at(F.array(*rows), (at + 1).cast("int"))
    return events.withColumn("_pg_rule", found).select(*events.columns, "_pg_rule.*")


def attach_rule_params(events: DataFrame, versions: DataFrame, cfg: RiskConfig, span: tuple[int, int] | None,
                       ms: str = "ms", bucket_ms: int = DAY_MS) -> DataFrame:
    """Every event gets the parameters of the version live at its time
    (``valid_from <= ms < valid_to``); before the first change: defaults. ``span``: see :func:`change_span`."""
    renamed = versions.select("valid_from_ms", "valid_to_ms",
                              *[F.col(p).alias(f"rp_{p}") for p in PARAMS])
    j = asof_merge(events, renamed, span, ms, bucket_ms)
    return j.select(*events.columns, F.col("valid_from_ms").alias("rule_version_ms"), *[
        F.coalesce(F.col(f"rp_{p}"), F.lit(getattr(cfg, p)).cast(param_type(p))).alias(f"rp_{p}") for p in PARAMS])


def apply_rule_log(events: DataFrame, updates: DataFrame, cfg: RiskConfig, ms: str = "ms") -> DataFrame:
    """J1 from the log itself. A log of at most ``SMALL_LOG_ROWS`` updates and
    ``SMALL_VERSIONS`` versions is looked up as literals, without a shuffle of the events; any
    other one is swept in buckets and merged."""
    few = small_versions(updates, cfg)
    if few is None:
        return attach_rule_params(events, rule_versions(updates, cfg), cfg, change_span(updates), ms)
    if len(few) <= SMALL_VERSIONS:
        return _literal_lookup(events, few, cfg, ms)
    types = "valid_from_ms long, valid_to_ms long, " + ", ".join(f"{p} {param_type(p)}" for p in PARAMS)
    local = events.sparkSession.createDataFrame([tuple(v.values()) for v in few], types)
    return attach_rule_params(events, local, cfg, (few[0]["valid_from_ms"], few[-1]["valid_from_ms"]), ms)


def dynamic_params() -> dict[str, Column]:
    return {p: F.col(f"rp_{p}") for p in PARAMS}
