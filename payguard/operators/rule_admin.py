"""Rule administration (Q8): upsert and disable with a transactional outbox
(J5, J6, T14), listing (L1), the ordered outbox relay (L2, T13), latest
state of the change log with tombstones (A12, D5) and bootstrap (D7).

Tables are DataFrames; each operation returns the new versions of the
tables it touches, so one job writes them together (the transaction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.config import ALLOWED_RULE_TYPES

PAYLOAD = T.StructType([
    T.StructField("ruleId", T.StringType()), T.StructField("ruleType", T.StringType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("updatedAt", T.TimestampType())])


def _payload(rule_id, rule_type, enabled, parameters, updated_at) -> Column:
    return F.to_json(F.struct(rule_id.alias("ruleId"), rule_type.alias("ruleType"), enabled.alias("enabled"),
                              parameters.alias("parameters"), updated_at.alias("updatedAt")))


def upsert_rules(rules: DataFrame, outbox: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J5 + T14. ``requests`` = (rule_id, rule_type, parameters, at).
    Type is lower-cased and must be known (P11, else rejected); null
    parameters -> {} (P12); the row is replaced except ``created_at``,
    which an existing rule keeps; ``enabled`` is always set to true.
    Returns (rules', outbox', rejected requests)."""
    req = (requests.withColumn("rule_type", F.lower("rule_type"))
           .withColumn("parameters", F.coalesce("parameters", F.create_map().cast("map<string,string>"))))
    known = F.coalesce(F.col("rule_type").isin(*ALLOWED_RULE_TYPES), F.lit(False))  # a null type is unknown too
    bad = req.filter(~known)
    req = req.filter(known)
    # several requests for one rule in a batch: the last one wins
    last = req.groupBy("rule_id").agg(F.max_by(F.struct(*req.columns), "at").alias("r")).select("r.*")
    old = rules.select("rule_id", F.col("created_at").alias("_old_created"))
    new_rows = last.join(old, "rule_id", "left").select(
        "rule_id", "rule_type", "parameters", F.lit(True).alias("enabled"),
        F.coalesce("_old_created", "at").alias("created_at"), F.col("at").alias("updated_at"))
    rules2 = rules.join(new_rows.select("rule_id"), "rule_id", "left_anti").unionByName(new_rows)
    out_rows = req.select("rule_id", _payload(F.col("rule_id"), F.col("rule_type"), F.lit(True), F.col("parameters"),
                                              F.col("at")).alias("payload"),
                          F.col("at").alias("created_at"))
    return rules2, _append_outbox(outbox, out_rows), bad


def disable_rules(rules: DataFrame, outbox: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J6 + T14: set enabled=false, updated_at; outbox gets the full record
    with enabled=false. Unknown ids are returned as not found."""
    hit = rules.join(requests.select("rule_id", "at"), "rule_id")
    not_found = requests.join(rules.select("rule_id"), "rule_id", "left_anti")
    upd = hit.select("rule_id", "rule_type", "parameters", F.lit(False).alias("enabled"), "created_at",
                     F.col("at").alias("updated_at"))
    rules2 = rules.join(upd.select("rule_id"), "rule_id", "left_anti").unionByName(upd)
    out_rows = hit.select("rule_id", _payload(F.col("rule_id"), F.col("rule_type"), F.lit(False), F.col("parameters"),
                                              F.col("at")).alias("payload"), F.col("at").alias("created_at"))
    return rules2, _append_outbox(outbox, out_rows), not_found


def _append_outbox(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """Outbox ids continue after the current max id and count up without gaps in
    (created_at, rule_id, payload) order: a rank within the day plus the rows of
    earlier days, so the numbers don't depend on partitions or recomputation."""
    base = outbox.agg(F.max("id")).first()[0] or 0  # scalar
    day = F.to_date("created_at")
    days = rows.groupBy(day.alias("_d")).agg(F.count("*").alias("_n")).withColumn("_k", F.lit(0))
    earlier = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.select("_d", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_day").orderBy("created_at", "rule_id", "payload"))
    numbered = (rows.withColumn("_day", day).withColumn("_p", place)
                .join(days, F.col("_day").eqNullSafe(F.col("_d"))))
    new = numbered.select((F.lit(base) + F.col("_before") + F.col("_p")).cast("long").alias("id"), "rule_id", "payload",
                          "created_at", F.lit(None).cast("timestamp").alias("published_at"))
    return outbox.unionByName(new)


def list_rules(rules: DataFrame) -> DataFrame:
    """L1: ORDER BY updated_at DESC, rule_id ASC."""
    return rules.orderBy(F.col("updated_at").desc(), F.col("rule_id").asc())


def pending_outbox(outbox: DataFrame, batch_size: int | None) -> DataFrame:
    """L2: unpublished rows by id, at most ``batch_size`` (the relay batch; None: all)."""
    pending = outbox.filter(F.col("published_at").isNull())
    return pending if batch_size is None else pending.orderBy("id").limit(batch_size)


def relay_outbox(outbox: DataFrame, batch_size: int | None, now: Column, publishable: Column | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """Take the pending batch in id order, publish up to (not including)
    the first entry that cannot be published, mark the published ones.
    Returns (rule-log records published, outbox')."""
    batch = pending_outbox(outbox, batch_size)
    parsed = F.from_json("payload", PAYLOAD)
    ok = publishable if publishable is not None else (
        parsed["ruleId"].isNotNull() & parsed["ruleType"].isNotNull() & parsed["enabled"].isNotNull())
    stop = batch.filter(~ok).agg(F.min("id")).first()[0]  # scalar over <= batch_size rows
    sent = batch if stop is None else batch.filter(F.col("id") < F.lit(stop))
    log = sent.select("id", F.from_json("payload", PAYLOAD).alias("p")).select(
        F.col("p.ruleId").alias("rule_id"), F.col("p.ruleType").alias("rule_type"), F.col("p.enabled").alias("enabled"),
        F.col("p.parameters").alias("parameters"), F.col("p.updatedAt").alias("updated_at"),
        F.col("id").alias("log_offset"))
    marked = sent.select("id").withColumn("_sent", F.lit(True))
    out = (outbox.join(marked, "id", "left")
           .withColumn("published_at", F.when(F.col("_sent") & F.col("published_at").isNull(), now)
                       .otherwise(F.col("published_at"))).drop("_sent"))
    return log, out


def latest_state(change_log: DataFrame) -> DataFrame:
    """A12 + D5 over a compacted log (rule_id, value columns, log_offset):
    last record per rule by offset; a tombstone (null rule_type) or a
    disabled record removes the rule."""
    last = change_log.groupBy("rule_id").agg(
        F.max_by(F.struct(*change_log.columns), "log_offset").alias("r")).select("r.*")
    return last.filter(F.col("rule_type").isNotNull() & F.coalesce("enabled", F.lit(False)))


RANGES = 256  # hash ranges in which a bootstrap numbers its records


def bootstrap(rules: DataFrame, deleted_ids: DataFrame | None = None, change_log: DataFrame | None = None) -> DataFrame:
    """Re-emit every live rule (and a tombstone per deleted id) to the rule
    log, so a fresh consumer rebuilds its state. Offsets continue after the
    last one of ``change_log``, so the records win against those already there."""
    live = rules.select("rule_id", "rule_type", "enabled", "parameters", "updated_at")
    if deleted_ids is not None:
        tomb = deleted_ids.select("rule_id", F.lit(None).cast("string").alias("rule_type"),
                                  F.lit(None).cast("boolean").alias("enabled"),
                                  F.lit(None).cast("map<string,string>").alias("parameters"),
                                  F.lit(None).cast("timestamp").alias("updated_at"))
        live = live.unionByName(tomb)
    start = 0
    if change_log is not None:
        last = change_log.agg(F.max("log_offset")).first()[0]  # scalar
        start = 0 if last is None else int(last) + 1
    # numbered by rule within hash ranges, after the rows of earlier ranges: independent of partitions
    live = live.withColumn("_r", F.pmod(F.xxhash64("rule_id"), F.lit(RANGES)).cast("int"))
    sizes = live.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_k", F.lit(0))
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    before = sizes.select("_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("rule_id", F.col("rule_type").asc_nulls_first()))
    numbered = live.withColumn("_p", place).join(before, "_r")
    return numbered.withColumn("log_offset", F.lit(start) + F.col("_before") + F.col("_p") - 1).drop("_r", "_p", "_before")
