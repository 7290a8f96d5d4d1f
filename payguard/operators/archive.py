"""Idempotent archive writes (Q7: S3-S5, J4, J6).

``ON CONFLICT DO NOTHING`` becomes: keep the first arrival per key inside the
batch, drop keys already in the target (``left_anti``), append. Replaying a
batch appends nothing. Updates by key (J6) rewrite the matching rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.session import path_exists


def first_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order`` (aggregate, so a hot key is
    combined map-side rather than sorted in one task)."""
    packed = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r"))
    return packed.select("_r.*")


def insert_if_absent(batch: DataFrame, target: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: first per key, not yet in ``target``."""
    first = first_per_key(batch, key, order)
    if target is None:
        return first
    return first.join(target.select(*key), key, "left_anti")


def update_by_key(target: DataFrame, updates: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Set ``cols`` from ``updates`` on matching keys; others unchanged;
    unknown keys are ignored (the caller reports them as not found)."""
    u = updates.select(*key, *[F.col(c).alias(f"_u_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = target.join(u, key, "left")
    for c in cols:
        j = j.withColumn(c, F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)))
    return j.drop("_hit", *[f"_u_{c}" for c in cols])


def missing_keys(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``updates`` absent from ``target`` (the 404 case)."""
    return updates.select(*key).join(target.select(*key), key, "left_anti")


MAX_LITERALS = 1_000  # partitions of a batch that are named in a filter


def of_partitions(target: DataFrame, batch: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows of ``target`` in the partitions that ``batch`` touches. Up to ``MAX_LITERALS`` of them are
    literals, so that only their folders are listed and read; more are joined."""
    touched = batch.select(*partition_by).distinct()
    few = touched.limit(MAX_LITERALS + 1).collect()
    if len(few) > MAX_LITERALS:
        return target.join(touched, partition_by, "left_semi")
    if len(partition_by) == 1:
        c, values = F.col(partition_by[0]), [r[0] for r in few]
        named = c.isin([v for v in values if v is not None])
        return target.filter(named | c.isNull() if None in values else named)
    hit = F.lit(False)
    for r in few:
        same = F.lit(True)
        for c, v in zip(partition_by, r):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        hit = hit | same
    return target.filter(hit)


INDEX_BITS = 20  # of a partition's membership bitmap; words of 15 bits


def _places(rows: DataFrame, key: list[str], partition_by: list[str]) -> DataFrame:
    """(partition, word, bit) of each row's key in the bitmap of its partition."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << INDEX_BITS))
    return rows.select("*", F.bitmap_bucket_number(place + 1).alias("_word"), F.bitmap_bit_position(place + 1).alias("_bit"))


def index_rows(rows: DataFrame, key: list[str], partition_by: list[str]) -> DataFrame:
    """Membership bitmaps of the rows' keys: (partition, word, bitmap)."""
    return _places(rows, key, partition_by).groupBy(*partition_by, "_word").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def maybe_members(rows: DataFrame, index: DataFrame, key: list[str], partition_by: list[str]) -> DataFrame:
    """Rows whose key may be among those indexed (all that are, and a few others)."""
    words = index.groupBy(*partition_by, "_word").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    j = _places(rows, key, partition_by).join(words, [*partition_by, "_word"])
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("_bit"), F.lit(8)))), F.lit(2)) == 1
    return j.filter(hit).select(*rows.columns)


def append_idempotent(batch: DataFrame, path: str, key: list[str], order: list[str],
                      partition_by: list[str] | None = None) -> int:
    """S4/S5 sink: append the new rows of ``batch`` to the Parquet table at
    ``path`` (created when absent). Returns the rows appended.

    With ``partition_by`` (functions of the row, e.g. its event date) a key is unique within its
    partition. Bitmaps of the archived keys lie beside the table (``path``_index, written before
    the rows, so a failure between both only makes a later check read more). Rows they don't
    know are new; for the others the archive is read, and of it only the partitions that
    hold them."""
    spark = batch.sparkSession
    exists = path_exists(spark, path)
    new = first_per_key(batch, key, order).persist()
    try:
        if exists and partition_by:
            if not path_exists(spark, f"{path}_index"):  # a table from before its bitmaps
                whole = index_rows(spark.read.parquet(path), key, partition_by)
                whole.write.partitionBy(*partition_by).parquet(f"{path}_index")
            index = of_partitions(spark.read.parquet(f"{path}_index"), new, partition_by)
            maybe = maybe_members(new, index, key, partition_by).persist()
            known = of_partitions(spark.read.parquet(path), maybe, partition_by)
            old = maybe.join(known.select(*key), key, "left_semi").select(*key)
            fresh = new if maybe.isEmpty() else new.join(old, key, "left_anti")
        else:
            maybe, fresh = None, insert_if_absent(new, spark.read.parquet(path) if exists else None, key, order)
        fresh = fresh.persist()
        n = fresh.count()
        if n and partition_by:
            index_rows(fresh, key, partition_by).write.mode("append").partitionBy(*partition_by).parquet(f"{path}_index")
        if n or not exists:
            w = fresh.write.mode("append")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        fresh.unpersist()
        if maybe is not None:
            maybe.unpersist()
    finally:
        new.unpersist()
    return n
