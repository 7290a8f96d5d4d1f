"""Helpers shared by the operators: tables, work tables in the shared folder,
content-based range bounds and connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.session import expose_package, run_folder

#: The white space of the word definition `[^\x20\x09-\x0D]+`.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Arrow batches between Spark and Python tasks: by bytes, as texts differ in length.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Python workers find the package, and no Arrow batch takes more memory than
    intended, unless the session says otherwise."""
    expose_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo ``k`` (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(k)).cast("int")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the process that made it ends."""
    return run_folder(spark, label)


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reread
    table: lineage is cut, and the rows no longer depend on any executor."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more: it does so
    when the driver's JVM collects them, which may be put off for long, and the session refers
    to its last plan until another has run."""
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def range_bounds(df: DataFrame, key: str, parts: int, sample_rows: int = 50_000) -> list[int]:
    """At most ``parts - 1`` ascending values of the integer column ``key``
    that cut it into ranges of about equal row counts. The bounds depend on the
    key values alone (a value is in the sample iff its hash is), never on
    partitions or retries. At most about ``sample_rows`` values reach the driver."""
    keys = df.select(F.col(key).cast("long").alias("k")).filter("k IS NOT NULL")
    n = keys.count()
    if parts <= 1 or n == 0:
        return []
    every = max(1, n // sample_rows)
    sample = keys.filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).groupBy("k").count().orderBy("k").collect()
    total, bounds, seen = sum(r["count"] for r in sample), [], 0
    for r in sample:
        if seen >= total * (len(bounds) + 1) / parts:
            bounds.append(r["k"])
        seen += r["count"]
    return bounds


def in_ranges(df: DataFrame, key: str, bounds: np.ndarray) -> DataFrame:
    """``range`` (index of the range that holds the key; nulls: the first)
    before the columns of ``df``."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at)
            lowest = pa.scalar(-2**63, pa.int64())
            found = np.searchsorted(bounds, keys.cast(pa.int64()).fill_null(lowest).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *batch.columns], ["range", *batch.schema.names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"range long, {fields}")


def salted_join(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``rows`` to ``facts`` (one row per key): each key's rows are dealt over
    ``salts`` tasks by ``spread_by`` and its facts copied to each, so a key with any
    share of the rows is split."""
    many = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    few = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, [key, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b: long); the component
    is the smallest id reachable. Alternating large and small stars: each step
    is a minimum per node (pre-aggregated) joined back to its edges, so no
    neighbour list is ever gathered, and merged, as a small file of edges is a large table in
    the driver. Edge sets are stored after each round."""
    e = (edges.filter(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stored(e, label)
    sig = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join reads two plain exchanges, of which Spark can split a hub's
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), label)
        large = (both.filter(F.col("v") > F.col("u")).join(low.hint("merge"), F.col("u") == F.col("n"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, label)
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), label)
        small = large.join(low2.hint("merge"), F.col("u") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").filter("u <> v").distinct()
        e = stored(small, label)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sig == (now["n"], now["h"]):
            break
        sig = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    tops = e.select("v").distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        tops.select(F.col("v").alias("id"), F.col("v").alias("component")))
