"""SparkSession helpers: building a local session and finding the shared
checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_RUN_FOLDERS: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "payguard") -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session and
    only call :func:`ensure_checkpoint_dir` on it."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("PAYGUARD_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAYGUARD_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # idle-key timeouts are checked when data arrives, so a drained
        # stream stops running empty micro-batches
        .config("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` always wins; a private folder is
    created only when none is configured (local runs and tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder "
                               "that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="payguard-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder for one run of a query; it is
    deleted when the process that made it ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _RUN_FOLDERS:
        atexit.register(drop_run_folders)
    _RUN_FOLDERS.append(path)
    return path


def drop_run_folders() -> None:
    """Delete the folders of this process's runs (a session that has stopped leaves them)."""
    spark = SparkSession.getActiveSession() or SparkSession._instantiatedSession
    while _RUN_FOLDERS and spark is not None and spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(_RUN_FOLDERS.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist, in whatever store Spark reads it from?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that start from here on keep their state in RocksDB: Spark's default store has no
    column families, which ``transformWithState`` needs. A store that the cluster names
    stays, and a query that restarts keeps the one it began with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(key, STATE_STORE)


STATE_PARTITIONS = 2  # of a stream, for each core


def start_stream(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream. Each partition of its state costs about a core second a micro-batch, also an empty one,
    so it has at most ``STATE_PARTITIONS`` a core, whatever number batch queries shuffle
    to; a stream that restarts keeps the number it began with. No empty micro-batches are run: idle keys'
    timers are checked when data arrives, and a drained stream ends."""
    use_state_store(spark)
    expose_package(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    key = "spark.sql.shuffle.partitions"
    parts = spark.conf.get(key)
    try:
        spark.conf.set(key, min(int(parts), STATE_PARTITIONS * max(spark.sparkContext.defaultParallelism, 4)))
        return writer.start()
    finally:
        spark.conf.set(key, parts)


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was loaded
    from (a no-op where it is installed; a cluster without it needs
    ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reread table: its lineage
    is cut, it survives the loss of executors, and its size is known to the planner."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
