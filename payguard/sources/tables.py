"""Tables that change together (T14, J6): each version of a table is a set of folders, and a
manifest names the folders of all tables. Readers follow the last manifest; a commit
writes new folders and then one new manifest by an exclusive rename, so its tables
change at once or not at all, and of two commits from one version the later fails.

A table is cut into buckets by its key; an update writes only the buckets that it changes,
the others stay as they are. Folders that no manifest names (of lost or failed
commits) are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_B = "_pg_bucket"


class CommitConflict(RuntimeError):
    """Another commit came first."""


class Tables:
    """The tables under ``root``. ``keys``: key columns of each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version (0: none)."""
        at = self._path(f"{self.root}/_manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The table at a version (default: the last)."""
        entry = self._manifest(self.version() if version is None else version)[name]
        schema = T.StructType.fromJson(entry["schema"])
        paths = sorted(set(entry["buckets"].values()))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, df: DataFrame) -> dict[str, str]:
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.withColumn(_B, self._bucket(name)).repartition(self.buckets, _B).write.partitionBy(_B).parquet(folder)
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(folder))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith(f"{_B}=")}

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Replace these tables together; ``base`` is the version they were made from."""
        entries = {n: {"schema": df.schema.jsonValue(), "buckets": self._write(n, df)} for n, df in tables.items()}
        return self._publish({**self._manifest(base), **entries}, base)

    def update_by_key(self, name: str, updates: DataFrame, cols: list[str], base: int | None = None) -> tuple[int, DataFrame]:
        """Set ``cols`` of the rows with the keys of ``updates`` (one row a key). Buckets without such a
        key are neither read nor written. Returns the version and the keys that aren't in the table."""
        from payguard.operators.archive import missing_keys, update_by_key
        base = self.version() if base is None else base
        manifest = self._manifest(base)
        entry, key = manifest[name], self.keys[name]
        touched = {str(r[0]) for r in updates.select(self._bucket(name)).distinct().collect()}  # at most one a bucket
        old = {b: p for b, p in entry["buckets"].items() if b in touched}
        schema = T.StructType.fromJson(entry["schema"])
        rows = self.spark.read.schema(schema).parquet(*old.values()) if old else self.spark.createDataFrame([], schema)
        new = self._write(name, update_by_key(rows, updates, key, cols).select(schema.fieldNames())) if old else {}
        kept = {b: p for b, p in entry["buckets"].items() if b not in touched}
        version = self._publish({**manifest, name: {"schema": entry["schema"], "buckets": {**kept, **new}}}, base)
        return version, missing_keys(rows, updates, key)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with the keys of ``keys``; only the buckets that may hold one are read."""
        entry, key = self._manifest(self.version())[name], self.keys[name]
        asked = {str(r[0]) for r in keys.select(self._bucket(name)).distinct().collect()}  # at most one a bucket
        paths = [p for b, p in sorted(entry["buckets"].items()) if b in asked]
        schema = T.StructType.fromJson(entry["schema"])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.join(keys.select(*key).distinct(), key, "left_semi")

    def _publish(self, manifest: dict, base: int) -> int:
        folder = f"{self.root}/_manifests"
        self._fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._path(f"{folder}/{base + 1}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise CommitConflict(f"version {base + 1} exists")
        return base + 1
