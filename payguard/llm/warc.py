"""Deterministic sharded WARC writer, and its reader.

Pages are cut into ranges of page id whose bounds depend on the ids alone; a
range is sorted and written as one shard, whose files roll when their compressed
size reaches a limit. Headers and digests are made anew. Equal payloads of at least
``revisit_bytes`` are stored once, with the largest page id; the others revisit it.

Commit: a task writes under temporary names of its own attempt and returns
what it wrote; only what Spark commits of those rows is renamed (again after a
failure, a file already renamed is left), and the manifest table comes last.
Readers open the files of the manifest alone, so files of lost or
repeated attempts are never read. The same table gives the same files, bytes included.

Defined cases: null html is the empty payload; a null url has no target header;
a null page id sorts first and never is the response of others;
rows that repeat the response's page id are responses too; an empty table gives an
empty manifest. Control characters, blanks and non-ASCII characters of urls are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.llm.common import in_ranges, range_bounds, stored

REVISIT_BYTES, ROLL_BYTES, RANGE_ROWS, DATE = 1_000, 256 << 20, 20_000, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "manifest"
_WRITTEN = "name string, temporary string, records long, bytes long, crc32 long"


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:") and not folder.startswith("file://"):
        return pafs.LocalFileSystem(), folder[len("file:"):]
    return pafs.FileSystem.from_uri(folder)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str = DATE) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}<>\\\"-._")))
    head += [("WARC-Payload-Digest", _sha1(digest)), ("WARC-Block-Digest", _sha1(hashlib.sha1(block).hexdigest()))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Shard:
    """Open file of a shard; rolls by compressed size."""

    def __init__(self, folder: str, number: int, roll_bytes: int):
        self.fs, self.root = _files(folder)
        self.number, self.roll, self.part, self.stream = number, roll_bytes, 0, None
        self.attempt = f"{self.root}/_temporary/{uuid.uuid4().hex}"

    def add(self, data: bytes) -> tuple | None:
        if self.stream is None:
            self.fs.create_dir(self.attempt, recursive=True)
            self.name = f"shard-{self.number:07d}-{self.part:05d}.warc.gz"
            self.stream = self.fs.open_output_stream(f"{self.attempt}/{self.name}", compression=None)
            self.records = self.bytes = self.crc = 0
        z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member per record, without time or name
        packed = z.compress(data) + z.flush()
        self.stream.write(packed)
        self.records, self.bytes, self.crc = self.records + 1, self.bytes + len(packed), zlib.crc32(packed, self.crc)
        return self.close() if self.bytes >= self.roll else None

    def close(self) -> tuple | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream, self.part = None, self.part + 1
        return self.name, f"{self.attempt}/{self.name}", self.records, self.bytes, self.crc


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages below ``folder`` (shared by all executors) and return the
    manifest: name, records, bytes, crc32 of each file."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    light = stored(rows.select("id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")), "payloads")
    large = light.filter(F.col("size") >= revisit_bytes)
    top = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    revisits = large.join(top, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), light.count() // RANGE_ROWS)
    bounds = np.array(range_bounds(light, "id", parts), np.int64)
    # a page's revisit note travels to the same range and comes just before it: texts move once
    none = F.lit(None).cast("string")
    both = rows.select("id", F.lit(1).alias("kind"), none.alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionByName(
        revisits.select("id", F.lit(0).alias("kind"), "digest", "refers_to", none.alias("url"), none.alias("html")))
    dealt = in_ranges(both, "id", bounds).repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "id", "kind", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, notes, at = None, {}, object()
        schema = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])

        def out(row: tuple | None) -> Iterator[pa.RecordBatch]:
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
        for batch in batches:
            for number, page, kind, digest, refers_to, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or shard.number != number:
                    if shard is not None:
                        yield from out(shard.close())
                    shard = _Shard(folder, number, roll_bytes)
                if page != at:
                    notes, at = {}, page
                if kind == 0:
                    notes[digest] = refers_to
                    continue
                payload = text.encode()
                own = hashlib.sha1(payload).hexdigest()
                yield from out(shard.add(record(page, url, payload, notes.get(own), own)))
        if shard is not None:
            yield from out(shard.close())

    written = stored(dealt.mapInArrow(run, _WRITTEN), "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                final = files.get_file_info(f"{root}/{name}")
                if files.get_file_info(temporary).type != pafs.FileType.NotFound:
                    files.move(temporary, final.path)
                elif final.size != size:
                    raise OSError(f"{name} was neither written nor renamed whole")
            yield batch
    manifest = f"{folder}/{_MANIFEST}"
    written.mapInArrow(rename, _WRITTEN).drop("temporary").write.parquet(manifest)
    return spark.read.parquet(manifest)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, decompressed, one at a time."""
    data, z, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 18)
            if not data:
                if out:
                    raise OSError("the archive ends within a record")
                return
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """Headers and payload of a record; digests and lengths are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or _sha1(hashlib.sha1(block).hexdigest()) != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if h["WARC-Type"] == "response" and (len(payload) != size or _sha1(hashlib.sha1(payload).hexdigest()) != h["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload {h.get('WARC-Record-ID')}")
    return {"headers": h, "payload": payload, "payload_bytes": size}


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Records of the archives in the manifest: page_id, url, payload_bytes,
    payload_digest (hexadecimal), record_type, refers_to (and payload; null for revisits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        r = parse(data)
                        h = r["headers"]
                        page, refers = h.get("X-Page-Id"), h.get("X-Refers-To-Page")
                        row = (page and int(page), h.get("WARC-Target-URI"), r["payload_bytes"],
                               base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), h["WARC-Type"], refers and int(refers))
                        rows.append(row + ((r["payload"] if refers is None else None,) if payload else ()))
                        if len(rows) >= (100 if payload else 5_000):
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payload]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f[1]) for x, f in zip(zip(*rows), fields)], [f[0] for f in fields])
    names = spark.read.parquet(f"{folder}/{_MANIFEST}").select("name")
    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
             + ", payload binary" * payload)
