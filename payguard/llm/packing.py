"""Packing into fixed-length sequences, shortest pack first over the length
histogram.

Documents become token ids (a public byte-level BPE, then the end id) and are
cut at every ``capacity`` ids. The histogram of piece lengths (at most ``capacity``
rows) is all that reaches the driver: lengths are placed longest first, each into
the packs that are shortest so far, as runs of equal packs. A run says which
ranks of a length go to which range of sequences, and at which offset; pieces
get their rank among equal lengths in Spark (bucket counts plus a rank within the
bucket, so a length of any frequency is split) and look up their run.

Defined cases: a null text is empty and has the end id alone; repeated rows
are packed each; null ids are kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.llm.common import stored
from payguard.llm.textops import slices

CAPACITY, END_ID = 2048, 1
BUCKET_ROWS = 20_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its ids (uint32): what ``tokenizers`` gives for this
    byte-level BPE file without added tokens. The same vocabulary and split
    pattern run in the faster ``tiktoken``; texts that hold a control string
    go to ``tokenizers`` itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    # the byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 on
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    hidden = [c for c in range(256) if c not in set(shown)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
    ranks = {bytes(byte_of[x] for x in word): i for word, i in whole.get_vocab().items() if word not in special}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)
    return encode


def pieces(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(own), capacity):
                        cut = own[a:a + capacity]
                        for x, y in zip(out, (doc, a, len(cut), zlib.crc32(cut.tobytes()), len(own), cut if keep_ids else None)):
                            x.append(y)
                columns = [pa.array(x, pa.int64()) for x in out[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
                           + ", ids array<int>" * keep_ids)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, copies in each pack, packs, first sequence,
    offset). Lengths are placed longest first, into the packs with most room
    until those are no longer the shortest; packs alike are kept as ranges of sequences."""
    runs, room, total = [], {}, 0  # room: ranges (first sequence, packs) by room left
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            most = max(room, default=0)
            if most < length:
                total += left
                room.setdefault(capacity - length, []).append((total - left, left))
                runs.append((length, rank, 1, left, total - left, 0))
                break
            below = max((r for r in room if r < most), default=0)
            copies = min(max(1, -(-(most - below) // length)), most // length)
            ranges = room.pop(most)
            while ranges and left:
                first, packs = ranges.pop()
                m = min(copies, left)
                take = min(packs, left // m)
                runs.append((length, rank, m, take, first, capacity - most))
                rank, left = rank + m * take, left - m * take
                room.setdefault(most - m * length, []).append((first, take))
                if take < packs:
                    ranges.append((first + take, packs - take))
            if ranges:
                room.setdefault(most, []).extend(ranges)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (their work table)."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(shortest_pack_first(histogram, capacity), key=lambda r: r[:2])
    table = np.array(runs, np.int64).reshape(-1, 6)
    buckets = max(32, sum(histogram.values()) // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (dealt.withColumn("place", F.row_number().over(order)).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("place") - 1).drop("bucket", "before", "place"))
    ranked = ranked.select(*cut.columns, "rank")
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    key = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            r = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at_rank], pa.array(r[:, 4] + nth // r[:, 2]), pa.array(r[:, 5] + nth % r[:, 2] * length)],
                [*batch.schema.names[:at_rank], "sequence_id", "offset"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, keep_ids: bool = False, **columns) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place."""
    return pack(stored(pieces(documents, tokenizer, keep_ids=keep_ids, **columns), "pieces"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (padded to ``capacity``), of pieces packed with their
    ids. Sequences hold at most ``capacity`` ids, so each is one bounded group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).withColumn(
        "ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))))
