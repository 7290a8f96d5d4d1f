"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (non-empty lines). A paragraph hashes
to a wide vector: ``WIDE`` 64-bit lanes of its bytes' hash, and ``LANES``
32-bit lanes to which each of its three-word shingles adds +1 or -1 by its hash. The
fingerprint is the sum of the vectors, modulo 2**64 and 2**32: order does not
matter, and paragraphs are inserted or deleted by adding or subtracting their
vectors (:meth:`Fingerprints.plus`, :meth:`Fingerprints.minus`). Equal fingerprints mean equal
multisets up to a collision of 512 bits; the signed lanes also measure
likeness, ``2 A.B / (A.A + B.B)`` of two sums, which estimates twice the common
shingles over all shingles.

Defined cases: null texts are empty; the empty text's fingerprint is all
zeros; blank lines are no paragraphs; a paragraph of fewer words is one
shingle; equal texts and equal fingerprints have likeness 1. For neighbours,
rows with equal ids follow each other by text, null ids come last. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.llm.common import in_ranges, range_bounds
from payguard.llm.textops import U64, Texts, mix64

WIDE, LANES, SHINGLE = 8, 128, 3
HASH_BLOCK = 256  # bytes of a paragraph hashed in sequence
RANGE_ROWS = 20_000
SLICE_CHARS = 1 << 20


class Fingerprints:
    """Fingerprints of a list of texts: wide (n, WIDE) uint64, lanes (n, LANES) int32."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray):
        self.wide, self.lanes = wide, lanes

    @classmethod
    def of(cls, texts: list[str]) -> "Fingerprints":
        n = len(texts)
        out = cls(np.zeros((n, WIDE), U64), np.zeros((n, LANES), np.int32))
        t = Texts(pa.array(texts, pa.large_string()))
        if not len(t.data):
            return out
        breaks = np.flatnonzero(t.data == 10)
        # paragraphs: between line breaks and text bounds
        a = np.sort(np.concatenate([t.off[:-1], breaks + 1]))
        b = np.sort(np.concatenate([t.off[1:], breaks]))
        a, b = a[b > a], b[b > a]
        where = np.searchsorted(t.off, a, "right") - 1
        one, two = cls._paragraph_hashes(t, a, b, 1), cls._paragraph_hashes(t, a, b, 2)
        for i in range(WIDE):
            np.add.at(out.wide[:, i], where, mix64(one + U64(2 * i + 1) * (two | U64(1))))
        starts, ends, _ = t.runs()
        if not len(starts):
            return out
        h = t.hashes(starts, ends)
        para = np.searchsorted(a, starts, "right") - 1
        head = np.flatnonzero(np.diff(para, prepend=-1))
        size = np.diff(np.append(head, len(h)))
        left = np.repeat(head + size, size) - np.arange(len(h))  # words from here to the paragraph's end
        s = mix64(h)
        for i in range(1, SHINGLE):
            more = np.flatnonzero(left > i)
            s[more] = mix64(s[more] * U64(0x9E3779B97F4A7C15) + h[more + i])
        use = (left >= SHINGLE) | (np.repeat(size, size) < SHINGLE) & (left == np.repeat(size, size))
        s, where = s[use], np.searchsorted(t.off, starts[use], "right") - 1
        for i in range(0, len(s), 1 << 15):
            x, w = s[i:i + (1 << 15)], where[i:i + (1 << 15)]
            bits = np.stack([mix64(x + U64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(LANES // 64)], 1)
            bits = np.unpackbits(bits.view(np.uint8), axis=1)
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
            out.lanes[w[cut]] += 2 * ones - np.diff(np.append(cut, len(x)))[:, None].astype(np.int32)
        return out

    @staticmethod
    def _paragraph_hashes(t: Texts, a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        """Hash of each byte range: of the sum of its blocks' hashes, each mixed with its place."""
        blocks = -(-(b - a) // HASH_BLOCK)
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(a, blocks) + place * HASH_BLOCK
        h = mix64(t.hashes(at, np.minimum(at + HASH_BLOCK, np.repeat(b, blocks)), seed) + place.astype(U64) * U64(0xD6E8FEB86659FD93))
        return mix64(np.add.reduceat(h, first) + (b - a).astype(U64)) if len(first) else h

    def plus(self, other: "Fingerprints") -> "Fingerprints":
        return Fingerprints(self.wide + other.wide, self.lanes + other.lanes)

    def minus(self, other: "Fingerprints") -> "Fingerprints":
        return Fingerprints(self.wide - other.wide, self.lanes - other.lanes)

    def take(self, rows: np.ndarray) -> "Fingerprints":
        return Fingerprints(self.wide[rows], self.lanes[rows])

    def text(self) -> list[str]:
        raw = np.concatenate([self.wide.view(np.uint8), self.lanes.view(np.uint8)], 1)
        return [base64.b64encode(x.tobytes()).decode() for x in raw]

    def likeness(self, other: "Fingerprints") -> np.ndarray:
        a, b = self.lanes.astype(float), other.lanes.astype(float)
        norm = (a * a).sum(1) + (b * b).sum(1)
        near = np.clip(2 * (a * b).sum(1) / np.maximum(norm, 1), 0, 1)
        same = (self.wide == other.wide).all(1) & (self.lanes == other.lanes).all(1)
        return np.where(same, 1.0, near)


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[str]]]:
    ranges, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
    ranges = [(r, t) for r, t in zip(ranges, batch.column(2).to_pylist())]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
            size += len(texts[j])
            j += 1
        yield ranges[i:j], ids[i:j], texts[i:j]
        i = j


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, texts in _lists(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(Fingerprints.of(texts).text())],
                                                 ["id", "fingerprint"])
    rows = documents.select(F.lit(0).alias("range"), F.col(id_col).cast("long").alias("id"), F.lit(False).alias("lent"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string")


def in_descending_order(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, id, lent, text) rows: each range of ids together and in descending
    order, followed by the first row of the range below it (``lent``), after
    the lowest range by the very first. So a task that reads a range in order
    has every row's successor; texts move once."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.count() // RANGE_ROWS)
    bounds = np.array(range_bounds(rows, "id", parts), np.int64)
    tops = in_ranges(rows.select("id"), "id", bounds).groupBy("range").agg(F.max("id").alias("top")).collect()
    order = sorted((r["range"], r["top"]) for r in tops)  # one entry per range
    top = dict(order)
    above = {r: order[(i + 1) % len(order)][0] for i, (r, _) in enumerate(order)}

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.append_column("lent", pa.array([False] * batch.num_rows))
            yield own
            ranges, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            first = [i for i, (r, x) in enumerate(zip(ranges, ids)) if x == top[r]]
            if first:
                copy = own.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([above[ranges[i]] for i in first], pa.int64()), copy.column(1),
                                                  copy.column(2), pa.array([True] * len(first))], own.schema.names)
    dealt = in_ranges(rows, "id", bounds).mapInArrow(lend, "range long, id long, text string, lent boolean")
    return (dealt.select("range", "id", "lent", "text").repartitionById(len(bounds) + 1, F.col("range").cast("int"))
            .sortWithinPartitions("range", "lent", F.desc_nulls_last("id"), "text"))


def edited_neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last third is taken
    from the head of the next text in descending id order. The edited fingerprint is
    the text's, less the paragraphs from the cut on, plus the new ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: its place, id, text and fingerprint
        for batch in batches:
            for places, ids, texts in _lists(batch):
                prints = Fingerprints.of(texts)
                if held is not None:
                    places, ids, texts = [held[0], *places], [held[1], *ids], [held[2], *texts]
                    prints = Fingerprints(np.concatenate([held[3].wide, prints.wide]), np.concatenate([held[3].lanes, prints.lanes]))
                pairs = [i for i in range(len(texts) - 1) if not places[i][1] and places[i][0] == places[i + 1][0]]
                last = len(texts) - 1
                held = (places[last], ids[last], texts[last], prints.take(np.array([last])))
                gone, new, digest = [], [], []
                for i in pairs:
                    s, k = texts[i], len(texts[i]) // 3
                    edited = s[:len(s) - k] + texts[i + 1][:k]
                    start = s.rfind("\n", 0, len(s) - k) + 1  # of the paragraph that is cut
                    gone.append(s[start:])
                    new.append(edited[start:])
                    digest.append(hashlib.sha256(edited.encode()).hexdigest())
                at = np.array(pairs, np.int64)
                own, after = prints.take(at), prints.take(at + 1)
                changed = own.minus(Fingerprints.of(gone)).plus(Fingerprints.of(new))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array(digest, pa.string()), pa.array(own.text(), pa.string()), pa.array(changed.text(), pa.string()),
                    pa.array(own.likeness(changed)), pa.array(own.likeness(after)),
                ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return in_descending_order(documents, id_col, text_col).mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
             " near_edited double, near_next double")
