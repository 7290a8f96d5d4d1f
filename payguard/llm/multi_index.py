"""Embedding near-duplicates over an inverted multi-index.

Vectors are scaled to length 1 and cut into halves, each with a codebook of
its own (k-means on a bounded sample); the product of the codebooks is a grid of
cells. Every vector lives in the cell of its two nearest codewords and, as a query,
visits cells by multi-sequence traversal: in ascending order of a bound on the
distance to the cell (the sum over the halves of the squared distance to the codeword's
Voronoi cell) up to a radius. The radius is set for a target recall of
neighbours at exactly the threshold cosine, on sample vectors and random
directions. A pair is found if either visits the other's cell; then the
cosine is verified in double precision.

Equal vectors are one class with a multiplicity. Cells of any size are cut
into blocks, a task per pair of blocks; a task returns a row per vector (its
links there, its smallest partner by links), never the pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, link with nothing and are their own
component; vectors of different lengths don't link; repeated rows are vectors
of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.llm.common import connected_components, stored
from payguard.llm.minhash_dedup import _roots

SAMPLE_ROWS = 20_000   # vectors that reach the driver to fit codebooks and radius
CELL_ROWS = 256        # vectors of a cell on average
MAX_CODEWORDS = 1_024  # of a half
TARGET_RECALL = 0.995  # of one direction, at the threshold
BLOCK = 256


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # squares of any finite components stay in range
    return x / np.sqrt((x * x).sum(1))[:, None]


def _squares(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)


class MultiIndex:
    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        k = min(MAX_CODEWORDS, len(sample), max(2, math.isqrt(max(1, rows // CELL_ROWS))))
        self.books = [self._kmeans(half, k, rng) for half in (sample[:, :self.cut], sample[:, self.cut:])]
        self.apart = [np.sqrt(np.maximum(_squares(c, c), 1e-18)) for c in self.books]
        self.k = len(self.books[0])
        x = sample[rng.permutation(len(sample))[:4_000]]
        g = rng.normal(size=x.shape)
        g -= (g * x).sum(1)[:, None] * x
        g /= np.maximum(np.sqrt((g * g).sum(1)), 1e-12)[:, None]
        near = threshold * x + math.sqrt(1 - threshold ** 2) * g
        (_, l1), (_, l2) = self.bounds(x)
        (n1, _), (n2, _) = self.bounds(near)
        at = np.arange(len(x))
        self.radius = float(np.quantile(l1[at, n1] + l2[at, n2], recall))

    @staticmethod
    def _kmeans(a: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        c = a[rng.choice(len(a), k, replace=False)]
        for _ in range(rounds):
            near = _squares(a, c).argmin(1)
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, a)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return c

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest codeword, and the squared distance to
        each codeword's Voronoi cell at least."""
        out = []
        for half, book, apart in zip((x[:, :self.cut], x[:, self.cut:]), self.books, self.apart):
            d = _squares(half, book)
            near = d.argmin(1)
            gap = np.maximum(0, d - d.min(1)[:, None]) / (2 * apart[near])
            gap[np.arange(len(x)), near] = 0
            out.append((near, gap * gap))
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each vector; (vector, cell) of every visit. The
        traversal walks both halves' codewords in ascending order; it takes the
        pairs under the radius, a staircase."""
        (n1, l1), (n2, l2) = self.bounds(x)
        o1, o2 = l1.argsort(1), l2.argsort(1)
        s1, s2 = np.take_along_axis(l1, o1, 1), np.take_along_axis(l2, o2, 1)
        who, cell = [], []
        for i in range(self.k):
            rows = np.flatnonzero(s1[:, i] <= self.radius)
            if not len(rows):
                break
            reach = (s1[rows, i, None] + s2[rows] <= self.radius).sum(1)
            who.append(np.repeat(rows, reach))
            step = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
            cell.append(o1[who[-1], i] * self.k + o2[who[-1], step])
        return n1 * self.k + n2, np.concatenate(who), np.concatenate(cell)

    def visiting(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Does each vector visit its cell?"""
        (_, l1), (_, l2) = self.bounds(x)
        at = np.arange(len(x))
        return l1[at, cell // self.k] + l2[at, cell % self.k] <= self.radius


def _clean(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id, vec (bytes; null: links with nothing), and the numpy type of the bytes."""
    wide = not isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind, arrow = ("<f8", pa.float64()) if wide else ("<f4", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1).cast(pa.list_(arrow))
            out = []
            for i, x in zip(batch.column(0).to_pylist(), col):
                a = None
                if i is not None and x.is_valid and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(v).all() and v.any():
                        a = v.astype(kind).tobytes()
                out.append(a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, vec binary"), kind


def _links(classes: DataFrame, kind: str, threshold: float, recall: float) -> DataFrame:
    """(id, n, root) rows of classes of one vector length: links of the class in a
    task, and an id it is connected with there."""
    rows = classes.count()
    every = max(1, rows // SAMPLE_ROWS)
    picked = classes.filter(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE_ROWS).collect()
    raw = sorted(bytes(r["vec"]) for r in picked) or [bytes(r["vec"]) for r in classes.select("vec").limit(100).collect()]
    index = MultiIndex(_unit(raw, kind), rows, threshold, recall)
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                home, who, cell = shared.value.visits(_unit(part.column(2).to_pylist(), kind))
                own = np.arange(len(home))
                at = pa.array(np.concatenate([own, who]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([home, cell]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(own), np.int32), np.ones(len(who), np.int32)])),
                    part.column(0).take(at), part.column(1).take(at), pa.array(home[np.asarray(at)].astype(np.int64)),
                    part.column(2).take(at)], ["cell", "side", "id", "m", "home", "vec"])
    placed = classes.select("id", "m", "vec").mapInArrow(
        place, "cell long, side int, id long, m long, home long, vec binary")
    # how many blocks of members and of queries a cell has
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("side") == 0, 1)) / BLOCK)), F.ceil(F.count(F.when(F.col("side") == 1, 1)) / BLOCK)
    sizes = placed.groupBy(F.col("cell").alias("c")).agg(blocks[0].alias("nm"), blocks[1].alias("nq"),
                                                         F.count(F.when(F.col("side") == 0, 1)).alias("members")).filter("members > 0")
    dealt = (placed.join(sizes, F.col("cell") == F.col("c"))
             .withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("nm")).otherwise(F.col("nq"))))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nq")).otherwise(F.col("nm")) - 1)))
             .withColumn("pair", F.when(F.col("side") == 0, F.col("b") * F.col("nq") + F.col("o"))
                         .otherwise(F.col("o") * F.col("nq") + F.col("b"))))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")])
        side, ids, m, home = (t[c].to_numpy() for c in ("side", "id", "m", "home"))
        x, cell, n_m = _unit(t["vec"].to_pylist(), kind), t["cell"][0].as_py(), int((side == 0).sum())
        mine, asks = x[:n_m], x[n_m:]
        q, y = np.nonzero(asks @ mine.T >= threshold)
        q = q + n_m
        q, y = q[ids[q] != ids[y]], y[ids[q] != ids[y]]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, q, m[y])
        # a member that doesn't visit the query's home learns of the link here alone
        cross = np.flatnonzero(home[q] != cell)
        if len(cross):
            alone = cross[~shared.value.visiting(mine[y[cross]], home[q[cross]])]
            np.add.at(count, y[alone], m[q[alone]])
        known, at = np.unique(ids, return_inverse=True)
        root = _roots(len(known), at[q], at[y])
        total = np.bincount(at, count, len(known)).astype(np.int64)
        hit = np.flatnonzero((total > 0) | (root != np.arange(len(known))))
        return pa.table({"id": known[hit], "n": total[hit], "root": known[root[hit]]},
                        schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))
    return dealt.select("cell", "pair", "side", "id", "m", "home", "vec").groupBy("cell", "pair").applyInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.95, recall: float = TARGET_RECALL) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    rows, kind = _clean(vectors, id_col, vector_col)
    rows = stored(rows, "vectors")
    classes = stored(rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("m"))
                     .withColumn("width", F.length("vec")), "vector-classes")
    found = None
    for r in classes.select("width").distinct().orderBy("width").collect():  # the lengths of vectors in use
        part = _links(classes.filter(F.col("width") == r["width"]), kind, threshold, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "id long, n long, root long")
    found = stored(found, "links")
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-groups")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(links, "id", "left").join(groups, "id", "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(named, "vec", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
