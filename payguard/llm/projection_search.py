"""Approximate nearest neighbours by inner product, over stable projections.

Vectors are scaled by the greatest norm and given one more component that brings
them to length 1, queries are scaled to length 1: the squared distance of a query and a
vector is then 2 - 2 * (their scaled inner product), so the nearest vector has the
largest one. A few Gaussian (2-stable) projections map a distance d to a projected
distance whose square is d^2 times a chi-square variable of as many degrees of freedom.

The projected vectors are indexed by a kd-tree, fitted on a bounded sample; every vector
is placed in a leaf, whose box is that of all its vectors. A query opens leaves in ascending
distance of their boxes, in waves (1, 3, 12, ... leaves), and a leaf yields
its vectors in ascending projected distance, which are verified in double
precision on the original vectors. It ends, in a leaf and over leaves,
when the stopping test holds: a vector as near as the query's last neighbour so far would
have shown a smaller projected distance than the next one with probability
``certainty``; this is also the recall expected of the last neighbour at least, nearer ones have more.

Equal vectors are one class with its smallest ids, searched once. A leaf with many
vectors or visited by many queries is cut into parts by both; a task holds one part
of each and returns the best of each query, which windows merge.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows without an id, take no part; vectors of different lengths don't meet; rows of the same
id and vector count once, and a query's own id is never its neighbour; an empty table
gives an empty result. Norms must be between 1e-150 and 1e150. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.llm.common import salted_join, stored

NEIGHBOURS = 20
PROJECTIONS = 12        # even: the chi-square distribution has a closed form
CERTAINTY = 0.95
SAMPLE_ROWS = 20_000    # vectors that reach the driver to fit the kd-tree
LEAF_ROWS = 2_048       # of a leaf on average, while the sample can tell them apart
MAX_DEPTH = 11          # leaves hold ten sampled vectors at least
PART_ROWS = 8_192       # vectors of a leaf in a task
QUERY_ROWS = 2_048      # queries of a leaf in a task
STEP = 64               # projected neighbours verified between two tests


def chi_square_cdf(x: float, freedom: int) -> float:
    """P(chi-square <= x), for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    lo, hi = 0.0, 1_000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, freedom) < p else (lo, mid)
    return hi


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 0))


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    return top * np.sqrt(np.square(x / top[:, None]).sum(1))


def _clean(wide: bool):
    """(id, asks, vec): the components of usable vectors as bytes."""
    arrow, kind = (pa.float64(), np.float64) if wide else (pa.float32(), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(batch.column(0).is_valid())
            col = keep.column(2)
            n = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
            flat = col.flatten().cast(arrow)
            gaps = np.asarray(flat.is_null())
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            row = np.repeat(np.arange(len(n)), n)
            wrong = np.bincount(row, gaps | ~np.isfinite(values), len(n))
            some = np.bincount(row, values != 0, len(n))
            good = (wrong == 0) & (some > 0)
            data, size = values[good[row]].tobytes(), n[good] * values.itemsize
            off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            vec = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([keep.column(0).filter(mask), keep.column(1).filter(mask), vec], ["id", "asks", "vec"])
    return run


class Tree:
    """Projections and kd-tree of the vectors of one length."""

    def __init__(self, sample: np.ndarray, top_norm: float, rows: int, projections: int, leaf_rows: int):
        rng = np.random.default_rng(11)
        self.top_norm = top_norm
        self.plane = rng.normal(size=(sample.shape[1] + 1, projections))
        self.depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows / leaf_rows)))), max(0, int(math.log2(max(1, len(sample) / 10)))))
        self.dims = np.zeros(1 << self.depth, np.int64)
        self.cuts = np.zeros(1 << self.depth)
        y = self.project(sample)
        nodes = {1: np.arange(len(y))}
        for node in range(1, 1 << self.depth):
            rows_ = nodes.pop(node)
            part = y[rows_]
            self.dims[node] = part.var(0).argmax() if len(part) else 0
            own = part[:, self.dims[node]]
            self.cuts[node] = np.median(own) if len(own) else 0
            right = own > self.cuts[node]
            nodes[2 * node], nodes[2 * node + 1] = rows_[~right], rows_[right]

    def project(self, x: np.ndarray) -> np.ndarray:
        u = x / self.top_norm
        rest = np.sqrt(np.maximum(0, 1 - np.square(u).sum(1)))
        return u @ self.plane[:-1] + rest[:, None] * self.plane[-1]

    def project_queries(self, x: np.ndarray) -> np.ndarray:
        return (x / _norms(x)[:, None]) @ self.plane[:-1]

    def leaf(self, y: np.ndarray) -> np.ndarray:
        node = np.ones(len(y), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (y[np.arange(len(y)), self.dims[node]] > self.cuts[node])
        return node - (1 << self.depth)


def _place(tree, kind: str):
    """Classes to leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.leaf(tree.value.project(_matrix(batch.column(2), kind)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])
    return run


def _boxes(tree, kind: str):
    """(leaf, dim, lo, hi) of a batch's projected vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, leaf = tree.value.project(_matrix(batch.column(1), kind)), batch.column(0).to_numpy()
            order = np.argsort(leaf, kind="stable")
            known, first = np.unique(leaf[order], return_index=True)
            lo, hi = np.minimum.reduceat(y[order], first), np.maximum.reduceat(y[order], first)
            m = y.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known, m)), pa.array(np.tile(np.arange(m), len(known))),
                                              pa.array(lo.ravel()), pa.array(hi.ravel())], ["leaf", "dim", "lo", "hi"])
    return run


def _requests(tree, boxes, kind: str, quantile: float, begin: int, end: int):
    """(leaf, cid, last, vec): the leaves of a wave that each query opens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, lo, hi = boxes.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = _matrix(part.column(1), kind)
                y = tree.value.project_queries(x)
                gap = np.maximum(0, np.maximum(lo[None] - y[:, None], y[:, None] - hi[None]))
                far = np.square(gap).sum(2)
                order = np.lexsort((np.broadcast_to(leaves, far.shape), far))[:, begin:end]
                last = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                reach = np.maximum(0, 2 - 2 * last / _norms(x) / tree.value.top_norm) * quantile
                q, s = np.nonzero(~(np.take_along_axis(far, order, 1) > reach[:, None]))
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(leaves[order[q, s]]), part.column(0).take(at), part.column(2).take(at),
                                                  part.column(1).take(at)], ["leaf", "cid", "last", "vec"])
    return run


_BEST = pa.schema([("cid", pa.int64()), ("score", pa.float64()), ("low", pa.int64()), ("found", pa.int64()), ("m", pa.int64())])


def _last(score: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
    """The score of the count-th vector of each row of classes in descending order (-inf: fewer)."""
    enough = m.cumsum(1) >= count
    at = enough.argmax(1)
    rows = np.arange(len(score))
    return np.where(enough[rows, at], score[rows, at], -np.inf)


def _verify(tree, kind: str, quantile: float, count: int):
    """The best classes of each query in a leaf."""
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if not points.num_rows or not queries.num_rows:
            return pa.table([pa.array([], f.type) for f in _BEST], schema=_BEST)
        points = points.sort_by("cid")
        low, m, cid = (points[c].to_numpy() for c in ("low", "m", "cid"))
        x = _matrix(points["vec"].combine_chunks(), kind)
        y = tree.value.project(x)
        y2 = np.square(y).sum(1)
        own = x.shape[0]
        for i in range(0, queries.num_rows, 256):
            part = queries.slice(i, 256)
            q = _matrix(part["vec"].combine_chunks(), kind)
            z = tree.value.project_queries(q)
            scale = _norms(q) * tree.value.top_norm
            last = part["last"].to_numpy().astype(np.float64)
            last = np.where(np.isnan(last), -np.inf, last)
            far = np.maximum(0, np.square(z).sum(1)[:, None] + y2[None] - 2 * z @ y.T)
            order = far.argsort(1)
            rows = len(q)
            score = np.full((rows, count), -np.inf)
            found = np.full((rows, count), -1)
            live = np.arange(rows)
            for s in range(0, own, STEP):
                # the chi-square test on the next projected neighbour
                reach = np.maximum(0, 2 - 2 * last[live] / scale[live]) * quantile
                live = live[far[live, order[live, s]] <= reach]
                if not len(live):
                    break
                next_ = order[live, s:s + STEP]
                dots = np.matmul(x[next_], q[live][:, :, None])[:, :, 0]
                scores = np.concatenate([score[live], dots], 1)
                ids = np.concatenate([found[live], next_], 1)
                first = np.lexsort((low[ids], -scores))[:, :count]
                score[live], found[live] = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)
                members = np.where(found[live] >= 0, m[found[live]], 0)
                last[live] = np.maximum(last[live], _last(score[live], members, count))
            r, c = np.nonzero((found >= 0) & (score >= last[:, None]))
            at = found[r, c]
            out.append(pa.table([part["cid"].combine_chunks().take(pa.array(r)), pa.array(score[r, c]), pa.array(low[at]),
                                 pa.array(cid[at]), pa.array(m[at])], schema=_BEST))
        return pa.concat_tables(out)
    return run


def _neighbours(classes: DataFrame, kind: str, k: int, certainty: float, projections: int, leaf_rows: int) -> DataFrame | None:
    """(cid, score, found): the best k + 1 classes of each asking class, of one vector length."""
    spark, count = classes.sparkSession, k + 1
    quantile = chi_square_quantile(certainty, projections)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(_norms(_matrix(batch.column(0), kind)).max())])], ["norm"])
    rows = classes.count()
    top_norm = classes.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm").alias("n")).first()["n"]
    every = max(1, rows // SAMPLE_ROWS)
    picked = classes.filter(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE_ROWS).toArrow()["vec"]
    if not len(picked):
        picked = classes.select("vec").limit(100).toArrow()["vec"]
    sample = _matrix(pa.array(sorted(picked.to_pylist())), kind)
    tree = spark.sparkContext.broadcast(Tree(sample, top_norm, rows, projections, leaf_rows))
    placed = stored(classes.select("cid", "low", "vec", "m").mapInArrow(_place(tree, kind), "leaf long, cid long, low long, vec binary, m long"), "leaves")
    edges = placed.select("leaf", "vec").mapInArrow(_boxes(tree, kind), "leaf long, dim long, lo double, hi double")
    edges = edges.groupBy("leaf", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("leaf", "dim").toArrow()
    leaves = edges["leaf"].to_numpy()[::projections]
    boxes = spark.sparkContext.broadcast((leaves, edges["lo"].to_numpy().reshape(-1, projections), edges["hi"].to_numpy().reshape(-1, projections)))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    asking = classes.filter("asks").select("cid", "vec")
    best, begin, end = None, 0, 1
    while begin < len(leaves):
        if best is None:
            state = asking.withColumn("last", F.lit(None).cast("double"))
        else:
            order = Window.partitionBy("cid").orderBy(F.col("score").desc(), "low", "found").rowsBetween(Window.unboundedPreceding, 0)
            last = best.withColumn("upto", F.sum("m").over(order)).filter(F.col("upto") >= count).groupBy("cid").agg(F.max("score").alias("last"))
            state = asking.join(last, "cid", "left").select("cid", "vec", "last")
        wave = stored(state.mapInArrow(_requests(tree, boxes, kind, quantile, begin, end), "leaf long, cid long, last double, vec binary"), "wave")
        visits = wave.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("shares")).join(sizes, "leaf")
        queries = (wave.join(visits, "leaf").withColumn("share", F.pmod(F.xxhash64("cid"), "shares"))
                   .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
        points = (placed.join(visits, "leaf").withColumn("part", F.pmod(F.xxhash64("cid"), "parts"))
                  .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))))
        by = ["leaf", "part", "share"]
        found = (points.select(*by, "cid", "low", "m", "vec").groupBy(*by).cogroup(queries.select(*by, "cid", "last", "vec").groupBy(*by))
                 .applyInArrow(_verify(tree, kind, quantile, count), "cid long, score double, low long, found long, m long"))
        found = found if best is None else best.unionByName(found)
        place = Window.partitionBy("cid").orderBy(F.col("score").desc(), "low", "found")
        best = stored(found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= count).drop("place"), "neighbours")
        begin, end = end, 4 * end
    return best


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
           certainty: float = CERTAINTY, projections: int = PROJECTIONS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query, rank, id, score): the ``k`` nearest rows found of each row with ``is_query``."""
    spark = vectors.sparkSession
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f8" if wide else "<f4"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    rows = rows.mapInArrow(_clean(wide), "id long, asks boolean, vec binary").groupBy("vec", "id").agg(F.max("asks").alias("asks"))
    rows = stored(rows, "vectors")
    # of equal vectors no more than the k + 1 smallest ids can be anyone's neighbours
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("place") <= k + 1)
    members = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = rows.groupBy("vec").agg(F.max("asks").alias("asks"))
    classes = stored(members.join(asks, "vec").select(
        F.monotonically_increasing_id().alias("cid"), "vec", "ids", F.col("ids")[0].alias("low"), F.size("ids").cast("long").alias("m"),
        "asks", F.length("vec").alias("width")), "classes")
    best = None
    for r in classes.filter("asks").select("width").distinct().orderBy("width").collect():  # the lengths of vectors in use
        part = _neighbours(classes.filter(F.col("width") == r["width"]), kind, k, certainty, projections, leaf_rows)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], "query long, rank int, id long, score double")
    ids = classes.select(F.col("cid").alias("found"), "ids")
    place = Window.partitionBy("cid").orderBy(F.col("score").desc(), "id")
    near = (best.join(ids, "found").select("cid", "score", F.explode("ids").alias("id"))
            .withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
            .groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near")))
    near = near.join(classes.select("cid", "vec"), "cid").select("vec", "near")
    out = salted_join(rows.filter("asks").select("vec", F.col("id").alias("query")), near, "vec", "query", how="inner")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k)
    return out.select("query", F.posexplode(others).alias("at", "x")).select(
        "query", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
