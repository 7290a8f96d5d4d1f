"""Ranked lexical search: term-at-a-time and document-at-a-time together.

Documents are indexed in slices, a row per slice with the posting lists of the terms
that some query holds (a bitmap of fixed size lets a few others through). A task ranks all
queries over its slices, one after the other. For each query it sums the postings of its
short lists term by term into accumulators; these then stand as one more iterator, with
bounds per block of documents, beside the long lists, and the documents are
walked in order: a block whose summed bounds stay below the query's 10th best
score so far is skipped in all lists. Each task returns its best documents per
query, of which a window takes the best.

Nothing is gathered by term: document frequencies are sums over slices, so a
term in every document costs one row a slice. Queries are taken in blocks of a
bounded number of terms, which each task is given whole.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased, known by 64-bit hashes. All scores are 64-bit integers.

Defined cases: null texts have no terms; documents without a term count nowhere; repeated
documents are documents of their own; query rows with the same id are one query with
the terms of all of them; a null document id ranks before others at equal scores; empty
tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payguard.llm.common import stored
from payguard.llm.textops import TERM, Texts, U64, slices

TOP = 10
MAP_BITS = 22            # bitmap of query terms: 2^22 flags, whatever the queries
BLOCK_TERMS = 200_000    # (query, term) pairs of a block of queries, about
SLICE_BYTES = 8 << 20    # text of a slice (a longer text is a slice of its own)
SHORT = 32               # postings of a short list within a slice
BLOCK_DOCS = 64          # documents between two bounds of a long list
STEP = 8                 # blocks scored before the threshold is looked at again


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a slice's texts, and the first of each text."""
    texts = Texts(part.column(part.schema.get_field_index("text"))).lower()
    begin, end, first = texts.runs(of=TERM)
    return texts.hashes(begin, end), first


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            terms, first = _terms(part)
            n = np.diff(first)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms.view(np.int64))], ["query", "term"])


_INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("terms", pa.binary()), ("ends", pa.binary()),
                    ("docs", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_INDEX_TYPES = "ids array<long>, n binary, terms binary, ends binary, docs binary, tf binary, n_docs long, n_terms long"


def _index(wanted):
    """Slices of documents to posting lists: terms ascending, documents of a list
    ascending by their place in the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                terms, first = _terms(part)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                hit = np.flatnonzero(wanted.value[terms >> U64(64 - MAP_BITS)])
                known, rank = np.unique(terms[hit], return_inverse=True)
                key, tf = np.unique(rank * len(n) + doc[hit], return_counts=True)
                ends = np.searchsorted(key, (np.arange(len(known)) + 1) * len(n))
                packed = (n.astype("<i8"), known.astype("<u8"), ends.astype("<i8"), (key % max(len(n), 1)).astype("<i4"), tf.astype("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).cast(pa.int64())], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in packed),
                     pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], schema=_INDEX)
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            df = np.diff(np.frombuffer(ends, "<i8"), prepend=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i8")), pa.array(df)], ["term", "df"])


class _Queries:
    """A block of queries: their terms (ascending hashes) with weights, and for each
    query the places of its terms."""

    def __init__(self, pairs: pa.Table):
        ids = pa.concat_arrays([pa.array([], pa.int64()), *pairs["query"].chunks]).dictionary_encode("encode")
        self.names = ids.dictionary
        at = ids.indices.to_numpy()
        terms, place = np.unique(pairs["term"].to_numpy().view(U64), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.terms, self.weights = terms, np.zeros(len(terms), np.int64)
        self.weights[place] = pairs["w"].to_numpy()
        self.places = np.split(place[order], np.cumsum(np.bincount(at, minlength=len(self.names)))[:-1])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class _Slice:
    """Posting lists of a slice that a block of queries asks for, with impacts
    and, for long lists, bounds and places by blocks of documents."""

    def __init__(self, row: dict, queries: _Queries, n_docs: int, n_terms: int):
        self.ids = np.array([-2**63 if x is None else x for x in row["ids"]], np.int64)
        terms, ends = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["ends"], "<i8")
        place = np.searchsorted(queries.terms, terms)
        asked = np.flatnonzero(queries.terms[np.minimum(place, len(queries.terms) - 1)] == terms)
        starts = np.concatenate([[0], ends])[asked]
        size = ends[asked] - starts
        at = _ranges(starts, ends[asked])
        self.docs = np.frombuffer(row["docs"], "<i4")[at].astype(np.int64)
        tf = np.frombuffer(row["tf"], "<i4")[at].astype(np.int64)
        m = 100 - 90 + (90 * np.frombuffer(row["n"], "<i8") * n_docs) // n_terms
        weight = np.repeat(queries.weights[place[asked]], size)
        self.impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        self.lo = np.cumsum(size) - size
        self.hi = self.lo + size
        self.list_of = np.full(len(queries.terms), -1)
        self.list_of[place[asked]] = np.arange(len(asked))
        self.blocks = -(-len(self.ids) // BLOCK_DOCS)
        # long lists: the row of each, its postings' first place and greatest impact by block
        long_ = np.flatnonzero(size > SHORT)
        self.row_of = np.full(len(asked), -1)
        self.row_of[long_] = np.arange(len(long_))
        at = _ranges(self.lo[long_], self.hi[long_])
        cell = np.repeat(np.arange(len(long_)), size[long_]) * self.blocks + self.docs[at] // BLOCK_DOCS
        self.bound = np.zeros((len(long_), self.blocks), np.int64)
        np.maximum.at(self.bound.reshape(-1), cell, self.impact[at])
        count = np.bincount(cell, minlength=len(long_) * self.blocks).reshape(len(long_), self.blocks)
        self.first = np.concatenate([np.zeros((len(long_), 1), np.int64), count.cumsum(1)], 1) + self.lo[long_][:, None]

    def rank(self, places: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids) of a query after this slice."""
        lists = self.list_of[places]
        lists = lists[lists >= 0]
        if not len(lists):
            return best
        rows = self.row_of[lists]
        short, rows = lists[rows < 0], rows[rows >= 0]
        at = _ranges(self.lo[short], self.hi[short])
        summed = np.bincount(self.docs[at], self.impact[at], self.blocks * BLOCK_DOCS).astype(np.int64)  # exact: below 2^53
        bounds = summed.reshape(-1, BLOCK_DOCS).max(1) + self.bound[rows].sum(0)
        done = 0
        while True:
            least = max(1, int(best[0][-1])) if len(best[0]) == top else 1
            ahead = done + np.flatnonzero(bounds[done:] >= least)[:STEP]
            if not len(ahead):
                return best
            at = _ranges(self.first[rows][:, ahead].ravel(), self.first[rows][:, ahead + 1].ravel())
            doc = _ranges(ahead * BLOCK_DOCS, (ahead + 1) * BLOCK_DOCS)
            near = self.docs[at] - ahead[0] * BLOCK_DOCS
            score = summed[doc] + np.bincount(near, self.impact[at], int(doc[-1] - doc[0]) + 1).astype(np.int64)[doc - doc[0]]
            good = np.flatnonzero(score >= least)
            if len(good):
                scores = np.concatenate([best[0], score[good]])
                ids = np.concatenate([best[1], self.ids[doc[good]]])
                first = np.lexsort((ids, -scores))[:top]
                best = scores[first], ids[first]
            done = int(ahead[-1]) + 1


def _search(shared, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.names)
        for batch in batches:
            for i in range(batch.num_rows):
                part = _Slice(batch.slice(i, 1).to_pylist()[0], queries, n_docs, n_terms)
                best = [part.rank(p, b, top) for p, b in zip(queries.places, best)]
        n = [len(b[0]) for b in best]
        if sum(n):
            ids = np.concatenate([b[1] for b in best])
            yield pa.RecordBatch.from_arrays(
                [queries.names.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ids, mask=ids == -2**63),
                 pa.array(np.concatenate([b[0] for b in best]))], ["query", "id", "score"])
    return run


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query, rank, id, score): the ``top`` documents of each query with a score above 0."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_col).cast("long").alias("query"), F.col(text_col).alias("text"))
    asked = stored(asked.mapInArrow(_query_terms, "query long, term long").distinct(), "query-terms")
    flags = np.zeros(1 << MAP_BITS, bool)
    flags[asked.select(F.shiftrightunsigned("term", 64 - MAP_BITS).alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = stored(rows.mapInArrow(_index(spark.sparkContext.broadcast(flags)), _INDEX_TYPES), "postings")
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = size["n"] or 0, size["l"] or 0
    kind = "query long, id long, score long"
    found = spark.createDataFrame([], kind)
    if n_docs:
        df = index.select("terms", "ends").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
        pairs = stored(asked.join(df, "term").select("query", "term", weight.alias("w")), "query-weights")
        blocks = -(-pairs.count() // block_terms)
        for b in range(blocks):  # the stated queries, a bounded number of terms at a time
            block = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
            shared = spark.sparkContext.broadcast(_Queries(block.toArrow()))
            if len(shared.value.terms):
                found = found.unionByName(index.select([f.name for f in _INDEX]).mapInArrow(_search(shared, n_docs, n_terms, top), kind))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query", "rank", "id", "score")
