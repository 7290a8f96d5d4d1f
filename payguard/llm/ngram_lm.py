"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its trigram, its bigram,
its unigram and a uniform distribution over the V known tokens and one unknown:
``l3(b) c(g,h,w)/c(g,h) + l2(b) c(h,w)/c(h) + l1(b) c(w)/N + l0(b) / (V+1)``, where
the bucket b is the doubling class of c(g,h), or if that is 0 (then l3 is 0) the one of c(h). The weights of each bucket are learned by
expectation-maximisation on the counts of a deleted tenth of the training
documents, against estimates from the other nine; the final estimates use all
training documents.

Counting and look-up are one exchange. Each task turns its texts into batches
(distinct word hashes plus a stream of indexes), which are stored. A batch then
asks for the counts of its distinct unigrams and bigrams, and when those are answered of its
trigrams, with its own counts, in sorted blocks by hash range; the range's task adds up all
requests and answers each block in its order. So a frequent n-gram costs
one entry per batch, and the tables are never gathered. The entries follow the input linearly, and so do the rows
that carry them, as a batch sends no row to a range it asks nothing of: batches times ranges, of some 2,000 entries
each at 30 GB of text, and never more than there are entries.

Defined cases: a null text is empty (its end token alone); a null id counts
as the id '' for the folds; repeated rows are scored each; an empty training set leaves
the uniform distribution over the unknown token. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.llm.common import fold, release_shuffles, stored
from payguard.llm.textops import U64, Texts, mix64, slices

BATCH_BYTES = 4 << 20    # text of a batch
KEYS_PER_RANGE = 2_000_000  # tokens of the corpus per hash range
BUCKETS = 48               # of context counts: 0, 1, 2-3, 4-7, ...; those of two-token contexts follow those of one
STEPS_PER_OCTAVE, OCTAVES = 4, 48  # resolution of the estimates' ratios in the statistics of the deleted part
EM_ROUNDS = 200
END = U64(0)
#: Keys of bigrams and trigrams have 56 bits (a zero byte compresses away): of 3e9 distinct ones 4e-8 share a key.
KEY = ~U64(0xFF)

_codec = pa.Codec("zstd", compression_level=1)


def _pack(a: np.ndarray) -> bytes:
    """Compressed integers, bytes of equal significance together."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + (_codec.compress(raw, asbytes=True) if raw else b"")


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_codec.decompress(b[8:], n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def tokenised(docs: DataFrame) -> DataFrame:
    """Batches of documents (id, text, held_out, deleted); the two parts of
    the training set never share a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flag in (False, True):
                mine = batch.filter(pc.equal(batch.column(3), flag))
                for part in slices(mine, "text", BATCH_BYTES):
                    t = Texts(part.column(1)).lower()
                    s, e, first = t.runs()
                    tokens = np.insert(t.hashes(s, e), first[1:], END)
                    words, stream = np.unique(tokens, return_inverse=True)
                    lengths = np.diff(first) + 1
                    held = np.asarray(part.column(2)).astype(bool)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([flag]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([_pack(held.astype(np.uint8))], pa.binary()),
                        pa.array([_pack(lengths.astype(np.int64))], pa.binary()),
                        pa.array([_pack(np.diff(words, prepend=U64(0)))], pa.binary()),
                        pa.array([_pack(stream.astype(np.int32))], pa.binary()),
                        pa.array([len(tokens)], pa.int64()), pa.array([int(lengths[~held].sum())], pa.int64()),
                    ], ["deleted", "ids", "held_out", "lengths", "words", "stream", "n", "n_train"])
    schema = ("deleted boolean, ids array<long>, held_out binary, lengths binary, words binary, stream binary,"
              " n long, n_train long")
    out = docs.mapInArrow(run, schema)
    # the id need only be unique: the stored table fixes it
    return stored(out.withColumn("batch", F.monotonically_increasing_id()), "tokens")


def _key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(context + U64(0x9E3779B97F4A7C15)) ^ word) & KEY


def _ranked(keys: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return keys[order], rank[inverse]


class Batch:
    """A stored batch: words (sorted hashes), cur and prev (indexes of each
    token and its context; a document's first context is the end token)."""

    def __init__(self, row: dict):
        self.held = _unpack(row["held_out"], np.uint8).astype(bool)
        self.lengths = _unpack(row["lengths"], np.int64)
        self.words = np.cumsum(_unpack(row["words"], np.uint64), dtype=np.uint64)
        self.cur = _unpack(row["stream"], np.int32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.prev = np.empty_like(self.cur)
        self.prev[1:] = self.cur[:-1]
        self.prev[self.starts] = np.searchsorted(self.words, END)
        self.train = np.repeat(~self.held, self.lengths)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the distinct bigrams and each token's index among them."""
        pair, inverse = np.unique(self.prev * len(self.words) + self.cur, return_inverse=True)
        return _ranked(_key(self.words[pair // len(self.words)], self.words[pair % len(self.words)]), inverse)

    def trigrams(self, key2: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of trigrams, from the bigrams. A document's first context
        is two end tokens, which no token inside a document has."""
        before = self.before(at2, len(key2))
        three, inverse = np.unique(before * len(self.words) + self.cur, return_inverse=True)
        context = np.append(key2, _key(np.array([END]), np.array([END])))
        return _ranked(_key(context[three // len(self.words)], self.words[three % len(self.words)]), inverse)

    def before(self, of_bigram: np.ndarray, at_start: int) -> np.ndarray:
        """Of each token the value of the bigram before it."""
        out = np.empty_like(of_bigram)
        out[1:] = of_bigram[:-1]
        out[self.starts] = at_start
        return out


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of each 64-bit key; ascending if the keys are."""
    return (((keys >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unigram keys, evenly spread and sorted, and the order of the words there."""
    keys = mix64(words + U64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    return keys[order], order


def requests(tokens: DataFrame, parts: int, orders: tuple[int, ...]) -> DataFrame:
    """part, batch, deleted and for each order the sorted keys and own counts of a batch's distinct n-grams in a range.
    Ranges in which a batch has no n-gram get no row."""
    names = [f"{x}{k}" for k in orders for x in ("key", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row)
                own = []
                for k in orders:
                    if k == 1:
                        keys, order = _spread(b.words)
                        n = np.bincount(b.cur[b.train], minlength=len(b.words))[order]
                    else:
                        keys, at = b.bigrams()
                        keys, at = b.trigrams(keys, at) if k == 3 else (keys, at)
                        n = np.bincount(at[b.train], minlength=len(keys))
                    own.append((keys, n.astype(np.int32), _ranges(keys, parts)))
                asked = np.unique(np.concatenate([at for _, _, at in own]))
                blobs = [[(_pack(np.diff(keys[i:j], prepend=U64(0))), _pack(n[i:j]))
                          for i, j in zip(np.searchsorted(at, asked), np.searchsorted(at, asked, "right"))]
                         for keys, n, at in own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked), pa.array([row["batch"]] * len(asked), pa.int64()),
                    pa.array([row["deleted"]] * len(asked)),
                    *(pa.array([x[k] for x in side], pa.binary()) for side in blobs for k in (0, 1)),
                ], ["part", "batch", "deleted", *names])
    schema = "part long, batch long, deleted boolean, " + ", ".join(f"{x} binary" for x in names)
    return tokens.select("batch", "deleted", "held_out", "lengths", "words", "stream").mapInArrow(run, schema)


def answers(asked: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """For each request its n-grams' counts in the whole training set, for
    deleted batches also in the kept part; v, v_kept: known unigrams of the range (on one row).
    Counts of the orders not asked for are null."""
    def run(t: pa.Table) -> pa.Table:
        gone = np.asarray(t["deleted"]).astype(bool)
        out: dict[str, list] = {}
        v = v_kept = 0
        for k in map(str, orders):
            keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in t["key" + k].to_pylist()]
            counts = np.concatenate([_unpack(x, np.int32) for x in t["n" + k].to_pylist()]).astype(np.float64)
            size = np.array([len(x) for x in keys])
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, counts, len(known)).astype(np.int64)
            kept = total - np.bincount(at, counts * np.repeat(gone, size), len(known)).astype(np.int64)
            ends = np.cumsum(size)
            for name, values, only in (("c", total, None), ("kept", kept, gone)):
                out[name + k] = [_pack(values[at[j - n:j]]) if only is None or only[i] else None
                                 for i, (j, n) in enumerate(zip(ends, size))]
            if k == "1":
                v, v_kept = int((total > 0).sum()), int((kept > 0).sum())
        rest = [0] * (t.num_rows - 1)
        return pa.table({"part": t["part"], "batch": t["batch"], "deleted": t["deleted"],
                         **{x: pa.array(out[x], pa.binary()) if x in out else pa.nulls(t.num_rows, pa.binary())
                            for x in ("c1", "kept1", "c2", "kept2", "c3", "kept3")},
                         "v": pa.array([v, *rest], pa.int64()), "v_kept": pa.array([v_kept, *rest], pa.int64())})
    schema = ("part long, batch long, deleted boolean, c1 binary, kept1 binary, c2 binary, kept2 binary,"
              " c3 binary, kept3 binary, v long, v_kept long")
    found = stored(asked.groupBy("part").applyInArrow(run, schema), "counts")
    release_shuffles(asked.sparkSession)  # the requests are answered and stored
    return found


def _with_answers(tokens: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    mine = replies.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(
        "part", *[F.col(f"{name}{k}").alias(f"c{k}") for k in (1, 2, 3)]))).alias("replies"))
    return tokens.join(mine.hint("shuffle_merge"), "batch")


def _counts(b: Batch, row: dict) -> tuple[np.ndarray, ...]:
    """Of each token: the counts of its context, itself and its bigram, then
    of its two-token context and its trigram."""
    _, order = _spread(b.words)
    c1 = np.empty(len(b.words), np.int64)
    got1, c2, c3 = (np.concatenate([_unpack(x[k], np.int64) for x in row["replies"] if x[k] is not None]) for k in ("c1", "c2", "c3"))
    c1[order] = got1
    key2, at2 = b.bigrams()
    h, hw = c1[b.prev], c2[at2]
    # documents start as often as they end
    return h, c1[b.cur], hw, b.before(hw, int(c1[np.searchsorted(b.words, END)])), c3[b.trigrams(key2, at2)[1]]


def bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1), 0)


def _estimates(h: np.ndarray, w: np.ndarray, hw: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    return hw / np.maximum(h, 1), w / max(n, 1), 1.0 / (v + 1)


def buckets(h: np.ndarray, gh: np.ndarray) -> np.ndarray:
    return np.where(gh > 0, BUCKETS + bucket(gh), bucket(h))


TOP = STEPS_PER_OCTAVE * OCTAVES - 1
LOWEST = -TOP - 1
CLASSES = TOP - LOWEST + 1


def _class(ratio: np.ndarray) -> np.ndarray:
    """Class of a ratio in quarter octaves; -1 is zero, so those below 1 are moved down by one."""
    c = np.clip(np.round(STEPS_PER_OCTAVE * np.log2(np.maximum(ratio, 1e-300))), -TOP, TOP)
    return np.where(ratio > 0, c - (c < 0), -1).astype(np.int64)


def _ratio(c: np.ndarray) -> np.ndarray:
    return np.where(c == -1, 0.0, 2.0 ** ((c + (c < -1)) / STEPS_PER_OCTAVE))


def deleted_statistics(tokens: DataFrame, replies: DataFrame, n_kept: int, v_kept: int) -> np.ndarray:
    """How many deleted tokens have each (bucket, trigram to uniform ratio, bigram to uniform ratio,
    unigram to uniform ratio), in classes; the number is the last column. A bucket
    bounds its counts, so the cells stay few whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w, hw, gh, ghw = _counts(Batch(row), row)
                f2, f1, f0 = _estimates(h, w, hw, n_kept, v_kept)
                cell = buckets(h, gh)
                for f in (ghw / np.maximum(gh, 1), f2, f1):
                    cell = cell * CLASSES + _class(f / f0) - LOWEST
                cell, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])
    part = _with_answers(tokens.filter("deleted"), replies.filter("deleted"), "kept")
    sums = part.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, *classes = np.asarray(sums["cell"]), np.asarray(sums["n"])
    for _ in range(3):
        classes.insert(0, cell % CLASSES + LOWEST)
        cell = cell // CLASSES
    return np.stack([cell, *classes], axis=1)


def learn_weights(cells: list | np.ndarray) -> np.ndarray:
    """Weights (bigram, unigram, uniform, trigram) of each bucket by EM, from rows b, r2, r1, n and
    perhaps r3, or deleted_statistics. Buckets without deleted tokens take those of all tokens together."""
    def em(x: np.ndarray, seen: bool, three: bool) -> np.ndarray:
        weights = np.array([0.4, 0.4, 0.2, 0.0]) if seen else np.array([0.0, 0.7, 0.3, 0.0])
        weights = np.array([0.3, 0.2, 0.1, 0.4]) if three else weights
        ratio = np.stack([_ratio(x[:, 2]), _ratio(x[:, 3]), np.ones(len(x)), _ratio(x[:, 1])])
        for _ in range(EM_ROUNDS):
            share = weights[:, None] * ratio
            share *= x[:, 4] / share.sum(0)
            weights = share.sum(1) + np.array([0.5 * seen, 0.5, 0.5, 0.5 * three])  # half a token each: no weight becomes 0
            weights /= weights.sum()
        return weights
    if isinstance(cells, list):
        cells = [r.asDict() for r in cells]
        cells = np.array([[r["b"], r.get("r3", -1), r["r2"], r["r1"], r["n"]] for r in cells])
    x = np.array(cells, float).reshape(-1, 5)
    x = x[np.lexsort(x.T[::-1])]
    out = np.empty((2 * BUCKETS, 4))
    out[:BUCKETS] = em(x[(x[:, 0] > 0) & (x[:, 0] < BUCKETS)], True, False)
    out[0] = em(x[x[:, 0] == 0], False, False)
    out[BUCKETS:] = em(x[x[:, 0] >= BUCKETS], True, True)
    for b in range(1, 2 * BUCKETS):
        if (x[:, 0] == b).any():
            out[b] = em(x[x[:, 0] == b], True, b >= BUCKETS)
    return out


def score_texts(documents: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Score every text; learn from rows that aren't ``held_out``, weights
    from those that are ``deleted`` (conditions on the input's columns). Columns: id, held_out, n_tokens, n_known,
    train_tokens, base_score (smoothed unigram), score (log10 probability)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                            held_out.alias("held_out"), (deleted & ~held_out).alias("deleted"))
    tokens = tokenised(docs)
    sums = tokens.agg(F.sum("n").alias("n"), F.sum("n_train").alias("train"),
                      F.sum(F.when(F.col("deleted"), F.lit(0)).otherwise(F.col("n_train"))).alias("kept")).first()
    n, n_train, n_kept = (int(x or 0) for x in sums)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // KEYS_PER_RANGE))
    replies = answers(requests(tokens, parts, (1, 2)), (1, 2)).unionByName(answers(requests(tokens, parts, (3,)), (3,)))
    v, v_kept = (int(x or 0) for x in replies.agg(F.sum("v"), F.sum("v_kept")).first())
    weights = learn_weights(deleted_statistics(tokens, replies, n_kept, v_kept))
    if not n_train:
        weights[:] = (0, 0, 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row)
                h, w, hw, gh, ghw = _counts(b, row)
                f2, f1, f0 = _estimates(h, w, hw, n_train, v)
                mix = weights[buckets(h, gh)]
                model = np.log10(mix[:, 0] * f2 + mix[:, 1] * f1 + mix[:, 2] * f0 + mix[:, 3] * ghw / np.maximum(gh, 1))
                base = np.log10((w + 0.5) / (n_train + 0.5 * (v + 1)))
                each = [np.add.reduceat(x, b.starts) for x in ((w > 0).astype(np.int64), base, model)]
                size = len(b.lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(each[0]),
                    pa.array([n_train] * size, pa.int64()), pa.array(each[1]), pa.array(each[2]),
                ], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return _with_answers(tokens, replies, "c").mapInArrow(
        run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def by_folds(documents: DataFrame) -> DataFrame:
    """Held out: crc32(doc_id) mod 5 = 1; deleted: mod 10 = 0."""
    return score_texts(documents, fold("doc_id", 5) == 1, fold("doc_id", 10) == 0)
