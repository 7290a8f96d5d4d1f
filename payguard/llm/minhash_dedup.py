"""MinHash near-duplicates with odd sketches.

1. One pass over the texts gives each document its word-sequence digest, the
   size of its shingle set, MinHash band keys and an odd sketch: the MinHash
   samples (position, value) folded into a bitmap by parity, so the XOR of two
   sketches has one bit per sample in which the documents differ (less chance
   collisions) and its population count estimates their similarity.
2. Equal word sequences are one class, named by its smallest id; only classes
   go on. Classes that share a band key meet; there the sketches drop every
   pair whose estimate is clearly under the threshold.
3. What is left falls into families (components of candidate pairs). Within a
   family the whole shingle sets confirm each link; links make the groups.

Buckets and families of any size are cut into blocks. Each block first meets itself and the
first block, so that a family of copies of one text is united by rows in proportion to its
members; those it leaves apart from the largest part then meet all blocks. A task
returns one row per member (its smallest partner found), never the pairs. Nothing is capped or sampled.

Tables that grow with the documents are joined by merging, and facts of the second deal are copied to all tasks if they are few by
count: Spark takes a table for as large as its file, and an exploded one for no larger than before, and would send
many times its estimate through the driver.

Defined cases: null or blank texts have an empty set and link with nothing; a
text shorter than a shingle is one shingle; rows with equal ids count as the
same document; rows without an id take the component of their text's class
(null if that class has no id). Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payguard.llm.common import connected_components, salted_join, stored
from payguard.llm.textops import U64, Texts, mix64, slices

SAMPLES = 160        # MinHash samples folded into the sketch
BANDS, ROWS = 25, 4  # a pair at the threshold meets in no band with probability (1 - 0.8**4)**25 = 2e-6
SKETCH_BITS = 512
MARGIN = 0.14        # 4.4 standard deviations of a similarity of 0.8 estimated from 160 samples
BUCKET_BLOCK, FAMILY_BLOCK = 512, 128
MOST_SENT = 100_000  # rows of a table that is copied to all tasks

_rng = np.random.default_rng(20_240_229)
_A = (_rng.integers(0, 2**31, SAMPLES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of word hashes ``h``."""
    if not len(h):
        return h
    k = min(k, len(h))
    m = len(h) - k + 1
    s = np.full(m, U64(k))
    for i in range(k):
        s = mix64(s * U64(0x9E3779B97F4A7C15) + h[i:i + m])
    return np.unique(s)


def min_samples(s: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a shingle set."""
    x, best = (s >> U64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(best, (x[i:i + 4096, None] * _A + _B).min(0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> bytes:
    at = mix64(samples.astype(U64) + (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def max_differing_bits(threshold: float, margin: float = MARGIN) -> int:
    """Largest population count of a XOR whose estimated similarity,
    ``1 - ln(1 - 2z/n) / (2 k ln(1 - 2/n))``, is at least threshold - margin."""
    differ = 2 * SAMPLES * (1 - max(0.0, threshold - margin))
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ))


def band_keys(samples: np.ndarray) -> np.ndarray:
    m = samples[:BANDS * ROWS].reshape(BANDS, ROWS).astype(U64)
    h = np.arange(BANDS, dtype=U64)
    for i in range(ROWS):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + m[:, i])
    return h.view(np.int64)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and word hashes of each row, a bounded slice at a time."""
    for part in slices(batch, "text"):
        t = Texts(part.column(1)).lower()
        s, e, first = t.runs()
        h = t.hashes(s, e)
        yield part.column(0).to_pylist(), [h[first[i]:first[i + 1]] for i in range(len(t))]


def _digest(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """id, digest (null: no words), n_shingles, bands (array of long), sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words in _documents(batch):
                sets = [shingle_set(h, shingle) for h in words]
                mins = [min_samples(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([_digest(h) for h in words], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if m is None else band_keys(m) for m in mins], pa.list_(pa.int64())),
                    pa.array([None if m is None else odd_sketch(m) for m in mins], pa.binary()),
                ], ["id", "digest", "n_shingles", "bands", "sketch"])
    return docs.mapInArrow(run, "id long, digest binary, n_shingles long, bands array<long>, sketch binary")


def _of_groups(members: DataFrame, facts: DataFrame, group: str, rows: int) -> DataFrame:
    """``members`` (with ``id``) of the groups of ``facts``, however many a group has."""
    if rows <= MOST_SENT:
        return members.join(F.broadcast(facts), group)
    return salted_join(members, facts.hint("merge"), group, "id", "inner")


def _first_deal(members: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """Deal each group's members to tasks: adds ``pair`` (long) and ``side`` (0: left, 1: right, 2: both).
    A group of one block is one task; of a larger one, each block meets itself and the first block,
    which is three rows a member at most."""
    blocks = sizes.select(F.col(group).alias("_g"), F.ceil(F.col("n") / block).cast("int").alias("_nb"))
    m = (members.join(blocks.hint("merge"), F.col(group) == F.col("_g"))
         .withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")))
    own = F.struct(F.col("_b").cast("long").alias("pair"), F.lit(2).alias("side"))
    later = F.transform(F.sequence(F.lit(1), F.col("_nb") - 1), lambda i: F.struct((-i).cast("long").alias("pair"), F.lit(0).alias("side")))
    first = F.struct((-F.col("_b")).cast("long").alias("pair"), F.lit(1).alias("side"))
    deals = F.when(F.col("_nb") == 1, F.array(own)).when(F.col("_b") == 0, F.concat(F.array(own), later)).otherwise(F.array(own, first))
    return m.withColumn("_d", F.explode(deals)).select(*members.columns, "_d.pair", "_d.side", (F.col("_nb") > 1).alias("split"))


def _apart_deal(members: DataFrame, group: str, sizes: DataFrame, links: DataFrame, block: int, label: str) -> DataFrame | None:
    """The second deal, of groups of several blocks: members outside their group's largest part
    (those that ``links`` of the first deal unite with one member of the first block) meet all members. None if there
    are no such groups. Adds ``part``, ``pair`` and ``side``. So a family that the first block unites costs nothing more."""
    large = sizes.filter(F.col("n") > block)
    groups = large.count()
    if not groups:
        return None
    found = links.filter("split AND pair <= 0").groupBy("g", "a", (F.col("pair") == 0).alias("own")).agg(F.min("b").alias("b"))
    with_first = found.filter("NOT own").select(F.col("g").alias("_g1"), F.col("a").alias("_a1"), F.col("b").alias("_to"))
    in_first = found.filter("own").select(F.col("g").alias("_g2"), F.col("a").alias("_a2"), F.col("b").alias("_top"))
    blocks = large.select(group, F.ceil(F.col("n") / block).cast("int").alias("_nb"))
    m = _of_groups(members.select("id", group), blocks, group, groups)
    m = m.join(with_first.hint("merge"), (F.col(group) == F.col("_g1")) & (F.col("id") == F.col("_a1")), "left").withColumn("_to", F.coalesce("_to", "id"))
    m = m.join(in_first.hint("merge"), (F.col(group) == F.col("_g2")) & (F.col("_to") == F.col("_a2")), "left")
    m = stored(m.select("id", group, "_nb", F.coalesce("_top", "_to").alias("part")), label)
    weight = m.groupBy(group, "part").agg(F.count("*").alias("k"))
    top = weight.groupBy(group).agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("all"))
    top = top.select(group, F.col("top.part").alias("_top"), F.ceil((F.col("all") - F.col("top.k")) / block).cast("int").alias("_na")).filter("_na > 0")
    m = stored(_of_groups(m, top, group, groups), label + "-apart")
    spot = F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")
    mine = F.pmod(F.shiftright(F.xxhash64("id"), 20), F.col("_na")).cast("int")

    def task(a: Column, b: Column) -> Column:
        return (a.cast("long") * F.col("_nb") + b)
    left = m.filter(F.col("part") != F.col("_top")).withColumn("pair", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("_nb") - 1), lambda i: task(mine, i)))).withColumn("side", F.lit(0))
    right = m.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda i: task(i, spot)))).withColumn("side", F.lit(1))
    dealt = m.agg(F.sum(F.col("_na") + F.when(F.col("part") != F.col("_top"), F.col("_nb")).otherwise(0))).first()[0] or 0
    deals = left.unionByName(right).select("id", group, "part", "pair", "side")
    return members.join(deals.hint("broadcast" if dealt <= MOST_SENT else "merge"), ["id", group])


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _near(bits: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left row, right row), left before right, of at most ``most`` differing bits."""
    a, b = [], []
    for i in range(0, len(left), 64):
        d = np.bitwise_count(bits[left[i:i + 64], None, :] ^ bits[None, right, :]).sum(2, dtype=np.int32)
        x, y = np.nonzero(d <= most)
        a.append(left[i:i + 64][x])
        b.append(right[y])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row index reachable from each of n rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, root[root])
        while (root != root[root]).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


_LINKS = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pair", pa.int64()), ("split", pa.bool_())])
_LINK_TYPES = "g long, a long, b long, pair long, split boolean"


def _found(t: pa.Table, group: str, ids: np.ndarray, root: np.ndarray) -> pa.Table:
    """A row for each member of a task that isn't the first of its part there."""
    hit = np.flatnonzero(ids[root] != ids)
    same = {c: np.repeat(t[c][0].as_py(), len(hit)) for c in (group, "pair", "split")}
    return pa.table([same[group].astype(np.int64), ids[hit], ids[root[hit]], same["pair"].astype(np.int64), same["split"].astype(bool)], schema=_LINKS)


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) rows that connect classes exactly as their candidate pairs do."""
    most = max_differing_bits(threshold)
    rows = classes.select("id", "sketch", F.posexplode("bands").alias("band", "key"))
    rows = rows.withColumn("key", F.xxhash64("band", "key")).drop("band")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")])  # the first block's members name parts
        ids = t["id"].to_numpy()
        left, right = _sides(t["side"].to_numpy())
        a, b = _near(_bits(t["sketch"].combine_chunks()), left, right, most)
        return _found(t, "key", ids, _roots(len(ids), a, b))
    first = _first_deal(rows, "key", sizes, BUCKET_BLOCK).groupBy("key", "pair").applyInArrow(run, _LINK_TYPES)
    first = stored(first, "bucket-links")
    more = _apart_deal(rows, "key", sizes, first, BUCKET_BLOCK, "buckets")
    if more is not None:
        more = more.withColumn("split", F.lit(True)).groupBy("key", "pair").applyInArrow(run, _LINK_TYPES)
        first = first.unionByName(more)
    return first.select("a", "b").distinct()


def confirmed_links(docs: DataFrame, classes: DataFrame, families: DataFrame, shingle: int,
                    percent: int) -> DataFrame:
    """(a, b) rows that connect the classes of each family exactly as their
    links (100 * intersection >= percent * union on whole sets) do."""
    spark = docs.sparkSession
    wanted = stored(families.join(classes.select("id", "digest").hint("merge"), "id"), "families")
    # A fixed-size bitmap of hashed ids spares most other texts the shuffle; the join decides.
    slots = 1 << 22
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    maps = (wanted.select((slot + 1).alias("s"))  # the bitmap functions count from 1
            .groupBy(F.bitmap_bucket_number("s").alias("n"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
    bits = bytearray(slots // 8)
    for r in maps:
        at = (r["n"] - 1) * 4096
        bits[at:at + 4096] = r["m"][:max(0, len(bits) - at)]
    known = spark.sparkContext.broadcast(bytes(bits))
    most = max_differing_bits(percent / 100)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(known.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bitmap[batch.column(2).to_numpy(zero_copy_only=False)]))
            for ids, words in _documents(batch):
                full = [shingle_set(h, shingle) for h in words]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([_digest(h) for h in words], pa.binary()),
                    pa.array([odd_sketch(min_samples(s)) if len(s) else None for s in full], pa.binary()),
                    pa.array([s.tobytes() for s in full], pa.binary()),
                ], ["id", "digest", "sketch", "shingles"])

    found = (docs.filter("id IS NOT NULL").withColumn("slot", slot).mapInArrow(
        sets, "id long, digest binary, sketch binary, shingles binary"))
    # one row per class, by its digest: rows with an equal id and another text fall out
    sizes = stored(wanted.groupBy("family").agg(F.count("*").alias("n")), "family-sizes")
    full = (found.join(wanted.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"]).drop("digest"))
    full = stored(full, "sets")  # read by both deals

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("id", "ascending")])
        ids = t["id"].to_numpy()
        full = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        size = np.array([len(x) for x in full])
        left, right = _sides(t["side"].to_numpy())
        a, b = _near(_bits(t["sketch"].combine_chunks()), left, right, most)
        keep = (a < b) if len(left) == len(right) == len(ids) else ids[a] != ids[b]
        keep &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[keep], b[keep]
        known = t["part"].to_numpy() if "part" in t.column_names else ids  # what the first deal has united
        root = np.unique(known, return_index=True, return_inverse=True)
        root = root[1][root[2]].tolist()

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        # pairs next to the block's hubs first: they join most members, whose other pairs need no test then
        degree = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        for i in np.argsort(-np.maximum(degree[a], degree[b]), kind="stable"):
            x, y = top(a[i]), top(b[i])
            if x != y:
                p, q = full[a[i]], full[b[i]]
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    root[max(x, y)] = min(x, y)
        return _found(t, "family", ids, np.array([top(i) for i in range(len(ids))]))
    links = _first_deal(full, "family", sizes, FAMILY_BLOCK).groupBy("family", "pair").applyInArrow(run, _LINK_TYPES)
    links = stored(links, "family-links")
    more = _apart_deal(full, "family", sizes, links, FAMILY_BLOCK, "family-parts")
    if more is not None:
        links = links.unionByName(more.withColumn("split", F.lit(True)).groupBy("family", "pair").applyInArrow(run, _LINK_TYPES))
    return links.select("a", "b").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links,
    itself included), kept (the row's id names its component)."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = stored(signatures(docs, shingle), "signatures")
    classes = stored(sig.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .filter("id IS NOT NULL"), "classes")
    families = connected_components(candidate_links(classes, percent / 100), "families").select(
        "id", F.col("component").alias("family"))
    groups = connected_components(confirmed_links(docs, classes, families, shingle, percent), "groups")
    named = classes.select("digest", F.col("id").alias("class_id"))
    top = groups.select(F.col("id").alias("class_id"), "component")
    out = sig.select("id", "digest", "n_shingles").join(
        named.join(top.hint("merge"), "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component")),
        "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """``documents`` with one row for each group: that of the smallest id (of rows
    with one id, the first by text). Rows without an id can't be named and stay."""
    names = documents.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    d = documents.toDF(*[f"c{i}" for i in range(len(names))])
    stay = near_duplicates(documents, id_col, text_col, shingle, percent).filter("kept AND id IS NOT NULL").select(
        F.col("id").alias("kept_id")).distinct()
    d = d.join(stay, F.col(f"c{at_id}").cast("long") == F.col("kept_id"), "left").filter(
        F.col(f"c{at_id}").isNull() | F.col("kept_id").isNotNull())
    first = F.row_number().over(Window.partitionBy("kept_id").orderBy(f"c{at_text}"))
    named = d.filter("kept_id IS NOT NULL").withColumn("first", first).filter("first = 1")
    return named.drop("first").unionByName(d.filter("kept_id IS NULL")).drop("kept_id").toDF(*names)
