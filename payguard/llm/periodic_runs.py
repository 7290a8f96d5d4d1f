"""Periodic runs of words by scale-tiled search.

A run is a maximal stretch of words with smallest period q (words q apart are
equal) and a length of at least max(6, 4 * q). Periods are searched by octave: for
k = 2^j, the periods k <= p < 2k of a document are found in overlapping tiles with
a boundary c at every multiple of 2k. A tile's boundary Z-function tells, for each p,
how far the words at c and at c + p agree (forwards up to 3k words, backwards
up to 2k). A run of such a period holds at least 3k matches, so some boundary in it has
Z >= k, which is one comparison of hashes of k words (hashes of 2k words
come from those of k). Only boundaries that pass it, with a primitive period, are
extended. Tiles are solved independently of one another; their fragments
(document, period, interval) are shuffled by document and period and stitched.

Texts of up to ``long_words`` words are tiled where they are read, many texts at
once. Longer ones are cut into strips of tiles, a row per octave and strip, that are
dealt to all tasks; the tiles, fragments and results are the same.

Defined cases: a null or blank text has no words and no runs; repeated rows are
documents of their own; a null id is returned as null; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payguard.llm.common import WORD_PATTERN, stored
from payguard.llm.textops import Texts, U64, mix64, slices

MIN_WORDS = 6       # of a run
MIN_EXPONENT = 4
LONG_WORDS = 1 << 16
STRIP_WORDS = 1 << 15
LIFTED = 10         # octaves whose fragments are extended by hashes of all lower levels
CHUNK = 2 << 20     # bytes of text solved at once

_MUL, _MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_FACTOR = np.arange(2, dtype=np.int64)  # smallest prime factor, grown on demand


def _smallest_factors(top: int) -> np.ndarray:
    global _FACTOR
    if len(_FACTOR) <= top:
        f = np.arange(2 * top + 1, dtype=np.int64)
        for i in range(2, int(len(f) ** 0.5) + 1):
            if f[i] == i:
                part = f[i * i::i]
                part[part > i] = np.minimum(part[part > i], i)
        _FACTOR = f
    return _FACTOR


def _doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from hashes of k words (the last 2k - 1 mean nothing)."""
    out = h * _MUL
    out[:len(h) - k] += h[k:]
    out ^= out >> U64(32)
    out *= _MIX
    out ^= out >> U64(29)
    return out


def _primitive(c: np.ndarray, p: np.ndarray, k: int, now: np.ndarray, below: np.ndarray | None) -> np.ndarray:
    """Is the word of length p at c no power of a shorter one? ``now`` holds
    hashes of k words, ``below`` of k / 2."""
    good = np.ones(len(c), bool)
    if below is None:
        return good
    factors, rest, live = _smallest_factors(2 * k), p.copy(), np.flatnonzero(p > 1)
    while len(live):
        r = factors[rest[live]]
        d = p[live] // r
        span, at = p[live] - d, c[live]
        whole = span >= k
        size = np.where(whole, k, k // 2)
        tail = at + span - size
        same = np.where(whole, (now[at] == now[at + d]) & (now[tail] == now[tail + d]),
                        (below[at] == below[at + d]) & (below[tail] == below[tail + d]))
        good[live[same]] = False
        rest[live] //= r
        live = live[~same]
        live = live[rest[live] > 1]
    return good


def _lifted(levels: list[np.ndarray], c: np.ndarray, p: np.ndarray, reach: np.ndarray, top: np.ndarray, sign: int) -> np.ndarray:
    """Boundary Z-values by hashes of ever fewer words: matches from c on
    (``sign`` 1) or before c (-1), from ``reach`` known ones up to ``top``."""
    for b in [len(levels) - 1, *range(len(levels) - 1, -1, -1)]:
        step = 1 << b
        can = np.flatnonzero(reach + step <= top)
        at = c[can] + reach[can] if sign > 0 else c[can] - reach[can] - step
        same = levels[b][at] == levels[b][at + p[can]]
        reach[can[same]] += step
    return reach


def _compared(words: np.ndarray, c: np.ndarray, p: np.ndarray, reach: np.ndarray, top: np.ndarray, sign: int) -> np.ndarray:
    """As :func:`_lifted`, word by word (few boundaries with long periods)."""
    for i, (at, q, known, most) in enumerate(zip(c.tolist(), p.tolist(), reach.tolist(), top.tolist())):
        lo, hi = (at + known, at + most) if sign > 0 else (at - most, at - known)
        differ = np.flatnonzero(words[lo:hi] != words[lo + q:hi + q])
        if not len(differ):
            reach[i] = most
        else:
            reach[i] = known + int(differ[0]) if sign > 0 else hi - lo - 1 - int(differ[-1]) + known
    return reach


def _octave(j: int, words: np.ndarray, levels: list[np.ndarray], now: np.ndarray, below: np.ndarray | None,
            rel: np.ndarray, left: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, ...]:
    """(boundary position, period, matches before, matches after) of every
    tile's fragments with k <= period < 2k. Boundaries outside lo <= rel < hi are
    those of other strips."""
    k = 1 << j
    at = np.flatnonzero(rel & k)
    at = at[left[at] >= k]
    p = (rel[at] & (2 * k - 1)).astype(np.int64)
    c = at - p
    hit = np.flatnonzero(now[at] == now[c])
    c, p = c[hit], p[hit]
    if lo or hi is not None:
        mine = (rel[c] >= lo) & (rel[c] < (hi if hi is not None else 1 << 62))
        c, p = c[mine], p[mine]
    good = _primitive(c, p, k, now, below)
    c, p = c[good], p[good]
    after = np.full(len(c), k, np.int64)
    before = np.zeros(len(c), np.int64)
    most_after = np.minimum(3 * k, left[c] - p)
    most_before = np.minimum(2 * k, rel[c]).astype(np.int64)
    if j < LIFTED:
        after, before = _lifted(levels, c, p, after, most_after, 1), _lifted(levels, c, p, before, most_before, -1)
    else:
        after, before = _compared(words, c, p, after, most_after, 1), _compared(words, c, p, before, most_before, -1)
    # a fragment that ends within its tile on both sides is whole: too short ones go
    open_ = (after == 3 * k) | (before == 2 * k)
    keep = open_ | (before + after + p >= np.maximum(MIN_WORDS, MIN_EXPONENT * p))
    return c[keep], p[keep], before[keep], after[keep]


def joined(doc: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of a document and period that overlap or touch, as one."""
    if not len(doc):
        return doc, period, start, stop
    o = np.lexsort((start, period, doc))
    doc, period, start, stop = doc[o], period[o], start[o], stop[o]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])
    # running maximum of stops within a group: groups are lifted above each other
    lift = np.cumsum(fresh) * (int(stop.max()) + 1)
    far = np.maximum.accumulate(stop + lift) - lift
    fresh[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], period[first], start[first], np.maximum.reduceat(stop, first)


def fragments(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, period, start, stop) of matches words[i] = words[i + period],
    start <= i < stop, of all octaves; documents are words[off[d]:off[d + 1]]."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")  # long ones first: an octave works on a prefix
    order = order[n[order] >= MIN_WORDS]
    size = n[order]
    first = np.concatenate([[0], np.cumsum(size)])
    w = words[np.repeat(off[order] - first[:-1], size) + np.arange(first[-1])]
    rel = np.arange(first[-1]) - np.repeat(first[:-1], size)
    left = np.repeat(size, size) - rel
    levels, now, below, out, j = [], mix64(w), None, [], 0
    while True:
        k = 1 << j
        docs = int(np.searchsorted(-size, -max(MIN_WORDS, MIN_EXPONENT * k), "right"))
        if not docs:
            break
        end = first[docs]
        now, levels = now[:end], [x[:end] for x in levels]
        if j < LIFTED:
            levels.append(now)
        c, p, before, after = _octave(j, w, levels, now, None if below is None else below[:end], rel[:end], left[:end])
        d = np.searchsorted(first, c, "right") - 1
        out.append((order[d], p, c - before - first[d], c + after - first[d]))
        below, now, j = now, _doubled(now, k), j + 1
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return joined(*(np.concatenate(x) for x in zip(*out)))


def strips(n: int, strip_words: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(octave, first boundary, its end, first word, end of words) of the strips of
    a document of n words."""
    j = 0
    while n >= MIN_EXPONENT << j:
        k = 1 << j
        wide = max(2 * k, strip_words // (2 * k) * 2 * k)
        for f in range(0, n, wide):
            yield j, f, f + wide, max(0, f - 2 * k), min(n, f + wide + 3 * k)
        j += 1


def strip_fragments(words: np.ndarray, j: int, lo: int, hi: int, base: int) -> tuple[np.ndarray, ...]:
    """(period, start, stop) of a strip's tiles in octave j; its words begin at
    word ``base`` of the document, its boundaries are lo <= c < hi."""
    now, below, levels = mix64(words), None, []
    for b in range(j):
        if j < LIFTED:
            levels.append(now)
        below, now = now, _doubled(now, 1 << b)
    levels.append(now)
    rel = np.arange(len(words))
    c, p, before, after = _octave(j, words, levels, now, below, rel, len(words) - rel, lo - base, hi - base)
    _, p, start, stop = joined(np.zeros(len(c), np.int64), p, c - before + base, c + after + base)
    return p, start, stop


_FOUND = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("id", pa.int64()), ("plain", pa.string()), ("text", pa.string()),
                    ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("octave", pa.int32()),
                    ("lo", pa.int64()), ("hi", pa.int64()), ("base", pa.int64()), ("words", pa.binary())])
_DOCUMENT, _FRAGMENT, _STRIP = 0, 1, 2


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else
         pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _search(long_words: int, strip_words: int):
    """Documents to rows of three kinds: the document (its text only where it may
    have runs), fragments, strips."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                rid, ids, text = part.column(0).to_numpy(), part.column(1), part.column(2)
                texts = Texts(text)
                begin, end, first = texts.runs()
                words = texts.hashes(begin, end)
                n = np.diff(first)
                open_ = n > long_words
                for d in np.flatnonzero(open_).tolist():
                    own = words[first[d]:first[d + 1]]
                    for j, lo, hi, a, b in strips(len(own), strip_words):
                        yield _rows(_STRIP, 1, rid=[int(rid[d])], octave=[j], lo=[lo], hi=[hi], base=[a], words=[own[a:b].tobytes()])
                short = np.flatnonzero(~open_)
                size = n[short]
                off = np.concatenate([[0], np.cumsum(size)])
                if len(short) < len(n):
                    words = words[np.repeat(first[short] - off[:-1], size) + np.arange(off[-1])]
                d, p, start, stop = fragments(words, off)
                if len(d):
                    yield _rows(_FRAGMENT, len(d), rid=rid[short[d]], period=p, start=start, stop=stop)
                open_[short[d]] = True
                plain = [None if o else _digest((x or "").encode().split()) for o, x in zip(open_.tolist(), text.to_pylist())]
                kept = pa.array([x if o else None for o, x in zip(open_.tolist(), text.to_pylist())], pa.string())
                yield _rows(_DOCUMENT, len(n), rid=rid, id=ids.cast(pa.int64()), plain=plain, text=kept)
    return run


def _solve_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rid", "period", "start", "stop"]
    for batch in batches:
        for r in batch.to_pylist():
            p, start, stop = strip_fragments(np.frombuffer(r["words"], U64), r["octave"], r["lo"], r["hi"], r["base"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), r["rid"], np.int64)), *map(pa.array, (p, start, stop))], names)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the words that no run repeats."""
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()
            keep = np.ones(len(words), bool)
            for r in runs or ():
                keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
            out.append(_digest([w for w, k in zip(words, keep.tolist()) if k]))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*batch.schema.names[1:], "collapsed_sha256"])


def stitched(parts: DataFrame) -> DataFrame:
    """(rid, period, start, length) of the runs: fragments of a document
    and period that overlap or touch are one interval."""
    by = Window.partitionBy("rid", "period").orderBy("start", "stop")
    far = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    grouped = (parts.withColumn("fresh", F.when(F.col("start") <= far, 0).otherwise(1))
               .withColumn("g", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    whole = grouped.groupBy("rid", "period", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.select("rid", "period", "start", length.alias("length")).filter(
        F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_EXPONENT * F.col("period")))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text",
              long_words: int = LONG_WORDS, strip_words: int = STRIP_WORDS) -> DataFrame:
    """Per row: id, runs (array of start, length, period by start and period),
    collapsed_sha256 (the words outside every run's repeats, joined by one space)."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    types = "kind int, rid long, id long, plain string, text string, period long, start long, stop long, octave int, lo long, hi long, base long, words binary"
    found = stored(rows.mapInArrow(_search(long_words, strip_words), types), "runs")
    parts = found.filter(F.col("kind") == _FRAGMENT).select("rid", "period", "start", "stop")
    dealt = found.filter(F.col("kind") == _STRIP).select("rid", "octave", "lo", "hi", "base", "words")
    dealt = dealt.repartition("rid", "octave", "lo")
    parts = parts.unionByName(dealt.mapInArrow(_solve_strips, "rid long, period long, start long, stop long"))
    # a document's runs are fewer than its words, so its list is no longer than its text
    lists = stitched(parts).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    known = found.filter(F.col("kind") == _DOCUMENT)
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    clean = known.filter("plain IS NOT NULL").select(
        F.expr(f"CAST(array() AS {kind})").alias("runs"), "id", F.col("plain").alias("collapsed_sha256"))
    periodic = known.filter("plain IS NULL").join(lists, "rid", "left").select("text", "runs", "id")
    periodic = periodic.mapInArrow(_collapse, f"runs {kind}, id long, collapsed_sha256 string")
    return clean.unionByName(periodic).withColumn("runs", F.coalesce("runs", F.expr(f"CAST(array() AS {kind})"))).select(
        "id", "runs", "collapsed_sha256")


def digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: id, n_runs, the longest run (ties: smallest
    start, then period), runs_sha256, collapsed_sha256."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    whole = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", best)
    return out.select(
        "id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("CAST(-best.l AS LONG) * 1000 DIV best.p").alias("exponent_milli"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("runs_sha256"), "collapsed_sha256")


def planted(doc_id: str, text: str) -> Column:
    """A tenth of the texts with a cycle: with h = crc32 of the decimal id (null:
    empty), g = h div 10 and n > 0 words, if h mod 10 = 0, word i >= a = g mod n is the
    original word a + (i - a) mod p with p = 1 + (n - a) div (3 + g mod 8). Words are
    then joined by one space; other texts stay."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_PATTERN})"), F.lit(1))

    def cycle(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return F.when(h % 10 != 0, F.col(text)).otherwise(F.array_join(F.element_at(F.transform(
        F.array(words), lambda w: F.when(F.size(w) > 0, cycle(w))), 1), " "))
