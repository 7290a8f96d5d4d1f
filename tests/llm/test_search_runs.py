"""Nearest neighbours, periodic runs and lexical search against brute force, by
the registered queries and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from payguard.llm import lexical_search, periodic_runs, projection_search, queries
from payguard.session import expose_package

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOC = "doc_id long, text string, kind string, rid string, score string, n string, vec string, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, tied, periodic and very long texts; null ids; columns whose names clash."""
    expose_package(spark)
    body = "one Two three four five six seven Été-8 nine ten "
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, body * 3), (5, body * 3), (5, body * 3), (None, body * 7), (None, None), (6, "x " * 5_000),
             (7, "long word " * 40_000), (8, "x" * 300_000), (9, "123 ... !!"), (10, "a b a b a b a c a b a b a b a b"), (11, ("a a b " * 9 + "c ") * 20)]
    return spark.createDataFrame([(*t, *["extra"] * 6) for t in texts], DOC)


# ---------------------------------------------------------------- periodic runs

def brute_runs(words):
    runs, n = [], len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i - s + p
            if size >= max(6, 4 * p) and all(any(words[x] != words[x + d] for x in range(s, s + size - d)) for d in range(1, p)):
                runs.append((s, size, p))
    return sorted(runs)


def some_documents(rng, many):
    for _ in range(many):
        n, t = rng.randint(0, 120), rng.random()
        if t < 0.4:
            yield [rng.randint(0, 1) for _ in range(n)]
        elif t < 0.8:
            out = []
            while len(out) < n:
                out += [rng.randint(0, 3) for _ in range(rng.randint(1, 12))] * rng.randint(1, 8)
            yield out
        else:
            yield ([rng.randint(0, 1) for _ in range(rng.randint(1, 30))] * 40)[:n]


@pytest.mark.parametrize("lifted", [10, 0, 2])
def test_tiles_equal_brute_force(monkeypatch, lifted):
    monkeypatch.setattr(periodic_runs, "LIFTED", lifted)
    docs = list(some_documents(random.Random(1), 400))
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = collections.defaultdict(list)
    for d, p, a, b in zip(*(x.tolist() for x in periodic_runs.fragments(np.array(sum(docs, []), np.uint64), off))):
        if b - a + p >= max(6, 4 * p):
            found[d].append((a, b - a + p, p))
    assert all(sorted(found[i]) == brute_runs(d) for i, d in enumerate(docs))


def test_runs_of_deep_periods_and_thue_morse():
    tm = [bin(i).count("1") & 1 for i in range(4_096)]
    for words, want in ((tm, []), (tm[:2_500] * 5, (0, 12_500, 2_500)), ([1] * 30_000, (0, 30_000, 1))):
        d, p, a, b = periodic_runs.fragments(np.array(words, np.uint64), np.array([0, len(words)]))
        got = sorted((s, e - s + q, q) for q, s, e in zip(p.tolist(), a.tolist(), b.tolist()) if e - s + q >= max(6, 4 * q))
        assert (want in got) if want else not got


def contract_runs(doc_id, text, plant):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = fast_runs(w)
    keep = [True] * n
    for s, size, p in runs:
        keep[s + p:s + size] = [False] * (size - p)
    best = min(((-size, s, p) for s, size, p in runs), default=None)
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
    digest = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    return (doc_id, len(runs), *row, hashlib.sha256(digest.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for x, k in zip(w, keep) if k)).hexdigest())


def fast_runs(w):
    """Brute force over all periods, a vector comparison for each."""
    ids = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    n, out = len(ids), []
    for p in range(1, n // 4 + 1):
        same = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + p >= max(6, 4 * p) and not any(p % d == 0 and (ids[s:e + p - d] == ids[s + d:e + p]).all() for d in range(1, p)):
                out.append((s, e - s + p, p))
    return sorted(out)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_of_runs_equals_brute_force(spark):
    out = queries.op12_scale_tiles(spark, SF)
    assert out.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [contract_runs(r["doc_id"], r["text"], True) for r in docs]
    assert as_rows(out.select(out.columns[:8])) == sorted(want, key=repr)
    assert sum(r[1] for r in want) >= 10


@pytest.mark.parametrize("long_words,strip_words", [(1 << 16, 1 << 15), (10, 16), (0, 1 << 12)])
def test_runs_odd_rows(odd, long_words, strip_words):
    few = odd.filter("doc_id IS NULL OR doc_id <> 7")
    out = periodic_runs.digests(periodic_runs.find_runs(few, long_words=long_words, strip_words=strip_words))
    want = [contract_runs(r["doc_id"], r["text"], False) for r in few.collect()]
    assert as_rows(out) == sorted(want, key=repr)


def test_runs_very_long_and_empty(odd):
    out = periodic_runs.digests(periodic_runs.find_runs(odd.filter("doc_id = 7"))).collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in out] == [(1, 0, 80_000, 2)]
    assert periodic_runs.digests(periodic_runs.find_runs(odd.filter("false"))).count() == 0


def test_planted_texts(spark, odd):
    docs = odd.select("doc_id", "text", periodic_runs.planted("doc_id", "text").alias("p"))
    for r in docs.collect():
        w = (r["text"] or "").split()
        h = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        if h % 10:
            assert r["p"] == r["text"]
        elif w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert r["p"].split(" ") == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


# ---------------------------------------------------------------- lexical search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranking(docs, items, top=10):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for q, text in items:
        asked[q] |= set(terms(text))
    out = []
    for q, wanted in asked.items():
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in wanted if t in c)
            if score > 0:
                scored.append((-score, -2**63 if i is None else i))
        out += [(q, k + 1, None if i == -2**63 else i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def test_query_of_search_equals_brute_force(spark):
    out = queries.op13_hybrid_taat_daat(spark, SF)
    assert out.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(out) == brute_ranking(docs, items)


@pytest.mark.parametrize("short,block,step,slice_bytes,pairs", [(32, 64, 8, 8 << 20, 200_000), (0, 2, 1, 2_000, 20), (2, 3, 2, 500, 7), (10**9, 4, 1, 4_000, 50)])
def test_search_odd_rows(spark, odd, monkeypatch, short, block, step, slice_bytes, pairs):
    for name, value in (("SHORT", short), ("BLOCK_DOCS", block), ("STEP", step), ("SLICE_BYTES", slice_bytes)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(5)
    extra = [(100 + i, " ".join(f"t{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs = odd.select("doc_id", "text", "score", "n").unionByName(
        spark.createDataFrame([(*x, "e", "e") for x in extra], "doc_id long, text string, score string, n string"))
    items = [(1, "one two  t1 t2 t3 t3"), (2, None), (3, ""), (4, "x X long"), (5, "t1 t9 t17 t20 t30 été"), (6, "nothing known"), (None, "ten 123"),
             (7, "t5"), (7, "T6 t7"), (8, "t1 t2 t3 t4 t5 t6 t7 t8 t10 t11 t12")]
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, rank string, query string")
    got = lexical_search.search(docs, asked, block_terms=pairs)
    assert as_rows(got) == brute_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_search_empty_tables(odd):
    items = odd.select(F.col("doc_id").alias("item_id"), "text")
    assert lexical_search.search(odd.filter("false"), items).count() == 0
    assert lexical_search.search(odd, items.filter("false")).count() == 0
    assert lexical_search.search(odd.filter("doc_id < 4"), items).count() == 0


# ---------------------------------------------------------------- nearest neighbours

def brute_neighbours(rows, asks, k):
    good = {(i, np.array(v, np.float64).tobytes()) for i, v in rows
            if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for i, q in good:
        if asks(i):
            a = np.frombuffer(q)
            near = sorted((-float(a @ np.frombuffer(b)), j) for j, b in good if j != i and len(b) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def recall(got, want):
    ids = collections.defaultdict(list)
    for r in got:
        ids[r[0]].append(r)
    hit = total = 0
    for i, near in want.items():
        mine = sorted(ids[i], key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(1, len(near) + 1))
        assert all(a[3] > b[3] or (a[3] == b[3] and a[2] < b[2]) for a, b in zip(mine, mine[1:]))
        scores = [s for _, s in near]
        hit += sum(r[3] >= scores[-1] - 1e-9 for r in mine)
        total += len(near)
    assert set(ids) == {i for i, near in want.items() if near}
    return hit / max(total, 1)


def test_query_of_neighbours_recall(spark):
    out = queries.op11_projected_kd_tree(spark, "/root/testdata/sf0.1")
    assert out.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = [tuple(r) for r in out.collect()]
    assert recall(got, brute_neighbours(rows, lambda i: i % 20 == 0, 20)) >= 0.9
    by_id = dict(rows)
    assert all(abs(float(np.dot(np.float64(by_id[q]), np.float64(by_id[v]))) - s) < 1e-9 for q, _, v, s in got[:500])


@pytest.mark.parametrize("leaf,part,query", [(2_048, 8_192, 2_048), (40, 16, 5)])
def test_neighbours_of_clusters_copies_and_norms(spark, monkeypatch, leaf, part, query):
    """Clusters, a third of all rows one vector, norms over three decades, tiny tables' leaves and parts."""
    expose_package(spark)
    monkeypatch.setattr(projection_search, "PART_ROWS", part)
    monkeypatch.setattr(projection_search, "QUERY_ROWS", query)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 16))
    x[:100] *= 10 ** rng.uniform(-2, 1, (100, 1))
    x[300:460] = x[299]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in projection_search.search(df, F.col("vec_id") % 5 == 0, k=7, leaf_rows=leaf).collect()]
    want = brute_neighbours(rows, lambda i: i % 5 == 0, 7)
    assert recall(got, want) >= 0.93
    hot = {q: [] for q in range(300, 460, 5)}
    for q, r, v, _ in sorted(got):
        if q in hot:
            hot[q].append(v)
    # the copies' own scores may be below those of longer vectors; among equal scores the smallest ids come first
    assert all(v == [j for j, _ in want[q]] for q, v in hot.items())


def test_neighbours_odd_rows(spark):
    expose_package(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [3.0, 3.0]), (20, [0.9, 0.1]), (40, [1.0, 2.0, 3.0]), (60, [1.0, 2.0, 3.0]), (80, [-1e-30, 1e-30]), (100, None), (9, [1e30, 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, score string, ids string")
    got = [tuple(r) for r in projection_search.search(df, F.col("vec_id") % 20 == 0, k=3).collect()]
    assert recall(got, brute_neighbours(rows, lambda i: i % 20 == 0, 3)) == 1.0
    assert projection_search.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert projection_search.search(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_chi_square():
    assert abs(projection_search.chi_square_quantile(0.95, 12) - 21.026) < 1e-3
    assert abs(projection_search.chi_square_cdf(2 * math.log(2), 2) - 0.5) < 1e-12
