"""Each operator on small fixtures: brute force, round trips, and the defined
cases (nulls, empty and very long texts, ties, repeated rows, empty tables,
clashing columns)."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from payguard.llm import (chat_format, langid, minhash_dedup, mixing, multi_index, multiset_hash, ngram_lm, packing,
                          queries, url_filter, warc)
from payguard.llm.common import connected_components, work_folder
from payguard.session import expose_package

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
EXTRA = ("score", "id", "digest", "range", "component", "mix_tokens", "rank", "lang_pred", "kept", "n")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


@pytest.fixture(scope="module")
def docs(spark):
    expose_package(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated, tied and very long texts; null keys; columns whose names clash."""
    expose_package(spark)
    body = "one two three four five six seven eight nine ten " * 3
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, body, "en", "a", 9),
            (5, body, "en", "b", 9), (5, body, "en", "b", 9), (None, body, None, None, None), (None, None, None, None, None),
            (6, "Stra\u00dfe \u00c9t\u00e9 \u65e5\u672c\u8a9e\u2014 123", "de", "b", 5), (7, "long word " * 40_000, "en", "b", 1),
            (8, "x" * 300_000, "en", "c", 1), (9, "123 ... !!", "en", "c", 1)]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


# 1 language identification

def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        size = rng.integers(0, 120, 6)
        first = np.concatenate([[0], np.cumsum(size)])
        s = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
        path = langid.viterbi(s, first, 4.0)
        for a, b in zip(first[:-1], first[1:]):
            if a < b:
                v = s[a].astype(float)
                for t in range(a + 1, b):
                    v = np.maximum(v, v.max() - 4) + s[t]
                p = path[a:b]
                own = s[np.arange(a, b), p].sum(dtype=float) - 4 * (p[1:] != p[:-1]).sum()
                assert abs(own - v.max()) < 1e-3


def test_language_held_out_accuracy_and_spans(spark, docs):
    model = langid.learn(docs, langid.training_rows())
    out = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    held = [r for r in out if crc(r["doc_id"]) % 5 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    both = {r["lang"]: r["text"] for r in docs.filter("n_chars between 600 and 2000").select("lang", "text").collect()}
    first, second = sorted(both)[:2]
    text = both[first] + " \u2014 " + both[second]
    mixed = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert [s["lang"] for s in mixed["spans"]] == [first, second]
    at = mixed["spans"][1]["start"]
    assert abs(at - len(both[first])) < 40 and 0.3 < mixed["score"] < 0.9


def test_language_odd_rows(odd, none, docs):
    model = langid.learn(docs, langid.training_rows())
    out = langid.identify(odd, model, odd.columns).collect()
    assert len(out) == odd.count()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1 and (letters or (r["score"] == 0 and r["spans"] == []))
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    empty = langid.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, empty, ["doc_id"]).collect()} == {"und"}


# 2 language-model scoring

def brute_lm(rows):
    tokens = [(i, words(t) + ["\0"], crc(i) % 5 == 1) for i, t in rows]
    c = collections.Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i is not None, i, held, len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws, held in tokens)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_lm_counts_and_base_score(which, request):
    df = request.getfixturevalue(which)
    out = ngram_lm.by_folds(df).collect()
    got = sorted((r["id"] is not None, r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                 for r in out)
    want = brute_lm([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert repr(got) == repr(want)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in out)


def test_lm_weights_and_probabilities(docs):
    """EM equals a direct maximisation's order; the model beats the base on held-out texts."""
    cells = [{"b": 3, "r2": 20, "r1": 4, "n": 90}, {"b": 3, "r2": -1, "r1": 4, "n": 10}]
    w = ngram_lm.learn_weights([type("R", (), {"asDict": lambda self, x=x: x})() for x in cells])
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.7 and w[0, 0] == 0
    out = [r for r in ngram_lm.by_folds(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_learns_from_estimates_below_the_uniform_one():
    """EM on the classes equals EM on the estimates, where half of the unigrams lie far below the uniform one."""
    ratio = np.array([0.0, 1 / 64, 1 / 8, 0.5, 1.0, 8.0, 2.0 ** 20])
    assert np.allclose(ngram_lm._ratio(ngram_lm._class(ratio)), ratio)
    n = np.array([5.0, 60, 40, 20, 5, 70, 0])
    cells = [{"b": 3, "r2": -1, "r1": int(c), "n": int(k)} for c, k in zip(ngram_lm._class(ratio), n)]
    w = ngram_lm.learn_weights([type("R", (), {"asDict": lambda self, x=x: x})() for x in cells])[3]
    best = max(np.linspace(0.001, 0.999, 999), key=lambda a: (n * np.log(a * ratio + 1 - a)).sum())
    assert abs(w[1] - best) < 0.01


def test_lm_model_sums_to_one():
    """Over all continuations of a context, with the unknown token."""
    h, w = np.full(3, 10), np.array([5, 3, 0])
    f2, f1, f0 = ngram_lm._estimates(h, w, np.array([6, 4, 0]), 8, 2)
    mix = np.array([0.5, 0.3, 0.2])
    assert abs((mix[0] * f2 + mix[1] * f1 + mix[2] * f0).sum() - 1) < 1e-12


def test_lm_trigrams_by_batches_equal_brute_force(spark, monkeypatch):
    """Counts of contexts and trigrams over all batches; documents without a token and repeated starts among them."""
    expose_package(spark)
    rng = np.random.default_rng(8)
    texts = ["", "a", "a", *[" ".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(40)]]
    held = [i % 4 == 0 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held, [False] * len(texts))), "id long, text string, held_out boolean, deleted boolean")
    tokens = ngram_lm.tokenised(df.repartition(3))
    replies = ngram_lm.answers(ngram_lm.requests(tokens, 5, (1, 2)), (1, 2)).unionByName(ngram_lm.answers(ngram_lm.requests(tokens, 4, (3,)), (3,)))
    chains = [["\0", "\0", *words(t), "\0"] for t in texts]
    three = collections.Counter(tuple(c[i - 2:i + 1]) for c, out in zip(chains, held) if not out for i in range(2, len(c)))
    two = collections.Counter()
    for k, n in three.items():
        two[k[:2]] += n
    rows = ngram_lm._with_answers(tokens, replies, "c").collect()
    assert len(rows) > 1
    for row in rows:
        *_, gh, ghw = ngram_lm._counts(ngram_lm.Batch(row.asDict(recursive=True)), row.asDict(recursive=True))
        keys = [tuple(chains[d][i - 2:i + 1]) for d in row["ids"] for i in range(2, len(chains[d]))]
        assert gh.tolist() == [two[k[:2]] for k in keys] and ghw.tolist() == [three[k] for k in keys]


def plain_lm_scores(rows):
    """The whole model in plain Python: counts, weights by EM on the deleted tenth, and each text's score."""
    texts = [(i, ["\0", "\0", *words(t), "\0"], crc(i) % 5 == 1, crc(i) % 10 == 0) for i, t in rows]

    def counts(pick):
        c = [collections.Counter() for _ in range(3)]
        for _, ws, held, gone in texts:
            if pick(held, gone):
                for k in range(2, len(ws)):
                    for n in range(3):
                        c[n][tuple(ws[k - n:k + 1])] += 1
        one = collections.Counter({k[0]: v for k, v in c[0].items()})
        two = collections.Counter()
        for k, v in c[2].items():
            two[k[:2]] += v
        return one, c[1], c[2], two, sum(one.values()), len(one)

    def parts(model, g, h, w):
        one, pair, three, two, n, v = model
        gh, ch = two[(g, h)], one[h]
        b = 48 + int(math.log2(gh)) + 1 if gh else (int(math.log2(ch)) + 1 if ch else 0)
        return b, three[(g, h, w)] / max(gh, 1), pair[(h, w)] / max(ch, 1), one[w] / max(n, 1), 1 / (v + 1)

    kept, full = counts(lambda held, gone: not held and not gone), counts(lambda held, gone: not held)
    cells = collections.Counter()
    for _, ws, held, gone in texts:
        if gone and not held:
            for k in range(2, len(ws)):
                b, f3, f2, f1, f0 = parts(kept, *ws[k - 2:k + 1])
                cells[(b, *(int(ngram_lm._class(np.array([f / f0]))[0]) for f in (f3, f2, f1)))] += 1
    weights = ngram_lm.learn_weights(np.array([[*k, n] for k, n in cells.items()]))
    out = {}
    for i, ws, _, _ in texts:
        total = 0.0
        for k in range(2, len(ws)):
            b, f3, f2, f1, f0 = parts(full, *ws[k - 2:k + 1])
            m = weights[b]
            total += math.log10(m[0] * f2 + m[1] * f1 + m[2] * f0 + m[3] * f3)
        out[i] = total
    return out


def test_query_of_lm_equals_a_plain_model(spark):
    out = queries.op2_deleted_interpolation(spark, SF)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_lm_scores(rows)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) <= 1e-6 * max(1, abs(want[i])) for i in want)


def test_lm_asks_only_ranges_that_hold_its_ngrams(spark):
    """However many ranges there are, a batch's rows are no more than its distinct n-grams."""
    df = spark.createDataFrame([(i, f"a{i} b c", False, False) for i in range(5)] + [(9, None, True, False)],
                               "id long, text string, held_out boolean, deleted boolean")
    tokens = ngram_lm.tokenised(df.coalesce(1))
    # words: a0-a4, b, c, end; bigrams: end a, a b of each, b c, c end, end end; trigrams: three of each, b c end, one of the empty text
    for orders, most in (((1, 2), (8, 13)), ((3,), (17,))):
        asked = ngram_lm.requests(tokens, 100_000, orders).toPandas()
        assert len(asked) <= sum(most) and len(asked) == len(set(asked["part"]))
        for k, n in zip(orders, most):
            assert sum(len(ngram_lm._unpack(x, np.uint64)) for x in asked[f"key{k}"]) == n


def test_lm_learns_from_the_second_last_word(spark):
    """After 'l x' comes 'a', after 'r x' comes 'b': no bigram tells them apart."""
    expose_package(spark)
    rows = [(i, " ".join(["l x a", "r x b"][(i * 7 + k * k) % 3 == 0] for k in range(12)), i >= 180, i % 9 == 0) for i in range(200)]
    rows += [(900, "l x a", True, False), (901, "l x b", True, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean, gone boolean")
    got = {r["id"]: r["score"] for r in ngram_lm.score_texts(df, F.col("held"), F.col("gone")).collect()}
    assert got[900] > got[901] + 1


# 3 embeddings

def test_multi_index_equals_brute_force(spark):
    expose_package(spark)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.15
    x = np.concatenate([base, near, base[:5], np.repeat(base[:1], 300, 0), base[7:8] + rng.normal(size=(300, 16)) * 0.05]).astype(np.float32)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    rows += [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [1.0, None] * 8, 0), (None, rows[0][1], 0),
             (9005, [float("inf")] + [1.0] * 15, 0), (9006, [1.0, 2.0], 0), (9007, [1.0, 2.0], 0), (9008, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("n", F.lit(1))
    out = {r["id"]: r for r in multi_index.near_duplicates(df).collect() if r["id"] is not None}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    links, found = s.sum(1), np.array([out[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(s, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    assert np.mean([out[i]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    far = spark.createDataFrame([(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2.0, -1.0])], "vec_id long, embedding array<double>")
    assert {r["id"]: r["n_links"] for r in multi_index.near_duplicates(far).collect()} == {1: 1, 2: 1, 3: 0}
    for i in (9001, 9002, 9003, 9004, 9005, 9008):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert (out[9006]["n_links"], out[9007]["component_id"], out[9007]["kept"]) == (1, 9006, False)
    assert multi_index.near_duplicates(df.filter("false")).count() == 0


# 4 packing

def test_encoder_equals_the_tokenizer():
    path = tokenizer_path("byte_bpe_50k.json")
    encode, whole = packing.encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(0)
    texts = ["", "  ", "a  b\n\n c", "it's <|endoftext|> ok", "\u00e9\u00e8 \u65e5\u672c\xa0x", "y" * 50_000]
    texts += ["".join(rng.choice(list(" \n\tab.'s1\u00e9\u3000"), 25)) for _ in range(300)]
    for t in texts:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    copies = collections.Counter(i for i, _ in texts)
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i])
        if i is not None:
            cuts = [(a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
            assert own == collections.Counter({c: copies[i] for c in cuts})
    return by_seq


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    packed = packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), keep_ids=True)
    rows = packed.collect()
    seqs = check_packing(rows, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], packing.CAPACITY)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert set(ids) == set(seqs) and all(len(x) == packing.CAPACITY for x in ids.values())
    for r in rows:
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_shortest_pack_first_fills():
    rng = np.random.default_rng(1)
    hist = {n: int(k) for n, k in zip(range(1, 2049), rng.integers(0, 60, 2048))} | {1: 50_000, 3: 4_000}
    used = collections.Counter()
    ranks = collections.defaultdict(list)
    for length, rank, copies, packs, first, offset in packing.shortest_pack_first(hist):
        ranks[length].append((rank, copies * packs))
        for s in range(first, first + packs):
            assert used[s] == offset
            used[s] += copies * length
    for length, n in hist.items():
        at = 0
        for rank, k in sorted(ranks[length]):
            assert rank == at
            at += k
        assert at == n
    assert max(used.values()) <= 2048 and sum(used.values()) / len(used) / 2048 > 0.98


# 5 near-duplicate texts

def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_minhash_equals_brute_force(spark, docs):
    """With planted copies at 0 to 30 edited words of a hundred, and a chain of copies."""
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    base = [f"word{i}" for i in rng.integers(0, 10**6, 400)]
    for i in range(700):
        copy = list(base)
        for j in rng.choice(400, int(rng.integers(0, 30)), replace=False):
            copy[j] = f"new{rng.integers(10**6)}"
        rows.append((100_000 + i, " ".join(copy)))
    rows.append((200_000, " ".join(base).upper().replace(" ", "\n\t ")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 4, 80)
    got = {r["id"]: r for r in minhash_dedup.near_duplicates(df, shingle=4, percent=80).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_minhash_odd_rows(odd, none):
    out = collections.defaultdict(list)
    for r in minhash_dedup.near_duplicates(odd, shingle=4).collect():
        out[r["id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert out[1] == [(0, 1, True)] and out[2] == [(0, 2, True)] and out[3] == [(0, 3, True)]
    assert out[4] == [(10, 4, True)] and out[5] == [(10, 4, False)] * 2 and out[8] == [(1, 8, True)]
    assert sorted(out[None], key=str) == [(0, None, True), (10, 4, False)]
    assert minhash_dedup.near_duplicates(none).count() == 0
    left = minhash_dedup.drop_near_duplicates(odd, shingle=4)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.95):
        n = 2_000
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2).astype(np.uint64)])) for _ in range(2))
        z = sum(bin(x ^ y).count("1") for x, y in zip(*(minhash_dedup.odd_sketch(minhash_dedup.min_samples(s)) for s in (a, b))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        m = minhash_dedup.SKETCH_BITS
        est = 1 - math.log(1 - 2 * z / m) / (2 * minhash_dedup.SAMPLES * math.log(1 - 2 / m))
        assert abs(est - true) < 0.13
        assert z <= minhash_dedup.max_differing_bits(0.8)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(1_000, 1_400, (250, 2))] + [(5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}


# 6 fingerprints

def test_fingerprint_algebra():
    of = multiset_hash.Fingerprints.of
    a, b, c = "first line here now", "second line, another one", "third"
    x, y = of([f"{a}\n{b}\n{c}", f"{a}\n{b}"]), of([f"{c}\n{a}\n\n{b}", c])
    assert x.text()[0] == y.text()[0]
    assert of([f"{a}\n{b}"]).plus(of([c])).text() == [x.text()[0]]
    assert x.take(np.array([0])).minus(of([c])).text() == [x.text()[1]]
    assert of([f"{a}\n{a}"]).text() != of([a]).text() and set(of([""]).text()) == set(of(["\n"]).text())
    assert x.likeness(x).tolist() == [1, 1] and of([""]).likeness(of([""])).tolist() == [1]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_edited_neighbours(which, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = collections.defaultdict(list)
    for r in multiset_hash.edited_neighbours(df).collect():
        got[r["id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    want = collections.defaultdict(list)
    for i, (k, s) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(s) // 3
        e = s[:len(s) - cut] + after[:cut]
        prints = multiset_hash.Fingerprints.of([s, e])
        want[k].append((len(s), hashlib.sha256(e.encode()).hexdigest(), *prints.text()))
    for k, v in want.items():
        assert sorted(v) == sorted((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got[k])
    if which == "docs":
        far = [r for v in got.values() for r in v if r["n_chars"] > 200]
        assert np.mean([r["near_edited"] > r["near_next"] for r in far]) > 0.97


# 7 WARC

def test_warc_round_trip(spark):
    expose_package(spark)
    big, other = "payload \u00e9 " * 400, "other " * 400
    rows = [(i, f"http://h.example/{i}?a b\r\nX: y", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 2}") for i in range(60)]
    rows += [(60, None, None), (None, "u", big), (57, rows[57][1], big), (61, "http://x/", ""), (62, "http://x/", "z" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("digest", F.lit(2))
    one, two = work_folder(spark, "w"), work_folder(spark, "w")
    manifest = warc.write(df, one, roll_bytes=2_000).collect()
    again = warc.write(df.repartition(7), two, roll_bytes=2_000).collect()
    assert {(r["name"], r["crc32"], r["bytes"]) for r in manifest} == {(r["name"], r["crc32"], r["bytes"]) for r in again}
    got = warc.read(spark, one, payload=True).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest) and len(manifest) > 8
    top = {big: 57, other: 58, "z" * 400_000: 62}
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        t = top.get(h)
        refers = t if t is not None and i != t else None
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else raw)] += 1
    assert want == collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                                        None if r["payload"] is None else bytes(r["payload"])) for r in got)
    assert all("\n" not in (r["url"] or "") for r in got)
    folder = one.removeprefix("file:")
    with gzip.open(f"{folder}/{min(r['name'] for r in manifest)}") as f:
        assert f.read(8) == b"WARC/1.1"
    empty = work_folder(spark, "w")
    assert warc.write(df.filter("false"), empty).count() == 0 and warc.read(spark, empty).count() == 0


# 8 chat

def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 1, "delta", 0, "user", "Hel"), (1, 2, "delta", 0, None, "lo"), (1, 3, "delta", 1, "assistant", "bad"),
           (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, "assistant", "go"), (1, 6, "delta", 1, "assistant", "od"),
           (1, 7, "edit", 0, "user", "Hi </turn>\n\\l"), (1, 8, "delta", 0, None, "!"), (1, 9, "delta", 2, "user", "later"),
           (1, 10, "regenerate", 2, None, None), (1, 11, "note", 1, None, "x"), (2, 1, "delta", 0, "u", "gone"), (2, 2, "regenerate", 0, None, None),
           (None, 1, "delta", None, None, None), (3, 1, "edit", 0, "a>b<c\\", "")]
    events = spark.createDataFrame(log, "conv_id long, seq long, type string, turn long, role string, text string").withColumn("head", F.lit(1))
    out = chat_format.render(chat_format.fold_events(events)).withColumn("turns", chat_format.parse("formatted")).withColumn("lost", chat_format.loss_text())
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["lost"]) for r in out.collect()}
    assert got == {1: ([("user", "Hi </turn>\n\\l!"), ("assistant", "good")], "good"), None: ([("", "")], ""), 3: ([("a>b<c\\", "")], "")}


def test_chat_round_trip(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("\\<>lbg/turn\n\u00e9 "), 30)) for _ in range(60)]
    rows = [(i % 7, i // 7, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)] + [(1, 1, "user", "tie"), (1, 1, "user", "tie"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(0))
    out = chat_format.render(chat_format.fold_events(chat_format.events_of_turns(df))).withColumn(
        "turns", chat_format.parse("formatted")).withColumn("lost", chat_format.loss_text())
    for r in out.collect():
        mine = sorted(((t is not None, t, o or "", x or "") for c, t, o, x in rows if c == r["conv_id"]))
        assert [tuple(t) for t in r["turns"]] == [m[2:] for m in mine]
        assert r["lost"] == "".join(m[3] for m in mine if m[2] == "assistant")


# 9 url filters

RULES = list(queries.URL_RULES)


def test_url_rules(spark):
    urls = {1: ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
            2: ("https://a.example.net/fr/", "a.example.net", "/fr/", "net/", "block"),
            3: ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
            4: ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
            5: ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), 6: ("http://net", "net", "", None, None),
            7: (None, "", "", None, None), 8: ("no scheme/net/", "", "", None, None),
            9: ("a\n://\u00c9Z.NET/a://b", "\u00c9z.net", "/a://b", "net/", "block"), 10: ("http://x.net?y/", "x.net", "", None, None)}
    df = spark.createDataFrame([(i, u[0], None, "x") for i, u in urls.items()], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for r in url_filter.judge(df, rules).collect():
        _, host, path, rule, verdict = urls[r["id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
        assert r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.filter("false"), rules).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = np.random.default_rng(4)
    n = 30
    a = (rng.random((n, n)) < 0.08) * rng.integers(1, 5, (n, n))
    np.fill_diagonal(a, 0)
    a[3] = 0
    seeds = rng.integers(0, 4, (n, 3))
    hosts = spark.createDataFrame([(f"h{i}", *map(int, seeds[i])) for i in range(n)], "host string, pages long, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "src string, dst string, n long")
    got = {r["host"]: r for r in url_filter.propagate(hosts, edges, rounds=6, tolerance=0).collect()}

    def power(m, s):
        p = s / s.sum()
        out, x = m.sum(1), p
        for _ in range(6):
            flow = (x / np.maximum(out, 1)) @ m * 0.85
            x = flow + (1 - flow.sum()) * p
        return x
    for name, m, s in (("trust", a, seeds[:, 1]), ("distrust", a.T, seeds[:, 2]), ("importance", a, seeds[:, 0])):
        assert np.allclose([got[f"h{i}"][name] for i in range(n)], power(m.astype(float), s.astype(float)))


def test_distrust_goes_beyond_thirty_links(spark):
    """A chain of hosts that ends in a blocked one: distrust falls by the damping with each link."""
    n = 35
    hosts = spark.createDataFrame([(f"h{i}", 1, 0, int(i == n - 1)) for i in range(n)], "host string, pages long, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)], "src string, dst string, n long")
    got = {r["host"]: r["distrust"] for r in url_filter.propagate(hosts.coalesce(1), edges.coalesce(1), tolerance=1e-3).collect()}
    assert abs(got["h0"] / (got[f"h{n - 1}"] * 0.85 ** (n - 1)) - 1) < 0.1


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    page = '<a href="https://{}/x">y</a>'
    rows = [(1, "http://bad.net/a", None), *[(10 + i, "http://farm.com/x", page.format("bad.net")) for i in range(3)],
            *[(30 + i, f"http://ok{i}.com/x", page.format("good.org")) for i in range(20)], (60, "http://good.org/fr/a", None)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got["farm.com"] == "block" and got["ok3.com"] == "allow"


# 10 mixing

def brute_mix(rows, budget="total", entropy=mixing.ENTROPY, limit=mixing.MAX_EPOCHS):
    place = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    total = collections.Counter()
    for _, s, t in rows:
        total[s] += len(words(t))
    p = sorted(v / sum(total.values()) for v in total.values() if v)

    def spread(e):
        z = sum(x ** e for x in p)
        return math.log(z) - e * sum(x ** e * math.log(x) for x in p) / z

    def epochs(e):
        return p[0] ** (e - 1) / (p[-1] ** (e - 1) if budget == "cover" else sum(x ** e for x in p))

    def border(f):
        lo, hi = 0.0, 1.0
        for _ in range(mixing.STEPS):
            lo, hi = ((lo + hi) / 2, hi) if f((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return 1.0 if f(1.0) else lo
    e = max(border(lambda x: spread(x) >= entropy * math.log(len(p))), border(lambda x: epochs(x) > limit))
    n = sum(total.values())
    z = sum((v / n) ** e for v in total.values() if v)
    tokens = max(total.values()) / ((max(total.values()) / n) ** e / z) if budget == "cover" else n
    out = collections.Counter()
    for s, v in total.items():
        quota = math.floor(round((v / n) ** e / z * tokens, 3)) if v else 0
        passes, rest = divmod(quota, v) if v else (0, 0)
        own = [(place(i), i, len(words(t))) for i, x, t in rows if x == s]
        for at, i, k in own:
            upto = sum(m for b, _, m in own if b <= at)
            out[(i, s, k, passes + (1 if v and upto <= rest else 0))] += 1
    return out


@pytest.mark.parametrize("blocks", [(256, 4_096, 8 << 20), (8, 3, 0)], ids=["one group", "many groups, nothing copied"])
@pytest.mark.parametrize("budget", ["total", "cover"])
def test_mixing_equals_brute_force(spark, monkeypatch, budget, blocks):
    """The second form cuts sources into groups of few blocks and joins their facts with salt."""
    for name, value in zip(("BLOCK_ROWS", "GROUP_BLOCKS", "BROADCAST_BYTES"), blocks):
        monkeypatch.setattr(mixing, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, ["big", "big", "big", "big", "mid", None, "small"][int(rng.integers(7))] if i % 40 else "tiny", "w " * int(rng.integers(0, 30))) for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, mixing.word_count("text"), budget=budget).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["mix_tokens"], r["mix_copies"]) for r in got) == brute_mix(rows, budget)
    if budget == "cover":
        assert min(r["mix_copies"] for r in got) >= 1


def test_mixing_of_many_sources_of_one_size(spark):
    """Sources of equal size are one entry of the bisected sums; those without tokens are none."""
    rows = [(10 * i + j, f"host-{i}", "w " * (1 + i % 3)) for i in range(300) for j in range(2)] + [(-1, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, mixing.word_count("text")).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["mix_tokens"], r["mix_copies"]) for r in got) == brute_mix(rows)


def test_mixing_odd_rows(odd, none):
    out = mixing.mix(odd, mixing.word_count("text"))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    assert collections.Counter((r["doc_id"], r["source"], r["mix_tokens"], r["mix_copies"]) for r in out.collect()) == brute_mix(rows)
    assert mixing.mix(none, mixing.word_count("text")).count() == 0
    again = mixing.realise(out, odd.columns[:5])
    assert again.count() == sum(r["mix_copies"] for r in out.collect())
