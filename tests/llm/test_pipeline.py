"""The corpus pipeline: each stage and the whole on small fixtures, odd rows, and planted
documents that must stay or go."""

from __future__ import annotations

import collections
import random

import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from payguard.llm import langid, queries
from payguard.llm.common import fold
from payguard.session import expose_package

DOC = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = {"aa": "ba be bi bo bu da de di do du", "bb": "kra krel krin kron krum stra strel strin stron", "cc": "ouille eau oin aille eul ain oux euse"}


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean documents of three languages, one of them mostly one repeated text, exact and near copies, texts in no known script."""
    expose_package(spark)
    rng = random.Random(12)
    rows, i = [], 0

    def text(lang, n):
        syllables = VOCABULARY[lang].split()
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    for lang in VOCABULARY:
        for _ in range(40):
            rows.append((i, text(lang, rng.randint(30, 90)), lang if i % 5 else None, f"s{i % 3}", 1))
            i += 1
    repeated = text("bb", 60)
    rows += [(i + k, repeated, "bb", "s0", 1) for k in range(200)]
    i += 200
    words = text("aa", 80).split()
    for k in range(6):
        copy = list(words)
        copy[10 * k] = "changed"
        rows.append((i + k, " ".join(copy), "aa", "s1", 1))
    i += 6
    rows += [(i, "это русский текст без метки " * 4, None, "s2", 1), (i + 1, "12 34 !!", None, "s2", 1), (i + 2, None, None, "s2", 0)]
    return spark.createDataFrame(rows, DOC)


def test_language_learns_every_label_and_rejects_unknown_scripts(spark, corpus):
    model = langid.learn(corpus, F.lit(True))
    assert list(model.langs) == ["aa", "bb", "cc"]
    out = P.language(spark, corpus, None)
    assert out.columns == NAMES
    got = {r["doc_id"]: r for r in out.collect()}
    given = corpus.collect()
    clean = [r for r in given if r["doc_id"] < 326]
    assert all(r["doc_id"] in got and got[r["doc_id"]]["text"] == r["text"] for r in clean)
    want = {r["doc_id"]: list(VOCABULARY)[r["doc_id"] // 40] for r in clean if r["doc_id"] < 120}
    assert all(got[i]["lang"] == lang for i, lang in want.items())
    assert set(got) == {r["doc_id"] for r in clean}


def test_a_language_of_one_repeated_text_is_learned(spark):
    """Four labels of many rows each, three of them one text: a sample of rows by text would lose them."""
    expose_package(spark)
    rows = [("aa", f"ba be bi {i} bo du{i}") for i in range(300)] + [(x, t) for x, t in (("bb", "kra krel"), ("cc", "ouille eau"), ("dd", "zzz zyz")) for _ in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string"), F.lit(True), sample_rows=5)
    assert list(model.langs) == ["aa", "bb", "cc", "dd"]


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_keep_one_of_each_group(spark, corpus):
    out = P.near_duplicates(spark, corpus, None)
    assert out.columns == NAMES
    got = {r["doc_id"] for r in out.collect()}
    rows = sorted((r["doc_id"], shingles(r["text"])) for r in corpus.collect())
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (i, a) in enumerate(rows):
        for j, b in rows[n + 1:]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i for i in root if top(i) == i}


def test_mixture_keeps_every_document(spark, corpus):
    out = P.mixture(spark, corpus, None)
    assert out.columns == NAMES
    copies = collections.Counter(r["doc_id"] for r in out.collect())
    assert set(copies) == {r["doc_id"] for r in corpus.collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in corpus.collect()}
    source = {r["doc_id"]: r["source"] for r in corpus.collect()}
    given, mixed = collections.Counter(), collections.Counter()
    for i, n in words.items():
        given[source[i]] += n
        mixed[source[i]] += n * copies[i]
    share = [mixed[s] / sum(mixed.values()) for s in sorted(given, key=given.get)]
    assert share == sorted(share) and share[0] > given.most_common()[-1][1] / sum(given.values())


def test_run_packs_what_the_stages_leave(spark, corpus, tmp_path):
    corpus.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    tokens = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    out = P.run(spark, str(tmp_path))
    got, at = collections.Counter(), collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]] += r["length"]
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    assert all(sum(n for _, n in pieces) <= 2048 and sorted(pieces)[0][0] == 0 for pieces in at.values())


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_rows(spark, k):
    expose_package(spark)
    body = "ba be bi bo bu da de di do du " * 4
    rows = [(1, None, "aa", "a", 0), (2, "", "aa", None, 0), (3, " \n ", None, "a", 4), (4, body, "aa", "a", 9), (5, body, "aa", "b", 9), (5, body, "aa", "b", 9),
            (None, body, None, None, None), (None, None, None, None, None), (7, "long word " * 30_000, "aa", "b", 1), (8, "x" * 200_000, "aa", "c", 1)]
    extra = ("score", "id", "component", "mix_tokens", "rank", "lang_pred", "kept", "n")
    docs = spark.createDataFrame(rows, DOC).select("*", *[F.lit("extra").alias(c) for c in extra])
    name, stage = P.STAGES[k]
    out = stage(spark, docs, None)
    rows = out.collect()
    assert rows and (name == "pack" or (out.columns == docs.columns and all(r["score"] == "extra" for r in rows)))
    if name == "near_duplicates":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 4, 7, 8] and sum(r["doc_id"] is None for r in rows) == 2
    none = docs.filter("false")
    assert stage(spark, none, None).count() == 0


def test_query_of_language(spark):
    """Held-out flags, labels and accuracy of the registered query."""
    out = queries.op1_script_viterbi(spark, "/root/testdata/sf0.01")
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = out.join(docs.select("doc_id", "text", "lang", (fold("doc_id") == 0).alias("h")), "doc_id").collect()
    assert len(j) == docs.count() and all(r["held_out"] == r["h"] and 0 <= r["score"] <= 1 for r in j)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in j)
    held = [r for r in j if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 50


def test_drafted_log_folds_to_the_same_turns(spark):
    from payguard.llm import chat_format

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    plain = chat_format.events_of_turns(turns)
    log = chat_format.drafted(plain)
    kinds = {r["type"]: r["count"] for r in log.groupBy("type").count().collect()}
    assert kinds["edit"] > 50 and kinds["regenerate"] > 20 and kinds["delta"] > plain.count()
    same = [sorted((tuple(r) for r in chat_format.fold_events(x).collect()), key=repr) for x in (plain, log)]
    assert same[0] == same[1]
