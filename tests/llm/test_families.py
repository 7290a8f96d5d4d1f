"""Families of near copies cut into many blocks: the same groups as brute force, and dealt
rows in proportion to the members."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from payguard.llm import common, minhash_dedup
from payguard.session import expose_package


def brute_groups(texts, k, percent):
    sets = {i: {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if (w := t.split()) else set() for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("bucket,family", [(512, 128), (7, 5), (3, 2)])
def test_blocks_leave_no_link_out(spark, monkeypatch, bucket, family):
    """A family of copies of one template, a chain whose ends aren't linked, texts that
    share half of their words, and strangers."""
    expose_package(spark)
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", bucket)
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", family)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    template, chain, texts = [word() for _ in range(80)], [word() for _ in range(120)], []
    for i in range(40):
        texts.append([w if rng.random() > 0.01 else word() for w in template])
    for i in range(25):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(list(chain))
    half = [word() for _ in range(60)]
    for i in range(30):
        texts.append(half + [word() for _ in range(rng.choice([6, 14, 60]))])
    texts += [[word() for _ in range(50)] for _ in range(15)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=80).collect()
    assert {r["id"]: r["component_id"] for r in got} == brute_groups(rows, 3, 80)


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Tables that Spark takes for small ones (these are) are merged unless they are small by count: the estimate of
    an exploded table is too low."""
    expose_package(spark)
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "FAMILY_BLOCK", 2)
    monkeypatch.setattr(minhash_dedup, "MOST_SENT", 0, raising=False)
    plans, store = {}, common.stored

    def recorded(df, label, *more):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label, *more)
    for module in (common, minhash_dedup):
        monkeypatch.setattr(module, "stored", recorded)
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    half = [word() for _ in range(60)]
    rows = [(i, " ".join(half + [word() for _ in range(rng.choice([6, 14, 40]))])) for i in range(40)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=80).collect()
    assert {r["id"]: r["component_id"] for r in got} == brute_groups(rows, 3, 80)
    assert {"bucket-links", "buckets", "families", "sets", "family-links", "family-parts", "groups"} <= set(plans)
    joins = {label for label, each in plans.items() for p in each if "SortMergeJoin" in p}
    assert {"bucket-links", "buckets", "families", "sets", "family-links", "family-parts", "groups"} <= joins
    assert not {label for label, each in plans.items() for p in each if "Broadcast" in p}


def test_dealt_rows_follow_the_members(spark):
    rows = {}
    for n in (2_000, 32_000):
        members = spark.range(n).select("id", F.lit(1).alias("key"))
        sizes = members.groupBy("key").agg(F.count("*").alias("n"))
        deal = minhash_dedup._first_deal(members, "key", sizes, 512).groupBy("pair").agg(
            F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).collect()
        rows[n] = sum(r["n"] for r in deal)
        assert max(r["n"] for r in deal) < 1_500
    assert rows[2_000] <= 4 * 2_000 and rows[32_000] <= 4 * 32_000
    # a family that the first block unites is dealt no second time
    block = F.pmod(F.xxhash64("id"), F.lit(63)).cast("long")
    hub = members.filter(block == 0).agg(F.min("id")).first()[0]
    links = members.filter(F.col("id") != hub).select(F.col("key").cast("long").alias("g"), F.col("id").alias("a"), F.lit(hub).alias("b"), (-block).alias("pair"),
                                                      F.lit(True).alias("split"))
    assert minhash_dedup._apart_deal(members, "key", sizes, links, 512, "test").count() == 0
    some = links.filter("a % 100 <> 0")
    apart = links.filter("a % 100 = 0").count()
    assert minhash_dedup._apart_deal(members, "key", sizes, some, 512, "test").count() == apart * 63 + 32_000
