"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all
sources alike) and 1 (as they are) and normalised. The exponent is bisected: the
largest at which the weights' entropy reaches the target, but no smaller than
the one at which a source would be repeated more often than the limit.

The weights are realised as block permutations of each source: documents
are permuted by a keyed hash, in blocks of the hash range. A source's budget is so
many whole passes plus the head of the permutation that still fits; where
that head ends follows from the token sums of groups of blocks, then of the blocks of one
group, then from the order within one block, so no source, however large, is sorted in one task, and texts don't
move: every row compares its hash with its source's end.

Defined cases: a null source is a source of its own; documents without tokens go with their place
in the permutation; a source without tokens has weight 0 and its documents one
copy a pass of none (copies 0) unless nothing has tokens; rows with equal ids share a place; an empty
table gives no rows. All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payguard.llm.common import salted_join, stored

ENTROPY, MAX_EPOCHS, STEPS, BLOCK_ROWS, GROUP_BLOCKS = 0.9, 4.0, 50, 256, 4_096
_HASH_BITS = 60
BROADCAST_BYTES = 8 << 20  # facts of sources that may be copied to every executor
_FACT_BYTES = 64  # of a source's row beside its name


def _few(facts: DataFrame, name: str) -> bool:
    """May the facts of all sources be copied to every executor? By their bytes, names included."""
    size = F.sum(F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + _FACT_BYTES)
    return (facts.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def _of_source(rows: DataFrame, facts: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Rows with their source's facts (``of``, ...): copied to the rows if they are
    few (by their bytes), else by a salted join; a hot source is split either way."""
    if few:
        return rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("of")), how)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    named = F.coalesce(F.concat(F.lit("="), F.col("of").cast("string")), F.lit("null"))
    return salted_join(rows.withColumn("_of", key), facts.withColumn("_of", named), "_of", "place", how).drop("_of")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(key: Column, seed: str) -> Column:
    """Place in the permutation: the first 60 bits of md5(seed:key)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def exponent(sources: DataFrame, entropy: float, max_epochs: float, budget: str) -> float:
    """Bisect the exponent over sources (tokens). Sums run over the distinct numbers of tokens, smallest
    first, each with how many sources have it: T tokens have at most sqrt(2 T) of them, however many sources there are."""
    sizes = sources.filter("tokens > 0").groupBy(F.col("tokens").cast("double").alias("t")).agg(F.count("*").cast("double").alias("n"))
    shares = sizes.agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("s"), F.sum("n").alias("many"))
    shares = shares.select("s", "many", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["t"] * x["n"]).alias("all"))
    shares = shares.select("many", F.transform("s", lambda x: x["t"] / F.col("all")).alias("p"), F.transform("s", lambda x: x["n"]).alias("n"))
    shares = shares.select("many", "p", F.arrays_zip("p", "n").alias("s"))

    def total(f) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, x: a + x["n"] * f(x["p"]))

    def spread(e: Column) -> Column:
        z = total(lambda x: F.pow(x, e))
        return F.log(z) - e * total(lambda x: F.pow(x, e) * F.log(x)) / z

    def epochs(e: Column) -> Column:
        """Of the smallest source, which is repeated most."""
        least = F.pow(F.element_at("p", 1), e - 1)
        if budget == "cover":  # the largest source once
            return least / F.pow(F.element_at("p", -1), e - 1)
        return least / total(lambda x: F.pow(x, e))

    def bisect(up) -> Column:
        """The border in [0, 1] below which ``up`` holds."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            holds = up(mid)
            return F.struct(F.when(holds, mid).otherwise(s["lo"]).alias("lo"), F.when(holds, s["hi"]).otherwise(mid).alias("hi"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
        return F.when(up(F.lit(1.0)), F.lit(1.0)).otherwise(end["lo"])

    by_entropy = bisect(lambda e: spread(e) >= entropy * F.log("many"))
    by_epochs = bisect(lambda e: epochs(e) > max_epochs)
    found = shares.select(F.when(F.size("p") > 0, F.greatest(by_entropy, by_epochs)).otherwise(F.lit(1.0)).alias("e")).first()
    return float(found["e"])


def _crossing(sums: DataFrame, part: str) -> DataFrame:
    """of, the first part of each source at which its running sum of tokens, from ``start`` on,
    passes ``rest``, and the sum before that part. Sources that never pass it have no row."""
    upto = F.col("start") + F.sum("tokens").over(Window.partitionBy("source").orderBy(part))
    first = F.min_by(F.struct(part, (F.col("upto") - F.col("tokens")).alias("before")), part)
    return (sums.withColumn("upto", upto).filter("upto > rest").groupBy("source").agg(first.alias("c"))
            .select(F.col("source").alias("of"), F.col(f"c.{part}").alias(f"at_{part}"), F.col("c.before").alias("before")))


def plan(documents: DataFrame, source_col: str, entropy: float, max_epochs: float, budget: str, seed: str) -> DataFrame:
    """source, weight, passes, ends (place at which the last, partial pass
    ends; -1: it is empty). ``documents`` has id, source, tokens, place."""
    d = stored(documents.select(F.col(source_col).alias("source"), "tokens", "place"), "mix")
    sources = d.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    sources = stored(sources, "mix-sources")
    e = exponent(sources, entropy, max_epochs, budget)
    every = sources.filter("tokens > 0")
    size = every.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    if size["all"] is None:
        return sources.select("source", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(-1).cast("long").alias("ends"))
    share = F.col("tokens").cast("double") / F.lit(float(size["all"]))
    power = F.when(F.col("tokens") > 0, F.pow(share, F.lit(e))).otherwise(F.lit(0.0))
    z = every.agg(F.sum(power).alias("z")).first()["z"]
    if budget == "cover":
        tokens = float(size["most"]) / ((float(size["most"]) / float(size["all"])) ** e / z)
    else:
        tokens = float(size["all"])
    quota = F.floor(F.round(power / F.lit(z) * F.lit(tokens), 3)).cast("long")
    if budget == "cover":  # whatever the rounding: no document is left out
        quota = F.greatest(quota, F.col("tokens"))
    s = sources.select("source", "tokens", "n", (power / F.lit(z)).alias("weight"), quota.alias("quota"))
    s = s.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(0)))
    s = s.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    # blocks of the hash range, about BLOCK_ROWS documents each
    s = stored(s.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)), "mix-plan")
    few = _few(s, "source")
    b = _of_source(d, s.select(F.col("source").alias("of"), "rest", "blocks"), few).select(
        "source", "tokens", "place", "rest", F.floor(F.col("place") / F.lit(2.0 ** _HASH_BITS) * F.col("blocks")).alias("block"))
    group = F.floor(F.col("block") / GROUP_BLOCKS).alias("group")
    sums = stored(b.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("group", group), "mix-blocks")
    wide = sums.groupBy("source", "group", "rest").agg(F.sum("tokens").alias("tokens")).withColumn("start", F.lit(0))
    inner = _of_source(sums.withColumn("place", F.col("block")), _crossing(wide, "group"), few).filter("group = at_group")
    cut = _crossing(inner.withColumn("start", F.col("before")).drop("of", "before"), "block")
    # within the block where the budget ends: the last place whose rows all fit
    mine = _of_source(b, cut, few).filter("block = at_block")
    at_place = mine.groupBy("source", "rest", "before", "place").agg(F.sum("tokens").alias("tokens"))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    inside = at_place.withColumn("run", run).filter("run <= rest").groupBy("source").agg(F.max("place").alias("last"))
    first = mine.groupBy("source").agg(F.min("place").alias("from"))
    ends = first.join(inside.withColumnRenamed("source", "is"), F.col("source").eqNullSafe(F.col("is")), "left").select(
        F.col("source").alias("es"), F.coalesce(F.col("last"), F.col("from") - 1).alias("ends"))
    return s.join(ends, F.col("source").eqNullSafe(F.col("es")), "left").select(
        "source", "weight", F.col("passes").cast("long").alias("passes"), F.coalesce("ends", F.lit(-1)).alias("ends"))


def mix(documents: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", entropy: float = ENTROPY,
        max_epochs: float = MAX_EPOCHS, budget: str = "total", seed: str = "mix") -> DataFrame:
    """All rows with mix_tokens and mix_copies (times the row is in the mixture).
    ``entropy``: of the weights, as a part of the most possible. ``budget``: ``total`` (as many
    tokens as there are) or ``cover`` (the largest source once, so every document at
    least once). Weights are met to within a document of each source. Columns of the
    two names give way."""
    d = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(documents.columns)], tokens.alias("tokens"),
                         place(F.col(id_col), seed).alias("place"), F.col(source_col).alias("source"))
    p = plan(d.select("source", "tokens", "place"), "source", entropy, max_epochs, budget, seed)
    p = stored(p.select(F.col("source").alias("of"), "passes", "ends"), "mix-ends")
    joined = _of_source(d, p, _few(p, "of"))
    copies = F.col("passes") + F.when(F.col("place") <= F.col("ends"), 1).otherwise(0)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns) if c.lower() not in ("mix_tokens", "mix_copies")]
    return joined.select(*kept, F.col("tokens").alias("mix_tokens"), copies.cast("long").alias("mix_copies"))


def realise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture's rows: each as often as its copies say."""
    passes = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixed.filter("mix_copies > 0").withColumn("_mix_pass", passes).select(*columns)
