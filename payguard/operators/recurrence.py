"""Greedy acceptance recurrences: alert cool-down (T10) and severity bans.

Per key, rows are visited in (ms, seq) order. A row is *accepted* when no
earlier accepted row still holds the key: the holder set at ``h`` holds until
``h.ms + ttl`` (null ttl = forever) unless a row of higher severity arrives
(severity mode). Accepted rows restart the hold. This depends on the previous
accepted row, so it is not a window frame.

Two exact forms, for any severities and holds (0 included), chosen per key by
its rows (no result depends on the choice):

* ``fold``: sort the key's rows into one array and fold it with the
  built-in ``aggregate`` (JVM side), for keys of at most ``fold_max_group_rows`` rows.
* ``doubling``: each row's successor (the row that would be accepted next if
  this one is) is found with bucketed windows; the accepted rows are the
  chain of successors from each key's first row, marked by pointer doubling
  (log2(chain length) rounds of joins on unique row ids, a stored table
  each round). No key is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payguard.config import DAY_MS
from payguard.session import cut_lineage

_B = "_pg_rb"
_FOREVER = 2 ** 62


def _node(ms="ms", seq="seq", node_id="node_id") -> Column:
    return F.struct(F.col(ms).alias("ms"), F.col(seq).alias("seq"), F.col(node_id).alias("id"))


def _suffix_min_later(stats: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """For every (key, bucket): min of each column over the key's later buckets."""
    w = Window.partitionBy(*keys).orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return stats.select(*keys, _B, *[F.min(c).over(w).alias(f"{c}_later") for c in cols])


def successors(nodes: DataFrame, keys: list[str], ttl_ms: str, sev: str | None = None,
               bucket_ms: int = DAY_MS) -> DataFrame:
    """Add ``succ`` = struct(ms, seq, id) of the row accepted next after this
    one if this one is accepted (null = none). Needs columns ms, seq, node_id."""
    n = nodes.withColumn("_pg_probe", F.col("ms") + F.col(ttl_ms))
    # time successor: first later row with ms >= probe (descending running min). A hold of 0 ends
    # at once: its probe stands right after the row itself, so the next row follows.
    none_id = F.lit(None).cast("string")
    tgt = n.select(*keys, F.struct(F.col("ms").alias("t"), F.lit(1).alias("k"), F.col("seq").cast("long").alias("s"),
                                   F.col("node_id").cast("string").alias("i"), F.lit(0).alias("z")).alias("_at"),
                   _node().alias("_tid"), none_id.alias("_src"))
    at_once = F.col(ttl_ms) <= 0
    prb = n.filter(F.col("_pg_probe").isNotNull()).select(
        *keys, F.struct(F.when(at_once, F.col("ms")).otherwise(F.col("_pg_probe")).alias("t"),
                        F.when(at_once, 1).otherwise(0).alias("k"),
                        F.when(at_once, F.col("seq")).otherwise(F.lit(0)).cast("long").alias("s"),
                        F.when(at_once, F.col("node_id").cast("string")).otherwise(F.lit("")).alias("i"),
                        F.lit(1).alias("z")).alias("_at"),
        F.lit(None).cast(tgt.schema["_tid"].dataType).alias("_tid"), F.col("node_id").cast("string").alias("_src"))
    u = tgt.unionByName(prb).withColumn(_B, F.floor(F.col("_at.t") / bucket_ms).cast("long"))
    w = (Window.partitionBy(*keys, _B).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = u.withColumn("_loc", F.min("_tid").over(w)).filter(F.col("_src").isNotNull())
    stats = _suffix_min_later(u.groupBy(*keys, _B).agg(F.min("_tid").alias("_m")), keys, ["_m"])
    tsucc = (local.join(stats, [*keys, _B], "left")
             .select(F.col("_src").alias("node_id"), F.coalesce("_loc", "_m_later").alias("_tsucc")))
    out = n.join(tsucc, "node_id", "left")
    if sev is None:
        return out.withColumnRenamed("_tsucc", "succ").drop("_pg_probe")
    # severity successor: first later row with a higher severity, for each severity in use
    levels = [r[0] for r in n.select(sev).distinct().orderBy(sev).collect()]
    b = out.withColumn(_B, F.floor(F.col("ms") / bucket_ms).cast("long"))
    wl = (Window.partitionBy(*keys, _B)
          .orderBy(F.col("ms").desc(), F.col("seq").desc(), F.col("node_id").desc())
          .rowsBetween(Window.unboundedPreceding, -1))
    lv = [f"_gt{i}" for i in range(len(levels))]
    for lvl, c in zip(levels, lv):
        b = b.withColumn(c, F.min(F.when(F.col(sev) > lvl, _node())).over(wl))
    st = b.groupBy(*keys, _B).agg(*[F.min(F.when(F.col(sev) > lvl, _node())).alias(c)
                                    for lvl, c in zip(levels, lv)])
    b = b.join(_suffix_min_later(st, keys, lv), [*keys, _B], "left")
    pick = F.coalesce(*[F.when(F.col(sev) == lvl, F.coalesce(c, f"{c}_later")) for lvl, c in zip(levels, lv)])
    return (b.withColumn("succ", F.least("_tsucc", pick))
            .drop("_tsucc", "_pg_probe", _B, *lv, *[f"{c}_later" for c in lv]))


def chain_marks(nodes: DataFrame, keys: list[str], max_rounds: int = 64) -> DataFrame:
    """Ids of the rows reachable from each key's first row along ``succ``
    (pointer doubling). Input needs ms, seq, node_id, succ."""
    heads = nodes.groupBy(*keys).agg(F.min(_node()).alias("h")).select(F.col("h.id").alias("node_id"))
    jump = cut_lineage(nodes.filter(F.col("succ").isNotNull())
                       .select(F.col("node_id").alias("src"), F.col("succ.id").alias("dst")))
    reached = cut_lineage(heads)
    for _ in range(max_rounds):
        new = reached.join(jump, reached.node_id == jump.src).select(F.col("dst").alias("node_id"))
        new = cut_lineage(new)
        if new.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(new))
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", F.col("b.dst")))
    raise RuntimeError("chain longer than 2**max_rounds rows")


def _fold(nodes: DataFrame, keys: list[str], ttl_ms: str, sev: str | None) -> DataFrame:
    """Fast path: one array per key folded with ``aggregate``."""
    sv = F.col(sev).cast("int") if sev else F.lit(0)
    items = F.struct(F.col("ms").alias("ms"), F.col("seq").alias("seq"), F.col("node_id").alias("id"),
                     sv.alias("sev"), F.col(ttl_ms).cast("long").alias("ttl"))
    g = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(items)).alias("xs"))
    acc_t = "array<struct<id:string,ms:bigint,exp:bigint>>"
    init = F.struct(F.lit(None).cast("bigint").alias("exp"), F.lit(None).cast("int").alias("sev"),
                    F.array().cast(acc_t).alias("acc"))

    def step(st, x):
        take = st["exp"].isNull() | (x["ms"] >= st["exp"])
        if sev:
            take = take | (x["sev"] > st["sev"])
        exp = F.coalesce(x["ms"] + x["ttl"], F.lit(_FOREVER))
        return F.when(take, F.struct(exp.alias("exp"), x["sev"].alias("sev"), F.concat(
            st["acc"], F.array(F.struct(x["id"].alias("id"), x["ms"].alias("ms"), exp.alias("exp")))
        ).alias("acc"))).otherwise(st)

    acc = F.aggregate("xs", init, step)["acc"]
    with_end = F.transform(acc, lambda a, i: F.struct(
        a["id"].alias("node_id"),
        F.least(a["exp"], F.try_element_at(acc, i + 2)["ms"]).alias("until_ms")))
    return g.select(F.explode(with_end).alias("a")).select("a.node_id", "a.until_ms")


def _double(nodes: DataFrame, keys: list[str], ttl_ms: str, sev: str | None, bucket_ms: int) -> DataFrame:
    with_succ = successors(nodes, keys, ttl_ms, sev, bucket_ms)
    with_succ = cut_lineage(with_succ.select("node_id", *keys, "ms", "seq", ttl_ms, "succ"))
    reached = chain_marks(with_succ, keys)
    return (with_succ.join(reached, "node_id", "left_semi")
            .select("node_id", F.least(F.coalesce(F.col("ms") + F.col(ttl_ms), F.lit(_FOREVER)),
                                       F.coalesce(F.col("succ.ms"), F.lit(_FOREVER))).alias("until_ms")))


def greedy_accept(nodes: DataFrame, keys: list[str], ttl_ms: str, sev: str | None = None,
                  method: str = "auto", fold_max_group_rows: int = 2_000, bucket_ms: int = DAY_MS) -> DataFrame:
    """Add ``accepted`` (bool) and ``until_ms`` (end of the hold started by an
    accepted row: its expiry, or the next accepted row if earlier; the
    sentinel 2**62 = forever). Input needs ms, seq, node_id (unique) and the
    ``ttl_ms`` column (null = forever, 0 = ends at once).

    Both forms give the same rows for any severities and holds. Keys of more than
    ``fold_max_group_rows`` rows go by pointer doubling, so that no key is gathered in one
    task; the others fold in place. The input is computed once (its lineage is cut)."""
    nodes = cut_lineage(nodes)
    if method == "fold":
        acc = _fold(nodes, keys, ttl_ms, sev)
    elif method == "doubling":
        acc = _double(nodes, keys, ttl_ms, sev, bucket_ms)
    elif method == "auto":
        long = nodes.groupBy(*keys).count().filter(F.col("count") > fold_max_group_rows).drop("count")
        if long.isEmpty():
            acc = _fold(nodes, keys, ttl_ms, sev)
        else:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}"))
            rest = nodes.alias("n").join(long.alias("l"), same, "left_anti")
            hot = cut_lineage(nodes.alias("n").join(long.alias("l"), same, "left_semi"))
            acc = _fold(rest, keys, ttl_ms, sev).unionByName(_double(hot, keys, ttl_ms, sev, bucket_ms))
    else:
        raise ValueError(f"unknown method {method!r}")
    acc = acc.withColumn("accepted", F.lit(True))
    return (nodes.join(acc, "node_id", "left")
            .withColumn("accepted", F.coalesce("accepted", F.lit(False))))
