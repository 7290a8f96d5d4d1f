"""Join helpers: a bucketed interval (as-of) join.

Spark has no native range join. ``interval_join`` spreads each interval over
the time buckets it overlaps and equi-joins on ``keys + bucket`` before the
range test, so candidates are limited to one key and one bucket. The join is
declared only: AQE broadcasts the interval side when its run-time size in
bytes is under ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed buckets otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.config import DAY_MS

_B = "_pg_ib"


def interval_join(points: DataFrame, intervals: DataFrame, point_ms: str, start_ms: str,
                  end_ms: str, keys: tuple[str, ...] = (), how: str = "left",
                  bucket_ms: int = DAY_MS, start_inclusive: bool = True,
                  max_point_ms: int | None = None, condition: Column | None = None) -> DataFrame:
    """Join points to the intervals of the same ``keys`` that contain them.

    Containment: ``start <= p < end`` (``start < p < end`` when
    ``start_inclusive`` is False); a null end is open. Buckets are capped at
    one past the last interval start (one scalar read from the interval side, or
    ``max_point_ms`` when given): later points share that bucket, which only
    open or long intervals reach, and the range test keeps the join exact.
    The result keeps every point column plus the interval columns.
    """
    if max_point_ms is None:
        last_start = intervals.agg(F.max(start_ms)).first()[0]
        cap = (0 if last_start is None else int(last_start) // bucket_ms) + 1
    else:
        cap = int(max_point_ms) // bucket_ms + 1
    hi = F.coalesce(F.col(end_ms) - 1, F.lit(cap * bucket_ms))
    first_b = F.least(F.floor(F.col(start_ms) / bucket_ms).cast("long"), F.lit(cap))
    last_b = F.least(F.floor(F.greatest(hi, F.col(start_ms)) / bucket_ms).cast("long"), F.lit(cap))
    spread = intervals.withColumn(_B, F.explode(F.sequence(first_b, last_b)))
    p = points.withColumn(_B, F.least(F.floor(F.col(point_ms) / bucket_ms).cast("long"), F.lit(cap)))
    pa, ia = p.alias("p"), spread.alias("i")
    eq = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys] + [F.col(f"p.{_B}") == F.col(f"i.{_B}")]
    lower = (F.col(f"i.{start_ms}") <= F.col(f"p.{point_ms}")) if start_inclusive else (
        F.col(f"i.{start_ms}") < F.col(f"p.{point_ms}"))
    upper = F.col(f"i.{end_ms}").isNull() | (F.col(f"p.{point_ms}") < F.col(f"i.{end_ms}"))
    cond = eq[0]
    for c in eq[1:]:
        cond = cond & c
    cond = cond & lower & upper
    if condition is not None:
        cond = cond & condition
    joined = pa.join(ia, cond, how)
    keep = [F.col(f"p.{c}") for c in points.columns] + [
        F.col(f"i.{c}") for c in intervals.columns if c not in keys and c not in points.columns]
    return joined.select(*keep)
