"""The ban store as a keyed stateful stream operator (T9) on
``applyInPandasWithState``; ``keyed_state`` has the others.

It keeps per-key state in the state store (RocksDB provider, checkpointed
with the query) and processes a key's rows of a micro-batch in arrival order
(``seq``). Late rows are still processed (T5): there is no event-time watermark,
which would drop them. State expires by the key's own event time, so nothing is lost to an
outage of any length; a wall-clock timeout (``STATE_TTL_MS``, far longer than
outages) only clears keys that never return.
The per-row loop is the state machine itself; Spark partitions the keys and
moves the rows as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from payguard.config import DAY_MS
from payguard.streaming.keyed_state import in_order

STATE_TTL_MS = 30 * DAY_MS


# --- T9: ban store ------------------------------------------------------------------

BAN_OUT = ("request_key string, user_id string, reason string, severity int, ttl_seconds long, ms long,"
           " accepted boolean, expires_ms long")


def ban_timeout_ms(expires_ms: int, now_ms: int) -> int:
    """How long an idle user's ban is kept: to its expiry at least, so a milder set is
    refused however long the hold."""
    return max(STATE_TTL_MS, expires_ms - now_ms + 1)


def ban_stream(requests: DataFrame) -> DataFrame:
    """T9 keyed by user: a set is accepted when no ban is live (``ms <
    expiry``) or the live one has a lower severity; ttl 0 = permanent."""
    def step(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = in_order(pdfs, ("ms", "seq", "request_key"))
        if not len(rows):
            return
        exp, sev = (state.get if state.exists else (None, None))
        acc, exps = [], []
        for ms, s, ttl in zip(rows["ms"].tolist(), rows["severity"].tolist(), rows["ttl_seconds"].tolist()):
            ms, s, ttl = int(ms), int(s), int(ttl)
            live = exp is not None and (exp < 0 or ms < exp)
            ok = (not live) or s > sev
            if ok:
                exp, sev = (-1 if ttl == 0 else ms + ttl * 1000), s
            acc.append(ok)
            exps.append(exp if ok else None)
        state.update((int(exp), int(sev)))
        if exp >= 0:
            state.setTimeoutDuration(ban_timeout_ms(int(exp), state.getCurrentProcessingTimeMs()))
        same = {c: rows[c].to_numpy() for c in ("request_key", "user_id", "reason", "severity", "ttl_seconds", "ms")}
        yield pd.DataFrame({**same, "accepted": acc, "expires_ms": pd.array(exps, dtype="Int64")})

    sel = requests.select("user_id", "request_key", F.unix_millis("ts").alias("ms"), "seq", "reason",
                          F.col("severity").cast("int").alias("severity"), F.col("ttl_seconds").cast("long").alias("ttl_seconds"))
    return sel.groupBy("user_id").applyInPandasWithState(
        step, BAN_OUT, "expires_ms long, severity int", "append", GroupStateTimeout.ProcessingTimeTimeout)
