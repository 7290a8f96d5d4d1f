"""Stateful stream operators with a state entry per member (``transformWithState``).

A key's window is kept as chunks of (time, member) entries, sorted by time, and, where
members are counted once, the last time of each member. A micro-batch reads
the entries of the members it brings (or all, if they are fewer than its rows), and the chunks whose first entry has left the
window; it writes those members, one new chunk, and what is left of the chunks it
opened. So its cost follows its own rows and the rows that expire, not
the size of the window. Users are many and bring few rows each: they are dealt over ``USER_SHARDS`` keys, and a
user costs one look-up and one write a micro-batch as long as its window has few entries.

Rows of a micro-batch are taken in the order of (``ms``, ``seq``), and late rows are
still processed: a key keeps its own greatest time instead of a
watermark, and its window ends by that time, so an outage of any length loses nothing. A
key that brings no row for ``idle_ms`` of wall-clock time is cleared.

Defined cases: events without a merchant (count 0), with a blank one, without a user or a
time (count 1) have no state; they are dealt over ``ALONE`` keys, or the users' shards, and pass through. Null request
ids are one member. Alert deliveries need an id, a user, a severity and a time (the consumer's decoding sees to that).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from payguard.config import DAY_MS
from payguard.functions import is_blank
from payguard.session import expose_package, use_state_store

IDLE_MS = 30 * DAY_MS
CHUNK_ROWS = 512  # entries of a chunk
PACK_ROWS = 128   # names of a bucket
ALONE = 64        # keys over which rows without state are dealt

_KEY = T.StructType([T.StructField("k", T.StringType())])
_NUMBER = T.StructType([T.StructField("i", T.LongType())])
_TIME = T.StructType([T.StructField("ms", T.LongType())])
_HEAD = "live long, next long, chunks array<long>, firsts array<long>, max_ms long"
_CHUNK = "ms array<long>, members array<string>"
_PACK = "names array<string>, put_ms array<long>"
_PART = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType())])
_DEALT_HEAD = f"{_HEAD}, ms array<long>, members array<string>, buckets long, used_ms long"


def in_order(frames: Iterator[pd.DataFrame], order: tuple[str, ...] = ("ms", "seq")) -> pd.DataFrame:
    """A key's rows sorted by ``order``, which begins with a time. Most keys bring few rows of
    different times: those are sorted by the time alone, at a tenth of the cost."""
    parts = [p for p in frames if len(p)]
    if not parts:
        return pd.DataFrame()
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    times = rows[order[0]].to_numpy()
    if times.dtype.kind == "i":
        by = times.argsort(kind="stable")
        if (times[by[1:]] > times[by[:-1]]).all():
            return rows.iloc[by]
    return rows.sort_values(list(order), kind="stable")


class Window:
    """Entries of a sliding window in keyed state. ``distinct``: a member counts
    once, at its last time; otherwise every entry counts."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, distinct: bool):
        self.distinct = distinct
        self.head = handle.getValueState(f"{name}_head", _HEAD)
        self.chunks = handle.getMapState(f"{name}_chunks", _NUMBER, _CHUNK)
        self.seen = handle.getMapState(f"{name}_seen", _KEY, _TIME) if distinct else None

    def open(self, rows: int = 0) -> None:
        """Begin a micro-batch of the current key, of ``rows`` rows."""
        self.live, self.next, chunks, firsts, self.max_ms = self.head.get() or (0, 0, (), (), None)
        self.closed = list(zip(firsts or (), chunks or ()))
        heapq.heapify(self.closed)
        self.read: list[int] = []                        # chunks taken out of the state
        self.entries: list[tuple[int, str]] = []         # a heap of entries in memory
        self.last: dict[str, int | None] = {}            # members looked up or put
        self.known: dict[str, int | None] = {}           # their stored times
        self.whole = self.distinct and self.live <= rows  # fewer members in the window than rows: all are read, in a few calls
        if self.whole and self.live:
            self.last = {member: int(ms) for (member,), (ms,) in self.seen.iterator()}
            self.known = dict(self.last)

    def _last(self, member: str) -> int | None:
        if member not in self.last:
            value = None if self.whole else self.seen.getValue((member,))
            self.last[member] = self.known[member] = None if value is None else int(value[0])
        return self.last[member]

    def drop_before(self, ms: int) -> None:
        while self.closed and self.closed[0][0] < ms:
            _, chunk = heapq.heappop(self.closed)
            times, members = self.chunks.getValue((chunk,))
            self.read.append(chunk)
            for entry in zip(times, members):
                heapq.heappush(self.entries, (int(entry[0]), entry[1]))
        while self.entries and self.entries[0][0] < ms:
            at, member = heapq.heappop(self.entries)
            if not self.distinct:
                self.live -= 1
            elif self._last(member) == at:  # else the member came again later
                self.live -= 1
                self.last[member] = None

    def put(self, member, ms: int) -> None:
        member = "" if member is None or member is pd.NA or member != member else str(member)
        if not self.distinct:
            self.live += 1
        else:
            if self._last(member) is None:
                self.live += 1
            self.last[member] = ms
        heapq.heappush(self.entries, (ms, member))

    def close(self) -> None:
        """Write the key's state back."""
        for chunk in self.read:
            self.chunks.removeKey((chunk,))
        # entries in memory that no later one of their member replaces
        rest = sorted({e for e in self.entries if self._last(e[1]) == e[0]}) if self.distinct else sorted(self.entries)
        for i in range(0, len(rest), CHUNK_ROWS):
            part = rest[i:i + CHUNK_ROWS]
            self.chunks.updateValue((self.next,), ([e[0] for e in part], [e[1] for e in part]))
            self.closed.append((part[0][0], self.next))
            self.next += 1
        for member, ms in self.last.items():
            if ms != self.known.get(member):
                if ms is None:
                    self.seen.removeKey((member,))
                else:
                    self.seen.updateValue((member,), (ms,))
        self.head.update((self.live, self.next, [c for _, c in self.closed], [f for f, _ in self.closed], self.max_ms))

    def clear(self) -> None:
        for state in (self.head, self.chunks, self.seen):
            if state is not None:
                state.clear()


class Part:
    """One key's entries of a map that the keys of a shard share."""

    def __init__(self, state):
        self.state, self.key = state, None

    def getValue(self, k):
        return self.state.getValue((self.key, *k))

    def updateValue(self, k, v):
        self.state.updateValue((self.key, *k), v)

    def removeKey(self, k):
        self.state.removeKey((self.key, *k))


class DealtWindow(Window):
    """A window of each key of a shard. The latest ``CHUNK_ROWS`` entries, at most, lie in the key's head, earlier ones in
    chunks. A window with chunks has its members' last times in buckets, by the member's hash. ``more`` fields of the
    head are the caller's."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, distinct: bool, more: str = ""):
        self.distinct = distinct
        self.heads = handle.getMapState(f"{name}_heads", _KEY, _DEALT_HEAD + more)
        self.chunks = Part(handle.getMapState(f"{name}_chunks", _PART, _CHUNK))
        self.seen = Part(handle.getMapState(f"{name}_seen", _PART, _CHUNK)) if distinct else None

    def of(self, key: str) -> None:
        for part in (self.chunks, self.seen):
            if part is not None:
                part.key = key
        self.key = key

    def open(self, key: str) -> tuple:
        """Begin a micro-batch of ``key``; returns the caller's fields, none for a new key."""
        self.of(key)
        self.live, self.next, chunks, firsts, self.max_ms, times, members, self.buckets, _, *more = (
            self.heads.getValue((key,)) or (0, 0, (), (), None, (), (), 0, None))
        self.closed = list(zip(firsts, chunks))
        heapq.heapify(self.closed)
        self.read = []
        self.entries = list(zip(times, members if self.distinct else [""] * len(times)))  # sorted, so a heap
        self.loaded: dict[int, dict[str, int]] = {}  # buckets as they are stored
        self.last = {} if self.buckets or not self.distinct else {member: ms for ms, member in self.entries}
        return tuple(more)

    def _load(self, bucket: int) -> None:
        times, members = self.seen.getValue((bucket,)) or ((), ())
        self.loaded[bucket] = dict(zip(members, times))
        self.last.update(self.loaded[bucket])

    def _last(self, member: str) -> int | None:
        if member not in self.last:
            if self.buckets and (bucket := zlib.crc32(member.encode()) % self.buckets) not in self.loaded:
                self._load(bucket)
            self.last.setdefault(member, None)
        return self.last[member]

    def close(self, now: int, *more) -> None:
        """Write the key's state back."""
        for chunk in self.read:
            self.chunks.removeKey((chunk,))
        rest = sorted({e for e in self.entries if self._last(e[1]) == e[0]}) if self.distinct else sorted(self.entries)
        while len(rest) > CHUNK_ROWS:
            part, rest = rest[:CHUNK_ROWS], rest[CHUNK_ROWS:]
            self.chunks.updateValue((self.next,), ([e[0] for e in part], [e[1] for e in part]))
            self.closed.append((part[0][0], self.next))
            self.next += 1
        if self.distinct:
            self._keep_members()
        self.heads.updateValue((self.key,), (
            self.live, self.next, [c for _, c in self.closed], [f for f, _ in self.closed], self.max_ms,
            [e[0] for e in rest], [e[1] for e in rest] if self.distinct else [], self.buckets, now, *more))

    def _keep_members(self) -> None:
        """Write the buckets that changed; their number follows the number of members, and is 0 where the head has all."""
        old = new = self.buckets
        if not self.closed:
            new = 0
        elif self.live > 2 * CHUNK_ROWS * old:
            new = 1 + 2 * self.live // CHUNK_ROWS
            for bucket in set(range(old)) - set(self.loaded):
                self._load(bucket)
        parts: dict[int, dict[str, int]] = {}
        if new:
            for member, ms in self.last.items():
                if ms is not None:
                    parts.setdefault(zlib.crc32(member.encode()) % new, {})[member] = ms
        for bucket in self.loaded if new == old else range(max(old, new)):
            part = parts.get(bucket)
            if part and (new != old or part != self.loaded[bucket]):
                self.seen.updateValue((bucket,), (list(part.values()), list(part)))
            elif not part and bucket < old:
                self.seen.removeKey((bucket,))
        self.buckets = new

    def forget(self, key: str, chunks: list[int], buckets: int) -> None:
        self.of(key)
        for chunk in chunks:
            self.chunks.removeKey((chunk,))
        for bucket in range(buckets):
            self.seen.removeKey((bucket,))
        self.heads.removeKey((key,))


class Dealt(StatefulProcessor):
    """A processor of shards of keys (column ``pg_key``; rows without one have no state), with a ``DealtWindow`` for each
    key. A key that brings no row for ``idle_ms`` of wall-clock time is cleared when its shard is looked
    through, an eighth of that time later at most. Sub-classes give the window (``begin``) and the rows' results (``step``)."""

    idle_ms = IDLE_MS
    order: tuple[str, ...] = ("ms", "seq")
    window: DealtWindow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sweep = handle.getValueState("sweep", "timer long")
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows, self.order)
        if not len(frame):
            return
        self.now = timerValues.getCurrentProcessingTimeInMs()
        codes, names = pd.factorize(frame["pg_key"])
        by = codes.argsort(kind="stable")
        frame, codes = frame.iloc[by], codes[by]
        starts = np.flatnonzero(np.diff(codes, prepend=-2)).tolist()
        parts = [(names[codes[i]], i, j) for i, j in zip(starts, [*starts[1:], len(codes)]) if codes[i] >= 0]
        if parts and self.sweep.get() is None:
            self._look_through_at(self.now + self.idle_ms)
        yield self.step(frame, [None if ms != ms else int(ms) for ms in frame["ms"].tolist()], parts)

    def _look_through_at(self, timer: int) -> None:
        self.handle.registerTimer(timer)
        self.sweep.update((timer,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        idle, due = [], 1 << 62
        for (k,), (_, _, chunks, _, _, _, _, buckets, used, *more) in self.window.heads.iterator():
            until = max(used + self.idle_ms, self.needed_until(*more))
            if until <= now:
                idle.append((k, chunks, buckets))
            else:
                due = min(due, until)
        for k, chunks, buckets in idle:
            self.window.forget(k, chunks, buckets)
        self.sweep.clear()
        if due < 1 << 62:
            self._look_through_at(max(due, now + max(self.idle_ms // 8, 1)))
        return iter(())

    def needed_until(self, *more) -> int:
        """Wall-clock time before which an idle key's state is still needed."""
        return 0

    def close(self) -> None:
        pass


class Keyed(StatefulProcessor):
    """A processor whose keys are cleared after ``idle_ms`` without a row. Sub-classes give
    the state (``begin``), the rows' results (``step``) and its end (``clear``)."""

    idle_ms = IDLE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "ms long, timer long")
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows, self.order)
        if not len(frame):
            return
        if key[0] is not None and str(key[0]).startswith("\0"):
            yield self.pass_on(frame)
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        _, timer = self.used.get() or (None, None)
        if timer is None:
            timer = now + self.idle_ms
            self.handle.registerTimer(timer)
        self.used.update((now, timer))
        yield self.step(frame)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        last = self.used.get()[0] if self.used.exists() else 0
        until = self.stays_until()
        if until is not None and (now - last < self.idle_ms or now < until):
            timer = max(last + self.idle_ms, until, now + 1)
            self.handle.registerTimer(timer)
            self.used.update((last, timer))
        else:
            self.used.clear()
            self.clear()
        return iter(())

    def stays_until(self) -> int | None:
        """Wall-clock time before which an idle key's state is still needed."""
        return 0

    def pass_on(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Results of rows without state."""
        raise NotImplementedError

    order: tuple[str, ...] = ("ms", "seq")

    def close(self) -> None:
        pass


class Burst(Keyed):
    """T2/T4 by merchant: users last seen within the window before the merchant's
    greatest time less ``lag_ms``, the current one included."""

    def __init__(self, window_ms: int, lag_ms: int, columns: list[str], out: str):
        self.window_ms, self.lag_ms, self.columns, self.out = window_ms, lag_ms, columns, out

    def begin(self, handle):
        self.window = Window(handle, "users", distinct=True)

    def step(self, frame):
        w, counts = self.window, []
        w.open(len(frame))
        for user, ms in zip(frame["user_id"], frame["ms"].tolist()):
            w.max_ms = ms if w.max_ms is None else max(w.max_ms, ms)
            w.drop_before(w.max_ms - self.lag_ms - self.window_ms)
            if user is not None:  # an event without a user adds none
                w.put(user, ms)
            counts.append(w.live)
        w.close()
        return frame[self.columns].assign(**{self.out: pd.array(counts, "int64")})

    def pass_on(self, frame):
        return frame[self.columns].assign(**{self.out: frame["merchant_id"].notna().astype("int64")})

    def clear(self):
        self.window.clear()


class Velocity(Dealt):
    """W3 by shards of users: rows of the window up to the user's greatest time, this one included."""

    def __init__(self, window_ms: int, columns: list[str], out: str):
        self.window_ms, self.columns, self.out = window_ms, columns, out

    def begin(self, handle):
        self.window = DealtWindow(handle, "rows", distinct=False)

    def step(self, frame, times, parts):
        w, counts = self.window, np.ones(len(frame), "int64")
        for user, i, j in parts:
            w.open(user)
            for row in range(i, j):
                ms = times[row]
                w.max_ms = ms if w.max_ms is None else max(w.max_ms, ms)
                w.drop_before(w.max_ms - self.window_ms)
                w.put(None, ms)
                counts[row] = w.live
            w.close(self.now)
        return frame[self.columns].assign(**{self.out: counts})


class RateLimit(Dealt):
    """T8 by shards of users: add the request id at now, drop ids scored at or before now - window,
    count; blocked iff the count exceeds the limit."""

    def __init__(self, window_ms: int, limit: int):
        self.window_ms, self.limit = window_ms, limit

    def begin(self, handle):
        self.window = DealtWindow(handle, "calls", distinct=True)

    def call(self, request, ms: int) -> int:
        self.window.put(request, ms)
        self.window.drop_before(ms - self.window_ms + 1)
        return self.window.live

    def step(self, frame, times, parts):
        requests, counts = frame["request_id"].tolist(), []
        for user, i, j in parts:
            self.window.open(user)
            counts += [self.call(r, ms) for r, ms in zip(requests[i:j], times[i:j])]
            self.window.close(self.now)
        return pd.DataFrame({"event_id": frame["event_id"].values, "rate_count": pd.array(counts, "int64"),
                             "rate_blocked": [c > self.limit for c in counts]})


class Held:
    """A value of the key at hand, kept in its head."""

    def __init__(self, fields=()):
        self.fields = tuple(fields)

    def exists(self) -> bool:
        return bool(self.fields) and self.fields[0] is not None

    def get(self) -> tuple | None:
        return self.fields if self.exists() else None


class Admission(RateLimit):
    """Q3 by shards of users: ban sets and calls in one order. A ban set is accepted when no ban is
    live or the live one has a lower severity; a call sees bans set strictly before it (of
    one ms, calls come first) and enters the limiter only if no ban is live."""

    order = ("ms", "is_ban", "seq", "event_id")

    def begin(self, handle):
        self.window = DealtWindow(handle, "calls", distinct=True, more=", expires long, severity int, reason string")

    def step(self, frame, times, parts):
        rows = list(zip(times, *(frame[c].tolist() for c in (
            "user_id", "is_ban", "event_id", "request_id", "severity", "reason", "ttl_seconds", "violations"))))
        out = []
        for user, i, j in parts:
            self.ban = Held(self.window.open(user))
            expires, severity, reason = self.ban.get() or (None, None, None)
            for ms, user_id, is_ban, event, request, sev, why, ttl, bad in rows[i:j]:
                live = expires is not None and (expires < 0 or ms < expires)
                if is_ban:
                    if not live or sev > severity:
                        expires, severity, reason = (-1 if ttl == 0 else ms + int(ttl) * 1000), int(sev), why
                elif bad:
                    out.append((event, user_id, "REJECTED", bad, 0))
                elif live:
                    out.append((event, user_id, "BLOCKED", f"blacklist:{reason}", 0))
                else:
                    n = self.call(request, ms)
                    out.append((event, user_id, "BLOCKED", "rate_limit", n) if n > self.limit
                               else (event, user_id, "ACCEPTED", "passed_fast_path", n))
            self.window.close(self.now, expires, severity, reason)
        return pd.DataFrame(out, columns=["event_id", "user_id", "status", "reason", "rate_limit_count"])

    def stays_until(self):
        expires = self.ban.get()[0] if self.ban.exists() else 0
        return 1 << 62 if expires < 0 else expires

    def needed_until(self, *more):
        self.ban = Held(more)
        return self.stays_until()


class Packed:
    """A shard's set of names, in buckets by the name's hash: a micro-batch reads and writes each bucket it touches once, so that
    many names cost few calls and one name a bucket of at most about ``2 * PACK_ROWS``. A name is forgotten ``keep_ms`` of
    wall-clock time after it was put (None: never); the state's TTL drops buckets whose names all are."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, keep_ms: int | None):
        self.keep_ms = keep_ms
        self.head = handle.getValueState(f"{name}_head", "live long, buckets long", keep_ms)
        self.parts = handle.getMapState(f"{name}_parts", _NUMBER, _PACK, keep_ms)

    def open(self, now: int) -> None:
        """Begin a micro-batch of the current shard."""
        self.now = now
        self.live, self.buckets = self.head.get() or (0, 1)
        self.loaded: dict[int, dict[str, int]] = {}
        self.changed: set[int] = set()

    def _part(self, bucket: int) -> dict[str, int]:
        part = self.loaded.get(bucket)
        if part is None:
            names, put = (self.parts.getValue((bucket,)) if self.live else None) or ((), ())
            part = dict(zip(names, put))
            if self.keep_ms is not None:
                part = {n: at for n, at in part.items() if at + self.keep_ms > self.now}
            self.live -= len(names) - len(part)
            self.loaded[bucket] = part
        return part

    def _bucket(self, name: str) -> int:
        return zlib.crc32(name.encode()) % self.buckets

    def add(self, name: str) -> bool:
        """Put the name if it isn't there; was it new?"""
        bucket = self._bucket(name)
        part = self._part(bucket)
        if name in part:
            return False
        part[name] = self.now
        self.live += 1
        self.changed.add(bucket)
        return True

    def close(self) -> None:
        """Write the buckets that changed; their number follows the number of names."""
        if not self.changed:
            return
        if self.live > 2 * PACK_ROWS * self.buckets:
            for bucket in range(self.buckets):
                self._part(bucket)
            names = [e for part in self.loaded.values() for e in part.items()]
            self.live, self.buckets = len(names), max(self.buckets, 2 * len(names) // PACK_ROWS)
            self.loaded = {bucket: {} for bucket in range(self.buckets)}
            for name, at in names:
                self.loaded[self._bucket(name)][name] = at
            self.changed = set(self.loaded)
        for bucket in self.changed:
            part = self.loaded[bucket]
            if part:
                self.parts.updateValue((bucket,), (list(part), list(part.values())))
            else:  # only when the buckets are dealt anew
                self.parts.removeKey((bucket,))
        self.head.update((self.live, self.buckets))


class FirstDelivery(StatefulProcessor):
    """J7 by a shard of alert ids. The first delivery of an id, by (``ms``, ``offset``, ``partition``)
    within a micro-batch, is no duplicate."""

    def __init__(self, columns: list[str], keep_ms: int | None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = Packed(handle, "taken", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows, ("ms", "offset", "partition"))
        if not len(frame):
            return
        self.taken.open(timerValues.getCurrentProcessingTimeInMs())
        duplicate = [not self.taken.add(a) for a in frame["alert_id"].tolist()]
        self.taken.close()
        yield frame[self.columns].assign(duplicate=duplicate)

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """T10 by a shard of (user, severity) pairs, with an entry per pair, so that a pair costs two look-ups a micro-batch and
    no call of its own: allowed iff nothing was allowed yet or the last one at least ``cooldown_ms`` ago. Duplicates pass
    through, not allowed. A pair that brings no row for ``idle_ms`` of wall-clock time is forgotten."""

    idle_ms = IDLE_MS

    def __init__(self, cooldown_ms: int, columns: list[str]):
        self.cooldown_ms, self.columns = cooldown_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", _KEY, _TIME, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = in_order(rows, ("ms", "offset", "partition"))
        if not len(frame):
            return
        last: dict[str, int | None] = {}
        allowed = []
        for pair, ms, duplicate in zip(frame["pg_pair"], frame["ms"].tolist(), frame["duplicate"].tolist()):
            if duplicate:
                allowed.append(False)
                continue
            if pair not in last:
                value = self.last.getValue((pair,))
                last[pair] = None if value is None else int(value[0])
            ok = last[pair] is None or ms - last[pair] >= self.cooldown_ms
            if ok:
                last[pair] = ms
            allowed.append(ok)
        for pair, ms in last.items():
            self.last.updateValue((pair,), (int(ms),))
        yield frame[self.columns].assign(allowed=allowed)

    def close(self) -> None:
        pass


class Sequence(StatefulProcessor):
    """D1 by user: an automaton of (last first step, last second step with the first step
    before it). Its timer is in event time: ``within_ms`` after its last step it is cleared."""

    def __init__(self, first: str, second: str, third: str, within_ms: int, least: int):
        self.types, self.within_ms, self.least = (first, second, third), within_ms, least

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("steps", "first_ms long, second_ms long, second_first long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        frame = in_order(rows)
        if not len(frame):
            return
        first, second, carried, timer = self.state.get() or (None, None, None, None)
        out, step = [], None
        for event, kind, ms, amount in zip(*(frame[c].tolist() for c in ("event_id", "event_type", "ms", "amount_cents"))):
            if kind == self.types[2] and amount == amount and amount is not None and amount >= self.least \
                    and carried is not None and carried >= ms - self.within_ms:
                out.append((event, ms, second, carried))
            before = first
            if kind == self.types[0]:
                first = step = ms
            if kind == self.types[1]:
                second, carried, step = ms, before, ms
        if step is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = step + self.within_ms + 1
            self.handle.registerTimer(timer)
            self.state.update((first, second, carried, timer))
        found = pd.DataFrame(out, columns=["event_id", "ms", "second_ms", "first_ms"])
        found.insert(1, "user_id", frame["user_id"].iloc[0])
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self):
        pass


def _with_state(rows: DataFrame, key: list[str], processor: StatefulProcessor, out: T.StructType | str, time: str = "ProcessingTime") -> DataFrame:
    use_state_store(rows.sparkSession)
    expose_package(rows.sparkSession)
    return rows.groupBy(*key).transformWithStateInPandas(processor, out, "Append", time)


def _typed(df: DataFrame, columns: list[str], out: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + [T.StructField(out, T.LongType())])


def _key_or_alone(key: str, alone: Column) -> Column:
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("event_id"), F.lit(ALONE)).cast("string"))
    return F.when(alone | F.col("ms").isNull(), spread).otherwise(F.col(key)).alias("_key")


def burst(events: DataFrame, window_ms: int, lag_ms: int = 0, columns: tuple[str, ...] = ("event_id",),
          out: str = "merchant_users") -> DataFrame:
    """W1 on a stream: ``columns`` and ``out``. ``lag_ms`` 0 equals the
    batch operator for input in order; ``skew + 1`` the look-back of the reference's watermark."""
    cols, m = list(columns), F.col("merchant_id")
    need = list(dict.fromkeys([*cols, "merchant_id", "user_id", "ms", "seq"]))
    keyed = events.select(*need, _key_or_alone("merchant_id", m.isNull() | is_blank(m)))
    return _with_state(keyed, ["_key"], Burst(window_ms, lag_ms, cols, out), _typed(events, cols, out))


def velocity(events: DataFrame, window_ms: int, columns: tuple[str, ...] = ("event_id",), out: str = "velocity_7d") -> DataFrame:
    """W3 on a stream: ``columns`` and ``out``."""
    cols = list(columns)
    need = list(dict.fromkeys([*cols, "user_id", "ms", "seq", "event_id"]))
    keyed = _dealt(events.select(*need, F.when(F.col("ms").isNotNull(), F.col("user_id")).alias("pg_key")))
    return _with_state(keyed, ["_key"], Velocity(window_ms, cols, out), _typed(events, cols, out))


USER_SHARDS = 1024  # keys over which users are dealt


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with the shard of their ``pg_key``; rows without one are dealt by their event."""
    return rows.withColumn("_key", F.pmod(F.xxhash64(F.coalesce("pg_key", "event_id")), F.lit(USER_SHARDS)).cast("string"))


def _any_user() -> Column:
    """The user as a key; calls without one are one key."""
    return F.coalesce(F.concat(F.lit("="), "user_id"), F.lit("")).alias("pg_key")


def rate_limit(calls: DataFrame, window_ms: int, limit: int) -> DataFrame:
    """W2 on a stream: event_id, rate_count, rate_blocked."""
    return _with_state(_dealt(calls.select("event_id", "request_id", "ms", "seq", _any_user())), ["_key"], RateLimit(window_ms, limit),
                       "event_id string, rate_count long, rate_blocked boolean")


ADMISSION_INPUT = ("user_id string, event_id string, request_id string, ms long, seq long, is_ban boolean, severity int, "
                   "reason string, ttl_seconds long, violations string")


def admission(records: DataFrame, window_ms: int, limit: int) -> DataFrame:
    """Q3 on a stream of calls and ban sets (``ADMISSION_INPUT``): one outcome a call."""
    fields = [f.split()[0] for f in ADMISSION_INPUT.split(", ")]
    return _with_state(_dealt(records.select(*fields, _any_user())), ["_key"], Admission(window_ms, limit),
                       "event_id string, user_id string, status string, reason string, rate_limit_count long")


def sequence(events: DataFrame, first: str, second: str, third: str, within_ms: int, least: int = 0) -> DataFrame:
    """D1 on a stream with a watermark on ``ts``."""
    need = events.select("user_id", "event_id", "event_type", "ms", "seq", "amount_cents", "ts")
    return _with_state(need, ["user_id"], Sequence(first, second, third, within_ms, least),
                       "event_id string, user_id string, ms long, second_ms long, first_ms long", "EventTime")


ID_SHARDS = PAIR_SHARDS = 1024  # keys over which alert ids, and pairs of user and severity, are dealt


def first_deliveries(alerts: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """J7 on a stream of alert deliveries (alert_id, ms, partition, offset, ...): the same rows with
    ``duplicate``. Ids are kept for good, or for ``keep_ms`` of wall-clock time."""
    cols = alerts.columns
    keyed = alerts.withColumn("_key", F.pmod(F.xxhash64("alert_id"), F.lit(ID_SHARDS)).cast("string"))
    return _with_state(keyed, ["_key"], FirstDelivery(cols, keep_ms),
                       T.StructType([*alerts.schema.fields, T.StructField("duplicate", T.BooleanType())]))


def cooldown(deliveries: DataFrame, cooldown_ms: int) -> DataFrame:
    """T10 on a stream of ``first_deliveries``: the same rows with ``allowed``. Pairs of user and severity are dealt
    over ``PAIR_SHARDS`` keys; duplicates don't enter the state and are dealt by their alert id."""
    cols = deliveries.columns
    user, severity = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (F.col("user_id"), F.upper("severity")))
    pairs = deliveries.select(F.concat(user, F.lit("\u0000"), severity).alias("pg_pair"), *cols)
    dealt = F.when(F.col("duplicate"), F.col("alert_id")).otherwise(F.col("pg_pair"))
    keyed = pairs.withColumn("_key", F.pmod(F.xxhash64(dealt), F.lit(PAIR_SHARDS)).cast("string"))
    return _with_state(keyed, ["_key"], Cooldown(cooldown_ms, cols),
                       T.StructType([*deliveries.schema.fields, T.StructField("allowed", T.BooleanType())]))
