"""Keyed state on event time: decisions that need the rows of a key in order, and state that expires.

Rows wait until the watermark has passed them: a few in one value state, more in a map state, in parts by slice of time. A
timer at the earliest waiting row then takes the slices one after another: only one slice and a few rows are in memory,
however many rows a key has, and arrival order doesn't matter within the watermark's delay. What decisions remember is
in the same value state; it is cleared by a timer of its own once it can't matter any more. Every call on a state is a
round trip to the JVM and every frame handed over an Arrow batch: where keys have few rows, ``buckets`` of keys by hash
share one state, each key with a memory of its own. Needs the RocksDB state store (``session.keyed_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.session import keyed_state

DAY_US = 86_400_000_000
# Rows that wait together before they are dealt to slices, rows to an output frame, and buckets for many small keys.
FEW, FRAME, BUCKETS = 5_000, 10_000, 8_192


class InOrder(StatefulProcessor):
    """Hands the rows of every key to ``decide`` by (us, id), once the watermark is at their millisecond or later.

    Subclasses give ``memory`` (name and type of what they remember of a key), ``decide`` and ``expires``. Columns of a
    row are ``of`` (its key as a string), ``us`` (microseconds) and ``id``; a group of rows is one key or a bucket of keys.
    """

    memory: dict[str, str] = {}

    def __init__(self, key: str, id_type: str, slice_us: int):
        self.key, self.id_type, self.slice_us = key, id_type, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = f"of array<string>, us array<long>, id array<{self.id_type}>"
        known = "".join(f", {name} array<{kind}>" for name, kind in self.memory.items())
        self.waiting = handle.getMapState("waiting", "slice long, part long", rows)
        self.kept = handle.getValueState("kept", f"{rows}, parts long, known array<string>{known}")

    def decide(self, kept: tuple | None, us: int, id_: Any) -> tuple[tuple | None, tuple]:
        """(what to remember, the row's result)."""
        raise NotImplementedError

    def expires(self, kept: tuple) -> int:
        """The time from which ``kept`` decides nothing any more."""
        raise NotImplementedError

    def result(self, keys: list, us: list, ids: list, out: list[tuple]):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        kept, near, n = self._known()
        low = None
        for frame in rows:
            new = frame["us"].tolist()
            low = min(new) if low is None else min(low, min(new))
            near += zip(frame["of"].tolist(), new, frame["id"].tolist(), strict=True)
            if len(near) > FEW:
                near, n = [], self._spread(near, n)
        self._keep(kept, near, n)
        if low is not None:
            self.handle.registerTimer(millisecond(low))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs()
        kept, near, n = self._known()
        near, far = self._slices(near), self._parts() if n else {}
        late, done, out = [], [], []
        for at in sorted(near.keys() | far.keys()):
            if millisecond(at * self.slice_us) > now:
                late += near.get(at, [])
                continue
            rows = near.get(at, []) + self._take(at, far.pop(at, []))
            for row in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2])):
                of, us, id_ = row
                if millisecond(us) > now:
                    late.append(row)
                    continue
                kept[of], result = self.decide(kept.get(of), us, id_)
                done.append(row)
                out.append(result)
            if len(done) >= FRAME:
                yield self.result(*zip(*done, strict=True), out)
                done, out = [], []
        if done:
            yield self.result(*zip(*done, strict=True), out)
        self._remember(kept, late, far, n, now)

    def _known(self) -> tuple[dict[str | None, tuple], list[tuple], int]:
        """What is remembered of every key, the few rows that wait together, and the number of the next part."""
        found = self.kept.get()
        if found is None:
            return {}, [], 0
        of, us, ids, n, keys, *memory = found
        return dict(zip(keys, zip(*memory, strict=True), strict=True)), list(zip(of, us, ids, strict=True)), n

    def _keep(self, kept: dict[str | None, tuple], near: list[tuple], n: int) -> None:
        memory = ([m[i] for m in kept.values()] for i in range(len(self.memory)))
        self.kept.update((*columns(near), n, list(kept), *memory))

    def _slices(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        slices: dict[int, list[tuple]] = {}
        for row in rows:
            slices.setdefault(row[1] // self.slice_us, []).append(row)
        return slices

    def _spread(self, rows: list[tuple], n: int) -> int:
        """Deals rows to parts of their slices; the number of the next part."""
        for at, part in self._slices(rows).items():
            self.waiting.updateValue((at, n), columns(part))
            n += 1
        return n

    def _parts(self) -> dict[int, list[int]]:
        """The parts of every slice; only the map's keys are read."""
        slices: dict[int, list[int]] = {}
        for at, part in self.waiting.keys():
            slices.setdefault(int(at), []).append(int(part))
        return slices

    def _take(self, at: int, parts: list[int]) -> list[tuple]:
        """The rows of a slice's parts, which leave the state."""
        rows = []
        for part in parts:
            rows += zip(*self.waiting.getValue((at, part)), strict=True)
            self.waiting.removeKey((at, part))
        return rows

    def _remember(self, kept: dict[str | None, tuple], late: list[tuple], far: dict[int, list[int]], n: int, now: int) -> None:
        """Keeps what can still matter and what the watermark hasn't passed, with timers at the earliest of either."""
        kept = {k: m for k, m in kept.items() if millisecond(self.expires(m)) > now}
        if not kept and not late and not far:
            self.kept.clear()
            return
        first = [millisecond(at * self.slice_us) for at in far] + [millisecond(r[1]) for r in late]
        n = n if far else 0
        if len(late) > FEW:
            late, n = [], self._spread(late, n)
        self._keep(kept, late, n)
        if first:
            self.handle.registerTimer(min(first))
        if kept:
            self.handle.registerTimer(min(millisecond(self.expires(m)) for m in kept.values()))

    def close(self) -> None:
        pass


def columns(rows: list[tuple]) -> tuple[list, list, list]:
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def millisecond(us: int) -> int:
    """The first millisecond at or after a time, as the watermark counts."""
    return -(-us // 1000)


class Limiter(InOrder):
    """Admits a row when fewer than ``limit`` were admitted in the ``width`` before it (STR2)."""

    memory = {"admitted": "array<long>"}

    def __init__(self, key: str, id_type: str, limit: int, width: int):
        super().__init__(key, id_type, max(width, 1))
        self.limit, self.width = limit, width

    def decide(self, kept, us, id_):
        # The list is this call's own: the last ``limit`` admitted times.
        recent = kept[0] if kept else []
        ok = len(recent) < self.limit or recent[-self.limit] <= us - self.width
        if ok:
            recent = [*recent[-self.limit + 1 :], us] if self.limit > 1 else [us]
        return (recent,), (ok,)

    def expires(self, kept):
        return kept[0][-1] + self.width if kept[0] else 0

    def result(self, keys, us, ids, out):
        import pandas as pd

        return pd.DataFrame({"id": ids, self.key: keys, "us": us, "admitted": [r[0] for r in out]})


class FirstWithin(InOrder):
    """The first row of a key registers it for ``ttl``; until then others are its duplicates and don't prolong it (DED3)."""

    def __init__(self, key: str, id_type: str, ttl: int, slice_us: int = DAY_US):
        super().__init__(key, id_type, slice_us)
        self.memory = {"owner": id_type, "until": "long"}
        self.ttl = ttl

    def decide(self, kept, us, id_):
        if kept is not None and us < kept[1]:
            return kept, (True, kept[0])
        return (id_, us + self.ttl), (False, None)

    def expires(self, kept):
        return kept[1]

    def result(self, keys, us, ids, out):
        import pandas as pd

        existing = pd.Series([r[1] for r in out], dtype="object")
        return pd.DataFrame({"id": ids, self.key: keys, "us": us, "is_duplicate": [r[0] for r in out], "existing_id": existing})


def _ordered(rows: DataFrame, key: str, us: Column, id_: str, delay: str, buckets: int | None):
    """(of, us, id) with a watermark on whole milliseconds, which never runs ahead of a row it has passed, by key or bucket."""
    seen = F.timestamp_millis(F.ceil(us / 1000).cast("long"))
    group = F.col(key) if buckets is None else F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    slim = rows.where(us.isNotNull()).select(group, F.col(key).cast("string").alias("of"), us.alias("us"), F.col(id_).alias("id"), seen.alias("seen"))
    return slim.withWatermark("seen", delay).groupBy(key if buckets is None else "bucket")


def rate_limit(events: DataFrame, limit: int, width: int, key: str = "api_key", us: str = "us", id_: str = "event_id", delay: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """``id_``, ``key``, ``us`` and admitted of every row, in each key's order (STR2).

    Rows come out once the watermark, ``delay`` behind the newest, has reached them; rows behind it are dropped and
    counted by the query's progress. Times are after 1970; rows without one are left out; a null key is a key. Keys are
    atomic and not binary. With ``buckets`` that many groups of keys have a state each, else every key has.
    """
    keyed_state(events.sparkSession)
    types = dict(events.dtypes)
    out = f"id {types[id_]}, `{key}` string, us long, admitted boolean"
    step = Limiter(key, types[id_], limit, width)
    done = _ordered(events, key, F.col(us), id_, delay, buckets).transformWithStateInPandas(step, out, "Append", "EventTime")
    return done.select(F.col("id").alias(id_), F.col(key).cast(types[key]).alias(key), F.col("us").alias(us), "admitted")


def dedup(docs: DataFrame, key: str, ts: str, doc_id: str, ttl: int = DAY_US, delay: str = "0 seconds", buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``key``, is_duplicate and existing_id under a TTL of microseconds on event time (DED3).

    Rows without a key are nobody's duplicates and pass at once. Of rows of one time the one of least id is first. State
    of a key is gone when its TTL has passed. Keys and ``buckets`` as in ``rate_limit``.
    """
    keyed_state(docs.sparkSession)
    types = dict(docs.dtypes)
    out = f"id {types[doc_id]}, `{key}` string, us long, is_duplicate boolean, existing_id {types[doc_id]}"
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    step = FirstWithin(key, types[doc_id], ttl, max(ttl, 1))
    done = _ordered(docs.where(F.col(key).isNotNull()), key, us, doc_id, delay, buckets).transformWithStateInPandas(step, out, "Append", "EventTime")
    done = done.select(F.col("id").alias(doc_id), F.col(key).cast(types[key]).alias(key), "is_duplicate", "existing_id")
    free = docs.where(F.col(key).isNull()).select(doc_id, key, F.lit(False).alias("is_duplicate"), F.lit(None).cast(types[doc_id]).alias("existing_id"))
    return done.unionByName(free)


class Stopper(StatefulProcessor):
    """Counts an experiment's failed windows and gives one row when they reach the limit (STR8)."""

    def __init__(self, limit: float, failures: int):
        self.limit, self.failures = limit, failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        n = self.count.get()[0] if self.count.exists() else 0
        if n < self.failures:
            # Windows that close together are a few at most: one every half minute of the watermark's step.
            failed = pd.concat([f[f["error_rate"] > self.limit] for f in rows]).sort_values("window_start")
            if len(failed):
                self.count.update((min(n + len(failed), self.failures),))
            if n + len(failed) >= self.failures:
                at = failed.iloc[self.failures - n - 1]
                yield pd.DataFrame({"experiment_id": [key[0]], "window_start": [at["window_start"]], "error_rate": [at["error_rate"]], "failures": [self.failures]})

    def close(self) -> None:
        pass


def canary_stop(rates: DataFrame, limit: float, failures: int) -> DataFrame:
    """One row per experiment, given by the running stream at the window that is its last failure allowed (STR8).

    ``rates``: experiment_id, window_start, error_rate of closed windows, from an append-mode aggregation.
    """
    keyed_state(rates.sparkSession)
    out = "experiment_id string, window_start timestamp, error_rate double, failures long"
    slim = rates.select("experiment_id", "window_start", "error_rate")
    return slim.groupBy("experiment_id").transformWithStateInPandas(Stopper(limit, failures), out, "Append", "None")
