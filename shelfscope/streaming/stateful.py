"""Streams whose keys hold state of their own: order restored, alerts and rebuilds fired once.

What a key gets may come late, twice and in any order of files.  Rows wait in the key's state until
the watermark has passed them; a timer then takes them out in the order of their time, so the result
is that of the sorted input, however it arrived.  Each job is one keyed operator with its state in
RocksDB, checkpointed in the shared folder; state goes when the watermark or its time to live says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows


class _Ordered(StatefulProcessor):
    """Holds rows (at: milliseconds, id, value) until the watermark has passed them; subclasses say what a row then makes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<bigint>, id array<bigint>, value array<int>")
        self.last = handle.getValueState("last", "id bigint, value int, n bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = list(zip(*self.held.get(), strict=True)) if self.held.exists() else []
        known = set(now)
        for frame in rows:
            for at, id_, value in zip(frame["at"], frame["id"], frame["value"], strict=True):
                row = (int(at), int(id_), None if pd.isna(value) else int(value))
                if row not in known:  # delivered twice
                    known.add(row)
                    now.append(row)
        self._hold(now)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        now = list(zip(*self.held.get(), strict=True)) if self.held.exists() else []
        ready = sorted((r for r in now if r[0] <= passed), key=lambda r: (r[0], r[1]))
        self._hold([r for r in now if r[0] > passed])
        if ready:
            yield self.made(key, ready)

    def _hold(self, rows: list[tuple]) -> None:
        if rows:
            self.held.update(tuple(list(c) for c in zip(*rows, strict=True)))
            self.handle.registerTimer(min(r[0] for r in rows))
        else:
            self.held.clear()

    def made(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError


class _Diffs(_Ordered):
    """Each value against the one before it."""

    def made(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        before = self.last.get()[1] if self.last.exists() else None
        out = []
        for _, id_, value in rows:
            out.append((key[0], id_, value, value - before if value is not None and before is not None else None))
            before = value
        self.last.update((rows[-1][1], before, 0))
        return pd.DataFrame(out, columns=["key", "id", "value", "delta"]).astype({"value": "Int32", "delta": "Int32"})


class _Alerts(_Ordered):
    """A report that asks for an alert fires one, unless its key had one within the quiet time before."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet = quiet_ms

    def made(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        fired_at = self.last.get()[2] if self.last.exists() else None
        out = []
        for at, id_, value in rows:
            if fired_at is None or at - fired_at > self.quiet:
                out.append((key[0], id_, value))
                fired_at = at
                self.last.update((id_, value, at))
        return pd.DataFrame(out, columns=["key", "id", "value"]).astype({"key": "int64", "id": "int64", "value": "Int32"})


def ordered_diffs(rows: DataFrame) -> DataFrame:
    """key, id, value, delta: each value of a key against the one before it by time, whatever order they arrive in.

    ``rows`` is a stream of key (never null), time (with a watermark), at (time in milliseconds), id and value; rows that come after the watermark are dropped.
    """
    return _keyed(rows).groupBy("key").transformWithStateInPandas(_Diffs(), "key long, id long, value int, delta int", "append", "EventTime")


def alerts_once(rows: DataFrame, quiet_ms: int) -> DataFrame:
    """key, id, value: of the rows that ask for an alert, by time, those that come when none was fired for ``quiet_ms``; each once, also if delivered twice."""
    return _keyed(rows).groupBy("key").transformWithStateInPandas(_Alerts(quiet_ms), "key long, id long, value int", "append", "EventTime")


class _Barrier(StatefulProcessor):
    """Counts different parts of a key; fires once when all are there."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "parts array<bigint>, done boolean, last bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts, done, last = self.seen.get() if self.seen.exists() else ([], False, 0)
        parts, needed, fired = set(parts), 0, done
        for frame in rows:
            parts.update(int(p) for p in frame["part"])
            needed, last = max(needed, int(frame["needed"].max())), max(last, int(frame["at"].max()))
        done = done or len(parts) >= needed  # once fired, more parts change nothing
        self.seen.update(([] if done else sorted(parts), done, last))
        self.handle.registerTimer(last + self.ttl)
        if done and not fired:
            yield pd.DataFrame({"key": [key[0]], "needed": [needed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists() and self.seen.get()[2] + self.ttl <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
        yield from ()


def rebuild_once(rows: DataFrame, ttl_ms: int = 30 * 24 * 3_600_000) -> DataFrame:
    """key, needed: one row for each key when ``needed`` different parts of it have come; a key is forgotten a month of its stream's time after its last part.

    ``rows`` is a stream of key (never null), time (with a watermark), at (in milliseconds), part and needed; a key's parts are as many as one claim waits for.
    """
    return _keyed(rows).groupBy("key").transformWithStateInPandas(_Barrier(ttl_ms), "key long, needed int", "append", "EventTime")
