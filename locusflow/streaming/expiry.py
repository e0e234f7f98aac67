"""State that ends by itself: sessions that close, guests that expire, windows that reset, by timers on event time.

Rows of a key wait in its state until the watermark has passed them, and are then taken in the order of (ts, seq): so rows
that come late, but within the watermark's delay, count where they belong, and a stream gives what a batch over the same
rows gives. Nothing is scanned for what is due: every row and every end sets a timer, and the store wakes the keys
whose timers are over. A key whose session is closed, guest gone or window over keeps no state.

Input rows: key STRING, ts TIMESTAMP, seq BIGINT (the order of equal times), kind STRING.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row as it waits: microseconds, order, kind.
WAITING = "us bigint, seq bigint, kind string"
Row = tuple[int, int, str]


class InOrder(StatefulProcessor):
    """Hands a key's rows to `take` in order, once the watermark has passed them, and due times to `due`."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def take(self, key: str, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, key: str, us: int) -> Iterator[tuple]:
        return iter(())

    def wake(self, us: int) -> None:
        """Sets a timer for the first millisecond at or after a time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        us = got["ts"].astype("datetime64[us]").astype("int64")
        new = [(int(t), int(s), str(k)) for t, s, k in zip(us, got["seq"], got["kind"], strict=True)]
        self.waiting.appendList(new)
        for t in sorted({-(-t // 1000) for t, _, _ in new}):
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        out = [x for r in ready for x in self.take(key[0], r)] + list(self.due(key[0], now))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Sessions(InOrder):
    """Sessions that an end closes, or so long without a row."""

    columns = ["key", "begin_us", "end_us", "n", "closed_by"]

    def __init__(self, ends: str, idle_seconds: int):
        self.ends, self.idle = ends, idle_seconds * 1_000_000

    def open(self) -> None:
        self.now = self.handle.getValueState("session", "begin bigint, last bigint, n bigint")

    def _closed(self, key: str, by: str) -> tuple:
        begin, last, n = self.now.get()
        self.now.clear()
        return key, begin, last, n, by

    def take(self, key: str, row: Row) -> Iterator[tuple]:
        us, _, kind = row
        if self.now.exists() and us - self.now.get()[1] > self.idle:
            yield self._closed(key, "idle")
        begin, _, n = self.now.get() if self.now.exists() else (us, us, 0)
        self.now.update((begin, us, n + 1))
        if kind == self.ends:
            yield self._closed(key, "end")
        else:
            self.wake(us + self.idle + 1)

    def due(self, key: str, us: int) -> Iterator[tuple]:
        if self.now.exists() and us - self.now.get()[1] > self.idle:
            yield self._closed(key, "idle")


class Guests(InOrder):
    """Guests that weren't seen for so long; one who has joined doesn't expire."""

    columns = ["key", "last_us"]

    def __init__(self, joined: str, seconds: int):
        self.joined, self.life = joined, seconds * 1_000_000

    def open(self) -> None:
        self.seen = self.handle.getValueState("seen", "last bigint, joined boolean")

    def take(self, key: str, row: Row) -> Iterator[tuple]:
        us, _, kind = row
        joined = kind == self.joined or (self.seen.exists() and self.seen.get()[1])
        self.seen.update((us, joined))
        if not joined:
            self.wake(us + self.life + 1)
        return iter(())

    def due(self, key: str, us: int) -> Iterator[tuple]:
        if self.seen.exists():
            last, joined = self.seen.get()
            if not joined and us - last > self.life:
                self.seen.clear()
                yield key, last


class Windows(InOrder):
    """Each row's place in the fixed window of its key, and whether the limit lets it pass."""

    columns = ["key", "us", "seq", "place", "allowed"]

    def __init__(self, seconds: int, limit: int):
        self.width, self.limit = seconds * 1_000_000, limit

    def open(self) -> None:
        self.count = self.handle.getValueState("count", "window bigint, n bigint")

    def take(self, key: str, row: Row) -> Iterator[tuple]:
        us, seq, _ = row
        window = us // self.width
        have = self.count.get() if self.count.exists() else (window, 0)
        n = have[1] + 1 if have[0] == window else 1
        self.count.update((window, n))
        self.wake((window + 1) * self.width)
        yield key, us, seq, n, n <= self.limit

    def due(self, key: str, us: int) -> Iterator[tuple]:
        if self.count.exists() and us // self.width > self.count.get()[0]:
            self.count.clear()
        return iter(())


def _run(events: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    keyed = events.select("key", "ts", "seq", "kind").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def closed_sessions(events: DataFrame, *, ends: str, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, begin_us, end_us, n, closed_by) of each session once it is closed: by an `ends` row, or after so long without a row."""
    return _run(events, Sessions(ends, idle_seconds), "key string, begin_us bigint, end_us bigint, n bigint, closed_by string", late)


def expired_guests(events: DataFrame, *, joined: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, last_us) of each guest once it wasn't seen for so long; a later row makes it a guest anew."""
    return _run(events, Guests(joined, seconds), "key string, last_us bigint", late)


def rate_limited(events: DataFrame, *, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """(key, us, seq, place, allowed) of every row, as `logs.rate_limited` has them."""
    return _run(events, Windows(seconds, limit), "key string, us bigint, seq bigint, place bigint, allowed boolean", late)
