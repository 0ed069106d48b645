"""Keyed timers on a stream: saves on the minute, the flag of switching, and the status feed.

Each is a processor for transformWithState: a key's state is one small value, and one timer stands at
the next time at which something falls due. On a stream keys are dealt to a fixed number of groups by
hash; a group's states are one value in the state store and have one timer, at the earliest of those
times, as calls of the store for each key cost far more than its rows. Rows of a key are taken in order
(us, seq) within a micro-batch. By the event clock time is that of rows, and timers ring when the
watermark passes; by the processing clock it is the wall clock. State and timers live in the checkpoint.

What a processor does is in start, take, due and wake, which know of no stream, so a test moves the
clock by hand.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from framewise.operators.state import KEEP_FRAMES
from framewise.streaming.live import GROUPS, group_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
# Seconds between saves, of silence before a keepalive.
SAVE_S, KEEPALIVE_S = 60, 30
#: A switch that is not acknowledged for so long is given up.
SWITCH_S = 30


def _plain(value):
    """Rows inside of what came from the state as tuples: the state store does not take them back."""
    return tuple(map(_plain, value)) if isinstance(value, tuple) else [_plain(v) for v in value] if isinstance(value, list) else value


class Timed(StatefulProcessor):
    """A processor with one value of state and one timer a key. clock: event or processing."""

    #: Fields of the state.
    COLUMNS: tuple[str, ...] = ()
    OUT = ""
    #: Whether what falls due before a row is settled when the row comes; else only timers settle it, so late rows still count.
    ROWS_SETTLE = True

    def __init__(self, clock: str = "event") -> None:
        self.clock = clock

    # What a processor is, on times in microseconds. held is a list, changed in place.

    def start(self) -> list:
        raise NotImplementedError

    def take(self, held: list, key: tuple, row: Row, at: int) -> Iterator[tuple]:
        """What a row makes come out, after the key."""
        raise NotImplementedError

    def due(self, held: list, key: tuple, until: int) -> Iterator[tuple]:
        """What falls due up to and with a time."""
        raise NotImplementedError

    def wake(self, held: list) -> int | None:
        """When something falls due next."""
        raise NotImplementedError

    # Where many rows come out at even steps, the state's side tells them as one and Spark spreads them.

    def folded(self) -> Timed:
        """The processor that a stream runs in the place of this one."""
        return self

    def spread(self, rows: DataFrame) -> DataFrame:
        """The rows of OUT from those of folded."""
        return rows

    def taken(self, held: list, key: tuple, rows: list[Row], now: int | None) -> Iterator[tuple]:
        """What rows in order make come out; now: the wall clock, or None for the times of rows."""
        for row in rows:
            at = row.us if now is None else now
            if self.ROWS_SETTLE:
                yield from self.due(held, key, at)
            yield from self.take(held, key, row, at)

    # The stream's side.

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", self.state())

    def state(self) -> str:
        return ", ".join(self.COLUMNS)

    def _now(self, timers: TimerValues) -> int:
        return 1000 * (timers.getCurrentWatermarkInMs() if self.clock == "event" else timers.getCurrentProcessingTimeInMs())

    def _held(self) -> list:
        found = self.value.get()
        return [_plain(v) for v in found] if found is not None else self.start()

    def _kept(self, held: list, before: int | None) -> None:
        self._timer(before, self.wake(held))
        self.value.update(tuple(held))

    def _timer(self, before: int | None, after: int | None) -> None:
        """Move the timer from one time to another, in microseconds."""
        ring = lambda us: None if us is None else -(-us // 1000)
        old, new = ring(before), ring(after)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self._held()
        before = self.wake(held)
        now = self._now(timerValues) if self.clock != "event" else None
        yield from self._rows(key, self.taken(held, key, sorted(rows, key=lambda r: (r.us, r.seq)), now))
        self._kept(held, before)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        # The timer that rang is gone; all that is due by now is settled at once.
        yield from self._rows(key, self.due(held, key, max(self._now(timerValues), 1000 * expiredTimerInfo.getExpiryTimeInMs())))
        self._kept(held, None)

    def _rows(self, key: tuple, told: Iterator[tuple]) -> Iterator[Row]:
        named = Row(*[c.split()[0] for c in self.OUT.split(", ")])
        return (named(*key, *t) for t in told)

    def close(self) -> None:
        pass


class Saver(Timed):
    """At the end of every period saves its last frames, which are all newer than the save before: saved_us, seq, idx.

    A frame of a period that is already saved comes too late, as it is older than the last save.
    """

    COLUMNS = ("periods array<struct<end: bigint, frames: array<struct<us: bigint, seq: bigint>>>>", "saved bigint")
    OUT = "key bigint, saved_us bigint, seq bigint, idx int"
    ROWS_SETTLE = False

    def __init__(self, seconds: int = SAVE_S, n: int = KEEP_FRAMES, clock: str = "event") -> None:
        super().__init__(clock)
        self.period, self.n = seconds * SECOND, n

    def start(self) -> list:
        return [[], None]

    def take(self, held: list, key: tuple, row: Row, at: int) -> Iterator[tuple]:
        end = (at // self.period + 1) * self.period
        if row.kind == "frame" and (held[1] is None or end > held[1]):
            # Many periods can be open; only the one of the row is touched.
            i = bisect_left(held[0], end, key=itemgetter(0))
            old = held[0][i][1] if i < len(held[0]) and held[0][i][0] == end else None
            held[0][i : i + (old is not None)] = [(end, sorted([*(old or []), (at, row.seq)])[-self.n :])]
        return iter(())

    def due(self, held: list, key: tuple, until: int) -> Iterator[tuple]:
        for end, frames in [p for p in held[0] if p[0] <= until]:
            yield from ((end, seq, i) for i, (_, seq) in enumerate(frames))
            held[1] = end
        held[0] = [p for p in held[0] if p[0] > until]

    def wake(self, held: list) -> int | None:
        return min((p[0] for p in held[0]), default=None)


class InFlight(Timed):
    """The flag that a switch is under way, from its command to its acknowledgement or, failing that, for a time: us, seq of the command, in_flight, why."""

    COLUMNS = ("seq bigint", "until bigint")
    OUT = "key bigint, us bigint, seq bigint, in_flight boolean, why string"

    def __init__(self, seconds: float = SWITCH_S, clock: str = "event") -> None:
        super().__init__(clock)
        self.most = int(seconds * SECOND)

    def start(self) -> list:
        return [None, None]

    def take(self, held: list, key: tuple, row: Row, at: int) -> Iterator[tuple]:
        if row.kind == "switch":
            held[:] = [row.seq, at + self.most]
            yield at, row.seq, True, "started"
        elif row.kind == "done" and held[0] is not None:
            yield at, held[0], False, "acknowledged"
            held[:] = self.start()

    def due(self, held: list, key: tuple, until: int) -> Iterator[tuple]:
        if held[1] is not None and held[1] <= until:
            yield held[1], held[0], False, "expired"
            held[:] = self.start()

    def wake(self, held: list) -> int | None:
        return held[1]


class StatusFeed(Timed):
    """Changes of a status only, and a keepalive after every so many seconds without a message: us, message, status."""

    COLUMNS = ("status string", "sent bigint")
    OUT = "key bigint, us bigint, message string, status string"

    def __init__(self, seconds: float = KEEPALIVE_S, clock: str = "event") -> None:
        super().__init__(clock)
        self.silence = int(seconds * SECOND)

    def start(self) -> list:
        return [None, None]

    def take(self, held: list, key: tuple, row: Row, at: int) -> Iterator[tuple]:
        if row.kind == "status" and (held[1] is None or row.status != held[0]):
            held[:] = [row.status, at]
            yield at, "change", row.status

    def due(self, held: list, key: tuple, until: int) -> Iterator[tuple]:
        while held[1] is not None and held[1] + self.silence <= until:
            held[1] += self.silence
            yield held[1], "keepalive", held[0]

    def wake(self, held: list) -> int | None:
        return None if held[1] is None else held[1] + self.silence

    def folded(self) -> Timed:
        return FoldedFeed(self.silence / SECOND, self.clock)

    def spread(self, rows: DataFrame) -> DataFrame:
        step = F.lit(self.silence)
        return rows.withColumn("us", F.explode(F.sequence("us", F.col("us") + (F.col("n") - 1) * step, step))).drop("n")


class FoldedFeed(StatusFeed):
    """The feed with the keepalives that fall due at once as one row: us of the first, message, status, n.

    A row that leaves Python costs far more than one that Spark makes, and a task holds all that its timers tell at a time.
    """

    OUT = StatusFeed.OUT + ", n bigint"

    def take(self, held: list, key: tuple, row: Row, at: int) -> Iterator[tuple]:
        return ((*told, 1) for told in super().take(held, key, row, at))

    def due(self, held: list, key: tuple, until: int) -> Iterator[tuple]:
        n = 0 if held[1] is None else (until - held[1]) // self.silence
        if n > 0:
            yield held[1] + self.silence, "keepalive", held[0], n
            held[1] += n * self.silence


class Grouped(Timed):
    """A processor over groups of keys: a group's value is the states of its keys, its timer is the earliest of theirs."""

    def __init__(self, one: Timed) -> None:
        super().__init__(one.clock)
        self.one, self.OUT = one, one.OUT

    def state(self) -> str:
        return "keys array<struct<key: bigint, " + ", ".join(c.replace(" ", ": ", 1) for c in self.one.COLUMNS) + ">>, wake bigint"

    def _read(self) -> tuple[dict, int | None]:
        found = self.value.get()
        return ({}, None) if found is None else ({key: [_plain(v) for v in held] for key, *held in found[0]}, found[1])

    def _write(self, states: dict, before: int | None) -> None:
        wake = min((w for w in map(self.one.wake, states.values()) if w is not None), default=None)
        self._timer(before, wake)
        # A state as at the start need not be kept.
        self.value.update(([(key, *held) for key, held in states.items() if held != self.one.start()], wake))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        states, before = self._read()
        now = self._now(timerValues) if self.clock != "event" else None
        own: dict = {}
        for row in rows:
            own.setdefault(row.key, []).append(row)
        for k, given in own.items():
            given.sort(key=lambda r: (r.us, r.seq))
            yield from self._rows((k,), self.one.taken(states.setdefault(k, self.one.start()), (k,), given, now))
        self._write(states, before)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        states, _ = self._read()
        until = max(self._now(timerValues), 1000 * expiredTimerInfo.getExpiryTimeInMs())
        for k, held in states.items():
            yield from self._rows((k,), self.one.due(held, (k,), until))
        self._write(states, None)


#: Whole numbers that may be null: pandas has no null among them, so a bit of `nulls` tells that there is one.
NUMBERS = ("key", "us", "seq")
#: Times of pandas reach as far, in microseconds.
PANDAS_US = 9 * 10**15
#: Rows in a frame that comes out.
AT_ONCE = 10_000


class Framed(Grouped):
    """Groups whose rows come and go as frames: where Spark hands Rows over it makes them cell by cell, which took most of the time of a micro-batch."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return self._frames(super().handleInputRows(key, self._given(rows), timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frames(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def _given(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            cells = {}
            for c in frame.columns.drop(["ts", "group", "nulls"]):
                column = frame[c]
                cells[c] = (column.astype(object).where(column.notna(), None) if column.hasnans else column).tolist()
            nulls = frame["nulls"].to_numpy()
            for i, c in enumerate(NUMBERS):
                for at in (nulls >> i & 1).nonzero()[0].tolist():
                    cells[c][at] = None
            yield from map(namedtuple("Given", cells, rename=True)._make, zip(*cells.values(), strict=True))

    def _rows(self, key: tuple, told: Iterator[tuple]) -> Iterator[tuple]:
        return ((*key, *t) for t in told)

    def _frames(self, told: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.OUT.split(", ")]
        while some := list(islice(told, AT_ONCE)):
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*some, strict=True), strict=True)})


def timed(rows: DataFrame, processor: Timed, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """The stream of a processor's rows from a stream of rows (key, ts, seq, kind, …); rows may come late by so much. Needs the state store of `use_store`."""
    at = F.col("ts").cast("timestamp")
    rows = rows.withColumns({"ts": at, "us": F.unix_micros(at)})
    if processor.clock == "event":
        rows = rows.withWatermark("ts", late)
    nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(NUMBERS)), F.lit(0))
    # Behind the watermark ts only tells late rows from others; a time that pandas cannot hold is never late.
    near = F.when(F.col("us").between(-PANDAS_US, PANDAS_US), F.col("ts")).alias("ts", metadata=rows.schema["ts"].metadata)
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS]
    rest = [c for c in rows.columns if c not in ("ts", *NUMBERS)]
    rows = rows.select(near, *numbers, *rest, group_of("key", groups).alias("group"), nulls.alias("nulls"))
    one = processor.folded()
    mode = "EventTime" if processor.clock == "event" else "ProcessingTime"
    return processor.spread(rows.groupBy("group").transformWithStateInPandas(Framed(one), one.OUT, "append", mode))


def use_store(spark: SparkSession) -> None:
    """Timers need a state store that lists them; it is a setting of the session, read when a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
