"""Processors of keyed timers, with a clock moved by hand."""

import pytest
from pyspark.sql import Row

from framewise.streaming import timers

S = timers.SECOND


class Clock:
    """A state store of one key, its timers and a wall clock."""

    def __init__(self, processor):
        self.processor, self.ms, self.value, self.timers = processor, 0, None, set()
        processor.init(self)

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs

    def getExpiryTimeInMs(self):
        return self.rung

    def move(self, seconds):
        """Go to a time; timers ring on the way."""
        out = []
        while self.timers and min(self.timers) <= seconds * 1000:
            self.ms = self.rung = min(self.timers)
            self.timers.discard(self.rung)
            out += [tuple(r)[1:] for r in self.processor.handleExpiredTimer((1,), self, self)]
        self.ms = int(seconds * 1000)
        return out

    def give(self, *rows):
        return [tuple(r)[1:] for r in self.processor.handleInputRows((1,), iter(rows), self)]


def row(kind, us=0, seq=0, status=None):
    return Row(us=us, seq=seq, kind=kind, status=status)


def test_keepalive_after_thirty_seconds_of_silence():
    c = Clock(timers.StatusFeed(clock="processing"))
    assert c.give(row("status", status="ad")) == [(0, "change", "ad")]
    assert c.move(29) == [] and c.give(row("status", status="ad")) == []
    assert c.move(61) == [(30 * S, "keepalive", "ad"), (60 * S, "keepalive", "ad")]
    assert c.give(row("status", status="content")) == [(61 * S, "change", "content")]
    assert c.move(90) == [] and c.move(91) == [(91 * S, "keepalive", "content")]
    assert len(c.timers) == 1


def test_switch_is_in_flight_until_acknowledged_or_expired():
    c = Clock(timers.InFlight(30, clock="processing"))
    assert c.give(row("done")) == [] and not c.timers
    assert c.give(row("switch", seq=1)) == [(0, 1, True, "started")]
    c.move(10)
    assert c.give(row("done")) == [(10 * S, 1, False, "acknowledged")] and not c.timers
    assert c.give(row("switch", seq=2)) == [(10 * S, 2, True, "started")]
    assert c.move(39) == [] and c.move(41) == [(40 * S, 2, False, "expired")]
    assert c.give(row("switch", seq=3), row("switch", seq=4))[-1] == (41 * S, 4, True, "started")
    assert c.move(100) == [(71 * S, 4, False, "expired")]


@pytest.mark.parametrize("late", [False, True])
def test_saves_hold_only_frames_newer_than_the_last(late):
    c = Clock(timers.Saver(60, n=3))
    frames = [row("frame", s * S, s) for s in (5, 10, 15, 20, 61)]
    assert c.give(*frames, row("capture", 30 * S, 30)) == []
    assert c.move(59) == []
    if late:
        c.give(row("frame", 59 * S, 59))
    kept = [15, 20, 59] if late else [10, 15, 20]
    assert c.move(60) == [(60 * S, s, i) for i, s in enumerate(kept)]
    assert c.give(row("frame", 58 * S, 58)) == [] and c.move(119) == []
    assert c.move(200) == [(120 * S, 61, 0)]
    assert c.value == ([], 120 * S) and not c.timers
