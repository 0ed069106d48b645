"""Streams whose keys are dealt to groups: as many states as groups, and the results of keys on their own."""

import random

import pytest
from pyspark.sql import Row

from framewise.streaming import live, timers
from tests.test_timers import Clock

S = timers.SECOND


def log_rows(rng, keys, n, seq):
    kinds = ["frame"] * 10 + ["report", "capture", "trigger", "pause", "resume", "auto", "debounce"]
    out = []
    for i in range(seq, seq + n):
        kind = rng.choice(kinds)
        result = rng.choice(["ad", "content", "unknown"]) if kind in ("frame", "report", "trigger") else None
        out.append((rng.choice(keys), i, kind, result, rng.choice(["opencv", "llm", None]), rng.choice([True, False, None])))
    return out


def test_live_state_is_one_value_a_group(spark, tmp_path):
    """Fifty keys, one of them null, in three groups, in two micro-batches with a restart between them."""
    rng = random.Random(5)
    keys = [None, *[2**53 + k for k in range(49)]]
    parts = [log_rows(rng, keys, 700, 0), log_rows(rng, keys, 700, 700)]
    states = {}
    want = {}
    for key, seq, kind, result, source, flag in sum(parts, []):
        state = states.setdefault(key, [None, None, True, True, None, []])
        want[seq] = (key, kind, *live.step(state, kind, result, source, bool(flag), float(seq), seq))
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, "key long, seq long, kind string, result string, source string, flag boolean")
        rows.selectExpr("key", "CAST(timestamp_seconds(seq) AS timestamp_ntz) AS ts", "seq", "kind", "result", "source", "flag").write.parquet(str(tmp_path / f"log/{i}"))
        stream = live.live(spark.readStream.schema(live.LOG).parquet(str(tmp_path / "log/*")), groups=3)
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress.stateOperators[0].numRowsTotal <= 4
    got = {r["seq"]: (r["key"], r["kind"], r["prev"], r["committed"], r["changed"], r["suspicious"], r["emits"], r["saved"]) for r in spark.read.schema(live.OUT).parquet(str(tmp_path / "out")).collect()}
    assert got == want


@pytest.mark.parametrize("make", [timers.Saver, timers.InFlight, timers.StatusFeed])
@pytest.mark.parametrize("clock", ["event", "processing"])
def test_a_group_tells_what_its_keys_do_alone(make, clock):
    rng = random.Random(7)
    alone, group = {}, Clock(timers.Grouped(make(20, clock=clock)))
    told = lambda out: sorted(map(str, out))
    for at in range(0, 300, 15):
        rows = {}
        for seq in range(at, at + 12):
            key = rng.choice([None, 1, 2, 3])
            kind = rng.choice(["frame", "switch", "done", "status"])
            rows.setdefault(key, []).append(Row(key=key, us=seq * S, seq=seq, kind=kind, status=rng.choice(["ad", "content"])))
        own = []
        for key, given in rows.items():
            c = alone.setdefault(key, Clock(make(20, clock=clock)))
            c.move(at)
            own += [tuple(r) for r in c.processor.handleInputRows((key,), iter(given), c)]
        mixed = [r for given in rows.values() for r in given]
        rng.shuffle(mixed)
        assert told(tuple(r) for r in group.processor.handleInputRows((0,), iter(mixed), group)) == told(own)
        for key, c in alone.items():
            c.rang = [(key, *r) for r in c.move(at + 15)]
        rang, ms = [], (at + 15) * 1000
        while group.timers and min(group.timers) <= ms:
            group.ms = group.rung = min(group.timers)
            group.timers.discard(group.rung)
            rang += [tuple(r) for r in group.processor.handleExpiredTimer((0,), group, group)]
        group.ms = ms
        assert told(rang) == told(r for c in alone.values() for r in c.rang)
        assert len(group.timers) <= 1


def test_keepalives_due_at_once_leave_the_state_as_one_row(spark):
    """A day of them is one row, which Spark spreads."""
    rows = [Row(key=k, us=0, seq=k, kind="status", status="ad") for k in (1, 2)]
    plain, folded = timers.StatusFeed(30), timers.StatusFeed(30).folded()
    told = []
    for p in (plain, folded):
        c = Clock(timers.Grouped(p))
        out = [*c.processor.handleInputRows((0,), iter(rows), c)]
        c.ms = c.rung = 86_400_000
        told.append([tuple(r) for r in [*out, *c.processor.handleExpiredTimer((0,), c, c)]])
    assert len(told[0]) == 2 * (1 + 2880) and len(told[1]) == 4
    spread = plain.spread(spark.createDataFrame(told[1], folded.OUT))
    assert spread.columns == ["key", "us", "message", "status"] and sorted(map(tuple, spread.collect())) == sorted(told[0])


def test_frames_keep_nulls_and_long_numbers(spark, tmp_path):
    """Null keys, sequence numbers and statuses, keys that no float holds, and times that nanoseconds do not reach."""
    big = 2**53 + 1
    given = [(None, 5, None, "ad"), (big, 6, big, None), (big, 7, None, "content"), (-1, 8, big + 2, "ad"), (big, 10**10, 4, "ad"), (0, 10**10, 5, None)]
    rows = spark.createDataFrame(given, "key long, at long, seq long, status string").selectExpr("key", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS ts", "seq", "'status' AS kind", "status")
    rows.write.parquet(str(tmp_path / "log"))
    timers.use_store(spark)
    silence = 10**9
    stream = timers.timed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")), timers.StatusFeed(silence), groups=1)
    assert "n" not in stream.columns
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(str, map(tuple, spark.read.schema(timers.StatusFeed.OUT).parquet(str(tmp_path / "out")).collect())))
    want = [(k, at * S, "change", s) for k, at, _, s in given]
    for k, at, s in ((None, 5, "ad"), (big, 7, "content"), (-1, 8, "ad")):
        want += [(k, (at + i * silence) * S, "keepalive", s) for i in range(1, 10)]
    assert got == sorted(map(str, want))


def test_late_rows_of_a_stream_are_still_left_out(spark, tmp_path):
    timers.use_store(spark)
    for i, at in enumerate((100, 200, 50, 300)):  # the watermark for late rows is that of the batch before
        rows = spark.createDataFrame([(1, at, i, f"s{i}")], "key long, at long, seq long, status string")
        rows = rows.selectExpr("key", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS ts", "seq", "'status' AS kind", "status")
        rows.write.parquet(str(tmp_path / f"log/{i}"))
        stream = timers.timed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log/*")), timers.StatusFeed(10**6), groups=1)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["status"] for r in spark.read.schema(timers.StatusFeed.OUT).parquet(str(tmp_path / "out")).collect()) == ["s0", "s1", "s3"]
