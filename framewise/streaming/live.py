"""The live state on a stream: the streaming twin of operators.state.

A log of frames and commands (columns key, ts, seq, kind, result, source, flag) is read as a stream;
each key's state is a dozen values and the last five frames. Keys are dealt to a fixed number of groups
by hash, and the states of a group are one value of the state store, as a call and a value for each key
cost far more than its rows. Rows of a key are taken in order (ts, seq) within a micro-batch. A row that comes after later rows of its key were processed is applied on arrival, as in
the application, whose order is that of arrival. State lives in the checkpoint and survives restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewise.operators.state import KEEP_FRAMES, PAUSE_S

LOG = "key bigint, ts timestamp_ntz, seq bigint, kind string, result string, source string, flag boolean"
OUT = "key bigint, seq bigint, kind string, prev string, committed string, changed boolean, suspicious boolean, emits string, saved array<bigint>"
# A field must not be named cls.
STATE = "keys array<struct<key: bigint, prev: string, committed: string, debounce: boolean, auto_switch: boolean, paused_until: double, ring: array<bigint>>>"
#: Groups that keys are dealt to; a checkpoint is bound to it.
GROUPS = 1024


def group_of(key: str, groups: int = GROUPS) -> Column:
    """The group of a key; rows without a key are a group of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))


def step(state: list, kind: str, result: str | None, source: str, flag: bool, at: float, seq: int) -> tuple:
    """One row of the log on a key's state, changed in place; returns what OUT has after kind."""
    prev, committed, debounce, auto, until, ring = state
    before, emits, suspicious, changed, saved = prev, None, False, False, []
    if kind == "frame":
        ring = [*ring, seq][-KEEP_FRAMES:]
        valid = result in ("ad", "content")
        suspicious = valid and prev is not None and result != prev and result != committed
        if suspicious:
            saved = ring
        if valid and (source == "opencv" or result == prev or not debounce) and result != committed:
            committed, changed = result, True
            if auto and not (until is not None and until > at):
                emits = result
        if result != "unknown":
            prev = result
    elif kind == "report":
        prev = committed = result
        if auto:
            until = at + PAUSE_S
        emits = result if flag else None
        saved = ring
    elif kind == "capture":
        saved = ring
    elif kind == "trigger":
        auto, emits = False, result
    elif kind == "pause":
        until = at + PAUSE_S
    elif kind == "resume":
        auto, until = True, -1.0
        emits = committed if committed in ("ad", "content") else None
    elif kind == "auto":
        auto = flag
    elif kind == "debounce":
        debounce = flag
    state[:] = [prev, committed, debounce, auto, until, ring]
    return before, committed, changed, suspicious, emits, saved


def live(log: DataFrame, debounce: bool = True, auto: bool = True, groups: int = GROUPS) -> DataFrame:
    """The stream of OUT rows of a stream of LOG rows."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = {key: [*state[:-1], list(state[-1])] for key, *state in held.get[0]} if held.exists else {}
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        plain = lambda c: rows[c].astype(object).where(rows[c].notna(), None)
        out = []
        for key, seq, kind, result, source, flag, at in zip(plain("key"), rows["seq"], rows["kind"], plain("result"), rows["source"], plain("flag"), seconds, strict=True):
            state = states.setdefault(key, [None, None, debounce, auto, None, []])
            out.append((key, seq, kind, *step(state, kind, result, source, bool(flag), at, int(seq))))
        held.update(([(key, *state) for key, state in states.items()],))
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "prev", "committed", "changed", "suspicious", "emits", "saved"])

    return log.withColumn("group", group_of("key", groups)).groupBy("group").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def read_log(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """A folder of parquet files as a stream; the number of files in a micro-batch is bounded."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).parquet(path)


def write_each(out: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Start a query that hands every micro-batch to sink (frame, batch number); a batch may come again after a failure."""
    return out.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(sink).start()


def minute_counts(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """An addition of our own: frames a minute by result, with a watermark for late rows."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 minute"), "result").agg(F.count(F.lit(1)).alias("n"))
