"""The live ad/content state as layered windows over a log of frames and commands.

Columns of a log: key, ts, seq, kind (frame, report, debounce, auto, trigger, pause, resume),
result, source, flag. All windows share one partitioning and order (key; ts, seq), so a log is
shuffled and sorted once; state never leaves its key, and each layer is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP_FRAMES = 5
PAUSE_S = 30


def _order():
    return W.partitionBy("key").orderBy("ts", "seq")


def before(value: Column) -> Column:
    """The last value that is not null, in the rows before this one."""
    return F.last(value, ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, -1))


def upto(value: Column) -> Column:
    """The last value that is not null, this row's included."""
    return F.last(value, ignorenulls=True).over(_order().rowsBetween(W.unboundedPreceding, 0))


def switches(result: Column) -> Column:
    return result.isin("ad", "content")


def debounced(frames: DataFrame, debounce: bool = True) -> DataFrame:
    """Frames with prev (the result before that is not unknown), set and committed state, changed and suspicious.

    A result commits if it is ad or content and debouncing is off, it is from opencv, or it is equal
    to prev. unknown neither counts as prev nor stands between equal results.
    """
    known = F.when(F.col("result") != "unknown", F.col("result"))
    agrees = (F.col("source") == "opencv") | F.coalesce(F.col("result") == F.col("prev"), F.lit(False)) | F.lit(not debounce)
    out = frames.withColumn("prev", before(known)).withColumn("setv", F.when(switches(F.col("result")) & agrees, F.col("result")))
    out = out.withColumns({"state_before": before(F.col("setv")), "committed": upto(F.col("setv")), "last_result": upto(known)})
    return out.withColumns(
        {
            "changed": F.col("setv").isNotNull() & ~F.col("setv").eqNullSafe(F.col("state_before")),
            "suspicious": switches(F.col("result"))
            & F.col("prev").isNotNull()
            & (F.col("result") != F.col("prev"))
            & ~F.col("result").eqNullSafe(F.col("state_before")),
            "pending": F.col("last_result").isNotNull() & ~F.col("last_result").eqNullSafe(F.col("committed")),
        }
    )


def replayed(log: DataFrame, debounce: bool = True, auto: bool = True) -> DataFrame:
    """A log with the whole state after each row and what the row makes switch.

    report sets state and prev, and pauses switching for 30 s if it is automatic; trigger ends
    automatic switching; resume starts it again and ends a pause; flags come from debounce and auto.
    """
    kind, result = F.col("kind"), F.col("result")
    seconds = F.col("ts").cast("timestamp").cast("double")
    first = log.withColumns(
        {
            "prev": before(F.when((kind == "report") | ((kind == "frame") & (result != "unknown")), result)),
            "debounce": F.coalesce(upto(F.when(kind == "debounce", F.col("flag"))), F.lit(debounce)),
            "auto_switch": F.coalesce(
                upto(F.when(kind == "auto", F.col("flag")).when(kind == "trigger", F.lit(False)).when(kind == "resume", F.lit(True))), F.lit(auto)
            ),
        }
    )
    commits = (F.col("source") == "opencv") | F.coalesce(result == F.col("prev"), F.lit(False)) | ~F.col("debounce")
    second = first.withColumns(
        {
            "setv": F.when(kind == "report", result).when((kind == "frame") & switches(result) & F.coalesce(commits, F.lit(False)), result),
            "setp": F.when((kind == "pause") | ((kind == "report") & F.col("auto_switch")), seconds + PAUSE_S).when(kind == "resume", F.lit(-1.0)),
        }
    )
    third = second.withColumns(
        {"state_before": before(F.col("setv")), "committed": upto(F.col("setv")), "paused_until": upto(F.col("setp"))}
    )
    changed = (kind == "frame") & F.col("setv").isNotNull() & ~F.col("setv").eqNullSafe(F.col("state_before"))
    paused = F.coalesce(F.col("paused_until") > seconds, F.lit(False))
    return third.withColumns(
        {
            "changed": changed,
            "paused": paused,
            "suspicious": (kind == "frame")
            & F.coalesce(switches(result) & (result != F.col("prev")), F.lit(False))
            & ~result.eqNullSafe(F.col("state_before")),
            "emits": F.when(changed & F.col("auto_switch") & ~paused, F.col("setv"))
            .when((kind == "resume") & switches(F.col("committed")), F.col("committed"))
            .when(((kind == "report") & F.coalesce(F.col("flag"), F.lit(False))) | (kind == "trigger"), result),
        }
    )


def ring(frames: DataFrame, n: int = KEEP_FRAMES) -> DataFrame:
    """The last n rows of each key, latest first, with their place."""
    latest = W.partitionBy("key").orderBy(F.desc("ts"), F.desc("seq"))
    return frames.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= n)


def flushed(frames: DataFrame, trigger: Column, n: int = KEEP_FRAMES) -> DataFrame:
    """For each row that meets trigger the n rows up to it, numbered from 0 as they are saved: key, at, idx, seq."""
    held = F.collect_list("seq").over(_order().rowsBetween(1 - n, 0))
    return (
        frames.withColumn("held", held)
        .filter(trigger)
        .select("key", F.col("seq").alias("at"), F.posexplode("held").alias("idx", "seq"))
    )


def periodic(frames: DataFrame, every: str = "1 minute", n: int = KEEP_FRAMES) -> DataFrame:
    """What a timer saves: of each period of a key the last n frames, all newer than the save before."""
    period = F.window("ts", every)["end"]
    latest = W.partitionBy("key", "saved_at").orderBy(F.desc("ts"), F.desc("seq"))
    oldest = W.partitionBy("key", "saved_at").orderBy("ts", "seq")
    kept = frames.withColumn("saved_at", period).withColumn("r", F.row_number().over(latest)).filter(F.col("r") <= n)
    return kept.withColumn("idx", F.row_number().over(oldest) - 1).drop("r")


def recently(frames: DataFrame, mark: Column, seconds: float = 3.0) -> DataFrame:
    """Frames with since: seconds since the last marked row of the key, and recent: whether that is within the limit."""
    at = F.col("ts").cast("timestamp").cast("double")
    out = frames.withColumn("since", at - upto(F.when(mark, at)))
    return out.withColumn("recent", F.coalesce(F.col("since") <= seconds, F.lit(False)))


def in_force(log: DataFrame, command: Column, default: str) -> DataFrame:
    """log with in_force: the value of the last command (null: no command) of its key up to and with each row, at first the default."""
    return log.withColumn("in_force", F.coalesce(upto(command), F.lit(default)))
