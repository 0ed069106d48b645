"""Messages with their length before them (4 bytes, lowest first), in streams that are cut anywhere into parts.

Where a message starts follows from the one before, so a stream seems to need reading from its start.
Here every part is read on its own. From each byte of a part, taken as the start of a message, follows
the first start beyond the part; nearly all of these paths run into each other, so a part has few
different ways out. Those ways out are nodes, and each leads to one further on; which of them are
really starts, the first one of each part that has any, is found by pointer doubling over the nodes:
as many joins as the number of parts has binary digits. Then each part reads its own messages, and
those that go over borders are put together from pieces. Short parts are put together first, so that
the work follows the bytes, not the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators import spans
from framewise.plans.persist import checkpointed

HEAD = 4
#: About the length of a part, for the join of places with parts.
CELL = 1 << 16
#: Bytes of a stream whose parts become one; longer parts stay as they are.
CHUNK = 1 << 18
#: Longer messages are taken for noise: a stream is not read beyond one.
MOST = 64 << 20
FAR = 1 << 62


def framed(payload: Column) -> Column:
    """A payload (binary) with its length before it."""
    n = F.octet_length(payload).cast("long")
    byte = lambda i: F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")
    return F.concat(F.unhex(F.concat(*[byte(i) for i in range(HEAD)])), payload)


def steps(data: bytes, more: bytes) -> np.ndarray:
    """From each byte of a part, taken as a message's start, the place of the next start, counted from the part's start (FAR: none). more: what follows the part, three bytes of it."""
    x = np.frombuffer(data + more, np.uint8).astype(np.int64)
    n = len(data)
    x = np.pad(x, (0, HEAD))
    heads = sum(x[i : i + n] << 8 * i for i in range(HEAD))
    return np.where(heads <= MOST, np.arange(n) + HEAD + heads, FAR)


def ways_out(step: np.ndarray) -> np.ndarray:
    """From each byte the first start beyond the part, by doubling."""
    n = len(step)
    while len(step):
        inside = step < n
        if not inside.any():
            break
        step = np.where(inside, step[np.minimum(step, n - 1)], step)
    return step


def placed(parts: DataFrame) -> DataFrame:
    """parts (stream, part, data) with start, end, more (what follows, three bytes) and total (the stream's length); empty and null parts go. Only lengths and three bytes of each part are put in order."""
    some = parts.filter("octet_length(data) > 0")
    order = W.partitionBy("stream").orderBy("part")
    head = some.select("stream", "part", F.octet_length("data").cast("long").alias("n"), F.substring("data", 1, HEAD - 1).alias("h"))
    end = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    follow = F.concat(*[F.coalesce(F.lead("h", i).over(order), F.unhex(F.lit(""))) for i in range(1, HEAD)])
    head = head.select("stream", "part", end.alias("end"), (end - F.col("n")).alias("start"), F.substring(follow, 1, HEAD - 1).alias("more"), F.sum("n").over(W.partitionBy("stream")).alias("total"))
    return some.select("stream", "part", "data").join(head, ["stream", "part"])


def chunked(parts: DataFrame) -> DataFrame:
    """Parts as `placed` gives them, those that start within the same CHUNK bytes of their stream as one, under the least number of them."""
    held = F.array_sort(F.collect_list(F.struct("start", F.hex("data").alias("x"))))
    whole = F.unhex(F.array_join(F.transform(held, lambda p: p["x"]), "")).alias("data")
    rows = parts.groupBy("stream", F.floor(F.col("start") / CHUNK).alias("chunk"))
    return rows.agg(
        F.min("part").alias("part"), F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("more", "start").alias("more"), F.max("total").alias("total"), whole
    ).drop("chunk")


def messages(parts: DataFrame) -> DataFrame:
    """The messages of streams of parts (stream, part, data; parts are whole numbers in order): stream, at (place of the message), payload, complete.

    A message that its stream ends in is not complete, nor is one that claims more than MOST bytes, with
    which its stream ends; fewer than four bytes at the end are no message.
    """
    # The parts are read three times; what is kept between the readings has a few rows a part.
    parts = checkpointed(chunked(placed(parts)))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("stream", "start", "data", "more", "total")), strict=True)
            out = [(s, int(p + q)) for s, p, d, m, total in rows for q in np.unique(ways_out(steps(d, m))) if p + q < total]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([q for _, q in out], pa.int64())], names=["stream", "at"])

    own = parts.select(F.col("stream").cast("string").alias("stream"), "part", "start", "end", "data", "more", "total")
    # Out of the last part of a stream no way leads on.
    inner = own.filter("`end` < total")
    nodes = inner.mapInArrow(exits, "stream string, at long").unionByName(own.select("stream", F.lit(0).cast("long").alias("at"))).distinct()
    at = nodes.select("stream", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    where = spans.overlapping(at, own.select("stream", "part", "start", "end"), ["stream"], CELL).groupBy("stream", "part").agg(F.collect_set("lo").alias("entries"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, p, d, m, entries in zip(*(b.column(c).to_pylist() for c in ("stream", "start", "data", "more", "entries")), strict=True):
                way = ways_out(steps(d, m))
                out += [(s, e, int(p + way[e - p])) for e in entries]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["stream", "at", "to"])

    jump = checkpointed(inner.join(where, ["stream", "part"]).mapInArrow(edges, "stream string, at long, to long"))
    real = own.select("stream").distinct().withColumn("at", F.lit(0).cast("long"))
    most = own.groupBy("stream").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        # After k rounds: the first 2 ** k of the starts, and jumps over as many.
        real = checkpointed(real.unionByName(real.join(jump, ["stream", "at"]).select("stream", F.col("to").alias("at"))).distinct())
        further = jump.select("stream", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = checkpointed(jump.join(further, ["stream", "to"]).select("stream", "at", F.col("next").alias("to")))
    entry = real.select("stream", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    entry = spans.overlapping(entry, own.select("stream", "part", "start", "end"), ["stream"], CELL).groupBy("stream", "part").agg(F.min("lo").alias("entry"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, p, d, m, e in zip(*(b.column(c).to_pylist() for c in ("stream", "start", "data", "more", "entry")), strict=True):
                x, i = d + m, e - p
                while i < len(d):
                    n = int.from_bytes(x[i : i + HEAD], "little")
                    j = i + HEAD + n if n <= MOST else FAR
                    if i + HEAD <= len(d) + len(m):
                        out.append((s, p + i, p + j, b"" if j == FAR else d[i + HEAD : j] if j <= len(d) else None, j != FAR))
                    i = j
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["stream", "at", "to", "payload", "complete"])

    found = checkpointed(own.join(entry, ["stream", "part"]).mapInArrow(read, "stream string, at long, to long, payload binary, complete boolean"))
    whole = found.filter("payload IS NOT NULL").select("stream", "at", "payload", "complete")
    cut = found.filter("payload IS NULL").select("stream", "at", (F.col("at") + HEAD).alias("lo"), F.col("to").alias("hi"))
    pieces = spans.pieced(spans.overlapping(cut, own.select("stream", "start", "end", "data"), ["stream"], CELL), ["stream", "at"], "data", "payload")
    joined = cut.join(pieces, ["stream", "at"], "left").withColumn("payload", F.coalesce("payload", F.unhex(F.lit(""))))
    return whole.unionByName(joined.select("stream", "at", "payload", (F.octet_length("payload") == F.col("hi") - F.col("lo")).alias("complete")))
