"""The audio ring: the last seconds of sound as chunks of samples, and slices of it as WAV files.

Chunks (key, ts, seq, pcm) are 16-bit samples of all channels. A running count of samples gives every
chunk its place; a slice is a stretch of sample numbers, cut out of the chunks that hold it. Only
lengths are counted in order by key; the sound itself is joined by stretches of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.operators import spans

# Samples a second, channels, bytes of a sample, seconds that are kept.
RATE, CHANNELS, WIDTH = 44_100, 1, 2
KEEP_S = 10.0


def little(n: Column, size: int) -> Column:
    """A whole number as binary of a size, lowest byte first."""
    byte = lambda i: F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")
    return F.unhex(F.concat(*[byte(i) for i in range(size)]))


def wav(pcm: Column, rate: int = RATE, channels: int = CHANNELS) -> Column:
    """A WAV file of 16-bit samples."""
    text = lambda s: F.encode(F.lit(s), "UTF-8")
    n, frame = F.octet_length(pcm), channels * WIDTH
    head = [text("RIFF"), little(n + 36, 4), text("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(channels), 2)]
    head += [little(F.lit(rate), 4), little(F.lit(rate * frame), 4), little(F.lit(frame), 2), little(F.lit(8 * WIDTH), 2), text("data"), little(n, 4)]
    return F.concat(*head, pcm)


def slices(chunks: DataFrame, requests: DataFrame, rate: int = RATE, channels: int = CHANNELS, keep_s: float = KEEP_S) -> DataFrame:
    """For every request (key, ts, seq, ms) the last ms milliseconds that the ring held then: key, seq, n_samples, wav.

    The ring drops its oldest chunk, as a whole, while it holds more than keep_s seconds. A slice of an
    empty ring is silence of the length asked for; of a ring that holds less, all it holds. A chunk of
    the request's own (ts, seq) counts as before it. Null and empty chunks hold no samples.
    """
    frame, most = channels * WIDTH, int(keep_s * rate)
    n = F.floor(F.coalesce(F.octet_length("pcm"), F.lit(0)) / frame).cast("long")
    order = W.partitionBy("key").orderBy("ts", "seq", "asks")
    both = chunks.select("key", "ts", "seq", F.lit(False).alias("asks"), n.alias("n"), F.lit(None).cast("long").alias("want"))
    want = F.floor(F.col("ms") * rate / 1000).cast("long")
    both = both.unionByName(requests.select("key", "ts", "seq", F.lit(True).alias("asks"), F.lit(0).cast("long").alias("n"), want.alias("want")))
    both = both.withColumn("total", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # The first chunk that is kept is the first to start within most samples of the end; none if the last one alone is longer.
    both = both.withColumn("start", F.col("total") - F.col("n"))
    starts = W.partitionBy("key").orderBy("total").rangeBetween(-most, 0)
    both = both.withColumn("oldest", F.min(F.when(~F.col("asks") & (F.col("n") > 0), F.struct("start", "total"))).over(starts))
    # Of the chunks that end in that range the very first may start before it.
    oldest = F.when(F.col("oldest.start") < F.col("total") - most, F.col("oldest.total")).otherwise(F.col("oldest.start"))
    asked = both.filter("asks").withColumn("oldest", F.coalesce(oldest, F.col("total")))
    asked = asked.withColumn("empty", F.col("oldest") >= F.col("total"))
    asked = asked.select("key", "seq", "want", "empty", F.greatest(F.col("total") - F.col("want"), "oldest").alias("lo"), F.col("total").alias("hi"))
    placed = both.filter("NOT asks AND n > 0").select("key", F.col("seq").alias("chunk"), "start", F.col("total").alias("end"))
    placed = placed.join(chunks.select("key", F.col("seq").alias("chunk"), "pcm"), ["key", "chunk"])
    met = spans.overlapping(asked.filter("NOT empty"), placed, ["key"], rate)
    # From samples to bytes, then the pieces in order.
    sized = met.select("key", "seq", *[(F.col(c) * frame).alias(c) for c in ("lo", "hi", "start", "end")], "pcm")
    sound = spans.pieced(sized, ["key", "seq"], "pcm", "pcm")
    silence = F.unhex(F.repeat(F.lit("00"), (F.col("want") * frame).cast("int")))
    pcm = F.when(F.col("empty"), silence).otherwise(F.coalesce("pcm", F.unhex(F.lit(""))))
    out = asked.join(sound, ["key", "seq"], "left").withColumn("pcm", pcm)
    return out.select("key", "seq", F.floor(F.octet_length("pcm") / frame).cast("long").alias("n_samples"), wav(F.col("pcm"), rate, channels).alias("wav"))
