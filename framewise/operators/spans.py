"""Joins of things that have a place on a line: which chunks hold which stretch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(stretches: DataFrame, chunks: DataFrame, by: list[str], width: int) -> DataFrame:
    """Each stretch (by…, lo, hi, …) with each chunk (by…, start, end, …) that shares a place with it; ends are exclusive.

    Both are dealt to cells of a width, and of the cells in which two meet the first counts: an
    equi-join in place of a comparison of all with all. width should be about the length of a chunk or
    more; columns of the two must differ but for those in by.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = stretches.filter("lo < hi").withColumn("cell", cells("lo", "hi"))
    right = chunks.filter("start < `end`").withColumn("cell", cells("start", "end"))
    met = left.join(right, [*by, "cell"]).filter("lo < `end` AND start < hi")
    return met.filter(F.col("cell") == F.floor(F.greatest("lo", "start") / width)).drop("cell")


def pieced(parts: DataFrame, by: list[str], data: str = "data", out: str = "data") -> DataFrame:
    """The binary pieces (by…, lo, start, end, hi, data) of each stretch, cut to it and put together in order: by…, out."""
    at = F.greatest(F.col("lo"), F.col("start"))
    n = F.least(F.col("hi"), F.col("end")) - at
    piece = F.substring(F.col(data), (at - F.col("start") + 1).cast("int"), n.cast("int"))
    held = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.hex(piece).alias("x"))))
    return parts.groupBy(*by).agg(F.unhex(F.array_join(F.transform(held, lambda p: p["x"]), "")).alias(out))
