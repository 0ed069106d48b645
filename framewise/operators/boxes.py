"""Rectangles in a frame against known boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Known boxes as shares of width and height, in order of priority, and the limit.
KNOWN = (
    ("fox-side-by-side-left", 0.000, 0.239, 0.387, 0.381),
    ("fox-side-by-side-right", 0.411, 0.234, 0.542, 0.542),
    ("fox-side-by-side-scoreboard", 0.022, 0.029, 0.792, 0.176),
)
EPS = 0.05


def known(spark: SparkSession) -> DataFrame:
    rows = [(i, *b) for i, b in enumerate(KNOWN)]
    return spark.createDataFrame(rows, "prio int, box string, bx double, by double, bw double, bh double")


def matches(rectangles: DataFrame, boxes: DataFrame, eps: float = EPS) -> DataFrame:
    """Rectangles (frame_id, idx, x, y, w, h, width, height) within eps (included) of a box, by all four shares at once.

    Boxes are a list of constants (as many as KNOWN); it is what is shipped to the rectangles.
    """
    sq = lambda a, b, size: F.pow(F.col(a) / F.col(size) - F.col(b), F.lit(2))
    d = F.sqrt(sq("x", "bx", "width") + sq("y", "by", "height") + sq("w", "bw", "width") + sq("h", "bh", "height"))
    out = rectangles.join(F.broadcast(boxes)).withColumn("distance", d)
    return out.filter(F.col("distance") <= eps).select("frame_id", "idx", "prio", "box", "distance")


def first_box(matched: DataFrame) -> DataFrame:
    """The box of highest priority in each frame."""
    return matched.groupBy("frame_id").agg(F.min_by("box", "prio").alias("box"))


def largest(videos: DataFrame) -> DataFrame:
    """The video of largest area on each page (page, idx, w, h); ties to the first."""
    return videos.groupBy("page").agg(F.max_by("idx", F.struct(F.col("w") * F.col("h"), -F.col("idx"))).alias("idx"))
