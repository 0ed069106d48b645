"""Overrides that are in force on a stream: a stored table, read again when it has a new version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewise.operators import dedupe
from framewise.sources.store import Store

SCHEMA = "pos long, phash long, label string"


def store(spark: SparkSession, home: str) -> Store:
    return Store(spark, home, SCHEMA, ["pos"], n_buckets=8)


def sink(home: str, out: str, threshold: int = dedupe.THRESHOLD) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: name and label of each micro-batch of frames (name, phash), by the overrides that are stored when it starts.

    An override that is added between two micro-batches counts from the next one. Only the number of the
    version is looked up each time; the table is kept as long as it is the same. A batch that comes
    again replaces what it wrote.
    """
    held: dict[int, DataFrame] = {}

    def write(frames: DataFrame, batch: int) -> None:
        table = store(frames.sparkSession, home)
        version = table.manifest()["version"]
        if version not in held:
            held.clear()
            held[version] = table.read(version)
        dedupe.overridden(frames, held[version], threshold).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write
