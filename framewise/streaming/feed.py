"""A written log played to a stream in parts, with a restart of the query between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from framewise.plans.persist import shared_dir

PARTS = 4


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a file or folder; False if old is not there or new is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(old)) or fs.exists(path(new)):
        return False
    fs.mkdirs(path(new).getParent())
    return bool(fs.rename(path(old), path(new)))


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/framewise-stream-{uuid.uuid4().hex}"


def appended(spark: SparkSession, old: str, new: str, name: str, suffix: str) -> None:
    """Move the data files of a folder into another, as name-number and suffix."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(old)):
        found = sorted(s.getPath().getName() for s in files.listStatus(path(old)) if s.getPath().getName().startswith("part-"))
        for i, f in enumerate(found):
            renamed(spark, f"{old}/{f}", f"{new}/{name}-{i}{suffix}")


def played(rows: DataFrame, run: Callable[[DataFrame, str], DataStreamWriter], by: str = "ts", parts: int = PARTS) -> str:
    """Play rows to a stream in parts by time and return the folder of what came out.

    run(stream, folder) says what the query does and where it writes. The rows are computed and written
    once, one folder a part; each part is moved to where the stream looks, and the query, started again
    from its checkpoint, takes all of it as a micro-batch.
    """
    spark = rows.sparkSession
    home = folder(spark)
    at = F.unix_micros(F.col(by).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)])).first()[0] or []
    rows.withColumn("part", sum(((at > c).cast("int") for c in cuts), F.lit(0))).write.partitionBy("part").parquet(f"{home}/staged")
    for i in range(parts):
        if renamed(spark, f"{home}/staged/part={i}", f"{home}/log/part-{i}"):
            stream = spark.readStream.schema(rows.schema).parquet(f"{home}/log/*")
            run(stream, f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{home}/out"
