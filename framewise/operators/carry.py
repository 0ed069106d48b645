"""Plans of moves and deletes carried out by tasks, with a journal; a dry run unless asked otherwise.

Every step is safe to repeat: a move whose source is gone and whose target is there has been done, a
delete of what is gone too. So a run that was killed midway is just run again; the journal saves the
looking, and tells what happened to each file. Targets that exist are never overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "src string, dest string, outcome string"
#: Outcomes after which a step need not be looked at again.
SETTLED = ("moved", "deleted", "missing")


def _folder_of(path: str, files: fs.FileSystem, made: set[str]) -> None:
    """Make the folder of a file, unless that was done before."""
    folder = path.rsplit("/", 1)[0]
    if folder not in made:
        files.create_dir(folder, recursive=True)
        made.add(folder)


def step(files: fs.FileSystem, src: str, dest: str | None, made: set[str] | None = None) -> str:
    """One move or, without dest, delete: moved, deleted, skipped (the target is there), missing (there is no source). made: folders of targets made so far."""
    at = lambda p: files.get_file_info(p).type
    there = at(src) != fs.FileType.NotFound
    if dest is None:
        if there:
            files.delete_file(src)
        return "deleted"
    if at(dest) != fs.FileType.NotFound:
        return "skipped" if there else "moved"
    if not there:
        return "missing"
    _folder_of(dest, files, set() if made is None else made)
    files.move(src, dest)
    return "moved"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """What the runs so far did; the last outcome of a step that was skipped may change when it is tried again."""
    try:
        return spark.read.schema(JOURNAL).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], JOURNAL)
        raise


def carried(plan: DataFrame, root: str, journal_path: str, apply: bool = False) -> DataFrame:
    """Carry out plan (src, dest; dest null: delete; paths below root, a URI) and return src, dest, outcome of every step of it.

    Without apply nothing is touched or noted, and outcomes are `would move` and `would delete`. Repeated
    steps are one; of several moves from or to one path the first by name is tried first, the others
    find it gone or there. Each step is one task's; steps of one target fall to one task.
    """
    spark = plan.sparkSession
    steps = plan.select("src", "dest").filter("src IS NOT NULL").distinct()
    if not apply:
        return steps.withColumn("outcome", F.when(F.col("dest").isNull(), "would delete").otherwise("would move"))
    settled = journal(spark, journal_path).filter(F.col("outcome").isin(*SETTLED)).dropDuplicates(["src", "dest"])
    left = steps.join(settled, (steps["src"] == settled["src"]) & steps["dest"].eqNullSafe(settled["dest"]), "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for part in parts:
            full = lambda p: f"{base.rstrip('/')}/{p}"
            some = lambda d: None if d is None or d != d else full(d)
            yield part.assign(outcome=[step(files, full(s), some(d), made) for s, d in zip(part["src"], part["dest"], strict=True)])

    # A number of tasks of its own: steps are few bytes each, but take long.
    dealt = left.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.coalesce("dest", "src")).sortWithinPartitions("dest", "src")
    dealt.mapInPandas(run, JOURNAL).write.mode("append").parquet(journal_path)
    done = journal(spark, journal_path)
    best = F.min_by("outcome", F.when(F.col("outcome").isin(*SETTLED), 0).otherwise(1)).alias("outcome")
    told = done.groupBy(F.col("src").alias("s"), F.col("dest").alias("d")).agg(best)
    return steps.join(told, (steps["src"] == F.col("s")) & steps["dest"].eqNullSafe(F.col("d")), "left").select("src", "dest", "outcome")


def put(contents: DataFrame, root: str) -> None:
    """Write a file for each row (src, text or binary) below root, by tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for part in parts:
            for src, text in zip(part["src"], part["text"], strict=True):
                path = f"{base.rstrip('/')}/{src}"
                _folder_of(path, files, made)
                with files.open_output_stream(path) as f:
                    f.write(text if isinstance(text, bytes) else (text or "").encode())
            yield part[["src"]]

    contents.select("src", "text").mapInPandas(run, "src string").write.format("noop").mode("overwrite").save()
