"""Listings and images in folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from framewise.functions import names, pixels

#: Files whose contents a task holds at a time.
AT_ONCE = 256


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.element_at(F.split("path", "/"), -1))


def listing(spark: SparkSession, path: str, any_case: bool = False) -> DataFrame:
    """Names, sizes and times of the image files in a folder, in chronological order; contents are not read. No folder, no rows."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "name string, size long, modificationTime timestamp")
        raise
    rows = _named(files).filter(names.has_image_suffix(F.col("name"), any_case)).select("name", F.col("length").alias("size"), "modificationTime")
    return rows.orderBy(*names.chronological(F.col("name")))


def evaluation_listing(spark: SparkSession, folder: str) -> DataFrame:
    """png and jpg files by name: those of the folder images/ below, or of the folder itself if there is none."""
    def of(path: str) -> DataFrame:
        one = lambda g: spark.read.format("binaryFile").option("pathGlobFilter", g).load(path).select("path")
        return _named(one("*.png").unionByName(one("*.jpg"))).select("name").orderBy("name")

    try:
        return of(f"{folder}/images")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return of(folder)
        raise


def images(spark: SparkSession, path: str) -> DataFrame:
    """name, height, width, data (BGR bytes) of all files that are images; others are left out."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").filter("width > 0 AND nChannels = 3")
    return rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", "data")


def hashed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, size, phash, dhash) of the image files in a folder, any case of suffix, and (name, size) of those that cannot be decoded."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    rows = rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", "nChannels", "data")
    rows = listing(spark, path, any_case=True).select("name", "size").join(rows, "name")
    good = (F.col("width") > 0) & (F.col("nChannels") == 3)
    hashes = rows.filter(good).select("name", "size", pixels.hashes("height", "width", "data").alias("h"))
    return hashes.select("name", "size", "h.phash", "h.dhash"), rows.filter(~good).select("name", "size")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """name and content of image files, any case of suffix."""
    files = _named(spark.read.format("binaryFile").load(path).select("path", "content"))
    return files.filter(names.has_image_suffix(F.col("name"), any_case=True)).select("name", "content")


def contents_below(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and content of all files in a folder and the folders in it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    under = F.substring_index(F.lit(root.rstrip("/")), "/", -1)
    return rows.select(F.element_at(F.split("path", F.concat(F.lit("/"), under, F.lit("/"))), -1).alias("path"), "content")


def contents_at(rows: DataFrame, root: str, column: str) -> DataFrame:
    """rows with content, the bytes of the file at a path below root (a URI); null without a path or a file.

    Tasks open the files that rows name; no folder is listed.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)

        def held(path: str | None) -> bytes | None:
            if path is None or path != path:
                return None
            try:
                with files.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for part in parts:
            for i in range(0, len(part), AT_ONCE):
                some = part.iloc[i : i + AT_ONCE]
                yield some.assign(content=pd.Series([held(p) for p in some[column]], some.index, object))

    # A number of tasks of its own: paths are few bytes each, but files take long.
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))


def prompt(spark: SparkSession, path: str) -> DataFrame:
    """One row with the text of a prompt file; an error if there is none, before any frame is classified."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("prompt")).limit(1)
