"""Readers of the logs and maps that the application writes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import names

FEATURES = "filename string, network_logo string, logo_position string, scoreboard_position string"
CLASSIFICATION = (
    "filename string, timestamp string, save_reason string, page_title string, video_title string, network_name string, "
    "video_offset double, state_classification string, classification string, classification_reason string, model_reply string, "
    "correct_label string, classified_as string"
)
#: What append() adds to a record: the time in microseconds and the place among the rows of one call.
STAMP = "_at bigint, _seq bigint"
RESULT = (
    "file string, status string, expected string, classified string, elapsed double, "
    "model_reply struct<source:string,type:string,reason:string,reply:string>"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value with its place: file, block (where its part of the file starts), n (ascending within it), and when the file was written."""
    places = ["_metadata.file_path AS file", "_metadata.file_block_start AS block", "_metadata.file_modification_time AS written"]
    return spark.read.text(path).selectExpr("value", *places).withColumn("n", F.monotonically_increasing_id())


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the file up to and with each line: sums of blocks first, then within blocks."""
    rows = rows.withColumn("_v", value)
    blocks = rows.groupBy("file", "block").agg(F.sum("_v").alias("_sum"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_v").over(W.partitionBy("file", "block").orderBy("n"))
    return rows.withColumn("_own", own).join(blocks, ["file", "block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_v", "_own", "_before")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _objects(texts: pd.Series) -> pd.Series:
    """The JSON objects in texts that hold several; what is none ends a text."""
    read = json.JSONDecoder().raw_decode

    def split(text: str) -> list[str]:
        out, at = [], text.find("{")
        while at >= 0:
            try:
                _, end = read(text, at)
            except ValueError:
                break
            out.append(text[at:end])
            at = text.find("{", end)
        return out

    return texts.map(split)


def _bare(text: str) -> Column:
    """A text without its strings."""
    return F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', "")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Column json: every object of files in which objects follow each other, several on a line or one over several lines.

    Lines are read in parts of files. Braces outside of strings tell how deep a line starts; lines that
    are whole stay as they are, and only the lines of longer objects are brought together, object by
    object. What is no JSON is left out.
    """
    lines = _lines(spark, path)
    bare = _bare("value")
    step = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    lines = _running(lines.withColumn("step", step), F.col("step"), "deep")
    start = F.col("deep") - F.col("step") == 0
    whole = lines.filter(start & (F.col("step") == 0)).select("value")
    parts = _running(lines.filter(~(start & (F.col("step") == 0))), start.cast("int"), "object")
    ordered = F.array_sort(F.collect_list(F.struct("block", "n", "value")))
    parts = parts.groupBy("file", "object").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
    # Within one object a closing brace is never followed by an opening one.
    found = whole.unionByName(parts.select("value")).select(F.trim("value").alias("json"), _bare("value").rlike(r"\}\s*\{").alias("several"))
    several = found.filter("several").select(F.explode(_objects("json")).alias("json"))
    one = found.filter("NOT several AND json LIKE '{%'").filter(F.try_parse_json("json").isNotNull()).select("json")
    return one.unionByName(several)


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an evaluation log, and its summaries as JSON."""
    rows = json_objects(spark, path)
    is_summary = F.coalesce(F.get_json_object("json", "$.status") == "summary", F.lit(False))
    return rows.filter(~is_summary).select(F.from_json("json", RESULT).alias("r")).select("r.*"), rows.filter(is_summary)


def labels(spark: SparkSession, path: str, drop_null: bool = False) -> DataFrame:
    """(name, label) from a file that holds one map; no file, no rows."""
    empty = spark.createDataFrame([], "name string, label string")
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    out = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "label"))
    return out.filter("label IS NOT NULL") if drop_null else out


def features(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each file name; blank lines are skipped.

    Last is by the time that append() notes in a record and, without one, by when the file was written
    and the place in it.
    """
    lines = _lines(spark, path).filter("trim(value) <> ''")
    noted = F.from_json("value", f"{FEATURES}, {STAMP}").alias("r")
    rows = lines.select(noted, "written", "file", "block", "n").select("r.*", "written", "file", "block", "n")
    place = F.struct(F.coalesce("_at", F.lit(0)), "written", "file", F.coalesce("_seq", F.lit(0)), "block", "n")
    last = rows.groupBy("filename").agg(F.max_by(F.struct("network_logo", "logo_position", "scoreboard_position"), place).alias("r"))
    return last.select(F.col("filename").alias("name"), "r.*")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(pos, phash, label) of JSON arrays of hexadecimal hashes, in order of insertion, from 0.

    Overrides are a list made by hand; it is numbered in one task.
    """
    whole = spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_path AS file", "_metadata.file_modification_time AS written")
    items = whole.select("file", "written", F.posexplode(F.from_json("value", f"array<struct<phash:string,label:string,{STAMP.replace(', ', ',').replace(' ', ':')}>>")).alias("i", "o"))
    order = W.orderBy(F.coalesce("o._at", F.lit(0)), "written", "file", "i")
    return items.select(
        (F.row_number().over(order) - 1).alias("pos"), F.conv("o.phash", 16, -10).cast("long").alias("phash"), F.col("o.label").alias("label")
    )


def append_overrides(rows: DataFrame, path: str) -> None:
    """Append overrides (phash, label), in their order, to a folder that overrides() reads: one array a call."""
    item = F.struct(F.format_string("%016x", "phash").alias("phash"), "label", *_stamp())
    one = rows.select(item.alias("o")).agg(F.sort_array(F.collect_list(F.struct(F.col("o._seq").alias("s"), "o"))).alias("all"))
    one.select(F.to_json(F.transform("all", lambda x: x["o"])).alias("value")).coalesce(1).write.mode("append").text(path)


def classifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLASSIFICATION).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value")).write.text(path)


def write_evaluation(judged_lines: DataFrame, summary: DataFrame, path: str) -> None:
    """An evaluation log: one line a row, and the summary as the last object, with status `summary`; results() reads it."""
    lines = judged_lines.select(F.to_json(F.struct(*judged_lines.columns)).alias("value"))
    last = summary.select(F.to_json(F.struct(F.lit("summary").alias("status"), *summary.columns), {"pretty": "true"}).alias("value"))
    lines.write.mode("append").text(path)
    last.coalesce(1).write.mode("append").text(path)


def _stamp() -> list[Column]:
    return [F.unix_micros(F.current_timestamp()).alias("_at"), F.monotonically_increasing_id().alias("_seq")]


def append(rows: DataFrame, path: str) -> None:
    """Append to a log; readers take the latest record of each key, so writers need no lock.

    Each record notes when it was appended and its place among the rows.
    """
    rows.select("*", *_stamp()).write.mode("append").json(path)


def save_batches(frames: DataFrame, path: str, reason: str) -> DataFrame:
    """Save frames (at, idx, timestamp, suffix, content, perhaps audio, and the fields of CLASSIFICATION that are known) and log them.

    Contents go to <path>/images as a table (filename, content), which frame_contents() reads: tasks write
    it, and one file a frame would be millions of small ones; sound goes to <path>/audio in the same way.
    A line each goes to <path>/classifications. A frame without a content cannot be saved: it gets no
    line. One without sound is saved without. Returns the names.
    """
    named = frames.filter("content IS NOT NULL").withColumn("filename", names.batch_name(F.col("timestamp"), F.col("idx"), F.col("suffix")))
    named = named.withColumn("save_reason", F.lit(reason))
    named.select("filename", "content").write.mode("append").parquet(f"{path}/images")
    if "audio" in frames.columns:
        sound = named.filter("audio IS NOT NULL").select(F.concat(names.stem(F.col("filename")), F.lit(".wav")).alias("filename"), F.col("audio").alias("content"))
        sound.write.mode("append").parquet(f"{path}/audio")
    known = [c for c in (f.split()[0] for f in CLASSIFICATION.split(", ")) if c in named.columns]
    append(named.select(*known), f"{path}/classifications")
    return named.select("filename")


def frame_contents(spark: SparkSession, path: str, medium: str = "images") -> DataFrame:
    return spark.read.schema("filename string, content binary").parquet(f"{path}/{medium}")
