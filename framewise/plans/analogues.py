"""The supplied tables in the shape of the application's entities.

events stands for the frame stream, documents and labels for frames with ground truth, the signs of
embeddings for perceptual hashes. They are analogues, not the application's data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import bits
from framewise.session import table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ts, seq, result, source, elapsed."""
    kind = F.col("event_type")
    result = F.when(kind == "error", "unknown").when(kind.isin("purchase", "click"), "ad").otherwise("content")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        "ts",
        F.col("event_id").alias("seq"),
        result.alias("result"),
        F.when(F.col("event_id") % 5 == 0, "opencv").otherwise("llm").alias("source"),
        F.col("value").alias("elapsed"),
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with some rows as commands: kind, flag, and no result where a command has none."""
    m = F.col("seq") % 20
    kind = (
        F.when(m == 1, "report").when(m == 2, "pause").when(m == 3, "resume").when(m == 4, "debounce")
        .when(m == 5, "auto").when(m == 6, "trigger").otherwise("frame")
    )
    valid = F.when(F.col("result") == "unknown", "ad").otherwise(F.col("result"))
    result = F.when(m.isin(1, 6), valid).when(m.isin(2, 3, 4, 5), None).otherwise(F.col("result"))
    rows = frames(spark, sf_dir).withColumns({"kind": kind, "flag": F.col("seq") % 40 < 20})
    return rows.select("key", "ts", "seq", "kind", result.alias("result"), "source", "flag")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names with label and features, missing for some: one row for each frame name (that of the least event)."""
    n = F.min("event_id").alias("n")
    rows = names(spark, sf_dir).groupBy("name").agg(n)
    m = F.col("n")
    return rows.select(
        "name",
        F.when(m % 4 == 0, "ad").when(m % 4 == 1, "content").when(m % 4 == 2, "ignore").alias("label"),
        F.when(m % 5 < 3, F.element_at(F.array(F.lit("Fox"), F.lit("NBC"), F.lit("none")), (m % 3 + 1).cast("int"))).alias("network_logo"),
        F.when(m % 7 < 5, "upper_left").alias("logo_position"),
        F.when(m % 2 == 0, "top").when(m % 9 == 1, "").alias("scoreboard_position"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame names in both conventions, some without a time: name, event_id, ts."""
    n = F.col("event_id")
    at = lambda f: F.date_format("ts", f)
    name = (
        F.when(n % 17 == 0, F.concat(F.lit("frame"), n.cast("string"), F.lit(".png")))
        .when(n % 3 == 0, F.concat(at("yyyy-MM-dd_HH-mm-ss"), F.lit(".jpg")))
        .when(n % 3 == 1, F.concat(at("yyyy-MM-dd'T'HH-mm-ss"), F.lit("-000123_"), (n % 12).cast("string"), F.lit(".jpg")))
        .otherwise(F.concat(at("yyyy-MM-dd_HH-mm"), F.lit(".jpeg")))
    )
    return table(spark, sf_dir, "events").select(name.alias("name"), "event_id", "ts")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, label: from quality and toxic."""
    label = F.when(F.col("toxic") == 1, "ignore").when(F.col("quality") == 1, "content").otherwise("ad")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("name"), label.alias("label"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, position, classified, elapsed for documents."""
    d = F.col("doc_id")
    kind = F.when(d % 11 == 0, "unknown").when(d % 5 == 0, "ad").otherwise("content")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("name"), d.alias("position"), kind.alias("classified"), ((d % 400) / F.lit(64.0)).alias("elapsed")
    )


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of an evaluation log made of events, and seq of each."""
    n = F.col("seq")
    expected = F.when(n % 7 == 0, "unknown").when(n % 2 == 0, "ad").otherwise("content")
    reason = F.when(n % 3 == 0, "network_logo").otherwise("model-match")
    rows = frames(spark, sf_dir).select(
        "seq",
        F.when(n % 13 == 0, "ignored").when(expected == F.col("result"), "correct").otherwise("incorrect").alias("status"),
        F.when(n % 13 != 0, expected).alias("expected"),
        F.when(n % 13 != 0, F.col("result")).alias("classified"),
        F.when(n % 13 != 0, F.round(F.col("elapsed"), 3)).alias("elapsed"),
        F.when(n % 13 != 0, F.struct("source", F.col("result").alias("type"), reason.alias("reason"))).alias("model_reply"),
    )
    return rows.select("seq", F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])).alias("json"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, size, phash, dhash from embeddings: signs of values, and of the next value less this one."""
    e = F.col("embedding")
    steps = F.transform(e, lambda x, i: F.get(e, (i + 1) % 64) - x)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("n"),
        bits.from_signs(e).alias("phash"),
        bits.from_signs(steps).alias("dhash"),
        F.col("label"),
    ).select(F.concat(F.lit("frame"), F.lpad(F.col("n").cast("string"), 9, "0"), F.lit(".jpg")).alias("name"), "n", (F.col("n") % 1000 + 1).alias("size"), "phash", "dhash", "label")


def near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hashes, and for every fifth row a copy with a few bits changed and a later name."""
    own = hashes(spark, sf_dir)
    flip = lambda c, k: F.col(c).bitwiseXOR(F.call_function("shiftleft", F.lit(k).cast("long"), (F.col("n") % 60).cast("int")))
    copies = own.filter("n % 5 = 0").select(
        F.concat(F.lit("frame"), F.lpad((F.col("n") + 100_000_000).cast("string"), 9, "0"), F.lit(".jpg")).alias("name"),
        (F.col("n") + 100_000_000).alias("n"), "size", flip("phash", 5).alias("phash"),
        F.when(F.col("n") % 2 == 0, flip("dhash", 3)).otherwise(F.bitwise_not("dhash")).alias("dhash"), ((F.col("label") + 1) % 3).cast("int").alias("label"),
    )
    return own.unionByName(copies)
