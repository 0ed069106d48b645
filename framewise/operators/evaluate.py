"""Evaluation of verdicts against labels, and reports over result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Upper bounds of the two histograms.
CLASSIFICATION_BOUNDS = (0.5, 0.6, 0.7, 0.8, 0.9, 1, 1.25, 1.5, 1.75, 2, 5, 10)
SWITCHING_BOUNDS = (0.5, 0.75, 1, 1.5, 2, 3, 4, 5)
SUMMARY = ("ad", "content")


def results_view(lines: DataFrame, name: str | None = None) -> DataFrame:
    """JSON texts (column json) as rows status, expected, classified, reason, source, elapsed; optionally a temporary view."""
    paths = {c: f"$.{c}" for c in ("status", "expected", "classified")} | {c: f"$.model_reply.{c}" for c in ("reason", "source")}
    out = lines.select(
        *[F.get_json_object("json", p).alias(c) for c, p in paths.items()],
        F.get_json_object("json", "$.elapsed").cast("decimal(18,3)").alias("elapsed"),
    )
    if name:
        out.createOrReplaceTempView(name)
    return out


def mean_by_group(results: DataFrame) -> DataFrame:
    rows = results.filter("source = 'llm' AND expected != 'unknown'")
    return rows.groupBy("status", "expected", "classified").agg(F.round(F.avg(F.col("elapsed").cast("double")), 2).alias("avg_elapsed"))


def pivoted(results: DataFrame, by: list[str], on: str, values: list[str]) -> DataFrame:
    """Mean and most of elapsed for each of values, given so that no job is run to find them."""
    x = F.col("elapsed").cast("double")
    rows = results.filter("expected != 'unknown'").groupBy(*by).pivot(on, values)
    return rows.agg(F.round(F.avg(x), 2).alias("avg_elapsed"), F.round(F.max(x), 2).alias("max_elapsed"))


def judged(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """frames (name, classified, …) with expected and status, and bucket for wrong verdicts."""
    expected = F.col("expected")
    status = (
        F.when(expected.isNull(), "unlabeled")
        .when(expected == "ignore", "ignored")
        .when(expected == F.col("classified"), "correct")
        .otherwise("incorrect")
    )
    bucket = F.when(F.col("classified") == "ad", "incorrectly_marked_as_ads").when(F.col("classified") == "content", "incorrectly_marked_as_content")
    joined = frames.join(labels.select("name", F.col("label").alias("expected")), "name", "left")
    return joined.withColumn("status", status).withColumn("bucket", F.when(F.col("status") == "incorrect", bucket.otherwise("incorrectly_unknown")))


def summary(judged_rows: DataFrame) -> DataFrame:
    """One row of counts and of the share of wrong verdicts (0 if none was given)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    total = n("correct", "incorrect")
    return judged_rows.agg(
        total.alias("total"),
        n("incorrect").alias("incorrect"),
        F.coalesce(F.round(F.try_divide(n("incorrect"), total), 4), F.lit(0.0)).alias("incorrect_pct"),
        n("unlabeled").alias("unlabeled"),
        n("ignored").alias("ignored"),
    )


#: Ranges between the least and the greatest time of a group, in which the median is looked for.
RANGES = 1024


def timing(judged_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, upper median, least, most and sum of elapsed over verdicts; no row if there is none.

    The upper median comes from counts: of RANGES ranges of each group first, then of the distinct times
    in the one range that holds it. Counts combine before the shuffle; no group is gathered or sorted.
    """
    keys = by or []
    given = judged_rows.filter(F.col("status").isin("correct", "incorrect") & F.col("elapsed").isNotNull())
    given = given.select(*keys, "elapsed", F.lit(0).alias("_all"))
    group = ["_all", *keys]
    x = F.col("elapsed")
    n = F.count(F.lit(1))
    stats = given.groupBy(*group).agg(n.alias("n"), F.avg(x).alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("s"))
    place = F.least(F.lit(RANGES - 1), F.floor(F.coalesce(F.try_divide((x - F.col("lo")) * RANGES, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    counts = given.groupBy(*group, "elapsed").agg(n.alias("c")).join(stats.select(*group, "n", "lo", "hi"), group).withColumn("range", place)
    upto = lambda order, *more: F.sum("c").over(W.partitionBy(*group, *more).orderBy(order))
    ranges = counts.groupBy(*group, "range").agg(F.sum("c").alias("c"), F.first("n").alias("n")).withColumn("upto", upto("range"))
    held = ranges.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*group).agg(F.min(F.struct("range", (F.col("upto") - F.col("c")).alias("under"))).alias("r"))
    held = held.select(*group, F.col("r.range").alias("range"), F.col("r.under").alias("under"))
    inside = counts.join(held, [*group, "range"]).withColumn("upto", F.col("under") + upto("elapsed", "range"))
    middle = inside.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*group).agg(F.min("elapsed").alias("mid"))
    return stats.join(middle, group).select(
        *keys,
        *[F.round(c, 2).alias(f"{a}_elapsed") for c, a in (("m", "avg"), ("mid", "median"), ("lo", "min"), ("hi", "max"), ("s", "total"))],
    )


def log_record() -> Column:
    """The line of a judged row in an evaluation log: ignored rows have file and status only, as nulls are not written."""
    given = F.col("status") != "ignored"
    return F.struct(
        F.col("name").alias("file"),
        "status",
        F.when(given, F.col("expected")).alias("expected"),
        F.when(given, F.col("classified")).alias("classified"),
        F.when(given, F.round("elapsed", 2)).alias("elapsed"),
    )


def wrong_names(judged_rows: DataFrame) -> DataFrame:
    """Names of wrong verdicts by bucket, in order of scanning (position, name)."""
    return judged_rows.filter("status = 'incorrect'").select("bucket", "position", "name")


def accuracy(judged_rows: DataFrame) -> DataFrame:
    """Share of right verdicts by label and, with label null, over all."""
    given = judged_rows.filter(F.col("status").isin("correct", "incorrect"))
    right = F.avg((F.col("status") == "correct").cast("double"))
    return given.rollup("expected").agg(F.count(F.lit(1)).alias("n"), F.round(right, 4).alias("accuracy")).filter("n > 0")


def meets(judged_rows: DataFrame, overall: float = 0.8, per_label: float = 0.75) -> DataFrame:
    rows = accuracy(judged_rows)
    least = F.when(F.col("expected").isNull(), F.lit(overall)).otherwise(F.lit(per_label))
    return rows.withColumn("ok", F.col("accuracy") >= least)


def histogram(rows: DataFrame, column: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts: one row for each bound and one without a bound."""
    counts = [F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(column).alias(f"b{len(bounds)}")]
    edges = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    edges.append(F.struct(F.lit(None).cast("double").alias("le"), F.col(f"b{len(bounds)}").alias("n")))
    return rows.agg(*counts).select(F.inline(F.array(*edges)))


def distinct_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) for every value of the columns; the viewer's choices."""
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(parts)).filter("value IS NOT NULL").distinct()
