"""What follows from a state: switch commands, status, saved batches, moved files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The outputs of the matrix.
OUTPUTS = ("A", "B")


def commands(emitted: DataFrame, settings: dict[str, dict[str, str]]) -> DataFrame:
    """One row (…, output, input) for each output that a classification sets; labels and unknown outputs are skipped."""
    per = [
        F.when(F.col("classification") == c, F.create_map(*[F.lit(x) for kv in m.items() for x in kv]))
        for c, m in settings.items()
        if m
    ]
    chosen = F.coalesce(*per) if per else F.lit(None).cast("map<string,string>")
    valid = F.map_filter(chosen, lambda k, v: k.isin(*OUTPUTS))
    rest = [c for c in emitted.columns]
    out = emitted.select(*rest, F.explode(valid).alias("output", "input"))
    return out.withColumn("input", F.col("input").cast("int"))


def command_sink(settings: dict[str, dict[str, str]], path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: the commands of each micro-batch of emitted rows (key, seq, emits), under path.

    A batch that comes again after a failure replaces what it wrote before.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        emitted = rows.filter("emits IS NOT NULL").select("key", "seq", F.col("emits").alias("classification"))
        commands(emitted, settings).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def status(rows: DataFrame, ad_label: str = "Ad view", race_label: str = "Race view") -> DataFrame:
    """The status line; the end of a pause shows only while it lasts."""
    return rows.select(
        "key",
        F.col("committed").alias("classification"),
        "pending",
        "auto_switch",
        F.lit(ad_label).alias("ad_view_label"),
        F.lit(race_label).alias("race_view_label"),
        F.when(F.col("paused"), F.col("paused_until")).alias("auto_switch_paused_until"),
    )


def destination(name: Column) -> Column:
    """Where a loose file belongs: by suffix, thumbnails by prefix; null: it stays."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    thumb = F.startswith(name, F.lit("compressed_"))
    return (
        F.when(suffix.isin(".png", ".jpg", ".jpeg") & thumb, F.concat(F.lit("thumbnails/"), F.substring(name, F.lit(12), F.length(name))))
        .when(suffix.isin(".png", ".jpg", ".jpeg"), F.concat(F.lit("images/"), name))
        .when(suffix == ".wav", F.concat(F.lit("audio/"), name))
    )


def moves(files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Plan (name, dest) of moves; files whose destination is there already are skipped. Nothing is moved."""
    out = files.select("name", destination(F.col("name")).alias("dest")).filter("dest IS NOT NULL")
    return out.join(present.select("dest"), "dest", "left_anti").select("name", "dest") if present is not None else out


def moves_by_folder(plan: DataFrame) -> DataFrame:
    return plan.groupBy(F.split_part("dest", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def size_text(n: Column) -> Column:
    """Bytes (whole numbers) as MiB or, from a GiB on, as GiB; halves of a hundredth go to the even one, as printf rounds."""

    def text(unit: int, name: str) -> Column:
        size = F.abs(n.cast("decimal(20,0)"))
        whole, rest = F.floor(size / unit).cast("long"), (size % unit).cast("long") * 100
        low, over = F.shiftright(rest, unit.bit_length() - 1), rest % unit * 2 - unit
        cents = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
        sign = F.when(n < 0, "-").otherwise("")
        return F.format_string(f"%s%d.%02d {name}", sign, whole + F.when(cents == 100, 1).otherwise(0), cents % 100)

    return F.when(n >= 1 << 30, text(1 << 30, "GiB")).when(n.isNotNull(), text(1 << 20, "MiB"))
