"""What the training-data operators share: reading tables, written intermediate tables, small expressions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space inside ASCII: space and \t \n \v \f \r.
SPACES = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where that is unset, a local one, if the master is local; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='framewise-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    This cuts the lineage: the rows outlive executors, and what is not deterministic in df (ids,
    order of ties) is fixed once. The tables lie under framewise-tables/ and may go when the job
    that asked for them has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewise-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Copies of one row that one task makes.
AT_ONCE = 10_000


def copies_of(rows: DataFrame, at_once: int = AT_ONCE, n_col: str = "n", copy_col: str = "copy") -> DataFrame:
    """rows with copy_col in place of n_col: each row n times, copies from 0. rows must not have a column copy_col.

    What is to be copied more than at_once times is dealt to tasks by blocks of copies first.
    """
    last = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    n = F.col(n_col)
    few = rows.filter(n.between(1, at_once)).withColumn(copy_col, F.explode(last(n)))
    many = rows.filter(n > at_once).withColumn("_fw_block", F.explode(last(F.ceil(n / at_once).cast("long"))))
    many = many.repartition("_fw_block", *[F.col(f"`{c}`") for c in rows.columns])
    first = F.col("_fw_block") * at_once
    many = many.withColumn(copy_col, F.explode(F.sequence(first, F.least(n, first + at_once) - 1)))
    return few.drop(n_col).unionByName(many.drop(n_col, "_fw_block"))


def hex_int(hexed: Column, digits: int) -> Column:
    """The first digits (15 at most) of a hexadecimal string as a long."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def prefixes(items: Column, zero: Column, op: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For an array of longs the array of op over all items before each one; op is associative, zero its start.

    Native and without quadratic copying: within blocks, then from block to block.
    """

    def scan(items: Column, start: Column) -> Column:
        init = F.struct(F.array().cast("array<bigint>").alias("a"), start.cast("long").alias("s"))
        return F.aggregate(
            items,
            init,
            lambda acc, x: F.struct(F.array_append(acc["a"], acc["s"]).alias("a"), op(acc["s"], x).cast("long").alias("s")),
        )["a"]

    blocks = in_blocks(items, "bigint", block)
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero.cast("long"), lambda a, x: op(a, x).cast("long")))
    return F.flatten(F.zip_with(blocks, scan(sums, zero), scan))


def in_blocks(items: Column, kind: str, block: int = 256) -> Column:
    """An array cut into arrays of block items."""
    n = F.ceil(F.size(items) / F.lit(block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(items, b * block + 1, F.lit(block)))
    return F.when(n > 0, cut).otherwise(F.array().cast(f"array<array<{kind}>>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str, group: int = 0, of_group: bool = False) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), code points, end exclusive.

    value is the match's group. Matches and the gaps between them come from the same regular
    expression, so their lengths give the places. With of_group the span is that of the group, which
    must end where the match does. Texts without a match cost one search, others one for each of
    matches, gaps and groups: results of searches are bound before any lambda reads them.
    """
    p = F.lit(pattern)
    found = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("g"),
        *([F.regexp_extract_all(text, p, F.lit(group)).alias("v")] if group else []),
    )

    def sized(r: Column) -> Column:
        values = r["v"] if group else r["m"]
        whole = F.transform(r["m"], lambda m: F.length(m).cast("long"))
        gaps = F.transform(F.slice(r["g"], F.lit(1), F.size(r["m"])), lambda g: F.length(g).cast("long"))
        return let(F.struct(whole.alias("n"), gaps.alias("g"), values.alias("v")), placed)

    def placed(r: Column) -> Column:
        ends = let(F.zip_with(r["g"], r["n"], lambda g, m: g + m), lambda steps: F.zip_with(prefixes(steps, F.lit(0), lambda a, x: a + x), steps, lambda a, x: a + x))
        held = lambda z: F.length(z["v"]).cast("long") if of_group else z["n"]
        return F.transform(
            F.arrays_zip(ends.alias("e"), r["n"].alias("n"), r["v"].alias("v")),
            lambda z: F.struct((z["e"] - held(z)).alias("start"), z["e"].alias("end"), z["v"].alias("value")),
        )

    return F.when(text.rlike(pattern), let(found, sized)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def replaced(text: Column, marks: Column) -> Column:
    """text with the spans in marks (start, end, put; longs and a string; ascending) replaced.

    Of overlapping spans the first to start wins and the rest goes with it. The work goes by blocks of
    marks, each with the part of the text that it covers, so that a text of many marks is not
    searched from its start for each of them.
    """
    spans = "struct<start:bigint,end:bigint,put:string>"
    state = lambda parts, at: F.struct(parts.alias("parts"), at.cast("long").alias("at"))
    none = F.array().cast("array<string>")

    def in_block(acc: Column, block: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(block, lambda m: m["end"])))
        held = F.struct(F.substring(text, (acc["at"] + 1).cast("int"), (end - acc["at"]).cast("int")).alias("t"), acc["at"].alias("base"))

        def add(own: Column, m: Column, h: Column) -> Column:
            gap = F.substring(h["t"], (own["at"] - h["base"] + 1).cast("int"), (m["start"] - own["at"]).cast("int"))
            take = m["start"] >= own["at"]
            return state(F.when(take, F.concat(own["parts"], F.array(gap, m["put"]))).otherwise(own["parts"]), F.when(take, m["end"]).otherwise(own["at"]))

        one = lambda h: F.aggregate(block, state(none, h["base"]), lambda own, m: add(own, m, h))
        new = F.transform(F.array(held), one)[0]
        return F.transform(F.array(new), lambda n: state(F.array_append(acc["parts"], F.array_join(n["parts"], "")), n["at"]))[0]

    given = F.transform(marks, lambda m: F.struct(m["start"].cast("long").alias("start"), m["end"].cast("long").alias("end"), m["put"].alias("put")))
    done = F.aggregate(in_blocks(given, spans), state(none, F.lit(0)), in_block)
    rest = lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))
    return F.transform(F.array(done), rest)[0]


#: Rows in an Arrow batch: with texts of some kilobytes a batch is a few megabytes, on both sides.
ARROW_ROWS = 1000


def _tidy() -> None:
    """Give memory that is free back to the system: Python workers are kept, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with small batches, after which a worker keeps little memory.

    The size of batches is a setting of the session, read when the plan runs.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _tidy()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(tidied, schema)
