"""Mixing sources to target weights by systematic sampling.

Within each source the documents' expected copies are summed in one fixed order, one random offset
is added, and a document is emitted once per integer boundary that its share of the sum crosses.
The order runs through size classes (sixteenths of a power of two), so that large and small
documents are hit in proportion and the words taken stay near the target.

In a source of few documents a large one weighs so much that taking it or not misses the target. So
a source's largest documents (more than 1 / LARGE of its words each, fewer than LARGE of them) are
drawn first, at the source's rate, and the expected copies of the others are what they leave of the
target. Over all offsets each document still is expected target / source_size times, unless the large
ones leave less than nothing or more than MOST_COPIES times the rest.

The running sum is never computed in one task per source: expected copies are alike for all
documents of a part, so the sum is a rank times a rate, and ranks come from cells (source, size
class, one of 256 hash slots): counts per cell, running sums over the slots of a class and over the
classes of a source, and a row number within each cell. A source that holds a third of all rows
spreads over its cells. Equal rows are counted before the shuffle, and their copies, which are told
apart by number, spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import SPACES, copies_of, hex_int, text_or_empty, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
LARGE = 64


def n_words(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACES}]+")).cast("long")


def size_class(size: Column) -> Column:
    """Length of the size in bits and its five leading bits: classes 1/16 apart at most."""
    bits = F.length(F.bin(size))
    return (bits * 32 + F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)))).cast("int")


def least_of_class(cls: Column) -> Column:
    """The smallest size in a class."""
    bits, lead = F.floor(cls / 32).cast("int"), (cls % 32).cast("long")
    return F.call_function("shiftleft", lead, F.greatest(bits - 5, F.lit(0)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Target words of each source from columns src, source_size: one row per source, in and out.

    Sources in order of src take the weights in turn. A target stops at most times the source's size
    and its excess goes to the others by weight: with sources in order of size per weight those that
    stop come first, so the level of the rest is a running sum away. The table is the list of sources
    with their sizes, which the windows here sort in one task; it does not grow with the documents.
    """
    order = W.orderBy("src")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("w", w.cast("long"))
    fill = W.orderBy(F.col("source_size") / F.col("w"), "src")
    before, everything = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= most * F.col("source_size") / F.col("w"))
    first = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), F.col("src"), F.col("level"))))
    return levels.withColumn("at", first.over(everything)["level"]).select(
        "src", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("w") * F.col("at")).alias("target")
    )


def row_name(docs: DataFrame) -> Column:
    """MD5 of all columns of a row, in order: equal for equal rows only. Nulls differ from every value."""
    return F.md5(F.concat(*[F.coalesce(F.md5(F.col(f"`{c}`").cast("string")), F.lit("n")) for c in docs.columns]))


def drawn(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, name (of the row), copy (its number among equal rows), size, source_size, target and copies, for every row of docs."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("z")).alias("src"),
        n_words(text_col).alias("size"),
        row_name(docs).alias("name"),
    )
    counted = written(rows.groupBy("name", "src", "size", "id").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    every = copies_of(counted).withColumn("hexed", F.md5(F.concat("name", F.col("copy").cast("string"))))
    every = every.withColumns({"cls": size_class(F.col("size")), "salt": hex_int(F.col("hexed"), 2).cast("int")})
    cells = written(every.groupBy("src", "cls", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells")

    goals = targets(cells.groupBy("src").agg(F.sum("words").alias("source_size")))
    of = cells.groupBy("src", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).join(goals, "src")
    of = of.withColumn("large", least_of_class(F.col("cls")) * LARGE > F.col("source_size"))
    lower = W.partitionBy("src", "large").orderBy("cls").rowsBetween(W.unboundedPreceding, -1)
    of = of.withColumn("under", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    before = W.partitionBy("src", "cls").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("src", "cls", "salt", "start")
    starts = starts.join(of, ["src", "cls"]).select("src", "cls", "salt", (F.col("start") + F.col("under")).alias("start"), "source_size", "target", "large")
    own = F.row_number().over(W.partitionBy("src", "cls", "salt").orderBy("size", "hexed"))
    ranked = every.withColumn("rank", own).join(starts, ["src", "cls", "salt"])
    ranked = ranked.select("id", "name", "copy", "src", "cls", "salt", "size", "source_size", "target", "large", (F.col("start") + F.col("rank")).alias("rank"))
    ranked = written(ranked, "mix-ranked")

    u = hex_int(F.md5(F.concat(F.lit(seed), F.col("src"))), 8) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def copies(rate: Column) -> Column:
        crossed = F.floor(rate * F.col("rank") + u) - F.floor(rate * (F.col("rank") - 1) + u)
        return F.least(crossed, F.lit(MOST_COPIES)).cast("long")

    large = ranked.filter("large").groupBy("src").agg(F.sum(F.col("size") * copies(rate)).alias("took"))
    parts = of.groupBy("src").agg(F.first("target").alias("target"), F.sum(F.when(~F.col("large"), F.col("words")).otherwise(0)).alias("words"))
    left = F.col("target") - F.coalesce("took", F.lit(0))
    rest = F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), left / F.col("words")))).otherwise(F.lit(0.0))
    rests = parts.join(large, "src", "left").select("src", rest.alias("rest"))
    # It comes back by cell, as a source may hold a third of all rows.
    by_cell = cells.select("src", "cls", "salt").join(rests, "src")
    return ranked.join(by_cell, ["src", "cls", "salt"]).select(
        "id", "name", "copy", "size", "source_size", "target", copies(F.when(F.col("large"), rate).otherwise(F.col("rest"))).alias("copies")
    )


def mixed(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes every document of docs.

    Returns id_col, size (words), source_size, target, copies and taken (size times copies). Null
    texts have size 0, null ids are an id, null sources are one source that comes last, repeated rows
    are rows of their own, very long texts are counted whole, an empty table gives no rows. All columns
    count in telling rows apart, whatever their names. The same rows and seed give the same copies
    again, in whatever order and files they come.
    """
    out = drawn(docs, seed, id_col, text_col, source_col).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", "taken")


def resampled(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, same columns, as often as mixed() takes them, row by row.

    Of equal rows one is shuffled, before it becomes as many as all of them are taken; so nulls, empty
    and very long texts and repeated rows come out as mixed() says, an empty table gives no rows. Other
    columns, whatever their names, come along unchanged (names that start with _fw_ are ours).
    """
    told = drawn(docs, seed, id_col, text_col, source_col).groupBy(F.col("name").alias("_fw_name")).agg(F.sum("copies").alias("_fw_n")).filter("_fw_n > 0")
    one = docs.withColumn("_fw_name", row_name(docs)).dropDuplicates(["_fw_name"])
    return copies_of(one.join(told, "_fw_name"), n_col="_fw_n", copy_col="_fw_copy").select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB twin of mixed() over documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s:' || source, 'z') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(md5(CAST(doc_id AS VARCHAR)), 'n') || coalesce(md5(text), 'n') || coalesce(md5(lang), 'n') || coalesce(md5(source), 'n') || coalesce(md5(CAST(n_chars AS VARCHAR)), 'n')) AS name
  FROM documents
), h AS (
  SELECT *, md5(name || (row_number() OVER (PARTITION BY name) - 1)) AS hexed FROM d
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY src) - 1 AS k FROM h GROUP BY src
), c AS (
  SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS cls, substr(hexed, 1, 2) AS salt,
         ((size >> greatest(length(bin(size)) - 5, 0)) << greatest(length(bin(size)) - 5, 0)) * 64 > source_size AS large
  FROM h JOIN s USING (src)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY src, large ORDER BY cls, salt, size, hexed) AS rk FROM c
), w AS (
  SELECT src, source_size, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - 2 * coalesce(sum(source_size) OVER o, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(level, (source_size / w, src)) FILTER (WHERE level <= 2 * source_size / w) AS lvl FROM f
), t AS (
  SELECT src, least(CAST(2 * source_size AS DOUBLE), w * lvl) AS target,
         CAST(CAST('0x' || substr(md5('mix' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM f, l
), q AS (
  SELECT doc_id, src, size, source_size, target, large, rk, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r JOIN t USING (src)
), b AS (
  SELECT src, coalesce(sum(size * CAST(least(floor(rate * rk + u) - floor(rate * (rk - 1) + u), 2) AS BIGINT)) FILTER (large), 0) AS took,
         coalesce(sum(size) FILTER (NOT large), 0) AS words, any_value(target) AS goal
  FROM q GROUP BY src
), e AS (
  SELECT src, CASE WHEN words > 0 THEN greatest(0.0, least(2.0, (goal - took) / words)) ELSE 0.0 END AS rest FROM b
), x AS (
  SELECT *, CASE WHEN large THEN rate ELSE rest END AS own FROM q JOIN e USING (src)
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(own * rk + u) - floor(own * (rk - 1) + u), 2) AS BIGINT) AS copies,
       CAST(least(floor(own * rk + u) - floor(own * (rk - 1) + u), 2) AS BIGINT) * size AS taken
FROM x
"""
