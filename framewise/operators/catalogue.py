"""The review listing: frames with labels and features, filtered, in order, by pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions import checks, names
from framewise.plans.persist import checkpointed


def latest(log: DataFrame, key: str, position: str) -> DataFrame:
    """The last record of each key of an append-only log; the whole record counts, nulls included."""
    rest = [c for c in log.columns if c not in (key, position)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def listing(frames: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """Frames (name) with label and features, nulls where there are none."""
    return frames.join(labels, "name", "left").join(features, "name", "left")


def filtered(
    rows: DataFrame,
    q: str | None = None,
    start: str | None = None,
    end: str | None = None,
    label: str | None = None,
    incomplete: bool = False,
    **features: str | None,
) -> DataFrame:
    checks.require("label", label, checks.LABELS)
    for f, value in features.items():
        checks.require(f, value, checks.FEATURES[f])
    keep = names.between(F.col("name"), start, end) & checks.selected(F.col("label"), label) & checks.all_selected(features)
    if q:
        keep = keep & F.contains(F.lower("name"), F.lit(q.lower()))
    if incomplete:
        keep = keep & checks.incomplete()
    return rows.filter(keep)


#: Rows from the nearer end up to which a page is a top-k; beyond, rows are dealt to ranges.
NEAR_END = 100_000
#: Rows of a range.
RANGE_ROWS = 1_000_000


def paged(rows: DataFrame, page: int = 1, per_page: int = checks.PER_PAGE, order: str = "asc") -> DataFrame:
    """One page of rows in chronological order, with place, page and pages.

    A page beyond the last is the last. Only counts go to the driver. A page near either end is a top-k
    from that end (each task keeps NEAR_END + per_page rows at most). For one in between, rows are dealt
    to ranges by a checkpoint, the ranges are counted, and only those that hold the page are sorted.
    """
    checks.require_page(page, per_page, order)
    n = rows.count()
    pages = max(1, -(-n // per_page))
    page = min(page, pages)
    start = (page - 1) * per_page
    size = min(per_page, n - start)
    # The keys become columns: a sort would work out an expression for each comparison.
    keyed = rows.withColumn("_taken", names.taken(F.col("name")))
    keys = names.ordered(F.col("_taken"), F.col("name"), order == "desc")
    behind = n - start - size
    if min(start, behind) <= NEAR_END and start <= behind:
        cut = keyed.orderBy(*keys).offset(start).limit(size)
    elif behind <= NEAR_END:
        back = names.ordered(F.col("_taken"), F.col("name"), order != "desc")
        cut = keyed.orderBy(*back).offset(behind).limit(size)
    else:
        ranges = keyed.repartitionByRange(-(-n // RANGE_ROWS), *keys).withColumn("_range", F.spark_partition_id())
        ranges = checkpointed(ranges)
        before, wanted = 0, []
        for r in ranges.groupBy("_range").count().orderBy("_range").collect():
            if before < start + size and before + r["count"] > start:
                wanted.append((r["_range"], before))
            before += r["count"]
        cut = ranges.filter(F.col("_range").isin([w for w, _ in wanted])).drop("_range").orderBy(*keys).offset(start - wanted[0][1]).limit(size)
    place = F.row_number().over(W.orderBy(*keys)) + start
    return cut.withColumns({"place": place, "page": F.lit(page), "pages": F.lit(pages)}).drop("_taken")


def neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by…, place, incomplete) with the next and the previous incomplete place."""
    own = W.partitionBy(*by).orderBy("place")
    at = F.when(F.col("incomplete"), F.col("place"))
    return rows.withColumns(
        {
            "next_incomplete": F.min(at).over(own.rowsBetween(1, W.unboundedFollowing)),
            "prev_incomplete": F.max(at).over(own.rowsBetween(W.unboundedPreceding, -1)),
        }
    )
