"""Hard negatives by norm-bucketed search.

Vectors become integers, floor(scale * x). Rows are sorted by length of vector and falling norm and cut
into buckets of about equal size. By Cauchy and Schwarz no row of a bucket scores more with an anchor
than the anchor's norm times the bucket's greatest, so an anchor skips every bucket in which that is
below what a row must score: its k-th best score so far and, for negatives, the lower limit of its
windows. An anchor's first bucket is searched first, and only to buckets that are then left is it sent
at all; inside a bucket the same bound goes by steps of rows.

Both searches, for positives (same label) and for negatives (other labels, a window of scores for each
positive), are one grid: anchors in blocks by hash, rows in buckets, a cell for each pair that any
anchor needs. A bucket is sent once for each block of anchors; a cell gives k rows an anchor and
window, which a ranking merges. No label and no norm makes a cell larger: many equal norms are cut by
row number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import written
from framewise.llm.nearest import usable, whole

#: Rows of a bucket, anchors of a block (in the mean), rows and anchors scored at once.
BUCKET, BLOCK = 16_384, 4096
STEP, ANCHORS = 1024, 256
#: A window's scores, in per cent of the positive's.
LOW, HIGH = 80, 100
NONE = np.iinfo(np.int64).min
#: Bounds are taken a little wider than floating point can be wrong.
MARGIN = 1 + 1e-9


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """row, id, label, v, size and norm of the rows that take part, with their bucket; written once."""
    v = F.col(vector_col)
    own = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(v))
    own = own.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole(v, scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    own = written(own.withColumns({"size": F.size("v"), "norm": F.sqrt(square)}), "negative-rows")
    n = max(1, -(-own.count() // BUCKET))
    return written(own.repartitionByRange(n, "size", F.desc("norm"), "row").withColumn("bucket", F.spark_partition_id()), "negative-buckets")


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(len(column), size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b: by floating point where no sum can leave its 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.array(a.astype(object) @ b.T.astype(object), object).astype(np.int64)  # an error if a score leaves 64 bits


class Best:
    """The k best (score, id) of each of n windows: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """For the windows at the scores of rows ids (ascending) of which ok take part."""
        some = ok.any(axis=1)
        at, scores = at[some], np.where(ok[some], scores[some], NONE)
        if not len(at):
            return
        k = min(self.k, scores.shape[1])
        if k < scores.shape[1]:
            # Those above the k-th, and of those equal to it the first, which have the smallest ids.
            least = -np.partition(-np.maximum(scores, NONE + 1), k - 1, axis=1)[:, k - 1]
            above, equal = scores > least[:, None], scores == least[:, None]
            keep = above | (equal & (np.cumsum(equal, axis=1) <= (k - above.sum(axis=1))[:, None]))
            rows, cols = np.nonzero(keep)
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            new_score, new_id = np.full((len(at), k), NONE), np.zeros((len(at), k), np.int64)
            new_score[rows, place], new_id[rows, place] = scores[rows, cols], ids[cols]
        else:
            new_score, new_id = scores, np.broadcast_to(ids, scores.shape)
        score, own = np.concatenate([self.score[at], new_score], axis=1), np.concatenate([self.id[at], new_id], axis=1)
        order = np.lexsort((own, -np.maximum(score, NONE + 1)), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)


def cells(anchors: DataFrame, n_anchors: int, rows: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(anchors, rows) for each block of anchors and each bucket that its anchors ask for (column buckets)."""
    blocks = max(1, -(-n_anchors // BLOCK))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    left = dealt.select("*", F.explode("buckets").alias("bucket")).drop("buckets")
    asked = left.select(F.col("block").alias("for_block"), F.col("bucket").alias("wanted")).distinct()
    right = rows.join(asked, rows["bucket"] == F.col("wanted"))
    return left.groupBy("block", "bucket").cogroup(right.groupBy("for_block", "wanted")).applyInArrow(search, schema)


def searched(rows: DataFrame, anchors: DataFrame, k: int, windows: bool) -> DataFrame:
    """Of every anchor and window the k best rows: row, id (the anchor's), place (the window's), rank, found, score.

    anchors: row, id, label, v, size, norm. Without windows rows are of the anchor's label and not the
    anchor; with windows (positive: array of scores) of another label, scores within LOW and HIGH per
    cent of the positive's.
    """

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        size = {n: (a, b) for n, a, b in _by_size(own, others)} if own.num_rows and others.num_rows else {}
        for a, b in size.values():
            out += list(_scored(a, b, k, windows))
        row, anchor, place, found, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 5))
        return pa.table({"row": row, "id": anchor, "place": pa.array(place, pa.int32()), "found": found, "score": score})

    schema = "row long, id long, place int, found long, score long"
    tops = rows.groupBy("size", "bucket").agg(F.max("norm").alias("top"))
    # By size the buckets with their greatest norm: sixteen bytes for BUCKET rows.
    tops = tops.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("bucket", "top"))).alias("tops"))
    asked = written(anchors.join(tops, "size"), "negative-anchors")
    n = asked.count()
    first = written(cells(asked.withColumn("buckets", F.array(F.col("tops")[0]["bucket"])).drop("tops"), n, rows, search, schema), "negative-first")

    # What a row must score: the k-th best so far, and for negatives the least limit of the windows.
    kth = first.groupBy("row", "place").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    if windows:
        limit = F.posexplode(F.transform("positive", lambda p: F.ceil(p.cast("double") * F.lit(LOW / 100)).cast("long")))
        limits = asked.select("row", limit.alias("place", "limit")).join(kth, ["row", "place"], "left")
        limits = limits.groupBy("row").agg(F.min(F.greatest("limit", "kth")).alias("must"))
        asked = asked.join(limits, "row")
    else:
        asked = asked.join(kth.select("row", F.col("kth").alias("must")), "row", "left")
    may = lambda b: F.col("must").isNull() | (F.col("norm") * b["top"] * F.lit(MARGIN) >= F.col("must"))
    rest = F.filter(F.slice("tops", F.lit(2), F.size("tops")), may)
    later = cells(asked.withColumn("buckets", F.transform(rest, lambda b: b["bucket"])).drop("tops"), n, rows, search, schema)
    ranked = F.row_number().over(W.partitionBy("row", "place").orderBy(F.desc("score"), "found"))
    return first.unionByName(later).withColumn("rank", ranked).filter(F.col("rank") <= k)


def _by_size(own: pa.Table, others: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table]]:
    a, b = np.asarray(own["size"]), np.asarray(others["size"])
    for n in np.intersect1d(a, b):
        yield int(n), own.filter(pa.array(a == n)), others.filter(pa.array(b == n))


def _scored(own: pa.Table, others: pa.Table, k: int, windows: bool) -> Iterator[list[np.ndarray]]:
    """Of anchors and rows with vectors of one size: anchor rows, anchor ids, places, ids found, scores."""
    size = int(own["size"][0].as_py())
    a, a_row, a_id, a_label, a_norm = matrix(own["v"], size), *(np.asarray(own[c]) for c in ("row", "id", "label", "norm"))
    falling = np.argsort(-np.asarray(others["norm"]), kind="stable")
    b, b_row, b_id, b_label, b_norm = matrix(others["v"], size)[falling], *(np.asarray(others[c])[falling] for c in ("row", "id", "label", "norm"))
    must = np.array([NONE if m is None else m for m in own["must"].to_pylist()]) if "must" in own.column_names else np.full(len(a), NONE)
    positive = own["positive"].to_pylist() if windows else [[0]] * len(a)
    for s in range(0, len(a), ANCHORS):
        part = slice(s, min(s + ANCHORS, len(a)))
        of = np.repeat(np.arange(part.start, part.stop), [len(p) for p in positive[part]])
        place = np.concatenate([np.arange(len(p)) for p in positive[part]]) if len(of) else of
        # In whole numbers of any size, as products with per cents may leave 64 bits.
        low = np.array([-(-x * LOW // 100) if windows else NONE for p in positive[part] for x in p], np.int64)
        high = np.array([x * HIGH // 100 for p in positive[part] for x in p], np.int64)
        best = Best(len(of), k)
        for t in range(0, len(b), STEP):
            reach = a_norm[of] * b_norm[t] * MARGIN
            live = np.flatnonzero((reach >= np.maximum(low, best.score[:, k - 1])) & (reach >= must[of]))
            if not len(live):
                break  # norms fall: nothing further on can do it either
            step = t + np.argsort(b_id[t : t + STEP], kind="stable")
            who, back = np.unique(of[live], return_inverse=True)
            scores = products(a[who], b[step])[back]
            same = b_label[step][None, :] == a_label[of[live]][:, None]
            if windows:
                ok = ~same & (scores >= low[live, None]) & (scores <= high[live, None])
            else:
                ok = same & (b_row[step][None, :] != a_row[of[live]][:, None])
            best.add(live, scores, ok, b_id[step])
        at, j = np.nonzero(best.score > NONE)
        yield [a_row[of[at]], a_id[of[at]], place[at], best.id[at, j], best.score[at, j]]


def mined(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    scale: int = 256,
) -> DataFrame:
    """The hardest negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors is a condition on id, label a column of rows. An anchor's positives are its best rows of the
    same label but itself; their negatives the best rows of other labels that score LOW to HIGH per cent
    of the positive. Ties go to smaller ids. Rows whose id, label or vector is null, or whose vector has
    null or non-finite components, take no part; rows meet rows with vectors of the same length only;
    repeated rows are rows of their own, as anchors, positives and negatives; empty tables, anchors
    without positives and windows without rows give no rows; other columns are not read. Scores must
    fit in 64 bits.
    """
    every = prepared(rows, id_col, vector_col, label, scale)
    asking = every.filter(anchors).drop("bucket")
    near = written(searched(every, asking, positives, windows=False), "negative-positives")
    lists = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found").alias("positive_id"), F.col("score").alias("positive")))).alias("p"))
    asking = asking.join(lists, "row").withColumn("positive", F.transform("p", lambda p: p["positive"])).drop("p")
    hard = searched(every, asking, negatives, windows=True)
    told = near.select("row", (F.col("rank") - 1).alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(told, ["row", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled() -> Column:
    """The label that the query over embeddings takes: every seventh row has the next one."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


#: DuckDB twin over embeddings: anchors are the ids divisible by 100.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.r, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
