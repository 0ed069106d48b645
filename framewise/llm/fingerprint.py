"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of
parts merge into the sketch of the whole (the k smallest of the union); from them come resemblance,
containment and the number of distinct shingles. A sketch that holds fewer than k hashes holds all,
and its figures are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped, written

K = 128


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of every text, ascending. Null and empty texts, and such without words, have empty ones."""
    data, starts = tg.flat(texts)
    out: list[np.ndarray] = []
    for a, b in tg.chunks(starts):
        h, doc, _ = tg.shingle_counts(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        at = np.searchsorted(doc, np.arange(b - a + 1))
        out += [h[x : min(x + k, y)] for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of two shingle sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[:-1] == both[1:]
    if len(a) < k and len(b) < k:
        return float(twice.sum() / (len(both) - twice.sum()))
    first = np.concatenate([[True], ~twice])
    union = both[first][:k]
    return float(np.count_nonzero(both[:-1][twice] <= union[-1]) / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) + 1) * 2.0**64


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k))


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id_col, fingerprint (packed sketch) and n_shingles (estimated distinct ones) of every row of docs.

    One pass without a shuffle. Null texts count as empty; null ids stay null; repeated rows are rows of
    their own; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(packed, found), pa.string()), pa.array([distinct_shingles(x, k) for x in found], pa.float64())],
                names=[id_col, "fingerprint", "n_shingles"],
            )

    rows = docs.select(id_col, text_col)
    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint string, n_shingles double")


#: Bytes of text in a part of the order, in the mean, until there are MOST_PARTS; then parts grow.
PART_BYTES = 8 << 20
MOST_PARTS = 100_000
#: Rows of a large group of copies that one task gives out.
AT_ONCE = 10_000
LEAST_ID = -(1 << 63)


def _ordered(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """(key, tie) as 16 bytes that order as the numbers do."""
    both = np.stack([key.astype(np.int64), tie.astype(np.int64)], 1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").reshape(-1)


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """docs in parts of consecutive rows, each with a copy of the row that follows its last one; and large groups.

    The order is by id (null first), then by a hash of the text. The first table has part, after (1: the
    copy), key, tie, id, text, sorted by those within each partition; after the last part comes the first
    row of all. A group of equal rows that spans parts is one row in it; the second table (id, text, n)
    has those groups. Bounds of parts come from a range partitioning of (id, hash) without texts; there
    are MOST_PARTS of them at most, 16 bytes each, and so many rows may also reach the driver.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // part_bytes)))
    dealt = rows.select("key", "tie").withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "key", "tie", "place")
    found = [tuple(r["b"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "tie")).alias("b")).collect()]
    times = Counter(found)
    bounds = sorted(times) or [(0, 0)]
    wide = [b for b in bounds if times[b] > 1]
    listed = docs.sparkSession.createDataFrame(wide, "key long, tie long")
    groups = rows.join(F.broadcast(listed), ["key", "tie"]).groupBy("key", "tie", "id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "sketch-groups")
    if wide:
        rows = rows.join(F.broadcast(listed), ["key", "tie"], "left_anti").unionByName(groups.select("key", "id", "text", "tie"))
    edges, m = _ordered(*np.array(bounds, np.int64).T), len(bounds)

    @F.pandas_udf("int")
    def place(keys: pd.Series, ties: pd.Series) -> pd.Series:
        own = _ordered(keys.to_numpy(), ties.to_numpy())
        at = np.maximum(np.searchsorted(edges, own, "right") - 1, 0)
        return pd.Series((at * 2 + (edges[at] == own)).astype(np.int32))

    part = F.call_function("shiftright", F.col("p"), F.lit(1))
    mine = F.struct(part.alias("part"), F.lit(0).alias("after"))
    before = F.struct(((part + (m - 1)) % m).cast("int").alias("part"), F.lit(1).alias("after"))
    spread = rows.withColumn("p", place("key", "tie")).select(
        F.explode(F.when(F.col("p") % 2 == 1, F.array(mine, before)).otherwise(F.array(mine))).alias("b"), "key", "tie", "id", "text"
    )
    order = ["part", "after", "key", "tie"]
    return spread.select("b.part", "b.after", "key", "tie", "id", "text").repartition(m, "part").sortWithinPartitions(*order), groups


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, part: int = 4) -> DataFrame:
    """Every text's sketch against that of an edited text and of the next document's text.

    The edited text has the last floor(n / part) code points replaced by the first as many (or all)
    of the next document, in order of id (then of a hash of the text); after the last comes the first.
    Null texts count as empty, null ids come first, repeated rows follow each other, an only row
    follows itself, very long texts are taken whole, an empty table gives no rows, and columns beside
    the two are not read.
    """

    def told(pairs: list[tuple[list, list]]) -> pa.RecordBatch:
        """Rows of pairs (document, next one), each [id, text, sketch or None]."""
        fresh = {id(r): r for pair in pairs for r in pair if r[2] is None}
        for r, s in zip(fresh.values(), sketches(pa.array([r[1] for r in fresh.values()], pa.string()), k), strict=True):
            r[2] = s
        edited = []
        for r, nxt in pairs:
            q = len(r[1]) // part
            edited.append(r[1][: len(r[1]) - q] + nxt[1][:q])
        other = sketches(pa.array(edited, pa.string()), k)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r, _ in pairs], pa.int64()),
                pa.array([len(r[1]) for r, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([packed(r[2]) for r, _ in pairs], pa.string()),
                pa.array(map(packed, other), pa.string()),
                pa.array([resemblance(r[2], s, k) for (r, _), s in zip(pairs, other, strict=True)], pa.float64()),
                pa.array([resemblance(r[2], nxt[2], k) for r, nxt in pairs], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs, held = None, [], 0
        for batch in batches:
            c = tg.columns(batch)
            for after, ident, text in zip(c["after"].to_pylist(), c["id"].to_pylist(), c["text"], strict=True):
                if after and last is None:
                    continue  # further rows that equal the one that follows
                row = [ident, text.as_py(), None]
                if last is not None:
                    pairs.append((last, row))
                    held += len(row[1])
                last = None if after else row
                if held > tg.CHUNK:
                    yield told(pairs)
                    pairs, held = [], 0
        if pairs:
            yield told(pairs)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that follow themselves, with n."""
        for batch in batches:
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [i, t, None]
                out = told([(row, row)])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([n], pa.int64())], names=[*out.schema.names, "n"])

    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows, groups = in_order_with_next(docs, id_col, text_col)
    out = mapped(rows, run, kinds)
    # Of a group of n equal rows the last meets what follows; the other n - 1 meet their own text.
    if not groups.isEmpty():
        own = mapped(groups.select("id", "text", "n"), alone, f"{kinds}, n long")
        blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / AT_ONCE).cast("long"))
        some = own.filter("n > 1").withColumn("block", F.explode(blocks)).repartition("block")
        rest = F.least(F.lit(AT_ONCE).cast("long"), F.col("n") - 1 - F.col("block") * AT_ONCE)
        out = out.unionByName(some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop("n", "block", "copy"))
    return out.withColumnRenamed("id", id_col).withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
