"""Exact top-k search by integer inner product, with a pivot table.

Vectors become integers, floor(scale * x). A table of distances to a fixed number of pivots is
computed once for every vector; |d(q, p) - d(x, p)| over all pivots p bounds the distance of query
and candidate from below, and with the norms that bounds their inner product from above. Candidates
are scored in order of that bound until the next bound is below the k-th best score: no candidate
that could enter is left out, so the result is exact, ties included.

Equal candidates are one row with a count. Queries and candidates are dealt to the cells of a grid by
hash, a bounded number of each to a cell, and every cell searches its candidates for its queries; it
keeps k rows a query, and a ranking by query merges the cells' rows. Candidates are sent once for
each block of queries, as an exact search of a query set against all rows asks. Only two counts and
the pivots go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import copies_of, mapped, written

PIVOTS = 32
#: Lengths of vectors that get pivots; vectors of further lengths are bounded by their norms alone.
LENGTHS = 64
#: Queries and candidates in a cell, in the mean, and the least number of candidate blocks.
BLOCK, CANDIDATES, LEAST_BLOCKS = 8192, 16_384, 16
#: Scored at once before the bounds are looked at again.
STEP = 64


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components. The empty vector is usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def pivots_of(queries: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """Of each of the LENGTHS commonest lengths n query vectors, those of least hash."""
    some = queries.select(F.size("v").alias("length"), "v").withColumn("h", F.xxhash64("v"))
    common = some.groupBy("length").count().orderBy(F.desc("count"), "length").limit(LENGTHS).select("length")
    first = F.row_number().over(W.partitionBy("length").orderBy("h"))
    rows = some.join(F.broadcast(common), "length").withColumn("r", first).filter(F.col("r") <= n).select("length", "v").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["length"], []).append(list(r["v"]))
    return {length: np.array(v, np.int64).reshape(len(v), length).astype(float) for length, v in out.items()}


def squares(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(float)
    return np.einsum("ij,ij->i", x, x)


def with_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, v, n) with t: the distances of v to the pivots of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: list = [[]] * batch.num_rows
            for length, where, m in _vectors(batch.column(1)):
                p = pivots.get(length)
                if p is not None:
                    d = squares(m)[:, None] + squares(p)[None, :] - 2 * (m.astype(float) @ p.T)
                    for i, t in zip(where, np.sqrt(np.maximum(d, 0)).tolist(), strict=True):
                        table[i] = t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table, pa.list_(pa.float64()))], names=["id", "v", "n", "t"])

    return mapped(rows.select("id", "v", "n"), run, "id long, v array<long>, n long, t array<double>")


def best_of(query: tuple[int, np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, counts: np.ndarray, square: np.ndarray, table: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (-score, id) for a query (id, vector, distances to pivots), and how many candidates were scored.

    One of the candidates that equal the query in id and vector is its own row and does not count.
    """
    own, vector, mine = query
    norm = float(vector.astype(float) @ vector.astype(float))
    low = np.abs(table - mine).max(axis=1) if table.shape[1] else np.zeros(len(ids))
    # Rounding of the distances is covered by a margin far above it.
    low = np.maximum(0, low - 1e-6 * (1 + low + np.sqrt(norm)))
    high = (norm + square - low * low) / 2 + 1e-9 * (norm + square) + 1
    order = np.argsort(-high, kind="stable")
    best: list[tuple[int, int]] = []
    at = 0
    while at < len(order):
        part = order[at : at + STEP]
        if len(best) == k and high[part[0]] < -best[-1][0]:
            break
        scores = vectors[part] @ vector
        n = counts[part] - ((ids[part] == own) & (vectors[part] == vector).all(axis=1))
        times = np.minimum(n, k)
        best = sorted([*best, *zip(np.repeat(-scores, times).tolist(), np.repeat(ids[part], times).tolist(), strict=True)])[:k]
        at += len(part)
    return best, at


def _vectors(column: pa.Array, kind: type = np.int64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), dtype=kind)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return [
        (int(n), rows := np.flatnonzero(lengths == n), flat[starts[rows][:, None] + np.arange(n)]) for n in np.unique(lengths)
    ]


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    n_pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """The k candidates of highest inner product for each query (all, if fewer), ties to smaller ids.

    Returns query_id, rank (from 1), id_col, score. Each row of queries has a list of its own, also where
    ids or whole rows repeat. One candidate row that equals the
    query in both is its own and left out; further ones, and rows of its id with another vector, are
    candidates, and repeated candidate rows count each. Vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null id; vectors meet those of the same
    length only, of whatever length. No queries or no candidates give no rows; other columns are not read.
    """

    def ready(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        rows = df.filter(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), whole(v, scale).alias("v"))
        return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))

    asked = ready(queries)
    pivots = pivots_of(asked, n_pivots)
    asked = written(with_table(asked, pivots).withColumn("query", F.monotonically_increasing_id()), "search-queries")
    rows = written(with_table(ready(candidates), pivots), "search-rows")

    across = max(1, -(-asked.count() // block))
    down = max(LEAST_BLOCKS, -(-rows.count() // CANDIDATES))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", "t", "query", dealt(across).alias("across"), every(down).alias("down"))
    right = rows.select("id", "v", "n", "t", every(across).alias("across"), dealt(down).alias("down"))

    def search(own: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if own.num_rows and others.num_rows:
            own, others = own.combine_chunks(), others.combine_chunks()
            held = lambda t, c, kind=np.int64: np.asarray(t[c].combine_chunks(), dtype=kind)
            tables = lambda t: {int(i): x for _, where, m in _vectors(t["t"].combine_chunks(), float) for i, x in zip(where, m, strict=True)}
            c_ids, c_n, c_t, q_ids, q_row, q_t = held(others, "id"), held(others, "n"), tables(others), held(own, "id"), held(own, "query"), tables(own)
            side = {n: (where, m) for n, where, m in _vectors(others["v"].combine_chunks())}
            for n, where, m in _vectors(own["v"].combine_chunks()):
                if n in side:
                    at, vectors = side[n]
                    table = np.stack([c_t[int(i)] for i in at])
                    parts = (c_ids[at], vectors, c_n[at], squares(vectors), table)
                    for i, v in zip(where, m, strict=True):
                        best, _ = best_of((int(q_ids[i]), v, q_t[int(i)]), *parts, k)
                        found += [(int(q_row[i]), int(q_ids[i]), x, -s) for s, x in best]
        r, q, i, s = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"query": pa.array(r, pa.int64()), "query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    cells = left.groupBy("across", "down").cogroup(right.groupBy("across", "down"))
    parts = cells.applyInArrow(search, "query long, query_id long, id long, score long")
    ranked = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    merged = parts.withColumn("rank", ranked).filter(F.col("rank") <= k)
    # Equal query rows were searched for once.
    merged = merged.join(asked.select("query", "n"), "query")
    return copies_of(merged).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


#: DuckDB twin over embeddings: queries are the ids divisible by 100.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
