"""Quality rules on repetition: how much of a text lies in n-grams and lines that it holds twice.

Rolling hashes of n-grams of words, for several n, come from one pass: the hash of n + 1 words is
that of n words, times a constant, plus the next word's. An n-gram that stands twice holds one of
n - 1 words that does, so only the shortest length is sorted in full and each further length looks at
what the one before found. Words in found n-grams are marked, each once however many cover it, and
their characters are measured; likewise those of lines that equal an earlier one. All texts of a chunk
are worked on together in NumPy; a text never leaves its row, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped

#: Most per cent of a text's characters (in words) inside n-grams that stand twice, by n (Rae et al., 2021).
MOST = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most per cent of lines, and of characters, in lines equal to an earlier one.
MOST_LINES, MOST_LINE_CHARS = 30, 20
#: The base rule: least words, the n-gram, and the most per cent of words inside repeated ones.
LEAST_WORDS, BASE_N, MOST_REPEATED = 20, 8, 30
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in MOST))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in an n-gram that starts at one of at."""
    edge = np.zeros(size + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge)[:size] > 0


def ngram_coverage(words: np.ndarray, doc: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, ascending, the words that lie in n-grams which their text holds twice."""
    with np.errstate(over="ignore"):
        salt = tg.mix(doc.astype(U) + U(1))
        at, h, have = np.arange(len(words)), words.copy(), 1
        for n in lengths:
            for j in range(have, n):
                at, h = at[at + j < len(words)], h[: np.count_nonzero(at + j < len(words))]
                inside = doc[at + j] == doc[at]
                at, h = at[inside], h[inside]
                h = h * STEP + words[at + j]
            have = n
            twice = repeated(tg.mix(h) ^ salt[at])
            at, h = at[twice], h[twice]
            yield n, covered(at, n, len(words))


def repeated_lines(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line with a word (first: where words start), and whether it equals an earlier one of its text."""
    ends = np.union1d(np.flatnonzero(data == 10), starts[1:])
    begins = np.concatenate([starts[:1], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)])
    some = np.searchsorted(first, ends) > np.searchsorted(first, begins)
    begins, ends = begins[some], ends[some]
    doc = np.searchsorted(starts, begins, "right") - 1
    earlier = np.zeros(len(begins), bool)
    keys = tg.run_hashes(data, begins, ends) ^ tg.mix(doc.astype(U) + U(1))
    seen: set[tuple[int, bytes]] = set()
    for i in np.flatnonzero(repeated(keys)):  # hashes only propose; bytes decide
        line = (int(doc[i]), data[begins[i] : ends[i]].tobytes())
        earlier[i] = line in seen
        seen.add(line)
    return begins, ends, doc, earlier


def measured(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text in data."""
    n_docs = len(starts) - 1
    out = {c: np.zeros(n_docs, np.int64) for c in COUNTS}
    if not len(data):
        return out
    first, last = tg.words(data, starts, ~tg.SPACE[data])
    doc = np.searchsorted(starts, first, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[last] - points[first]
    total = lambda of, weights=None: np.bincount(of, weights, n_docs).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_words"], out["word_chars"], out["n_symbols"] = total(doc), total(doc, chars), np.diff(symbols[starts])
    begins, ends, of, earlier = repeated_lines(data, starts, first)
    out["n_lines"], out["n_dup_lines"] = total(of), total(of[earlier])
    held = np.concatenate([[0], np.cumsum(chars)])
    inside = held[np.searchsorted(first, ends)] - held[np.searchsorted(first, begins)]
    out["dup_line_chars"] = total(of[earlier], inside[earlier])
    for n, marked in ngram_coverage(tg.sure_hashes(data, first, last), doc, tuple(MOST)):
        out[f"dup_chars_{n}"] = total(doc[marked], chars[marked])
        if n == BASE_N:
            out["n_repeat_words"] = total(doc[marked])
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col of every row of docs, COUNTS, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of them in 8-grams that stand twice. kept: not that,
    and within MOST for each n and the limits on repeated lines, all in whole numbers. Null and empty
    texts have no words and fail; repeated rows are rows of their own; very long texts are measured
    whole (a chunk holds one at least); an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = tg.flat(batch.column(1))
            parts = [measured(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in tg.chunks(starts)]
            c = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            kept = ~failed & (100 * c["n_dup_lines"] <= MOST_LINES * c["n_lines"]) & (100 * c["dup_line_chars"] <= MOST_LINE_CHARS * c["word_chars"])
            for n, most in MOST.items():
                kept &= 100 * c[f"dup_chars_{n}"] <= most * c["word_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(kept)], names=[id_col, *COUNTS, "base_failed", "kept"])

    rows = docs.select(id_col, text_col)
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return mapped(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {kinds}, base_failed boolean, kept boolean")


def _sql() -> str:
    grams = ", ".join(f"{' || chr(32) || '.join(['w', *(f'lead(w, {j}) OVER o' for j in range(1, n))])} AS g{n}" for n in MOST)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 AS t{n}" for n in MOST)
    marks = ", ".join(f"max(CAST(t{n} AS INT)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in MOST)
    sums = ", ".join(f"CAST(sum(m{n} * length(w)) AS BIGINT) AS dup_chars_{n}" for n in MOST)
    own = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in MOST)
    within = " AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in MOST.items())
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {words} AS ws, len({words}) AS n FROM d),
x AS (SELECT rid, i, w, {grams} FROM (SELECT rid, unnest(ws) AS w, unnest(range(n)) AS i FROM w) WINDOW o AS (PARTITION BY rid ORDER BY i)),
y AS (SELECT rid, i, w, {twice} FROM x),
z AS (SELECT rid, i, w, {marks} FROM y),
a AS (SELECT rid, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(sum(m{BASE_N}) AS BIGINT) AS n_repeat_words, {sums} FROM z GROUP BY rid),
l AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS k, coalesce(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda v: length(v))), 0) AS c
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
b AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, CAST(coalesce(sum(c) FILTER (k > 1), 0) AS BIGINT) AS dup_line_chars FROM l WHERE c > 0 GROUP BY rid),
r AS (SELECT doc_id, n AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, {own},
        n < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * n AS base_failed
      FROM d JOIN w USING (rid) LEFT JOIN a USING (rid) LEFT JOIN b USING (rid))
SELECT *, NOT base_failed AND 100 * n_dup_lines <= {MOST_LINES} * n_lines AND 100 * dup_line_chars <= {MOST_LINE_CHARS} * word_chars AND {within} AS kept FROM r
"""


#: DuckDB twin over documents.
SQL = _sql()
