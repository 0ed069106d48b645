"""Quality classifier from positive and unlabelled texts.

A linear model over character-class statistics is fitted by minimising the non-negative unbiased
risk (Kiryo et al., 2017): prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), with trusted positives,
unlabelled texts and an estimate of the class prior. Whenever the part for negatives falls below zero
it is pushed up again instead of being fitted further. Labels 0 are never looked at.

The prior comes from positives and unlabelled texts alone (best bin estimation, Garg et al., 2021): of
texts scored by a model that was fitted on the other half of the sample, the share of unlabelled ones
above a threshold is at least prior times that of positives, and nearly that where hardly a negative
is left; the threshold is the one with the least upper confidence bound.

Fitting takes a bounded sample of texts (MOST_POSITIVES, MOST_UNLABELLED; one text of each of the ids
of lowest hash), so what reaches the driver does not grow; scoring covers all texts, in one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped

MOST_POSITIVES = 3000
MOST_UNLABELLED = 5000

#: Classes of bytes: lower case, upper case, digits, blank, line end, other controls, lead and
#: continuation bytes of other characters, and each ASCII punctuation mark by itself.
CLASS = np.full(256, 5, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[32, 9]], CLASS[[10, 13]] = 3, 4
CLASS[192:256], CLASS[128:192] = 6, 7
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[MARKS] = np.arange(8, 8 + len(MARKS))
N_CLASSES = 8 + len(MARKS)
N_SHAPE = 14
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + N_SHAPE


def _repeats(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of each text's items that occur earlier in it."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    n = np.bincount(doc, minlength=n_docs)
    return np.bincount(d[again], minlength=n_docs) / np.maximum(n, 1)


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text: roots of the shares of byte classes and of pairs of them, and figures on words and lines."""
    data, starts = tg.flat(texts)
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for a, b in tg.chunks(starts):
        part, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        n, size = b - a, np.diff(at)
        doc = np.repeat(np.arange(n), size)
        cls = CLASS[part]
        one = np.bincount(doc * N_CLASSES + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        same = doc[1:] == doc[:-1]
        pair = np.bincount((doc[1:] * N_CLASSES**2 + cls[:-1] * N_CLASSES + cls[1:])[same], minlength=n * N_CLASSES**2)
        total = np.maximum(size, 1)[:, None]
        words, wdoc = tg.word_hashes(part, at)
        n_words = np.bincount(wdoc, minlength=n)
        trio, tdoc = tg.shingles(part, at, 3)
        ends = np.flatnonzero(part == 10)
        lines = np.bincount(doc[ends], minlength=n) + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(tg.BYTE[part] * tg.powers(tg.BASE, len(part)))])
            cuts = np.unique(np.concatenate([at[:-1][size > 0], ends + 1, at[1:][size > 0]]))
            first, last = cuts[:-1], cuts[1:]
            if len(first):
                last = last - (part[last - 1] == 10)
                line = tg.mix((sums[last] - sums[first]) * tg.powers(tg.UNBASE, len(part) + 1)[first])
                ldoc = doc[first]
            else:
                line, ldoc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        letters = one[:, 0] + one[:, 1] + one[:, 6]
        shape = np.stack(
            [
                np.log1p(size), np.log1p(n_words), np.log1p(lines), size / np.maximum(n_words, 1) / 10, size / lines / 100,
                _repeats(words, wdoc, n), _repeats(trio, tdoc, n), _repeats(line, ldoc, n),
                letters / total[:, 0], one[:, 1] / np.maximum(letters, 1), one[:, 2] / total[:, 0],
                one[:, 8:].sum(1) / total[:, 0], (one[:, 8:] > 0).sum(1) / 10, size == 0,
            ],
            1,
        )
        out[a:b, : N_CLASSES**2] = np.sqrt(pair.reshape(n, -1) / total)
        out[a:b, N_CLASSES**2 : -N_SHAPE] = np.sqrt(one / total)
        out[a:b, -N_SHAPE:] = shape
    return out


class Model:
    """Linear scores of standardised features; sigmoid of them as the score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.weights = (weights / scale).astype(np.float32)
        self.bias = float(bias - (mean / scale) @ weights)

    def score(self, texts: pa.Array) -> np.ndarray:
        z = features(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 150, rate: float = 0.03, decay: float = 1e-2) -> Model:
    """Fit by Adam on the whole sample, with logistic loss. No positives: every score is 0; no unlabelled texts: 1."""
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 40.0 if len(p) else -40.0)
    mean, scale = u.mean(0), np.maximum(u.std(0), np.float32(1e-3))
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (p, u))
    w, b = np.zeros(N_FEATURES), 0.0
    m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        zp, zu = (p @ w32).astype(float) + b, (u @ w32).astype(float) + b
        negative = soft(zu).mean() - prior * soft(zp).mean()
        # Gradients by score: loss(z) = log(1 + exp(-z)) for label 1, log(1 + exp(z)) for label 0.
        gp, gu = prior * -sig(-zp) / len(p), np.zeros(len(u))
        down_p, down_u = -prior * sig(zp) / len(p), sig(zu) / len(u)
        if negative >= 0:
            gp, gu = gp + down_p, down_u
        else:
            gp, gu = -down_p, -down_u
        g = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, b)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled texts, from scores of both by a model that saw neither."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x, at, "left") / len(x)
    of_p, of_u = above(p), above(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((of_u + slack) / of_p))
    return float(np.clip(of_u[best] / of_p[best], 0.01, 0.99))


def estimated_prior(p: np.ndarray, u: np.ndarray, steps: int = 60) -> float:
    """class_prior by two halves of the sample, each scored by a model of the other; 0.5 if a half has no text of a kind."""
    if min(len(p), len(u)) < 2:
        return 0.5
    scores: dict[str, list[np.ndarray]] = {"p": [], "u": []}
    for half in (0, 1):
        model = nnpu(p[half::2], u[half::2], 0.5, steps)
        for kind, x in (("p", p), ("u", u)):
            scores[kind].append(x[1 - half :: 2] @ model.weights + model.bias)
    return class_prior(np.concatenate(scores["p"]), np.concatenate(scores["u"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model from labels (id_col, label_col) that may be learnt from and the texts of docs.

    Null ids and labels take no part; of repeated ids one text counts (of least hash), null texts are
    empty ones, very long ones are read whole. Without labels, or without documents that have one, every
    score is 0. Other columns are not read.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    trusted = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(id_col)
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull())
    good = trusted.join(ids, id_col, "left_semi")
    # Both lists have a set size; so the join below ships a set size.
    pick = lambda df, n, kind: df.distinct().orderBy(order, id_col).limit(n).select(id_col, F.lit(kind).alias("kind"))
    chosen = pick(good, MOST_POSITIVES, "p").unionByName(pick(ids.filter(~held_out(id_col)), MOST_UNLABELLED, "u"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(id_col, text.alias("_fw_text")).join(F.broadcast(chosen), id_col)
    # An id that many rows have gives one text, chosen before the shuffle.
    texts = texts.groupBy("kind", id_col).agg(F.min_by("_fw_text", F.xxhash64("_fw_text")).alias("_fw_text")).select("kind", "_fw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1)).astype(np.float16)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["kind", "x"])

    got = mapped(texts, run, "kind string, x binary").toArrow().to_pydict()
    rows = {k: sorted(x for kind, x in zip(got["kind"], got["x"], strict=True) if kind == k) for k in "pu"}
    p, u = (np.frombuffer(b"".join(rows[k]), np.float16).reshape(-1, N_FEATURES).astype(np.float32) for k in "pu")
    return nnpu(p, u, estimated_prior(p, u))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row's whole text.

    Null texts count as empty and have a score like others; null ids stay null; repeated rows are rows of
    their own; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)), pa.float64())], names=[id_col, "score"])

    rows = docs.select(id_col, text_col)
    return mapped(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches least, same columns, whatever their names.

    Null texts are judged as empty ones and stay null; null ids and repeated rows are judged by their
    texts; very long texts are read whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array(model.score(part.column(at)) >= least))

    return mapped(docs, run, docs.schema)
