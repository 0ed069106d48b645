"""Removing byte strings that occur twice, with suffix arrays by two-stage sorting.

A string of LENGTH bytes has an anchor: the least hash of the GRAM-byte strings in it. Equal strings
have equal anchors, and the strings of a text with one anchor in a row form a segment. Only anchors
that occur in more than one place matter; their segments are cut out and dealt to tasks by anchor,
so that all places of a string meet. There suffix arrays are built over whole groups of segments, a
bounded number of bytes at a time: suffixes smaller than their successors are sorted, the others are
induced from them by scanning the buckets of first bytes, and neighbours that share LENGTH bytes mark
the strings. Anchors in more places than HOT are not gathered: their strings are dealt by hashes of
whole strings instead, and counted with partial sums. Equal texts are one text from the start.

Texts are told apart by 128 bits of their SHA-256. On the path for hot anchors strings are told apart
by 64-bit hashes of their anchor and of themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped, text_or_empty, written

LENGTH = 200
GRAM = 32
#: Places of an anchor up to which its segments are gathered in one group.
HOT = 5000
#: Bytes of segments in one suffix array; a group is never divided.
AT_ONCE = 1 << 19
U = np.uint64


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place."""
    if len(data) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(tg.BYTE[data] * tg.powers(tg.BASE, len(data)), out=sums[1:])
        return tg.mix((sums[n:] - sums[:-n]) * tg.powers(tg.UNBASE, len(data))[: len(sums) - n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the width values from each place."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: anchor, text, first start, last start, and places.

    places is 2 for a run whose anchor recurs so near that the run may hold a string twice, else 1.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    width = LENGTH - GRAM + 1
    grams = gram_hashes(data, GRAM)
    least = sliding_min(grams, width)
    size = np.diff(starts)
    n = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    anchor = least[at + starts[doc]]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first

    # Places of grams that are the least of some string; of equal ones those that are near each other.
    pad = np.zeros(width - 1, U)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), width)
    where = np.flatnonzero(most == grams)
    order = np.argsort(grams[where], kind="stable")
    where = where[order]
    value, owner = grams[where], np.searchsorted(starts, where, "right") - 1
    near = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(where) <= width)
    with np.errstate(over="ignore"):
        name = lambda v, d: v ^ tg.mix(d.astype(U) + U(1))
        twice = np.isin(name(anchor[first], doc[first]), name(value[1:][near], owner[1:][near]))
    return anchor[first].view(np.int64), doc[first], at[first], at[last], 1 + twice.astype(np.int64)


def two_stage_order(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of data, or those wanted among others, in order of their first depth bytes at least.

    A suffix is of the first stage if it is smaller than its successor, that is, if the next other
    byte is greater; those are sorted by comparing. The rest are induced: going through the buckets of
    first bytes upwards, each suffix in order puts its predecessor, if that is of the second stage,
    next in the front part of its own bucket.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    # small[i]: suffix i is smaller than suffix i + 1. The last suffix is larger than the empty one.
    change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    nxt = change[np.searchsorted(change, np.arange(n))]  # last place of the run of equal bytes
    small = np.zeros(n, bool)
    inner = nxt < n - 1
    small[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    need = np.ones(n, bool)
    if wanted is not None:
        # Those wanted and, for the second stage, their successors up to one of the first.
        first = np.append(np.flatnonzero(small), n - 1)
        at = np.flatnonzero(wanted)
        steps = np.bincount(at, minlength=n + 1) - np.bincount(first[np.searchsorted(first[:-1], at)] + 1, minlength=n + 1)
        need = np.cumsum(steps)[:n] > 0
    direct = np.array(sorted(np.flatnonzero(small & need).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    by = t[direct]
    cut = np.searchsorted(by, np.arange(257))
    out: list[np.ndarray] = []
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    # How far a suffix goes back through needed ones of its own byte: all of those it induces in its bucket.
    back = np.append(False, (need & ~small)[:-1] & (t[1:] == t[:-1]))  # whether i - 1 is one
    reach = np.arange(n) - np.maximum.accumulate(np.where(back, -1, np.arange(n)))

    def with_runs(part: np.ndarray) -> np.ndarray:
        """part and what it induces in its own bucket: first all predecessors, then all of theirs, and so on."""
        far = reach[part]
        which = np.repeat(np.arange(len(part)), far)
        step = np.arange(len(which)) - np.repeat(np.cumsum(far) - far, far) + 1
        order = np.lexsort((which, step))
        return np.concatenate([part, part[which[order]] - step[order]])

    def scan(part: np.ndarray, own: int) -> None:
        """Deal the predecessors of part to the buckets of other bytes."""
        before = part[part > 0] - 1
        before = before[~small[before] & need[before] & (t[before] != own)]
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        edges = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else c
        for x, y in zip(edges, np.append(edges[1:], len(c)), strict=len(c) > 0):
            waiting[c[x]].append(before[x:y])

    if need[n - 1]:
        waiting[int(t[-1])].append(np.array([n - 1]))  # its successor, the empty suffix, comes before all
    for c in range(256):
        if waiting[c]:
            part = with_runs(np.concatenate(waiting[c]))
            out.append(part)
            scan(part, c)
        part = direct[cut[c] : cut[c + 1]]
        if len(part):
            out.append(part)
            scan(part, c)
    return np.concatenate(out) if out else direct


def common_prefix_reaches(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether neighbours in order share length bytes, eight at a time; suffixes that are shorter do not."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.zeros(n, U)
    for j in range(8):
        words |= padded[j : j + n].astype(U) << U(8 * j)
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero((a + length <= n) & (b + length <= n))
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[words[a[alive] + j] == words[b[alive] + j]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_starts(parts: list[bytes], several: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For distinct segments the starts whose string occurs elsewhere among them.

    several: the segment itself is in more than one place, so all its strings are repeated.
    """
    data = b"".join(parts)
    t = np.frombuffer(data, np.uint8)
    size = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(parts)), size)
    within = begin[owner + 1] - np.arange(len(t)) >= length  # strings that lie within a segment
    order = two_stage_order(data, length + 8, within)
    order = order[within[order]]
    same = common_prefix_reaches(t, order, length)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    marks = np.zeros(len(t), bool)
    marks[order[hit]] = True
    return [
        np.arange(n - length + 1) if many else np.flatnonzero(marks[b : b + n])
        for b, n, many in zip(begin[:-1], size, several, strict=True)
    ]


def covered(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Runs of starts as byte ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def surveyed(rows: DataFrame) -> DataFrame:
    """rows (key, text) without text, with id (the first half of the text's SHA-256), n_bytes, sha256 and arrays anchors, first, last, places: a text's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = tg.flat(batch.column(1))
            for a, b in tg.chunks(starts):
                anchor, doc, first, last, places = segments(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                ends = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                sha = [hashlib.sha256(data[x:y]).digest() for x, y in zip(starts[a:b], starts[a + 1 : b + 1], strict=True)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (anchor, first.astype(np.int32), last.astype(np.int32), places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x[:16] for x in sha], pa.binary()), pa.array(np.diff(starts[a : b + 1])), pa.array([x.hex() for x in sha], pa.string()), *lists],
                    names=["key", "id", "n_bytes", "sha256", "anchors", "first", "last", "places"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return mapped(rows, run, f"key {kind}, id binary, n_bytes long, sha256 string, anchors array<long>, first array<int>, last array<int>, places array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts: (id, text, places) to (anchor, id, first, part)."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_py().encode()
            ident = batch.column(0)[i].as_py()
            places = {(p["a"], p["f"], p["l"]) for p in batch.column(2)[i].as_py()}
            rows = [(a, ident, f, data[f : l + LENGTH]) for a, f, l in places]
            for at in range(0, len(rows), 5000):
                a, d, f, p = zip(*rows[at : at + 5000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(d, pa.binary()), pa.array(f, pa.int32()), pa.array(p, pa.binary())],
                    names=["anchor", "id", "first", "part"],
                )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings of texts: (id, text, places) to (anchor, string, id, start)."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
            ident = batch.column(0)[i].as_py()
            for a, f, l in {(p["a"], p["f"], p["l"]) for p in batch.column(2)[i].as_py()}:
                h = gram_hashes(data[f : l + LENGTH], LENGTH).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, a)), pa.array(h), pa.array([ident] * n, pa.binary()), pa.array(np.arange(f, f + n, dtype=np.int32))],
                    names=["anchor", "string", "id", "start"],
                )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of segments, sorted by anchor and part, to repeated byte ranges (id, start, end)."""
    parts: list[bytes] = []  # distinct segments waiting
    places: list[list[tuple[int, int]]] = []  # of each: id and first start
    held, last = 0, None

    def flush() -> pa.RecordBatch:
        out = []
        for found, own in zip(repeated_starts(parts, [len({*p}) > 1 for p in places]), places, strict=True):
            for a, b in covered(found):
                out += [(d, f + a, f + b) for d, f in {*own}]
        d, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "start", "end"])

    for batch in batches:
        for anchor, ident, first, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != last and held >= AT_ONCE:
                yield flush()
                parts, places, held = [], [], 0
            if anchor != last or parts[-1] != part:
                parts.append(part)
                places.append([])
                held += len(part)
            places[-1].append((ident, first))
            last = anchor
    if parts:
        yield flush()


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ranges) to what is left of each text."""
    for batch in batches:
        out = []
        for ident, text, ranges in zip(*(batch.column(i) for i in range(3)), strict=True):
            data = text.as_py().encode()
            at, kept, spans, end = 0, [], 0, -1
            for a, b in sorted((r["start"], r["end"]) for r in ranges.as_py()):
                if a > end:
                    spans += 1
                    kept.append(data[at:a])
                end = max(end, b)
                at = end
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((ident.as_py(), len(data) - len(left), spans, left, hashlib.sha256(left).hexdigest()))
        i, n, s, left, sha = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(left, pa.binary()), pa.array(sha, pa.string())],
            names=["id", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """What is left of every row's text, as UTF-8 bytes, without repeated strings of LENGTH bytes.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if
    with_kept, kept (binary; null where nothing or everything was removed). Null texts count as
    empty and null ids stay null; texts below LENGTH bytes lose nothing; of repeated rows and equal
    texts every one loses all; very long texts are searched whole; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    survey = written(surveyed(rows), "suffix-survey")
    rows = rows.withColumn("id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    copies = survey.groupBy("id").agg(F.count(F.lit(1)).alias("n_copies"))

    places = survey.select("id", F.explode(F.arrays_zip("anchors", "first", "last", "places")).alias("p")).select(
        F.col("p.anchors").alias("a"), "id", F.col("p.first").alias("f"), F.col("p.last").alias("l"), F.col("p.places").alias("w")
    )
    shared = places.groupBy("a").agg(F.sum("w").alias("n")).filter("n > 1")
    lists = (
        places.join(shared, "a")
        .groupBy("id")
        .agg(F.collect_list(F.struct("a", "f", "l", (F.col("n") > HOT).alias("hot"))).alias("places"))
    )
    firsts = survey.groupBy("id").agg(F.min("key").alias("key"))
    # Of equal texts one row is enough; rows that repeat an id come along and are told apart by place.
    texts = rows.join(lists.join(firsts, "id").withColumnRenamed("key", "least"), "id").filter(F.col("key").eqNullSafe(F.col("least")))
    texts = written(texts.select("id", "text", "places"), "suffix-texts")

    cold = texts.select("id", "text", F.filter("places", lambda p: ~p["hot"]).alias("places")).filter(F.size("places") > 0)
    hot = texts.select("id", "text", F.filter("places", lambda p: p["hot"]).alias("places")).filter(F.size("places") > 0)
    parts = mapped(cold, _cut, "anchor long, id binary, first int, part binary").repartition("anchor")
    gathered = mapped(parts.sortWithinPartitions("anchor", "part"), _marked, "id binary, start long, end long")
    strings = mapped(hot, _strings, "anchor long, string long, id binary, start int")
    place = F.xxhash64("id", "start")
    twice = strings.groupBy("anchor", "string").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p <> q")
    counted = strings.join(twice, ["anchor", "string"]).select("id", F.col("start").cast("long").alias("start"), (F.col("start") + LENGTH).cast("long").alias("end"))

    ranges = gathered.unionByName(counted).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    left = texts.select("id", "text").join(ranges, "id").select("id", "text", "ranges")
    left = mapped(left, _rest, "id binary, n_removed long, n_spans long, kept binary, kept_sha256 string")
    left = left.dropDuplicates(["id"]) if with_kept else left.drop("kept").distinct()

    told = copies.join(left, "id", "left")
    everything = (F.col("n_copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.sha2(F.lit(""), 256)
    return survey.drop("anchors", "first", "last", "places").join(told, "id").select(
        F.col("key").alias(id_col),
        "n_bytes",
        F.when(everything, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(everything, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(everything, none).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(~everything, F.col("kept")).alias("kept")] if with_kept else []),
    )
