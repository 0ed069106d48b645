"""Phrase collocations from generalised suffix automata, one for each shard and language.

A shard is what a task holds at a time: runs of words, each different run once with its number. Its
suffix automaton has a state for each set of substrings that end at the same places; suffix links lead
from a state to the longest substrings that end at more, and counts of end places sum up along them.
Each state up to four words deep is enumerated, and the shards' counts are summed by phrase.

Most n-grams are rare, and summing those would be most of the work. So two passes before count
n-grams in the buckets of a hash, capped at the least count a candidate has: a bucket that stays below
it holds no candidate, and runs of words break there. Buckets that candidates share with others only
let some more through; all that comes through is counted exactly, at all its places.

A phrase lies inside a longer one of nearly its count only if it lies inside one that is a word longer
and has such a count. So subsumption looks along two edges of each phrase: its suffix link's (without
the first word) and the one without the last word.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm import textgrams as tg
from framewise.llm.common import mapped, written

DEPTH, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one has this per cent of its count.
SUBSUMED = 80
#: Different words' places in an automaton, and phrases that a task sums before it sends them on.
SHARD, HELD = 200_000, 700_000
#: Places in the shards of all languages of a task, in full shards.
MOST_SHARDS = 4
#: Bytes of text that a counting task reads at most, unless that leaves cores idle: every task sends the frequent phrases once.
READ = 256 << 20
#: n-grams that a task counts before it merges them, and buckets that it holds before it sends them.
BATCH, KEEP = 1 << 22, 1 << 22
#: The buckets of a level are 2 to the power of bits: as many as the corpus has bytes by eight, within
#: these bounds. BLOCK buckets are summed together.
LEAST_BITS, MOST_BITS = 20, 30
BLOCK = 1 << 17
#: Bits for each full bucket (twice that at most) in the bitmaps of a task. Rows of blocks in a batch.
SPARSE, BLOCKS = 32, 256
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
BREAK = np.isin(_byte, [*b".,;:!?", 10, 11, 12, 13])
SOLID = ~BREAK & ~np.isin(_byte, [32, 9])


class Words:
    """The words of a chunk of texts: bytes, where words are, hashes, and the hash of the n words from each one (salted by language) where a piece has them."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: np.ndarray) -> None:
        self.data = LOWER[data]
        self.first, self.last = tg.words(self.data, starts, SOLID[self.data])
        self.doc = np.searchsorted(starts, self.first, "right") - 1
        # Grows with each break and each text, so equal values are one piece.
        self.piece = np.concatenate([[0], np.cumsum(BREAK[self.data])])[self.first] + self.doc
        self.hash = tg.sure_hashes(self.data, self.first, self.last)
        self.salt = langs[self.doc]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, keys of the n-grams, and where each starts, for n up to DEPTH."""
        at, h = np.arange(len(self.hash)), self.hash
        with np.errstate(over="ignore"):
            yield 1, tg.mix(h ^ self.salt), at
            for n in range(2, DEPTH + 1):
                at = at[at + n - 1 < len(self.hash)]
                at = at[self.piece[at + n - 1] == self.piece[at]]
                h = np.zeros(len(at), U)
                for j in range(n):
                    h = h * STEP + self.hash[at + j]
                yield n, tg.mix(h ^ self.salt[at] * U(2 * n + 1)), at


class Full:
    """Which buckets are full, in memory by their number and not by that of all buckets: two bits for each.

    Of the other buckets a few in a thousand seem full, which only lets some more n-grams through.
    """

    def __init__(self, buckets: np.ndarray) -> None:
        self.bits = max(10, (SPARSE * len(buckets)).bit_length())
        self.bitmap = np.zeros(1 << self.bits >> 3, np.uint8)
        for a in range(0, len(buckets), BATCH):
            for at in self._places(buckets[a : a + BATCH].astype(U)):
                np.bitwise_or.at(self.bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _places(self, bucket: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for step in (STEP, U(0xD6E8FEB86659FD93)):
                yield ((bucket + U(1)) * step >> U(64 - self.bits)).astype(np.int64)

    def seems(self, bucket: np.ndarray) -> np.ndarray:
        """For each bucket whether it is full, or seems to be."""
        out = np.ones(len(bucket), bool)
        for at in self._places(bucket):
            out &= self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        return out


def alive(words: Words, full: dict[int, Full], bits: int) -> list[np.ndarray]:
    """For each n up to DEPTH whether the n-gram from each word may be a candidate: its bucket is full and so are those of its parts."""
    out = []
    for n, key, at in words.grams():
        ok = np.zeros(len(words.hash), bool)
        if n > 1:
            some = out[-1][at] & out[-1][at + 1]
            key, at = key[some], at[some]
        ok[at] = full[n].seems(key >> U(64 - bits)) if n in full else True
        out.append(ok)
    return out


def gaps(at: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as their gaps, the bytes of one place one after the other."""
    return np.diff(at, prepend=at.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def ungapped(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").reshape(-1), dtype=np.int64)


def packed(full: dict[int, np.ndarray]) -> dict[int, tuple[int, bytes]]:
    """Full buckets (ascending) as tasks get them: every executor keeps what is sent to it on its disk."""
    return {n: (len(b), pa.compress(gaps(b), codec="zstd", asbytes=True)) for n, b in full.items()}


def unpacked(sent: dict[int, tuple[int, bytes]]) -> dict[int, Full]:
    return {n: Full(ungapped(pa.decompress(raw, decompressed_size=4 * size, codec="zstd", asbytes=True), size)) for n, (size, raw) in sent.items()}


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """The words of the texts of a batch (lang, text), with the texts' languages."""
    langs = batch.column(0).to_pylist()
    salt = {x: U(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}
    salts = np.array([salt[x] for x in langs], U)
    data, starts = tg.flat(batch.column(1))
    for a, b in tg.chunks(starts):
        yield Words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], salts[a:b]), langs[a:b]


class Buckets:
    """Counts of hashed n-grams of one level, capped at LEAST: one number each, ascending, of the bucket and (in the last byte) the count."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = 0
        self.held = np.zeros(0, U)

    def add(self, bucket: np.ndarray) -> None:
        self.new.append(bucket.astype(np.uint32))
        self.size += len(bucket)
        if self.size >= BATCH:
            self.merge()

    def merge(self) -> None:
        both = np.concatenate([self.held, *(x.astype(U) << U(8) | U(1) for x in self.new)])
        self.new, self.size = [], 0
        both.sort()
        new = np.ones(len(both), bool)
        new[1:] = both[1:] >> U(8) != both[:-1] >> U(8)
        first = np.flatnonzero(new)
        n = np.minimum(np.add.reduceat(both & U(255), first), U(LEAST)) if len(first) else np.zeros(0, U)
        self.held = both[first] >> U(8) << U(8) | n

    def rows(self, level: int) -> Iterator[pa.RecordBatch]:
        """level, block, number of buckets, packed: gaps between buckets, and counts. Nothing is held then."""
        self.merge()
        bucket, n = (self.held >> U(8)).astype(np.int64), (self.held & U(255)).astype(np.uint8)
        self.held = np.zeros(0, U)
        block = bucket // BLOCK
        kinds = np.unique(block)
        cuts = [*zip(kinds.tolist(), *(np.searchsorted(block, kinds, s).tolist() for s in ("left", "right")), strict=True)]
        for i in range(0, len(cuts), BLOCKS):
            held = [(level, k, b - a, pa.compress(gaps(bucket[a:b] % BLOCK) + n[a:b].tobytes(), codec="zstd", asbytes=True)) for k, a, b in cuts[i : i + BLOCKS]]
            kind = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kind, strict=True)], names=["level", "block", "n", "packed"])


def full_buckets(texts: DataFrame, levels: tuple[int, ...], known: dict[int, np.ndarray], bits: int) -> dict[int, np.ndarray]:
    """For each level the buckets (ascending) that LEAST n-grams or more fall into, of those whose parts are in full buckets of the known levels."""

    sent = packed(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = {n: Buckets() for n in levels}, unpacked(sent)
        for batch in batches:
            for words, _ in chunked(batch):
                ok = alive(words, full, bits)
                for n, key, at in words.grams():
                    if n in held:
                        held[n].add(key[ok[n - 1][at]] >> U(64 - bits))
                        if len(held[n].held) >= KEEP:
                            yield from held[n].rows(n)
        for n, b in held.items():
            yield from b.rows(n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block by block, so a task holds the counts of one."""
        now, have = None, np.zeros(BLOCK, np.uint8)

        def told() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(have >= LEAST)
            if now is not None and len(at):
                row = (*now, len(at), pa.compress(gaps(at), codec="zstd", asbytes=True))
                kind = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kind, strict=True)], names=["level", "block", "n", "packed"])

        for batch in batches:
            for level, block, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (level, block):
                    yield from told()
                    now = (level, block)
                    have[:] = 0
                raw = pa.decompress(raw, decompressed_size=5 * n, codec="zstd", asbytes=True)
                at = ungapped(raw, n)
                have[at] = np.minimum(have[at] + np.frombuffer(raw, np.uint8, n, 4 * n), LEAST)  # 60 at most before
        yield from told()

    told = mapped(texts, count, "level int, block long, n long, packed binary")
    told = mapped(told.repartition("level", "block").sortWithinPartitions("level", "block"), add, "level int, block long, n long, packed binary")
    out: dict[int, list[tuple[int, np.ndarray]]] = {n: [] for n in levels}
    for r in told.toLocalIterator():  # the full buckets only
        at = ungapped(pa.decompress(bytes(r["packed"]), decompressed_size=4 * r["n"], codec="zstd", asbytes=True), r["n"])
        out[r["level"]].append((r["block"], (at + r["block"] * BLOCK).astype(np.uint32)))
    return {n: np.concatenate([np.zeros(0, np.uint32), *(x for _, x in sorted(b, key=lambda x: x[0]))]) for n, b in out.items()}


def automaton(runs: list[tuple[list[int], int]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The generalised suffix automaton of runs (symbols, times): of each state suffix link, length of its longest substring, an end place of it in the runs one after the other, and how often it occurs."""
    step: list[dict[int, int]] = [{}]
    link, length, end, count = [-1], [0], [-1], [0]

    def clone(p: int, q: int, c: int) -> int:
        new = len(step)
        step.append(step[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        end.append(end[q])
        count.append(0)
        link[q] = new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    at = -1
    for run, times in runs:
        last = 0
        for c in run:
            at += 1
            q = step[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else clone(last, q, c)
            else:
                new = len(step)
                step.append({})
                length.append(length[last] + 1)
                end.append(at)
                count.append(0)
                p = last
                while p != -1 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p == -1:
                    link.append(0)
                else:
                    q = step[p][c]
                    link.append(0)
                    link[new] = q if length[q] == length[p] + 1 else clone(p, q, c)
                last = new
            count[last] += times
    for v in np.argsort(-np.array(length), kind="stable")[:-1].tolist():  # the longest first; the root is last
        count[link[v]] += count[v]
    return link, length, end, count


class Shard:
    """Runs of words of one language, each different one once with its number.

    A run ends at a pair of neighbours, or a triple, that cannot be a candidate. The run behind a triple
    starts with its middle word, so every pair is in one run and so is every longer n-gram that counts;
    words alone are counted apart. Most runs are pairs, and many texts hold the same ones.
    """

    def __init__(self) -> None:
        self.words = np.zeros(0, np.int64)
        self.number: dict[int, int] = {}
        self.word: list[str] = []
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0
        self.runs: Counter[bytes] = Counter()
        self.flags: dict[bytes, bytes] = {}
        self.long = 0

    def size(self) -> int:
        """Places of words in different runs, and different words."""
        return self.long + 2 * len(self.pairs) + len(self.word)

    def add(self, words: Words, own: np.ndarray, ok: list[np.ndarray]) -> None:
        """The words at the places own (ascending, whole pieces)."""
        own = own[ok[0][own]]
        if not len(own):
            return
        kinds, first, where, times = np.unique(words.hash[own], return_index=True, return_inverse=True, return_counts=True)
        numbers = np.zeros(len(kinds), np.int64)
        for i, (h, f) in enumerate(zip(kinds.tolist(), own[first].tolist(), strict=True)):
            n = self.number.get(h)
            if n is None:
                n = self.number[h] = len(self.word)
                self.word.append(words.data[words.first[f] : words.last[f]].tobytes().decode())
            numbers[i] = n
        self.words = np.pad(self.words, (0, len(self.word) - len(self.words)))
        self.words[numbers] += times
        ids = np.zeros(len(words.hash), np.int64)
        ids[own] = numbers[where.reshape(-1)]

        pair = own[ok[1][own]]
        if not len(pair):
            return
        joined = (pair[1:] == pair[:-1] + 1) & ok[2][pair[:-1]]
        cut = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(pair)]])
        n = np.diff(cut)
        lone = pair[cut[:-1][n == 1]]
        self.new.append(ids[lone] << 32 | ids[lone + 1])
        self.waiting += len(lone)
        if self.waiting >= 2 * SHARD:
            self.merge()
        ids = ids.astype(np.int32)
        for a, b in zip(pair[cut[:-1][n > 1]].tolist(), (pair[cut[1:][n > 1] - 1] + 2).tolist(), strict=True):
            run = ids[a:b].tobytes()
            if run not in self.flags:
                self.flags[run] = ok[3][a:b].tobytes()
                self.long += b - a
            self.runs[run] += 1

    def merge(self) -> None:
        pairs, times = np.unique(np.concatenate([np.zeros(0, np.int64), *self.new]), return_counts=True)
        both, times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.pairs, where = np.unique(both, return_inverse=True)
        self.times = np.bincount(where.reshape(-1), times, len(self.pairs)).astype(np.int64)
        self.new, self.waiting = [], 0

    def counts(self) -> Iterator[tuple[str, int]]:
        """Phrase and times of every substring of DEPTH words or less that may be a candidate or a part of one."""
        yield from zip(self.word, self.words.tolist(), strict=True)
        self.merge()
        pairs = np.stack([self.pairs >> 32, self.pairs & 0xFFFFFFFF], axis=1)
        runs = [*zip(pairs.tolist(), self.times.tolist(), strict=True), *((np.frombuffer(r, np.int32).tolist(), t) for r, t in self.runs.items())]
        link, length, end, count = (np.array(x) for x in automaton(runs))
        ids = np.concatenate([pairs.reshape(-1), np.frombuffer(b"".join(self.runs), np.int32)])
        flags = np.concatenate([np.zeros(pairs.size, bool), np.frombuffer(b"".join(self.flags[r] for r in self.runs), bool)])
        shortest = length[link] + 1
        shortest[0] = DEPTH + 1
        for n in range(2, DEPTH + 1):
            v = np.flatnonzero((shortest <= n) & (length >= n))
            if n == DEPTH:  # pairs and triples of a run may all be candidates
                v = v[flags[end[v] - n + 1]]
            for e, t in zip(end[v].tolist(), count[v].tolist(), strict=True):
                yield " ".join([self.word[i] for i in ids[e - n + 1 : e + 1].tolist()]), t


def parted(sums: Counter[str]) -> tuple[Counter[str], Counter[str]]:
    """The frequent phrases, half of them at most, which a task that is full keeps as they come again, and the others, which it sends."""
    middle = sorted(sums.values())[len(sums) // 2] if sums else 0
    return Counter({p: n for p, n in sums.items() if n > middle}), Counter({p: n for p, n in sums.items() if n <= middle})


def gathered(texts: DataFrame, size: int) -> DataFrame:
    """texts of so many bytes in fewer partitions, none of them moved: two for each core, or as many as hold READ bytes each."""
    return texts.coalesce(max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // READ)))


def counted(texts: DataFrame, full: dict[int, np.ndarray], bits: int) -> DataFrame:
    """lang, phrase, n of the shards: parts of the counts of every phrase that may be a candidate or a part of one, and (phrase null) of all words."""

    given = packed(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(given)
        shards: dict[str, Shard] = {}
        total: Counter[str] = Counter()
        sums: dict[str, Counter[str]] = {}

        def sent(lang: str, keep: bool = False) -> pa.RecordBatch:
            own = sums.pop(lang, Counter())
            if keep:
                sums[lang], own = parted(own)
            phrase, n = [*own, None], [*own.values(), total.pop(lang, 0)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            own = sums.setdefault(lang, Counter())
            for phrase, n in shards.pop(lang).counts():
                own[phrase] += n
            if sum(map(len, sums.values())) >= HELD:
                for x in list(sums):
                    yield sent(x, keep=True)

        for batch in batches:
            for words, langs in chunked(batch):
                ok = alive(words, known, bits)
                code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                lang = np.array([code[x] for x in langs])[words.doc]
                for x, i in code.items():
                    own = np.flatnonzero(lang == i)
                    if not len(own):
                        continue
                    total[x] += len(own)
                    shard = shards.setdefault(x, Shard())
                    shard.add(words, own, ok)
                    if shard.size() >= SHARD:
                        yield from closed(x)
                while sum(x.size() for x in shards.values()) >= MOST_SHARDS * SHARD:  # many languages
                    yield from closed(max(shards, key=lambda x: shards[x].size()))
        for x in list(shards):
            yield from closed(x)
        yield from [sent(x) for x in {**sums, **total}]

    return mapped(texts, run, "lang string, phrase string, n long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, bits: int | None = None) -> DataFrame:
    """The strongest phrases of two to four words of each language.

    Returns lang, rank, phrase, a (times), l and r (of its parts at the weakest cut), n (words of the
    language), score. Null languages are `und`; null and empty texts have no words; repeated rows count
    each; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (size // 8).bit_length()))
    full = full_buckets(texts, (1, 2), {}, bits)
    full |= full_buckets(texts, (3, 4), full, bits)
    sums = counted(gathered(texts, size), full, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    sums = sums.withColumn("words", F.size(F.split("phrase", " ")))
    sums = written(sums.filter(F.col("phrase").isNull() | (F.col("a") >= LEAST)), "phrase-counts")
    return ranked(sums, top)


def ranked(sums: DataFrame, top: int = TOP) -> DataFrame:
    """The result from the counts of all phrases of LEAST occurrences or more (lang, phrase, words, a; phrase null: words of the language)."""
    known = sums.filter("phrase IS NOT NULL")
    found = known.filter("words >= 2").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    side = lambda x, n: known.select("lang", F.col("phrase").alias(x), F.col("a").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(38, 0)) + r) AS BIGINT)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    edges = F.explode(F.array(part(F.lit(2), F.col("words") - 1), part(F.lit(1), F.col("words") - 1)))
    around = found.filter("words >= 3").select("lang", edges.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = weakest.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * SUBSUMED))

    # The first of each deal of a language, then the first of those: no task sorts a whole language.
    order = [F.desc("c.score"), F.desc("a"), F.col("phrase")]
    dealt = free.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    words = sums.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


#: DuckDB twin over documents.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
x AS (SELECT pid, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM q),
g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM x WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, CAST(count(*) AS BIGINT) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= {LEAST}),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * u.a) // (x.a + y.a) AS BIGINT) AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS z FROM s) WHERE z = 1),
o AS (SELECT lang, a, k, w, unnest(range(1, k + 1)) AS b FROM c WHERE k > 2),
e AS (SELECT lang, a, k, w, b, unnest(range(b + 1, k + 1)) AS z FROM o),
m AS (SELECT DISTINCT i.lang, i.phrase FROM e JOIN c i ON i.lang = e.lang AND i.phrase = array_to_string(e.w[b:z], ' ') AND z - b + 1 < e.k AND 100 * e.a >= {SUBSUMED} * i.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN m USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= {TOP}
"""
