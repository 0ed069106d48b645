"""Quality rules, phrases and hard negatives: against SQL and plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framewise.llm import negatives, phrases, queries, rules
from framewise.llm import textgrams as tg
from tests.oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_negatives", "op12_rules", "op13_phrases"])
def test_matches_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], connect(sf))


def test_phrases_and_negatives_match_sql_on_larger_tables(spark):
    """The smallest tables hold few phrases of thirty occurrences."""
    sf = "/root/testdata/sf0.01"
    for name in ("op11_negatives", "op13_phrases"):
        same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], connect(sf))


# ---- rules -------------------------------------------------------------------------------------------


def plain_rules(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    total = sum(map(len, words))

    def marked(n):
        at = defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        return {i + j for places in at.values() if len(places) > 1 for i in places for j in range(n)}

    seen, dup, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            dup, chars = dup + 1, chars + len("".join(WORD.findall(line)))
        seen.add(line)
    cover = {n: sum(len(words[i]) for i in marked(n)) for n in rules.MOST}
    repeat = len(marked(8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and 100 * dup <= 30 * len(lines) and 100 * chars <= 20 * total and all(100 * cover[n] <= m * total for n, m in rules.MOST.items())
    return (len(words), total, len(re.findall(r"[#*$%&|<>]", text)), len(lines), dup, chars, repeat, *cover.values(), failed, kept)


def test_rules_edges(spark, edge_docs, no_docs):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted((tuple(r) for r in rules.judged(edge_docs).collect()), key=key)
    assert got == sorted(((r["doc_id"], *plain_rules(r["text"] or "")) for r in edge_docs.collect()), key=key)
    assert rules.judged(no_docs).count() == 0


def test_rules_match_plain_version(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "é", "\n", "# ", "\r\n", "x y z\n", "\x0b", "日 ", "one two three four five six seven "]) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    rows = {r["doc_id"]: tuple(r)[1:] for r in rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(texts))] == [plain_rules(t) for t in texts]


def test_long_words_and_lines_are_told_apart():
    """Strings of two letters whose polynomials agree modulo 2**64 for every base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    first, last = np.array([0, 2049]), np.array([2048, 4097])
    assert len(set(tg.run_hashes(data, first, last))) == 1 and len(set(tg.sure_hashes(data, first, last))) == 2
    text = f"{a}\n{b}\n{a} " + " ".join(f"{x} w" for x in [a, b] * 20)
    data, starts = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    got = rules.measured(data, starts)
    assert tuple(int(got[c][0]) for c in rules.COUNTS) == plain_rules(text)[:-2]


# ---- phrases -----------------------------------------------------------------------------------------


def plain_phrases(rows, top):
    """The contract word by word: rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= 30}
        best = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard", [150_000, 40])
def test_phrases_match_plain_version(spark, monkeypatch, shard):
    """In one automaton or many, with buckets that nearly all are shared or nearly none."""
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "HELD", shard * 2)
    rng = random.Random(11)
    words = ["The", "of", "São", "x" * 90, "new", "york", "日本", "A b", "c|d"]
    say = lambda: "".join(rng.choices([*words, "new york city", "at 5:30", ".", "\n", "\t", ";"], k=rng.randint(0, 30), weights=[3] * 9 + [6, 2, 2, 1, 1, 1]) and [" ".join(rng.choices(words + ["new york city hall ,"], k=rng.randint(0, 30)))])
    rows = [(rng.choice(["en", "de", None]), say()) for _ in range(400)] + [("fr", None), ("fr", ""), ("en", " . ,")] + [("es", "de la casa, de la mar")] * 40
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for bits in (17, 22):
        got = phrases.collocations(df, top=25, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 25)


def test_what_phrases_send_is_small(spark, monkeypatch):
    """Buckets in few bytes each, and bitmaps packed: each executor keeps them on disk."""
    held = phrases.Buckets()
    held.add(np.random.default_rng(1).integers(0, 1 << 26, 300_000))
    n, size = (sum(sum(x) for x in col) for col in zip(*[(b.column(2).to_pylist(), map(len, b.column(3).to_pylist())) for b in held.rows(2)], strict=True))
    assert n > 290_000 and size < 2 * n
    sent, real = [], phrases.mapped
    monkeypatch.setattr(phrases, "mapped", lambda df, run, schema: sent.append(len(cloudpickle.dumps(run))) or real(df, run, schema))
    texts = spark.createDataFrame([("en", "one two three four five")] * 40, "lang string, text string")
    assert phrases.collocations(texts, bits=25).count() > 0
    assert len(sent) == 5 and max(sent) < 1 << 20


def test_tasks_that_count_phrases_are_as_many_as_the_text_needs(spark, monkeypatch):
    """Every task sends what it has counted, so with a task for each of many small parts rows would grow with parts times phrases."""
    counting, real = [], phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda texts, *a: counting.append((texts, real(texts, *a))) or counting[-1][1])
    texts = spark.range(320).select(F.lit("en").alias("lang"), F.lit("one two three. four five").alias("text")).repartition(40)
    assert {r["a"] for r in phrases.collocations(texts).collect()} == {320}
    most = 2 * spark.sparkContext.defaultParallelism
    assert counting[0][0].rdd.getNumPartitions() == most < 40
    # Five words, three pairs and a triple; the number of words.
    assert counting[0][1].count() <= most * 10
    assert phrases.gathered(texts, 20 * phrases.READ - 1).rdd.getNumPartitions() == 20


def test_full_buckets_take_memory_by_their_number(spark, monkeypatch):
    """Not by the number of all buckets: a bitmap of 2**30 bits for each level was in every task."""
    texts = spark.createDataFrame([("en", "one two three four five")] * 40 + [("en", f"x{i}") for i in range(200)], "lang string, text string")
    found = phrases.full_buckets(texts, (1, 2), {}, 30)
    assert {n: len(b) for n, b in found.items()} == {1: 5, 2: 4} and sum(b.nbytes for b in found.values()) < 1000
    known = phrases.unpacked(phrases.packed(found))
    assert all(known[n].seems(b.astype(np.uint64)).all() and known[n].bitmap.nbytes < 1000 for n, b in found.items())
    many = np.unique(np.random.default_rng(4).integers(0, 1 << 30, 100_000))
    few = phrases.unpacked(phrases.packed({1: many}))[1]
    assert few.seems(many.astype(np.uint64)).all() and few.seems(np.setdiff1d(np.arange(100_000), many).astype(np.uint64)).mean() < 0.01


def test_counting_tasks_hold_few_buckets(spark, monkeypatch):
    """They send what they hold on the way, and parts of counts add up."""
    held = phrases.Buckets()
    monkeypatch.setattr(phrases, "BATCH", 1000)
    sent, rng = Counter(), np.random.default_rng(3)
    added = [rng.integers(0, 3000, 700) for _ in range(50)]
    for i, x in enumerate(added):
        held.add(x)
        if i % 7 == 6 or i == 49:
            for b in held.rows(2):
                for block, n, raw in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = phrases.pa.decompress(raw, decompressed_size=5 * n, codec="zstd", asbytes=True)
                    sent.update(dict(zip((phrases.ungapped(raw, n) + block * phrases.BLOCK).tolist(), raw[4 * n :], strict=True)))
            assert not len(held.held)
    assert sent == Counter(np.concatenate(added).tolist())


def test_frequent_phrases_stay_in_a_full_task():
    sums = Counter({"a": 5, "b": 1, "c": 1, "d": 9, "e": 2})
    kept, sent = phrases.parted(sums)
    assert kept == {"a": 5, "d": 9} and kept + sent == sums
    # Of equal ones none is kept, so a task always gets room.
    assert phrases.parted(Counter("abcd")) == (Counter(), Counter("abcd")) and phrases.parted(Counter()) == (Counter(), Counter())


def test_phrases_edges(spark, edge_docs, no_docs):
    many = edge_docs.crossJoin(spark.range(20).select(F.col("id").alias("times"))).drop("times")
    rows = [(r["lang"], r["text"]) for r in many.filter("length(text) < 5000 OR text IS NULL").collect()]
    got = phrases.collocations(many.filter("length(text) < 5000 OR text IS NULL"), top=200).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 200)
    assert phrases.collocations(no_docs).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    n = 10**13 + 7
    sums = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, n + 2), ("en", "a b", 2, n - 3), ("en", None, 0, 3 * n)], "lang string, phrase string, words int, a long")
    assert phrases.ranked(sums).first()["score"] == 2000000 * (n - 3) // (2 * n + 2)


def test_automaton_counts_every_substring():
    rng = random.Random(2)
    runs = [([rng.randint(0, 3) for _ in range(rng.randint(1, 12))], rng.randint(1, 5)) for _ in range(60)]
    link, length, end, count = phrases.automaton(runs)
    flat = [c for run, _ in runs for c in run]
    got = {}
    for v in range(1, len(link)):
        for n in range(length[link[v]] + 1, length[v] + 1):
            assert got.setdefault(tuple(flat[end[v] - n + 1 : end[v] + 1]), count[v]) == count[v]
    want = Counter()
    for run, times in runs:
        for a in range(len(run)):
            for b in range(a + 1, len(run) + 1):
                want[tuple(run[a:b])] += times
    assert got == want


# ---- negatives ---------------------------------------------------------------------------------------


def plain_negatives(rows):
    import math

    use = [(i, int(x), [math.floor(256 * float(c)) for c in v]) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, label, v) in enumerate(use):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, x) for m, (j, x, w) in enumerate(use) if m != n and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            hard = [(j, -t) for t, j, x in scored if x != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(hard)]
    return sorted(out)


def made_vectors(n, seed, dims=6, scale=1.0):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dims)) * scale * rng.pareto(2, size=(n, 1)), 1).astype(np.float32)
    return [(i * 20 % (n * 20), int(rng.integers(0, 4)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("bucket", [16_384, 37])
def test_negatives_match_plain_version(spark, monkeypatch, bucket):
    """Norms from tiny to large, a label with a third of the rows, ties, copies, nulls; in one bucket and in many, small steps."""
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rows = made_vectors(400, 1) + made_vectors(150, 2, 3)
    rows = [(i, 0 if i % 3 == 0 else x, v) for i, x, v in rows]
    rows += [rows[0], rows[0], rows[5], (100, 1, None), (None, 1, rows[1][2]), (200, None, rows[1][2]), (300, 2, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (300, 2, [float("nan")] * 6)]
    rows += [(500, 3, []), (7, 3, []), (600, 1, [0.0] * 6), (601, 1, [0.0] * 6), (602, 2, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"row": F.lit("clash"), "bucket": F.lit(1), "norm": F.lit(2)})
    got = negatives.mined(df, F.col("id") % 100 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_of_large_components_and_empty_tables(spark):
    rows = [(i, x, v) for i, x, v in made_vectors(60, 3, 4, 1e5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, negatives.mined(df, F.col("id") % 100 == 0, F.col("label")).collect())) == plain_negatives(rows)
    assert negatives.mined(df.filter("false"), F.col("id") % 100 == 0, F.col("label")).count() == 0
    assert negatives.mined(df, F.lit(False), F.col("label")).count() == 0


def test_small_norms_are_never_sent(spark, monkeypatch):
    """One loud cluster and a thousand faint rows: only buckets that can reach a window are searched."""
    monkeypatch.setattr(negatives, "BUCKET", 50)
    rows = [(i, i % 2, [10.0 + i % 3, 1.0]) for i in range(0, 100)] + [(1000 + i, i % 2, [0.01, 0.0]) for i in range(1000)]
    seen = []
    real = negatives.cells

    def counting(anchors, *rest):
        seen.append(anchors.select(F.sum(F.size("buckets"))).first()[0] or 0)
        return real(anchors, *rest)

    monkeypatch.setattr(negatives, "cells", counting)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.mined(df, F.col("id") == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == [r for r in plain_negatives(rows) if r[0] == 0]
    assert sum(seen) <= 6  # of 2 * 22
