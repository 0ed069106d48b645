import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from framewise.llm import bpe, mixing, nearest, neardup, quality, queries
from tests.llm.test_native import ASSIGN, base_spans, plain_targets
from tests.llm.test_texts import plain_classes
from tests.oracle import connect, same


def test_search_matches_sql(spark, sf):
    same(queries.QUERIES["op5_topk"](spark, sf), queries.ORACLE["op5_topk"], connect(sf))


def test_search_ties_blocks_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [None, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 4), (1003, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1100, []), (1200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "1 AS v", "1 AS score")
    want = {}
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows[:400]]
    for q, v in usable:
        if q % 10 == 0:
            want[q] = sorted((-int(v @ x), i) for i, x in usable if i != q)[:10]
    for block in (8192, 7):
        got = {}
        for r in nearest.top_k(df.filter("vec_id % 10 = 0"), df, block=block).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
        assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == want
    # One id with two vectors asks twice, and each row is a candidate of the other; repeated rows count each.
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [2.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [3.0, 3.0])]
    two = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.top_k(two.filter("vec_id IN (5, 7)"), two, k=4).collect())
    m = 1024**2
    lists = {
        (1.0, 0.0): [(8, 3 * m), (6, 2 * m), (7, m // 2), (7, m // 2)],
        (0.0, 1.0): [(8, 3 * m), (7, m // 2), (7, m // 2), (7, m // 2)],
        (0.5, 0.5): [(8, 3 * m), (6, m), (5, m // 2), (5, m // 2)],
    }
    ids = {(1.0, 0.0): 5, (0.0, 1.0): 5, (0.5, 0.5): 7}
    asked = [tuple(v) for i, v in rows if i in (5, 7)]  # each row of queries has its list
    assert got == sorted((ids[v], i, x, s) for v in asked for i, (x, s) in enumerate(lists[v], 1))
    assert nearest.top_k(df.filter("false"), df).count() == 0
    assert nearest.top_k(df, df.filter("false")).count() == 0


def test_pivots_leave_few_candidates_to_score():
    """In clusters most candidates are ruled out by their bound; spread evenly on a sphere, as the supplied vectors are, few can be."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 64))
    vectors = centres[rng.integers(0, 24, 4000)] + 0.05 * rng.normal(size=(4000, 64))
    vectors = np.floor(1024 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int64)
    ids = rng.permutation(4000)
    pivots = vectors[rng.permutation(4000)[: nearest.PIVOTS * 2]].astype(float)
    table = np.sqrt(((vectors[:, None, :] - pivots[None]) ** 2).sum(2))
    scored = []
    for q in range(0, 4000, 100):
        best, n = nearest.best_of((int(ids[q]), vectors[q], table[q]), ids, vectors, np.ones(4000, int), nearest.squares(vectors), table, 10)
        assert best == sorted((-int(s), int(i)) for i, s in zip(ids, vectors @ vectors[q], strict=True) if i != ids[q])[:10]
        scored.append(n / 4000)
    assert np.mean(scored) < 0.1


def random_looking(v):
    return len(re.findall("[0-9]", v)) >= 3 and len(re.findall("[A-Za-z]", v)) >= 3 and len(set(v)) >= 10


def plain_redacted(rows):
    """Texts of rows (id, text, source) without secrets: values counted over all rows."""
    marks = {}
    for i, text, source in rows:
        base = [(s, k, e, ASSIGN.match(text, s)[2] if k == 0 else text[s:e]) for s, k, _, e in base_spans(text)]
        bare = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if random_looking(m[0])]
        marks[i] = sorted(base + [x for x in bare if not any(b[0] < x[2] and x[0] < b[2] for b in base)])
    owners, repos = defaultdict(set), defaultdict(set)
    for i, _, source in rows:
        for *_, value in marks[i]:
            owners[value].add(source)
            repos[value].add((source, i))
    out = {}
    for i, text, _ in rows:
        at, parts = 0, []
        for start, kind, end, value in marks[i]:
            example = len(owners[value]) >= 3 or len(repos[value]) >= 20
            if start >= at and not example and (kind < 3 or random_looking(value)):
                parts += [text[at:start], "<SECRET>"]
                at = end
        out[i] = "".join(parts) + text[at:]
    return out


def plain_copies(rows):
    """Copies of rows (all columns of documents; text second, source fourth), which are distinct: one running sum per source and part."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    parts, words = defaultdict(list), Counter()
    for r in rows:
        words["s:" + r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    for r in rows:
        size, src = len(re.findall(r"[^\x20\x09-\x0D]+", r[1])), "s:" + r[3]
        hexed = md5(md5("".join(md5(str(x)) for x in r)) + "0")
        shift = max(len(f"{size:b}") - 5, 0)
        cls = len(f"{size:b}") * 32 + (size >> shift)
        parts[src, (size >> shift << shift) * mixing.LARGE > words[src]].append((cls, hexed[:2], size, hexed, r[0]))
    target, out = plain_targets(words), {}
    for src in words:
        u, took = int(md5("mix" + src)[:8], 16) / 2**32, 0
        for large in (True, False):
            held = sorted(parts[src, large])
            total = sum(x[2] for x in held)
            rate = target[src] / words[src] if large else min(2.0, max(0.0, (target[src] - took) / total)) if total else 0.0
            for k, x in enumerate(held, 1):
                out[x[4]] = min(math.floor(rate * k + u) - math.floor(rate * (k - 1) + u), 2)
                took += out[x[4]] * x[2]
    return out


def test_pipeline_against_plain_version(spark, sf):
    """Each stage again in plain Python (scores of the classifier by the fitted model, tokens by the library)."""
    docs = {r["doc_id"]: tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()}
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {i for i, r in docs.items() if model.score(pa.array([r[1]]))[0] >= 0.5}
    classes = plain_classes({i: docs[i][1] for i in good})
    first = sorted(i for i in good if classes[i] == i)
    texts = plain_redacted([(i, docs[i][1], docs[i][3]) for i in first])
    rows = [(i, texts[i], *docs[i][2:4], docs[i][4] if texts[i] == docs[i][1] else len(texts[i])) for i in first]
    copies = plain_copies(rows)
    path, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((i, library.encode_ordinary(texts[i])) for i in first for _ in range(copies[i]))
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and got == want


def test_every_query_row_has_its_list(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0]), (1, [2.0, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.top_k(rows.filter("vec_id = 0"), rows, k=2, scale=1).collect())
    assert got == Counter([(0, 1, 1, 2)] * 3 + [(0, 2, 0, 1)] * 3 + [(0, 1, 2, 3), (0, 2, 1, 2)])


def test_stages_leave_clashing_columns_alone(spark, sf, edge_docs):
    """Names that the stages use themselves come out as they went in."""
    names = ["copy", "n", "m", "part", "block", "rank", "class_id", "score", "size", "name"]
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in names)


def test_stages_on_edges(spark, sf, edge_docs, no_docs):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(plain), no_docs.select(plain)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == plain
            out.count()
    assert len(corpus_pipeline.STAGES) == 5
    assert neardup.LEAST == 0.8
