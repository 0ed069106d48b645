"""Near duplicates, quality, repeated strings, fingerprints, BPE: against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framewise.llm import bpe, fingerprint, neardup, quality, queries, suffixes
from framewise.llm import textgrams as tg


def shingles(text, n=5):
    w = text.split()
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def docs_of(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


# ---- near duplicates


def plain_classes(texts):
    sets = {i: Counter(shingles(t)) for i, t in texts.items()}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(min(a, b), max(a, b)) for l in index.values() for a in l for b in l if a != b}:
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_match_plain_version(spark, sf):
    _, texts = docs_of(spark, sf)
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op2_neardup"](spark, sf).collect()}
    assert got == plain_classes(texts)


def test_signature_agreement_is_weighted_likeness():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    sig = neardup.signatures(np.concatenate([h, h]), np.repeat([0, 1], 300), np.concatenate([wa, wb]), 2, 4000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (sig != 0).all()


def all_pairs(texts):
    """Least id of each text's class from the likenesses of all pairs."""
    column, rows = {}, []
    for t in texts.values():
        rows.append([column.setdefault((x, k), len(column)) for x, n in Counter(shingles(t)).items() for k in range(n)])
    held = np.zeros((len(rows), len(column)), np.float32)
    for r, at in enumerate(rows):
        held[r, at] = 1
    both, size = held @ held.T, held.sum(1)
    link = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-4
    label = np.arange(len(rows))
    while True:
        new = np.array([label[x].min() for x in link])
        if (new == label).all():
            ids = list(texts)
            return {i: ids[x] for i, x in zip(ids, label, strict=True)}, int(link.sum() - len(rows)) // 2
        label = new


def edited_copies(n_words, n, most, vocabulary, kinds, seed):
    """Copies of one text with up to most words replaced, left out or put in; new words are few, so edits meet."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        w = [f"w{j}" for j in range(n_words)]
        for _ in range(rng.randint(0, most)):
            at, kind, x = rng.randrange(len(w)), rng.choice(kinds), f"x{rng.randrange(vocabulary)}"
            w[at : at + (kind != "put")] = [] if kind == "cut" else [x]
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("group", [(150, 2200, 9, 20, ["new", "cut", "put"]), (300, 2200, 22, 200, ["new", "cut", "put"])])
def test_large_group_of_edited_copies(spark, group):
    """Likenesses from 0.4 to 1 in one group, a third of which links and the rest does not: at least 99 % as by all pairs."""
    texts = edited_copies(*group, seed=5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    want, links = all_pairs(texts)
    assert links > 50_000 and len(set(want.values())) > 500
    assert sum(got[i] == c for i, c in want.items()) >= 0.99 * len(want)


@pytest.mark.parametrize(("rare", "most"), [((1,), 4), ((2, 5), 4), ((2, 5), 0)])
def test_levels_of_rare_shingles_lose_no_pair(spark, monkeypatch, rare, most):
    """Few levels, many, and none where the first would count too many pairs."""
    monkeypatch.setattr(neardup, "PAIRS_A_SHINGLE", most)
    texts = edited_copies(80, 250, 6, 8, ["new", "cut", "put"], 2)
    monkeypatch.setattr(neardup, "left_pairs", lambda pool, t, f=neardup.left_pairs: f(pool, t, rare))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == plain_classes(texts)


def patchworks(n, seed, parts=24, of=17, words=40):
    """Texts of the same paragraphs, each without some: half alike, so that they meet in buckets; every fourth is an edited copy of the one before."""
    rng = random.Random(seed)
    said = [" ".join(f"w{rng.randrange(3000)}" for _ in range(words)) for _ in range(parts)]
    out = {}
    for i in range(n):
        if i % 4 == 3:
            cut = out[i - 1].split(" ")
            at = rng.randrange(len(cut) - 20)
            out[i] = " ".join(cut[:at] + ["new"] * 10 + cut[at + 10 :])
        else:
            out[i] = "\n".join(said[j] for j in sorted(rng.sample(range(parts), of)))
    return out


def test_texts_of_shared_parts_are_not_paired_by_bucket(spark, monkeypatch):
    """Nothing in them is rare: deep bands decide, and few pairs of texts are looked at."""
    asked = {}
    real = neardup.linked

    def counting(pairs, texts):
        asked.setdefault(n, []).append(pairs.count())
        return real(pairs, texts)

    monkeypatch.setattr(neardup, "linked", counting)
    n = 300
    texts = patchworks(n, 1)
    rows = neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got, want = {r["doc_id"]: r["class_id"] for r in rows}, plain_classes(texts)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * n
    assert all(r["n_links"] > 0 for r in rows if r["class_rows"] > 1) and not any(r["n_links"] for r in rows if r["class_rows"] == 1)
    # All pairs would be 45,000. About 330 are alike by three quarters; the others looked at share borders of
    # paragraphs that few texts have, as many as PAIRS_A_SHINGLE allows.
    assert asked[n][1] < 45_000 / 30


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    rows = neardup.classes(edge_docs).collect()
    old = edge_docs.collect()
    plain = plain_classes({i: r["text"] or "" for i, r in enumerate(old)})
    empty = [i for i, r in enumerate(old) if not (r["text"] or "")]  # equal texts are alike, also without words
    plain |= {i: empty[0] for i in empty}
    least = {c: min((old[i]["doc_id"] for i in plain if plain[i] == c and old[i]["doc_id"] is not None), default=None) for c in plain.values()}
    key = lambda i, c, n: (i is None, i or 0, c is None, c or 0, n)
    size = Counter(plain.values())
    assert sorted(key(r["doc_id"], r["class_id"], r["class_rows"]) for r in rows) == sorted(key(r["doc_id"], least[plain[i]], size[plain[i]]) for i, r in enumerate(old))
    out = neardup.deduplicated(edge_docs)
    assert out.columns == edge_docs.columns
    kept = [r["text"] or "" for r in out.collect()]
    assert len(kept) == len(set(kept)) == sum(r["first"] for r in rows)
    assert neardup.classes(no_docs).count() == 0 and neardup.deduplicated(no_docs).count() == 0


# ---- quality


def test_quality_on_held_out_labels(spark, sf):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels if rows[r["doc_id"]]["held_out"]]
    right = sum(q == r["predicted"] for q, r in held) / len(held)
    assert right > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 1), (7, 0), (None, 1), (9, None), (1, 0)], "doc_id long, quality int")
    model = quality.fit(edge_docs, labels)
    assert quality.scored(edge_docs, model).filter("score IS NULL OR isnan(score)").count() == 0
    old = edge_docs.collect()
    score = lambda t: float(model.score(pa.array([t], pa.string()))[0])
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(score(r["text"]), 6)) for r in old)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6)) for r in quality.scored(edge_docs, model).collect()) == want
    out = quality.kept(edge_docs, model)
    assert out.columns == edge_docs.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in old if score(r["text"]) >= 0.5)
    assert quality.kept(no_docs, model).count() == 0
    none = quality.fit(edge_docs, labels.filter("false"))
    assert quality.kept(edge_docs, none).count() == 0
    assert quality.scored(no_docs, quality.fit(no_docs, labels.filter("false"))).count() == 0


def test_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(6)
    for prior in (0.2, 0.5, 0.8):
        n = 4000
        side = rng.random(n) < prior
        u = np.where(side, rng.normal(2, 1, n), rng.normal(-2, 1, n))
        assert abs(quality.class_prior(rng.normal(2, 1, 2000), u) - prior) < 0.08
    x, p = (np.zeros((m, quality.N_FEATURES), np.float32) for m in (n, 1500))
    x[:, :30], p[:, :30] = rng.normal(size=(n, 30)), rng.normal(size=(1500, 30))
    x[:, 0] += np.where(side, 3, -3)
    p[:, 0] += 3
    found = quality.estimated_prior(p, x)
    assert abs(found - prior) < 0.1
    model = quality.nnpu(p, x, found)
    assert (((x @ model.weights + model.bias) >= 0) == side).mean() > 0.95


def test_labels_of_negatives_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one, two = quality.fit(docs, labels), quality.fit(docs.unionAll(docs), labels.filter("quality = 1"))
    assert np.allclose(one.weights, two.weights) and one.bias == two.bias


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c", "", None, "Hello, World! 123\nHello, World! 123\n", "é" * 50, "x"]
    together = quality.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


# ---- repeated strings


def plain_stripped(texts):
    n = suffixes.LENGTH
    seen = Counter(b[i : i + n] for b in texts.values() for i in range(len(b) - n + 1))
    out = {}
    for k, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_stripping_matches_plain_version(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    df, texts = docs_of(spark, sf)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.stripped(df).collect()}
    assert got == plain_stripped({k: t.encode() for k, t in texts.items()})


def test_stripping_periodic_and_shared_passages(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = noise(260)
    texts = ["ab" * 300, noise(90) + passage + noise(300), passage[:230] + noise(50), noise(199), noise(120) + "=" * 450 + noise(90), noise(40) * 12]
    texts += [noise(rng.randint(0, 400)) + passage + noise(rng.randint(0, 400)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.stripped(df).collect()}
    assert got == plain_stripped({i: t.encode() for i, t in enumerate(texts)})


def test_long_runs_of_a_byte_are_induced_at_once():
    data = b"ab" + b"a" * 300_000 + b"b" * 300_000 + b"a" * 300_000
    got = suffixes.two_stage_order(data, 64)
    depth = [data[i : i + 64] for i in got.tolist()]
    assert len(got) == len(set(got.tolist())) == len(data) and all(x <= y for x, y in zip(depth[:-1], depth[1:], strict=True))
    small = b"xx" + b"a" * 40 + b"b" * 7 + b"a" * 40 + b"c"
    assert suffixes.two_stage_order(small, 200).tolist() == sorted(range(len(small)), key=lambda i: small[i:])


def test_two_stage_order():
    rng = random.Random(3)
    for k in range(200):
        data = bytes(rng.choice(b"ab" if k % 2 else b"abc\x00\xff") for _ in range(rng.randint(1, 200)))
        assert suffixes.two_stage_order(data, len(data) + 1).tolist() == sorted(range(len(data)), key=lambda i: data[i:])  # noqa: B023
        wanted = np.array([rng.random() < 0.3 for _ in data])
        got = [i for i in suffixes.two_stage_order(data, len(data) + 1, wanted).tolist() if wanted[i]]
        assert got == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: data[i:])  # noqa: B023


def test_stripping_edges(edge_docs, no_docs):
    old = edge_docs.collect()
    want = plain_stripped({i: (r["text"] or "").encode() for i, r in enumerate(old)})
    key = lambda i, x: (i is None, i or 0, *x)
    got = suffixes.stripped(edge_docs, with_kept=True).collect()
    assert sorted(key(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == sorted(key(r["doc_id"], want[i]) for i, r in enumerate(old))
    assert suffixes.stripped(no_docs).count() == 0


# ---- fingerprints


def test_fingerprints_match_plain_version(spark, sf):
    _, texts = docs_of(spark, sf)
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_fingerprints"](spark, sf).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], texts[nxt]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(r["near_edited"] - like(set(shingles(t)), set(shingles(edited)))))
        assert abs(r["near_next"] - like(set(shingles(t)), set(shingles(n)))) < 0.2
    assert np.mean(errors) < 0.04


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    a, b = pool[rng.permutation(len(pool))[:3000]], pool[rng.permutation(len(pool))[:3000]]
    sa, sb = np.sort(a)[:128], np.sort(b)[:128]
    assert np.array_equal(fingerprint.merged(sa, sb), np.union1d(a, b)[:128])
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fingerprint.resemblance(sa, sb) - j) < 0.15
    assert abs(fingerprint.distinct_shingles(sa) / 3000 - 1) < 0.3
    assert abs(fingerprint.containment(sa, sb) - len(np.intersect1d(a, b)) / 3000) < 0.25
    assert np.array_equal(fingerprint.unpacked(fingerprint.packed(sa)), sa)


def plain_edited(rows):
    """Sorted (id, n_chars, SHA-256 of the edited text) of rows (id, text); ties in order of the hash, as given."""
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        out.append((i is None, i or 0, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    return sorted(out)


def test_many_parts_and_edges(spark, edge_docs, no_docs, monkeypatch):
    whole = fingerprint.in_order_with_next
    monkeypatch.setattr(fingerprint, "in_order_with_next", lambda d, i, t: whole(d, i, t, 900))
    monkeypatch.setattr(fingerprint, "AT_ONCE", 37)
    got = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in fingerprint.edited_likeness(df).collect())
    texts = [(i * 3, f"t{i} " * (i % 40)) for i in range(500)]
    assert got(spark.createDataFrame(texts, "doc_id long, text string")) == plain_edited(texts)
    rows = edge_docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").orderBy("doc_id", "h").collect()
    assert got(edge_docs) == plain_edited([(r["doc_id"], r["text"]) for r in rows])
    # Half of the rows without an id, in many parts of the order.
    hot = spark.range(2000).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "if(id % 4 = 0, 'same text of all', concat('text ', id % 7, ' w', id % 3)) AS text")
    rows = hot.selectExpr("*", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()
    assert got(hot) == plain_edited([(r["doc_id"], r["text"]) for r in rows])
    parts, groups = whole(hot, "doc_id", "text", 900)
    assert parts.groupBy("part").count().agg({"count": "max"}).first()[0] < 100 and groups.agg({"n": "max"}).first()[0] == 500
    assert got(edge_docs.limit(1)) == plain_edited([(edge_docs.limit(1).first()["doc_id"], edge_docs.limit(1).first()["text"] or "")])
    assert fingerprint.edited_likeness(no_docs).count() == 0
    sketch = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(edge_docs.filter("doc_id IS NOT NULL")).collect()}
    assert sketch[0] == sketch[1] == "" and sketch[3] == sketch[4] != ""
    assert fingerprint.fingerprints(edge_docs).count() == edge_docs.count() and fingerprint.fingerprints(no_docs).count() == 0


def test_shingle_hashes_do_not_depend_on_place():
    one = tg.shingles(*tg.flat(pa.array(["a b c d e f"])))[0]
    many = tg.shingles(*tg.flat(pa.array(["x y", "a b c d e f", None, "", "zz"])))
    assert np.array_equal(one, many[0][many[1] == 1])
    assert np.bincount(many[1], minlength=5).tolist() == [1, 2, 0, 0, 1]


# ---- BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_matches_the_library(spark, sf, library):
    _, texts = docs_of(spark, sf)
    for r in queries.QUERIES["op8_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_on_hard_texts(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéß 012\n\t-_=# the ing 漢字😀'll") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 3000, "-" * 999, "漢" * 300, "".join(rng.choice("etaoinshr") for _ in range(20_000)), "", "<|endoftext|>"]
    path, pattern = bpe.default_vocabulary()
    for most in (700_000, 300):
        own = bpe.Codec(bpe.read_ranks(path), pattern, most)
        for t in texts:
            ids = own.encode(t)
            assert ids.tolist() == library.encode_ordinary(t)
            assert "".join(own.decode(ids, 3)) == t


def test_utf8_in_parts():
    data = "a é 漢 😀 z".encode()
    for n in range(1, 6):
        u = bpe.Utf8()
        assert "".join(u.feed(data[i : i + n]) for i in range(0, len(data), n)) + u.close() == data.decode()
    u = bpe.Utf8()
    assert u.feed(b"\xff\xc3") + u.close() == "��"


def test_bpe_edges(edge_docs, no_docs):
    vocabulary = bpe.default_vocabulary()
    tokens = bpe.encoded(edge_docs, *vocabulary)
    assert tokens.count() == edge_docs.count()
    back = sorted(r["text"] for r in bpe.decoded(tokens, *vocabulary).collect())
    assert back == sorted((r["text"] or "") for r in edge_docs.collect())
    assert bpe.round_trip(no_docs, *vocabulary).count() == 0


# ---- the classifier, written out


def plain_features(text):
    """The features of one text, counted one by one."""
    data = (text or "").encode()
    kind = lambda b: int(quality.CLASS[b])
    n = quality.N_CLASSES
    one, pair = [0] * n, [0] * (n * n)
    for b in data:
        one[kind(b)] += 1
    for a, b in zip(data[:-1], data[1:], strict=True):
        pair[kind(a) * n + kind(b)] += 1
    words = data.replace(b"\v", b" ").replace(b"\f", b" ").split()
    trios = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] or ([tuple(words)] if words else [])
    lines = data.split(b"\n")
    held = lines if lines[-1] else lines[:-1]
    again = lambda x: (len(x) - len(set(x))) / max(1, len(x))
    size, letters = len(data), one[0] + one[1] + one[6]
    total = max(1, size)
    shape = [np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), size / max(1, len(words)) / 10, size / len(lines) / 100, again(words), again(trios), again(held)]
    shape += [letters / total, one[1] / max(1, letters), one[2] / total, sum(one[8:]) / total, sum(x > 0 for x in one[8:]) / 10, float(size == 0)]
    return np.array([*(np.sqrt(x / total) for x in pair), *(np.sqrt(x / total) for x in one), *shape])


def plain_nnpu(p, u, prior, steps):
    """Weights and bias on the features as they are, by the same descent in double precision, text by text."""
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    for t in range(1, steps + 1):
        negative = np.mean([np.log1p(np.exp(x @ w)) for x in u]) - prior * np.mean([np.log1p(np.exp(x @ w)) for x in p])
        sig = lambda z: 1 / (1 + np.exp(-z))
        part = sum(sig(x @ w) * x for x in u) / len(u) - prior * sum(sig(x @ w) * x for x in p) / len(p)
        g = part + prior * sum(-sig(-(x @ w)) * x for x in p) / len(p) if negative >= 0 else -part
        g = g + 1e-2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1] / scale, w[-1] - (mean / scale) @ w[:-1]


def plain_prior(p, u):
    scores = [[], []]
    for half in (0, 1):
        w, b = plain_nnpu(p[half::2], u[half::2], 0.5, 60)
        for kept, x in zip(scores, (p, u), strict=True):
            kept += (x[1 - half :: 2] @ w + b).tolist()
    slack = np.sqrt(np.log(40) / 2) * (len(scores[0]) ** -0.5 + len(scores[1]) ** -0.5)
    share = lambda x, at: sum(s >= at for s in x) / len(x)
    best = min(sorted(set(scores[0])), key=lambda at: (share(scores[1], at) + slack) / share(scores[0], at))
    return min(0.99, max(0.01, share(scores[1], best) / share(scores[0], best)))


def test_features_match_plain_version(edge_docs):
    texts = [r["text"] for r in edge_docs.collect()] + ["a\nb\na\n", "\n\n", "one two one two", "x"]
    got = quality.features(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_features(t), atol=1e-4, rtol=1e-4), t


def test_quality_matches_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    learnt = [i for i in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    half = lambda ids: np.array(sorted((plain_features(docs[i]).astype(np.float16) for i in ids), key=lambda x: x.tobytes())).astype(float)
    p, u = half([i for i in learnt if i in good]), half(learnt)
    w, b = plain_nnpu(p, u, plain_prior(p, u), 150)
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op3_quality"](spark, sf).collect()}
    want = {i: 1 / (1 + np.exp(-(plain_features(t) @ w + b))) for i, t in docs.items()}
    off = sorted(abs(got[i] - want[i]) for i in docs)
    assert off[-1] < 0.05 and off[len(off) // 2] < 0.01
    assert sum((got[i] >= 0.5) != (want[i] >= 0.5) for i in docs) <= 1
