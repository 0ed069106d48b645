import random

import pytest
from pyspark.sql import functions as F

from framewise.functions import bits
from framewise.functions import names as names_of
from framewise.operators import boxes, catalogue, dedupe, evaluate, outputs, state
from framewise.streaming import live


def frames(spark, items):
    rows = [(1, i, i, r, s) for i, (r, s) in enumerate(items)]
    return spark.createDataFrame(rows, "key long, ts int, seq long, result string, source string").withColumn("ts", F.timestamp_seconds("ts"))


def committed(spark, items, debounce=True):
    return [r["committed"] for r in state.debounced(frames(spark, items), debounce).orderBy("seq").collect()]


def test_debounce_rules(spark):
    assert committed(spark, [("ad", "llm")], debounce=False) == ["ad"]
    assert committed(spark, [("ad", "llm"), ("ad", "llm")]) == [None, "ad"]
    assert committed(spark, [("ad", "llm"), ("content", "llm")]) == [None, None]
    assert committed(spark, [("ad", "opencv")]) == ["ad"]
    assert committed(spark, [("ad", "llm"), ("unknown", "llm"), ("ad", "llm")]) == [None, None, "ad"]


def hash_rows(spark, rows):
    keep = spark.createDataFrame([(r[0],) for r in rows if r[3]], "name string")
    return dedupe.ordered(spark.createDataFrame([r[:3] for r in rows], "name string, phash long, dhash long"), keep)


def test_greedy_second_nearest_is_not_tried(spark):
    # b is nearest to c but its dhash is far; a would pass but is not asked.
    rows = [("a.jpg", 0b111, 0, False), ("b.jpg", 0b111 << 12, -1, False), ("c.jpg", 0b110 << 12, 0, False)]
    got = {r["name"]: r["kept"] for r in dedupe.kept_first(hash_rows(spark, rows), 4).collect()}
    assert got == {"a.jpg": True, "b.jpg": True, "c.jpg": True}


def test_greedy_chain_and_protected(spark):
    rows = [("a.jpg", 0, 0, False), ("b.jpg", 0b1111, 0, False), ("c.jpg", 0b11111111, 0, False)]
    got = {r["name"]: (r["kept"], r["representative"]) for r in dedupe.kept_first(hash_rows(spark, rows), 4).collect()}
    assert got == {"a.jpg": (True, None), "b.jpg": (False, "a.jpg"), "c.jpg": (True, None)}
    rows[1] = ("b.jpg", 0b1111, 0, True)
    got = {r["name"]: r["kept"] for r in dedupe.kept_first(hash_rows(spark, rows), 4).collect()}
    assert got == {"a.jpg": False, "b.jpg": True, "c.jpg": False}


def plain_greedy(rows, threshold):
    """Names kept or dropped with representative and distance, one row after the other."""
    kept, out = [], {}
    for name, phash, dhash, guarded in sorted(rows, key=lambda r: (not r[3], r[0])):
        bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        near = min(((bits(phash, p), i) for i, (_, p, _) in enumerate(kept)), default=(99, 0))
        if near[0] <= threshold and not guarded and bits(dhash, kept[near[1]][2]) <= threshold + 4:
            out[name] = (False, kept[near[1]][0], near[0])
        else:
            kept.append((name, phash, dhash))
            out[name] = (True, None, None)
    return out


@pytest.mark.parametrize(("seed", "local"), [(1, 0), (2, 60), (3, 5000), (1, 5000)])
def test_greedy_with_many_equal_hashes(spark, monkeypatch, seed, local):
    """By rounds, in groups that one task decides, and some of each."""
    monkeypatch.setattr(dedupe, "LOCAL", local)
    rng = random.Random(seed)
    hashes = [0, 0b1, 0b111, 0b11111, 0b1111111, 0xFF00, 0xFF01, 0xFFFF]
    rows = [(f"f{i:04}.jpg", rng.choice(hashes), rng.choice([0, 1, 2**20 - 1]), rng.random() < 0.1) for i in range(150)]
    got = {r["name"]: (r["kept"], r["representative"], r["distance"]) for r in dedupe.kept_first(hash_rows(spark, rows), 4).collect()}
    assert got == plain_greedy(rows, 4)


def test_one_hash_for_all_rows_makes_no_pairs(spark):
    rows = spark.range(20_000).selectExpr("concat('f', lpad(id, 9, '0'), '.jpg') AS name", "CAST(7 AS long) AS phash", "CAST(0 AS long) AS dhash", "false AS protected", "id AS pos")
    assert dedupe.hash_pairs(rows, 10).count() == 1
    assert dedupe.kept_first(rows, 10).filter("kept").count() == 1
    assert dedupe.clusters(rows.select("name", "phash", "pos"), 10).select("leader").distinct().count() == 1


def test_wider_bands_for_more_hashes():
    assert len(bits.band_plan(10, 1000)[0]) > len(bits.band_plan(10, 50_000_000)[0]) == 3


def test_median_by_group_over_many_times(spark):
    rng = random.Random(4)
    rows = [("correct", g, rng.choice([rng.random() * 10, 5.0, 1e6 * rng.random()])) for g in "abc" for _ in range(501)]
    df = spark.createDataFrame(rows, "status string, g string, elapsed double")
    got = {r["g"]: r["median_elapsed"] for r in evaluate.timing(df, ["g"]).collect()}
    assert got == {g: round(sorted(x for _, h, x in rows if h == g)[250], 2) for g in "abc"}
    assert evaluate.timing(df).first()["median_elapsed"] == round(sorted(x for _, _, x in rows)[len(rows) // 2], 2)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_from_both_ends_and_between(spark, monkeypatch, order):
    monkeypatch.setattr(catalogue, "NEAR_END", 60)
    monkeypatch.setattr(catalogue, "RANGE_ROWS", 40)
    names = [f"2026-01-{1 + i % 28:02}_10-{i % 60:02}-{i // 10:02}.jpg" for i in range(325)] + ["odd.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    whole = [r["name"] for r in df.orderBy(*names_of.chronological(F.col("name"), order == "desc")).collect()]
    for page in range(1, 8):
        got = catalogue.paged(df, page, 50, order).orderBy("place").collect()
        assert [r["name"] for r in got] == whole[(page - 1) * 50 : page * 50]
        assert [r["place"] for r in got] == list(range((page - 1) * 50 + 1, (page - 1) * 50 + 1 + len(got))) and {r["pages"] for r in got} == {7}


def test_upper_median_and_empty(spark):
    df = spark.createDataFrame([("correct", float(x)) for x in (4, 1, 3, 2)], "status string, elapsed double")
    assert evaluate.timing(df).first()["median_elapsed"] == 3.0
    assert evaluate.timing(df.filter("false")).count() == 0
    assert evaluate.summary(df.filter("false")).first()["incorrect_pct"] == 0.0


def test_rectangles(spark):
    def n(x, y, w, h):
        r = spark.createDataFrame([("f", 0, x, y, w, h, 1000, 1000)], "frame_id string, idx int, x int, y int, w int, h int, width int, height int")
        return boxes.matches(r, boxes.known(spark)).count()

    assert n(0, 239, 387, 381) == 1
    assert n(20, 259, 387, 381) == 1
    assert n(40, 279, 387, 381) == 0
    assert n(500, 500, 100, 100) == 0


def test_commands(spark):
    df = spark.createDataFrame([(1, "ad"), (2, "content"), (3, "unknown")], "seq int, classification string")
    got = outputs.commands(df, {"ad": {"label": "x", "A": "1", "Z": "2"}, "content": {}}).collect()
    assert [(r["seq"], r["output"], r["input"]) for r in got] == [(1, "A", 1)]


def test_step_by_step_is_the_window_plan():
    s = [None, None, True, True, None, []]
    assert live.step(s, "frame", "ad", "llm", False, 0.0, 1)[1] is None
    assert live.step(s, "frame", "ad", "llm", False, 1.0, 2)[4] == "ad"
    assert live.step(s, "report", "content", "", False, 2.0, 3)[1] == "content"
    assert live.step(s, "frame", "ad", "opencv", False, 3.0, 4)[4] is None  # paused
    assert live.step(s, "resume", None, "", False, 4.0, 5)[4] == "ad"
    for i in range(6, 12):
        live.step(s, "frame", "unknown", "llm", False, float(i), i)
    assert s[5] == [7, 8, 9, 10, 11]


def plain_leaders(rows, threshold):
    leaders, out = [], {}
    for name, phash in rows:
        near = next(((n, bin((phash ^ p) & (2**64 - 1)).count("1")) for n, p in leaders if bin((phash ^ p) & (2**64 - 1)).count("1") <= threshold), None)
        if near is None:
            leaders.append((name, phash))
        out[name] = near or (name, 0)
    return out


@pytest.mark.parametrize("use_dhash", [True, False])
def test_rounds_do_not_grow_with_a_group(spark, monkeypatch, use_dhash):
    """Eighty hashes near each other, and blocks of a few: three rounds decide them, not one for each row."""
    monkeypatch.setattr(dedupe, "LOCAL", 0)
    monkeypatch.setattr(dedupe, "MOST_ROUNDS", 6)
    monkeypatch.setattr(dedupe, "BLOCK", 30, raising=False)
    rows = [(f"f{i:04}.jpg", 1 << (i % 60) | (3 << 58 if i >= 60 else 0), 0, False) for i in range(80)]
    got = {r["name"]: (r["kept"], r["representative"], r["distance"]) for r in dedupe.kept_first(hash_rows(spark, rows), 4, use_dhash).collect()}
    assert got == plain_greedy(rows, 4)
    hashes = spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(rows)], "name string, phash long, pos long")
    got = {r["name"]: (r["leader"], r["distance"]) for r in dedupe.clusters(hashes, 4).collect()}
    assert got == plain_leaders([r[:2] for r in rows], 4)


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_and_pairs_of_random_hashes(spark, monkeypatch, seed):
    monkeypatch.setattr(dedupe, "BLOCK", 50, raising=False)
    rng = random.Random(seed)
    rows = [(f"f{i:04}.jpg", rng.getrandbits(10) | (rng.getrandbits(4) << 60) - (1 << 63)) for i in range(200)]
    hashes = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(rows)], "name string, phash long, pos long")
    got = {r["name"]: (r["leader"], r["distance"]) for r in dedupe.clusters(hashes, 3).collect()}
    assert got == plain_leaders(rows, 3)
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    own = {p for _, p in rows}
    assert sorted(map(tuple, dedupe.hash_pairs(hashes, 3).collect())) == sorted((a, b, apart(a, b)) for a in own for b in own if apart(a, b) <= 3)


def test_estimated_sizes_do_not_grow_with_rounds(spark, monkeypatch):
    """Each of a chain of hashes is near the next one only, so that there are several rounds; their joins must not multiply."""
    monkeypatch.setattr(dedupe, "LOCAL", 0)
    rows = [(f"f{i:04}.jpg", ((1 << 4 * i) - 1) - (1 << 63), 0, False) for i in range(6)]
    decided = dedupe.kept_first(hash_rows(spark, rows), 4, False)
    assert {r["name"]: (r["kept"], r["representative"], r["distance"]) for r in decided.collect()} == plain_greedy(rows, 4)
    assert int(str(decided._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**60
