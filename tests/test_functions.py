import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import bits, checks, names, pixels, profiles, replies
from framewise.operators import outputs


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_time_bounds():
    assert names.bound("2026-01-01", "high") == "20260101235959"
    assert names.bound("2026-01-01T14:30", "high") == "20260101143059"
    assert names.bound("2026-01-01 14:30:05", "low") == "20260101143005"
    assert names.bound("2026-13-40", "low") == "20261340000000"
    assert names.bound("", "high") is None
    for bad in ("soon", "2026-01", "01-01-2026", "2026-01-01T14", "2026-1-1"):
        with pytest.raises(ValueError):
            names.bound(bad, "high")


def test_chronological_order(spark):
    rows = ["b.png", "2026-01-01_10-00.jpg", "2026-01-01T09-00-00-5_10.jpg", "2026-01-01T09-00-00-5_9.jpg", "a.png", "2026-01-01_09-00-01.jpg"]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    up = [r[0] for r in df.orderBy(*names.chronological(F.col("name"))).collect()]
    assert up == ["2026-01-01T09-00-00-5_9.jpg", "2026-01-01T09-00-00-5_10.jpg", "2026-01-01_09-00-01.jpg", "2026-01-01_10-00.jpg", "a.png", "b.png"]
    down = [r[0] for r in df.orderBy(*names.chronological(F.col("name"), descending=True)).collect()]
    assert down == up[::-1]


def test_midnight_span_and_untimed(spark):
    rows = [("2026-01-01_23-30-00.jpg",), ("2026-01-02_01-00-00.jpg",), ("2026-01-02_01-00-01.jpg",), ("x.jpg",)]
    got = values(spark, rows, "name string", names.between(F.col("name"), "2026-01-01T23:30", "2026-01-02T01:00:00"))
    assert got == [True, True, False, False]
    assert all(values(spark, rows, "name string", names.between(F.col("name"))))


def test_reply_verdicts(spark):
    rows = [("type=ad x",), ("type=racing",), ('{"classification": "ad"}',), ('ok {"classification":"racing"}',), ('{"classification":"other"}',), ("?",), ("",), (None,), ("{bad}",)]
    got = values(spark, rows, "reply string", replies.verdict(F.col("reply")))
    assert [g["type"] for g in got] == ["ad", "content", "ad", "content", "unknown", "unknown", "unknown", "unknown", "unknown"]
    assert [g["reason"] for g in got][-2] == "empty_response"


def test_checks():
    checks.require("label", "ad", checks.LABELS)
    checks.require("label", checks.UNSET, checks.LABELS)
    with pytest.raises(ValueError):
        checks.require("label", "AD", checks.LABELS)
    for page in ((0, 10, "asc"), (1, 0, "asc"), (1, 501, "asc"), (1, 10, "up")):
        with pytest.raises(ValueError):
            checks.require_page(*page)


def test_bits(spark):
    rows = [("ffffffffffffffff", "0000000000000000"), ("8000000000000001", "0000000000000001")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = bits.from_hex(F.col("a")), bits.from_hex(F.col("b"))
    assert [tuple(r) for r in df.select(bits.distance(a, b), bits.to_hex(a)).collect()] == [(64, rows[0][0]), (1, rows[1][0])]


@pytest.mark.parametrize("threshold", [0, 4, 10, 20])
def test_bands_cover_the_threshold(threshold):
    bands, radius = bits.band_plan(threshold)
    assert sum(w for _, w in bands) == 64
    assert len(bands) * (radius + 1) > threshold


def test_white_mask_and_match():
    img = np.zeros((2, 2, 3), np.uint8)
    img[0, 0], img[0, 1], img[1, 0], img[1, 1] = 255, 100, 200, (255, 199, 255)
    masked = pixels.white_only(img)
    assert masked[0, 0].tolist() == [255] * 3 and masked[1, 0].tolist() == [200] * 3
    assert not masked[0, 1].any() and not masked[1, 1].any()
    assert pixels.mask_share(masked) == 0.5
    rng = np.random.default_rng(1)
    frame, logo = rng.integers(0, 255, (60, 80, 3), np.uint8), rng.integers(0, 255, (9, 11, 3), np.uint8)
    frame[20:29, 30:41] = logo
    score, x, y = pixels.match(frame, logo)
    assert score > 0.999 and (x, y) == (30, 20)
    assert pixels.difference(frame[15:35, 25:45], logo) < 1e-6
    assert pixels.match(np.full((50, 50, 3), 255, np.uint8), logo) == (0.0, 0, 0)


def test_perceptual_hashes(spark):
    rng = np.random.default_rng(2)
    img = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((16, 16, 1))).astype(np.uint8)
    other = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((16, 16, 1))).astype(np.uint8)
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert apart(pixels.phash(img), pixels.phash(np.clip(img.astype(int) + 4, 0, 255).astype(np.uint8))) <= 6
    assert apart(pixels.phash(img), pixels.phash(other)) > 10
    df = spark.createDataFrame([(128, 128, bytearray(img.tobytes()))], "height int, width int, data binary")
    got = df.select(pixels.hashes("height", "width", "data").alias("h")).select("h.*").first()
    assert (got["phash"], got["dhash"]) == (pixels.phash(img), pixels.dhash(img))


def test_profile_cascades(spark):
    rng = np.random.default_rng(3)
    logo = rng.integers(200, 255, (6, 6, 3), np.uint8)
    dark = np.zeros((80, 120, 3), np.uint8)
    with_logo = dark.copy()
    with_logo[2:8, 105:111] = logo
    calls = []
    full = lambda img: calls.append(1) or ("llm", "ad", "model-match", "type=ad")
    s = profiles.Scorers({"logo": [logo]}, ask_quick=lambda img: True, ask_full=full)
    assert profiles.nascar_on_fox(with_logo, s)[1:3] == ("content", "network_logo") and not calls
    assert profiles.nascar_on_fox(dark, s) == ("llm", "ad", "model-match", "type=ad") and calls
    assert profiles.nascar_on_fox(dark, profiles.Scorers(rectangle=lambda img: "left"))[2] == "matched_rectangle"
    assert profiles.nascar_on_fox(dark, profiles.Scorers(ask_quick=lambda img: False))[2] == "model_quick_reject"
    frame = np.full((1080, 1920, 3), 30, np.uint8)
    full_size = lambda x, y, img=frame: np.concatenate([img[:y], np.concatenate([img[y : y + 6, :x], logo, img[y : y + 6, x + 6 :]], 1), img[y + 6 :]])
    nbc = lambda img, *names, **kw: profiles.nascar_on_nbc(img, profiles.Scorers({n: [logo] for n in names}, **kw))[2]
    assert nbc(full_size(100, 100, full_size(1800, 80)), "side_by_side", "peacock") == "side_by_side"
    assert nbc(full_size(100, 100, full_size(1800, 80)), "side_by_side", "peacock", off=frozenset({"side_by_side"})) == "network_logo"
    assert nbc(full_size(100, 400), "side_by_side") == "no_model"  # not in the top left fifth
    assert nbc(full_size(1800, 80), "peacock") == "network_logo" and nbc(full_size(1700, 80), "peacock") == "no_model"
    assert nbc(full_size(1800, 80), "usa") == "no_model"  # the mask of the window is nearly empty
    band = frame.copy()
    band[55:75, 1760:1880] = 255
    assert nbc(full_size(1800, 100, band), "usa") == "network_logo"
    assert profiles.nascar_on_nbc(frame, profiles.Scorers(ask_quick=lambda img: False))[2] == "model_quick_reject"
    nhra = profiles.Scorers({"logo": [logo]})
    assert profiles.nhra_on_fox(full_size(1700, 80), nhra)[2] == "network_logo" and profiles.nhra_on_fox(full_size(900, 500), nhra)[2] == "default_ad"
    assert profiles.nascar_on_hbo_max(with_logo, profiles.Scorers({"be_back": [logo]}))[1:3] == ("ad", "well_be_back")
    assert profiles.nascar_on_hbo_max(dark, profiles.Scorers())[2] == "default_fallback"
    assert profiles.nhra_on_fox(dark, s)[1:3] == ("ad", "default_ad")
    rows = [(80, 120, bytearray(dark.tobytes()), "content"), (80, 120, bytearray(dark.tobytes()), None)]
    df = spark.createDataFrame(rows, "height int, width int, data binary, override string")
    got = [r["result"]["source"] for r in profiles.classified(df, "nhra_on_fox", profiles.Scorers()).collect()]
    assert got == ["phash_override", "default"]
    assert profiles.profile_names() == ["nascar_on_fox", "nascar_on_hbo_max", "nascar_on_nbc", "nhra_on_fox"]


def test_sizes_round_as_printf(spark):
    sizes = [0, 5 << 17, 3125 << 17, 409_600_000, (1 << 30) - 1, 1 << 30, 9 << 27, 13 << 27, -(5 << 17)]
    got = values(spark, [(n,) for n in sizes], "n long", outputs.size_text(F.col("n")))
    assert got == ["%.2f GiB" % (n / 2**30) if n >= 1 << 30 else "%.2f MiB" % (n / 2**20) for n in sizes]
