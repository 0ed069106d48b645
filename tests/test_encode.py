"""Image files written here and decoded by Spark; cosines and reductions by hand."""

import math

import numpy as np
import pytest

from framewise.functions import encode, pixels
from framewise.sources import files


def picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    img = np.stack([128 + 90 * np.sin(x / 17 + seed), 128 + 90 * np.cos(y / 23), 60 + (x + y) % 130], axis=2)
    return np.clip(img + rng.normal(0, 4, img.shape), 0, 255).astype(np.uint8)


def test_jpeg_is_decoded_near_the_picture(spark, tmp_path):
    made = {f"{h}x{w}.jpg": picture(h, w, h) for h, w in ((64, 64), (37, 91), (8, 8), (1, 1), (450, 800))}
    made["noise.jpg"] = np.random.default_rng(1).integers(0, 256, (120, 130, 3)).astype(np.uint8)
    made["black.jpg"] = np.zeros((33, 20, 3), np.uint8)
    for name, img in made.items():
        (tmp_path / name).write_bytes(encode.jpeg(img, 90))
    rows = files.images(spark, str(tmp_path)).collect()
    assert {r["name"] for r in rows} == set(made)
    for r in rows:
        got = pixels.image(r["height"], r["width"], r["data"]).astype(float)
        want = made[r["name"]].astype(float)
        assert got.shape == want.shape and np.abs(got - want).mean() < (12 if r["name"] == "noise.jpg" else 6), r["name"]
    sizes = [len(encode.jpeg(made["450x800.jpg"], q)) for q in (20, 50, 90)]
    assert sizes == sorted(sizes) and sizes[1] < 450 * 800


def test_png_is_decoded_to_the_pixel_and_damage_is_told(spark, tmp_path):
    made = {f"{i}.{'PNG' if i % 2 else 'png'}": picture(5 + i, 40 - i, i) for i in range(6)}
    for name, img in made.items():
        (tmp_path / name).write_bytes(encode.png(img))
    (tmp_path / "cut.png").write_bytes(encode.png(made["0.png"])[:60])
    (tmp_path / "text.jpg").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_bytes(b"no name of a picture")
    for r in files.images(spark, str(tmp_path)).collect():
        assert (pixels.image(r["height"], r["width"], r["data"]) == made[r["name"]]).all()
    hashes, errors = files.hashed(spark, str(tmp_path))
    assert {r["name"]: (r["phash"], r["dhash"]) for r in hashes.collect()} == {n: (pixels.phash(i), pixels.dhash(i)) for n, i in made.items()}
    assert {(r["name"], r["size"]) for r in errors.collect()} == {("cut.png", 60), ("text.jpg", 10)}


@pytest.mark.parametrize("counts", [[1], [5, 5], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765], list(range(1, 200))])
def test_codes_are_prefix_free_short_and_never_all_ones(counts):
    code, size, table = encode.codes(np.repeat(np.arange(len(counts)), counts))
    used = range(len(counts))
    words = {format(int(code[s]), f"0{size[s]}b") for s in used}
    assert len(words) == len(counts) and max(map(len, words)) <= 16 and not any(set(w) == {"1"} for w in words)
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert sum(table[:16]) == len(counts) and sorted(table[16:]) == list(used)


def test_reduction_keeps_proportions_and_brightness():
    img = picture(900, 1600)
    small = encode.within(img)
    assert small.shape == (450, 800, 3) and np.abs(small.mean(axis=(0, 1)) - img.mean(axis=(0, 1))).max() < 1
    assert encode.within(small) is small and encode.within(picture(1, 4000)).shape == (1, 800, 3)


def test_phash_is_that_of_the_cosines_written_out():
    img = np.random.default_rng(2).integers(0, 256, (32, 32, 3)).astype(np.uint8)
    grey = [[0.114 * b + 0.587 * g + 0.299 * r for b, g, r in row] for row in img.tolist()]
    low = [
        sum(grey[y][x] * math.cos(math.pi / 32 * (x + 0.5) * u) * math.cos(math.pi / 32 * (y + 0.5) * v) for y in range(32) for x in range(32))
        for v in range(8)
        for u in range(8)
    ]
    middle = sum(sorted(low)[31:33]) / 2
    bits = int("".join("1" if c > middle else "0" for c in low), 2)
    assert pixels.phash(img) % 2**64 == bits


def test_phash_of_symmetric_images_adds_term_by_term():
    """Their middle coefficients are equal but for rounding, so the order of adding decides."""
    cos = [[math.cos(math.pi / 32 * (x + 0.5) * u) for u in range(8)] for x in range(32)]
    for k in (196, 293, 584, 778, 972):
        v = [[(x * x * (k % 97 + 3) + y * y * 5 + x * y * 7 * (k % 89 + 1)) % 256 for x in range(32)] for y in range(32)]
        rows = []
        for y in range(32):
            row = [0.0] * 8
            for x in range(32):
                row = [a + v[y][x] * c for a, c in zip(row, cos[x], strict=True)]
            rows.append(row)
        low = [[0.0] * 8 for _ in range(8)]
        for y in range(32):
            low = [[a + s * cos[y][w] for a, s in zip(low[w], rows[y], strict=True)] for w in range(8)]
        flat = [f for row in low for f in row]
        middle = sum(sorted(flat)[31:33]) / 2
        bits = int("".join("1" if f > middle else "0" for f in flat), 2)
        img = np.repeat(np.array(v)[..., None], 3, axis=2).astype(np.uint8)
        assert pixels.phash(img) % 2**64 == bits
