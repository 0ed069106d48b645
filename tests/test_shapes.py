"""Rectangles by hand, at full size, and templates on whole frames."""

import resource
import time

import numpy as np
import pytest

from framewise.functions import pixels, profiles, shapes


def frame(h=300, w=400, level=20):
    return np.full((h, w, 3), level, np.uint8)


def test_box_of_a_bright_rectangle():
    img = frame()
    img[50:150, 60:260] = 220
    # Of the two pixels at a step the first is the edge: 59 to 259 across, 49 to 149 down.
    assert shapes.rectangles(img) == [(59, 49, 201, 101)]
    assert shapes.rectangles(img, least_area=200 * 100) == [] and shapes.rectangles(img, least_area=200 * 100 - 10) != []


def test_nested_touching_and_open_outlines():
    img = frame()
    img[20:280, 20:380] = 120
    img[100:200, 100:300] = 240  # inside the first: not an outer outline
    assert shapes.rectangles(img) == [(19, 19, 361, 261)]
    img = frame()
    img[20:120, 20:120] = 200
    img[120:220, 120:220] = 200  # touches the first at a corner: one outline around both
    assert shapes.rectangles(img) == [(19, 19, 201, 201)]
    img = frame()
    img[20:120, 20:120] = img[20:120, 140:240] = 200
    assert shapes.rectangles(img) == [(19, 19, 101, 101), (139, 19, 101, 101)]
    img = frame()
    img[40:42, 40:340] = img[40:260, 40:42] = 220  # an angle encloses nothing but its own width
    assert shapes.rectangles(img) == []
    img[258:260, 40:340] = img[40:260, 338:340] = 220
    img[148:151, 36:46] = 20  # a gap of three pixels is closed
    assert [b[2:] for b in shapes.rectangles(img)] == [(301, 221)]


def test_rotated_square():
    y, x = np.mgrid[0:300, 0:400]
    img = frame()
    img[np.abs(y - 150) + np.abs(x - 200) <= 100] = 230
    ((x, y, w, h),) = shapes.rectangles(img)
    assert abs(x - 99) <= 2 and abs(y - 49) <= 2 and abs(w - 202) <= 3 and abs(h - 202) <= 3
    # The square holds half of its box.
    assert shapes.rectangles(img, least_area=0.55 * w * h) == [] and len(shapes.rectangles(img, least_area=0.45 * w * h)) == 1


def test_outline_and_area_of_a_shape():
    mask = np.zeros((9, 9), bool)
    mask[2:6, 2:7] = True
    mask[6, 4] = True
    path = shapes.outline(mask, 2, 2)
    assert shapes.area(path) == 4 * 3 + 1 and len(path) == len(set(path)) == 14
    single = np.zeros((3, 3), bool)
    single[1, 1] = True
    assert shapes.outline(single, 1, 1) == [(1, 1)]
    line = np.zeros((3, 6), bool)
    line[1, 1:5] = True
    assert shapes.area(shapes.outline(line, 1, 1)) == 0


def test_thousands_of_specks_at_full_size():
    rng = np.random.default_rng(1)
    img = frame(1080, 1920)
    for y, x in zip(rng.integers(5, 1070, 3500), rng.integers(5, 1910, 3500), strict=True):
        img[y : y + 3, x : x + 3] = 255
    img[400:700, 600:1300] = 200
    began = time.perf_counter()
    found = shapes.rectangles(img)
    assert time.perf_counter() - began < 2 and len(found) == 1


def test_known_boxes_decide_in_the_profile():
    img = frame(1080, 1920)
    x, y, w, h = (round(v * s) for v, s in zip((0.411, 0.234, 0.542, 0.542), (1920, 1080, 1920, 1080), strict=True))
    img[y : y + h, x : x + w] = 210
    assert shapes.ad_box(img) == "fox-side-by-side-right" and shapes.ad_box(frame(1080, 1920)) is None
    nothing = profiles.Scorers()
    assert profiles.PROFILES["nascar_on_fox"](img, nothing) == ("opencv", "ad", "matched_rectangle", None)
    assert profiles.PROFILES["nascar_on_fox"](frame(1080, 1920), nothing)[2] == "no_model"


@pytest.mark.parametrize("seed", range(5))
def test_difference_matches_all_windows(seed):
    rng = np.random.default_rng(seed)
    img, t = rng.integers(0, 256, (23, 31, 3)).astype(np.uint8), rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    img[:9, :9] = 0
    x = np.lib.stride_tricks.sliding_window_view(img.astype(float), (5, 4, 3))[:, :, 0]
    d, scale = ((x - t) ** 2).sum(axis=(-3, -2, -1)), np.sqrt((x**2).sum(axis=(-3, -2, -1)) * (t.astype(float) ** 2).sum())
    assert abs(pixels.difference(img, t) - (d / np.where(scale > 0, scale, np.inf)).min()) < 1e-9


def test_template_on_a_whole_frame_needs_little_memory():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (1080, 1920, 3)).astype(np.uint8)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert pixels.difference(img, img[500:530, 700:740]) < 1e-9
    assert time.perf_counter() - began < 3 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20
    assert np.isnan(pixels.difference(img[:10], img[:20]))
