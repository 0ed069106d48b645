"""Pixel work in NumPy: perceptual hashes, the white mask and template matching.

Images are height x width x 3 arrays of bytes in the order blue, green, red, as Spark's image source
gives them. The hashes follow the usual definitions (cosine transform, horizontal gradient) on area
means; other libraries resample otherwise, so their bits can differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a pixel with any channel below this is masked.
WHITE = 200


def image(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def gray(img: np.ndarray) -> np.ndarray:
    """Whole thousandths until the end, so that a gray pixel is what it was."""
    return img @ np.array([114.0, 587.0, 299.0]) / 1000


def shrunk(img: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over a grid of areas, each pixel weighted by how much of it lies in the area."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        low, high = edge[:-1, None], edge[1:, None]
        at = np.arange(n)[None, :]
        return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) / (n / m)

    return weights(img.shape[0], rows) @ img @ weights(img.shape[1], cols).T


def _signed(bits: np.ndarray) -> int:
    value = int("".join("1" if b else "0" for b in bits.reshape(-1)), 2)
    return value - (1 << 64) if value >> 63 else value


_COSINES = np.array([[math.cos(math.pi / 32 * (x + 0.5) * u) for u in range(8)] for x in range(32)])


def phash(img: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest cosine coefficients of a 32 x 32 image, against their median.

    In symmetric images the two coefficients about the median are equal but for rounding, so the sums
    are taken term by term, first along a row; a matrix product adds in an order of its own.
    """
    small = shrunk(gray(img), 32, 32)
    rows = sum(small[:, x, None] * _COSINES[x] for x in range(32))
    low = sum(rows[y] * _COSINES[y, :, None] for y in range(32))
    return _signed(low > np.median(low))


def dhash(img: np.ndarray) -> int:
    """Whether brightness rises from left to right, on 8 rows of 9 areas."""
    small = shrunk(gray(img), 8, 9)
    return _signed(small[:, 1:] > small[:, :-1])


def white_only(img: np.ndarray, least: int = WHITE) -> np.ndarray:
    """A copy in which pixels with any channel below least are 0."""
    return np.where((img >= least).all(axis=2, keepdims=True), img, 0).astype(img.dtype)


def mask_share(img: np.ndarray) -> float:
    """Share of pixels that are not 0."""
    return float((img > 0).any(axis=2).mean())


def _windows(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over all h x w windows of a plane, from its integral image."""
    s = np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def _correlation(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sums of products of a plane's windows with a template's plane, by Fourier transforms."""
    shape = (x.shape[0], x.shape[1])
    both = np.fft.irfft2(np.fft.rfft2(x) * np.conj(np.fft.rfft2(t, shape)), shape)
    return both[: shape[0] - t.shape[0] + 1, : shape[1] - t.shape[1] + 1]


def match(img: np.ndarray, template: np.ndarray) -> tuple[float, int, int]:
    """Highest normalised correlation coefficient of a template in an image, and where (x, y).

    Flat windows and flat templates correlate with nothing (0). A template that is larger than the
    image gives 0 at (0, 0).
    """
    h, w = template.shape[:2]
    if h > img.shape[0] or w > img.shape[1]:
        return 0.0, 0, 0
    t = template.astype(float)
    t = t - t.mean(axis=(0, 1))
    norm = np.sqrt((t * t).sum())
    x = img.astype(float)
    score = variance = 0.0
    for c in range(x.shape[2]):
        score = score + _correlation(x[..., c], t[..., c])
        variance = variance + np.maximum(_windows(x[..., c] ** 2, h, w) - _windows(x[..., c], h, w) ** 2 / (h * w), 0)
    scale = np.sqrt(variance) * norm
    score = np.where(scale > 1e-6 * max(norm, 1.0) * np.sqrt(h * w), score / np.where(scale > 0, scale, 1), 0.0)
    at = int(score.argmax())
    return float(min(1.0, score.flat[at])), at % score.shape[1], at // score.shape[1]


def difference(img: np.ndarray, template: np.ndarray) -> float:
    """Least sum of squared differences over all places, normalised by both energies; 0 is the best.

    The sum is that of the window's squares and the template's less twice their products, so memory is
    a few planes of the image. Black windows differ by nothing; of a template that is larger than the
    image nothing is known (NaN).
    """
    h, w = template.shape[:2]
    if h > img.shape[0] or w > img.shape[1]:
        return float("nan")
    x, t = img.astype(float), template.astype(float)
    energy = sum(_windows(x[..., c] ** 2, h, w) for c in range(x.shape[2]))
    own = (t * t).sum()
    d = np.maximum(energy + own - 2 * sum(_correlation(x[..., c], t[..., c]) for c in range(x.shape[2])), 0)
    scale = np.sqrt(energy * own)
    return float((d / np.where(scale > 0, scale, np.inf)).min())


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at a size, each pixel from the four nearest ones by distance (bilinear, centres aligned)."""
    if img.shape[:2] == (height, width):
        return img

    def ends(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    top, bottom, down = ends(img.shape[0], height)
    left, right, across = ends(img.shape[1], width)
    x = img.astype(np.float32)
    rows = x[top] * (1 - down)[:, None, None] + x[bottom] * down[:, None, None]
    out = rows[:, left] * (1 - across)[None, :, None] + rows[:, right] * across[None, :, None]
    return np.rint(out).astype(np.uint8)


def window(img: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    return img[y0:y1, x0:x1]


def crop(img: np.ndarray, top: float = 0, bottom: float = 1, left: float = 0, right: float = 1) -> np.ndarray:
    """A part of an image, by shares of height and width."""
    h, w = img.shape[:2]
    return img[int(h * top) : max(int(h * bottom), int(h * top) + 1), int(w * left) : max(int(w * right), int(w * left) + 1)]


@F.pandas_udf(T.StructType([T.StructField("phash", T.LongType()), T.StructField("dhash", T.LongType())]))
def hashes(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Both hashes of images given as height, width, data."""
    for height, width, data in parts:
        images = [image(*x) for x in zip(height, width, data, strict=True)]
        yield pd.DataFrame({"phash": [phash(i) for i in images], "dhash": [dhash(i) for i in images]}, dtype="int64")


@F.pandas_udf(T.BinaryType())
def thumbnails(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Thumbnails of images given as height, width, data: height and width as two 4-byte numbers, then the pixels."""
    for height, width, data in parts:
        small = [thumbnail(image(*x)) for x in zip(height, width, data, strict=True)]
        yield pd.Series([np.array(t.shape[:2], "<i4").tobytes() + t.tobytes() for t in small])


@F.pandas_udf(
    T.StructType([T.StructField(n, T.IntegerType() if n in "xy" else T.DoubleType()) for n in ("score", "x", "y", "share", "difference")])
)
def matches(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of images and templates (height, width, data each): best match on the white mask and where, share of the mask, least difference."""
    for cols in parts:
        out = []
        for h, w, d, th, tw, td in zip(*cols, strict=True):
            img, template = image(h, w, d), image(th, tw, td)
            masked = white_only(img)
            out.append((*match(masked, template), mask_share(masked), difference(img, template)))
        yield pd.DataFrame(out, columns=["score", "x", "y", "share", "difference"])


def thumbnail(img: np.ndarray, most: int = 400) -> np.ndarray:
    """The image within most x most pixels, proportions kept; smaller images stay as they are."""
    share = min(1.0, most / max(img.shape[:2]))
    if share == 1.0:
        return img
    rows, cols = (max(1, round(n * share)) for n in img.shape[:2])
    return np.stack([shrunk(img[..., c].astype(float), rows, cols) for c in range(img.shape[2])], axis=2).round().astype(np.uint8)
