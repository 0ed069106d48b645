"""Rectangles in an image, in NumPy: thin edges, gaps closed, outer outlines and the area in them.

An edge is a pixel whose gradient is the greatest across the edge and steep, or fairly steep and
connected to steep ones. What is connected is found from the runs of rows, in time of the number of
runs; only outlines whose box is large enough are followed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import pixels
from framewise.operators import boxes

# Limits of the gradient, the side of the square that closes gaps, the least area of an outline.
WEAK, STRONG = 50, 150
CLOSE = 5
LEAST_AREA = 5000


def gradients(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives across and down; the border repeats."""
    p = np.pad(grey.astype(float), 1, mode="edge")
    smooth_rows = p[:-2] + 2 * p[1:-1] + p[2:]
    smooth_cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_rows[:, 2:] - smooth_rows[:, :-2], smooth_cols[2:] - smooth_cols[:-2]


def thinned(across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The gradient (sum of both sizes) where it is a maximum along its direction, else 0.

    Directions are horizontal, vertical or one of the diagonals, 22.5 degrees to each side. Of equal
    neighbours along a row or column the first stays; on a diagonal none does.
    """
    ax, ay = np.abs(across), np.abs(down)
    size = ax + ay
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    same = (across >= 0) == (down >= 0)
    along = lambda y, x: (size > at(-y, -x)) & (size > at(y, x))
    row, column = (size > at(0, -1)) & (size >= at(0, 1)), (size > at(-1, 0)) & (size >= at(1, 0))
    return np.where(np.where(flat, row, np.where(steep, column, np.where(same, along(1, 1), along(1, -1)))), size, 0)


class Runs:
    """The runs of set pixels of a mask by rows (row, start, end) and the number of the connected part of each, from 0."""

    def __init__(self, mask: np.ndarray, diagonal: bool = True) -> None:
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        self.row, self.start = np.nonzero(edge == 1)
        self.end = np.nonzero(edge == -1)[1]
        row, start, end = self.row.tolist(), self.start.tolist(), self.end.tolist()
        first = np.searchsorted(self.row, np.arange(mask.shape[0] + 1)).tolist()
        up = list(range(len(row)))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        reach = 1 if diagonal else 0
        for y in range(1, mask.shape[0]):
            i, j = first[y - 1], first[y]
            while i < first[y] and j < first[y + 1]:
                if start[i] < end[j] + reach and start[j] < end[i] + reach:
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
                if end[i] < end[j]:
                    i += 1
                else:
                    j += 1
        roots = np.array([find(i) for i in range(len(row))], int)
        self.part = np.unique(roots, return_inverse=True)[1].reshape(-1) if len(roots) else roots
        self.n = int(self.part.max()) + 1 if len(roots) else 0
        self.first = np.array(first)

    def boxes(self) -> np.ndarray:
        """Of each part left, top, right and bottom (exclusive) and its first run; from the runs alone."""
        order = np.argsort(self.part, kind="stable")
        at = np.searchsorted(self.part[order], np.arange(self.n))
        least = lambda v: np.minimum.reduceat(v[order], at)
        most = lambda v: np.maximum.reduceat(v[order], at)
        return np.stack([least(self.start), least(self.row), most(self.end), most(self.row) + 1, order[at]], axis=1) if self.n else np.zeros((0, 5), int)

    def of(self, y: int, x: int) -> int:
        """The part that holds a pixel; -1 if none does."""
        i = self.first[y] + np.searchsorted(self.start[self.first[y] : self.first[y + 1]], x, "right") - 1
        return int(self.part[i]) if i >= self.first[y] and x < self.end[i] else -1

    def painted(self, some: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """A mask of the runs of the parts for which some is set."""
        out = np.zeros((shape[0], shape[1] + 1), np.int8)
        keep = some[self.part] if self.n else np.zeros(0, bool)
        np.add.at(out, (self.row[keep], self.start[keep]), 1)
        np.add.at(out, (self.row[keep], self.end[keep]), -1)
        return np.cumsum(out, axis=1)[:, :-1] > 0


def _spread(mask: np.ndarray, size: int) -> np.ndarray:
    """Whether any pixel of the square around each one is set."""
    r = size // 2
    p = np.pad(mask, r)
    across = np.any([p[:, i : i + mask.shape[1]] for i in range(size)], axis=0)
    return np.any([across[i : i + mask.shape[0]] for i in range(size)], axis=0)


#: Steps to the eight neighbours (down, across), against the clock from the right.
AROUND = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))


def outline(mask: np.ndarray, y: int, x: int) -> list[tuple[int, int]]:
    """The pixels (y, x) of the outer border of the part whose first pixel by rows is given, in order, back to the start. The mask's border must not be set."""
    path, way = [(y, x)], 7
    while True:
        way = (way + 7) % 8 if way % 2 == 0 else (way + 6) % 8
        for k in range(8):
            dy, dx = AROUND[(way + k) % 8]
            if mask[y + dy, x + dx]:
                break
        else:
            return path  # a single pixel
        way = (way + k) % 8
        y, x = y + dy, x + dx
        # Back at the start and about to take the first step again.
        if len(path) > 2 and path[-1] == path[0] and (y, x) == path[1]:
            return path[:-1]
        path.append((y, x))


def area(path: list[tuple[int, int]]) -> float:
    """The area of the polygon through pixel centres."""
    y, x = np.array(path, float).T
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def edges(img: np.ndarray) -> np.ndarray:
    size = thinned(*gradients(np.rint(pixels.gray(img))))
    runs = Runs(size > WEAK)
    strong = np.zeros(runs.n, bool)
    if runs.n:
        # Whether a run holds a steep pixel: by sums along its row.
        held = np.pad(np.cumsum(size > STRONG, axis=1), ((0, 0), (1, 0)))
        strong[runs.part[held[runs.row, runs.end] > held[runs.row, runs.start]]] = True
    return runs.painted(strong, size.shape)


def rectangles(img: np.ndarray, least_area: float = LEAST_AREA) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, width, height) of outer outlines that enclose more than least_area, from the top left on."""
    # Beyond the border nothing is set while edges spread, and all is while they shrink.
    closed = np.pad(~_spread(~_spread(edges(img), CLOSE), CLOSE), 1)
    runs = Runs(closed)
    found = runs.boxes()
    large = np.flatnonzero((found[:, 2] - found[:, 0] - 1) * (found[:, 3] - found[:, 1] - 1) > least_area)
    ground = Runs(~closed, diagonal=False) if len(large) else None
    out = []
    for left, top, right, bottom, run in found[large].tolist():
        y, x = int(runs.row[run]), int(runs.start[run])
        # What lies before its first pixel is the ground outside, or a hole of the part around it.
        if ground.of(y, x - 1) == ground.of(0, 0) and area(outline(closed, y, x)) > least_area:
            out.append((left - 1, top - 1, right - left, bottom - top))
    return sorted(out, key=lambda b: (b[1], b[0]))


def ad_box(img: np.ndarray) -> str | None:
    """The first of the known boxes that a rectangle of the image is near to."""
    h, w = img.shape[:2]
    found = np.array(rectangles(img), float).reshape(-1, 4) / (w, h, w, h)
    for name, *box in boxes.KNOWN:
        if len(found) and np.sqrt(((found - box) ** 2).sum(axis=1)).min() <= boxes.EPS:
            return name
    return None


_BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h")])


@F.pandas_udf(T.ArrayType(_BOX))
def detected(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
    """The rectangles of images given as height, width, data."""
    return pd.Series([[dict(zip("xywh", b, strict=True)) for b in rectangles(pixels.image(*i))] for i in zip(height, width, data, strict=True)])
