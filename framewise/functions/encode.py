"""Image files from pixels, in NumPy: PNG, baseline JPEG, and the reduction before a picture goes to a model."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import pixels

# The longest side and the quality of a picture for a model.
LONGEST, QUALITY = 800, 50
# The standard's example tables of quantisation, by rows.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)
#: The order of coefficients: by diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def png(img: np.ndarray) -> bytes:
    """A PNG file of an image (blue, green, red)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.pad(img[..., ::-1].reshape(img.shape[0], -1), ((0, 0), (1, 0)))  # each row with filter 0
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.astype(np.uint8).tobytes())) + chunk(b"IEND", b"")


def lanczos(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at a smaller size, by a windowed sinc of three lobes."""

    def weights(n: int, m: int) -> np.ndarray:
        share = max(1.0, n / m)
        at = (np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * n / m) / share
        w = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0)
        return w / w.sum(axis=1, keepdims=True)

    down, across = weights(img.shape[0], height), weights(img.shape[1], width)
    out = np.stack([down @ img[..., c].astype(float) @ across.T for c in range(img.shape[2])], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def within(img: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The image reduced so that no side is over longest, proportions kept; smaller ones stay as they are."""
    share = min(1.0, longest / max(img.shape[:2]))
    return img if share == 1.0 else lanczos(img, *(max(1, round(n * share)) for n in img.shape[:2]))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of prefix codes of 16 bits at most for symbols by their counts; no code is all ones."""
    # A symbol that never comes takes the longest code, so that all ones stay free.
    counts = {**counts, -1: 0}
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        length, i = dict.fromkeys(counts, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            i += 1
            heapq.heappush(heap, (a[0] + b[0], i, a[2] + b[2]))
        if max(length.values()) <= 16:
            return length
        # Rarer symbols count for more until the tree is flat enough.
        counts = {s: (n + 1) // 2 + 1 if s >= 0 else 0 for s, n in counts.items()}


def codes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of 256 symbols the code and its length for those in use, and the table as a file holds it."""
    found, n = np.unique(symbols, return_counts=True)
    length = code_lengths(dict(zip(found.tolist(), n.tolist(), strict=True)))
    longest = max(length.values())
    # The symbol that never comes must have the last of the longest codes.
    order = sorted((s for s in length if s >= 0), key=lambda s: (length[s], s))
    if length[-1] != longest:
        last = order[-1]
        length[last], length[-1] = length[-1], longest
        order.sort(key=lambda s: (length[s], s))
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value = at = 0
    for s in order:
        value <<= length[s] - at
        at = length[s]
        code[s], size[s] = value, at
        value += 1
    held = bytes(sum(length[s] == i for s in order) for i in range(1, 17))
    return code, size, held + bytes(order)


def jpeg(img: np.ndarray, quality: int = QUALITY) -> bytes:
    """A baseline JPEG file of an image (blue, green, red), without subsampling, with prefix codes made for it."""
    h, w = img.shape[:2]
    b, g, r = (np.pad(img, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")[..., c].astype(float) for c in range(3))
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (luma - 128, (b - luma) / 1.772, (r - luma) / 1.402)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMINANCE, CHROMINANCE)]
    k = np.arange(8)
    cosines = np.cos(np.pi / 8 * (k[None, :] + 0.5) * k[:, None]) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    held = []
    for i, plane in enumerate(planes):
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        q = np.rint((cosines @ blocks @ cosines.T).reshape(-1, 64) / tables[min(i, 1)])[:, ZIGZAG].astype(np.int64)
        q[1:, 0] = np.diff(q[:, 0])
        held.append(q)
    rows = np.stack(held, axis=1).reshape(-1, 64)  # the three blocks of a place follow each other

    bits = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    extra = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    dc = bits(rows[:, 0])
    row, col = np.nonzero(rows[:, 1:])
    value = rows[:, 1:][row, col]
    new = np.diff(row, prepend=-1) > 0
    gap = col - np.where(new, -1, np.concatenate([[-1], col[:-1]])) - 1
    size = bits(value)
    last = np.full(len(rows), -1)
    last[row] = col
    # Everything with its place: a block's first number, runs of sixteen zeros, numbers, the end.
    long = np.repeat(np.arange(len(row)), gap // 16)
    ends = np.flatnonzero(last < 62)
    place = np.concatenate([np.arange(len(rows)) * 256, row[long] * 256 + 2 * col[long] + 1, row * 256 + 2 * col + 2, ends * 256 + 255])
    symbol = np.concatenate([dc, np.full(len(long), 0xF0), gap % 16 * 16 + size, np.zeros(len(ends), np.int64)])
    more = np.concatenate([extra(rows[:, 0], dc), np.zeros(len(long), np.int64), extra(value, size), np.zeros(len(ends), np.int64)])
    n_more = np.concatenate([dc, np.zeros(len(long), np.int64), size, np.zeros(len(ends), np.int64)])
    is_dc = np.arange(len(place)) < len(rows)
    dc_code, dc_size, dc_table = codes(symbol[is_dc])
    ac_code, ac_size, ac_table = codes(symbol[~is_dc])
    code, n_code = np.where(is_dc, dc_code[symbol], ac_code[symbol]), np.where(is_dc, dc_size[symbol], ac_size[symbol])
    order = np.argsort(place, kind="stable")
    word, n = (code << n_more | more)[order], (n_code + n_more)[order]
    of = np.repeat(np.arange(len(n)), n)
    down = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(of))
    stream = word[of] >> down & 1
    data = np.packbits(np.pad(stream.astype(np.uint8), (0, -len(stream) % 8), constant_values=1)).tobytes().replace(b"\xff", b"\xff\x00")

    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3))
    scan = b"\x03" + b"".join(bytes([i + 1, 0]) for i in range(3)) + b"\x00\x3f\x00"
    quant = [part(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(tables)]
    return b"".join(
        [b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *quant, part(0xC0, frame), part(0xC4, b"\x00" + dc_table), part(0xC4, b"\x10" + ac_table), part(0xDA, scan), data, b"\xff\xd9"]
    )


@F.pandas_udf(T.BinaryType())
def prepared(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """JPEG files for a model of images given as height, width, data."""
    for cols in parts:
        yield pd.Series([jpeg(within(pixels.image(*x))) for x in zip(*cols, strict=True)])
