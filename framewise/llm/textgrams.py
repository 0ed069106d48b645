"""Word shingles of Arrow text columns, hashed to 64 bits with NumPy.

Words are runs of bytes other than ASCII white space. A shingle is n words in a row; a text of
fewer words (but one at least) has one shingle of all of them; a text without words has none. The
hash of a word is a polynomial over its bytes (each looked up in a table of 64-bit values) modulo
2**64, mixed; it does not depend on where the word stands. Work goes in chunks of about a megabyte,
whole texts each, so memory is bounded by that and the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (two rounds of xor-shift-multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xF1357AEA2E62A9C5
UNBASE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[U(1)], np.full(max(n, CHUNK) * 5 // 4, U(base))]))
        _powers[base] = have
    return have[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts (one more at the end); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of CHUNK bytes or, if a text is longer, of one text."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end, end exclusive: runs of solid bytes inside a text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = np.flatnonzero(solid & (edge[:n] | ~np.concatenate([[False], solid[:-1]])))
    last = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    return first, last


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; it does not depend on where the run stands."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * powers(BASE, n), out=sums[1:])
        return mix((sums[last] - sums[first]) * powers(UNBASE, n + 1)[first] + (last - first).astype(U))


#: Longer runs have hashes that cannot be made to collide.
SAFE = 64


def sure_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """As run_hashes, but with a cryptographic hash for runs over SAFE bytes, for which the polynomial has known collisions."""
    out = run_hashes(data, first, last)
    for i in np.flatnonzero(last - first > SAFE):
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the index of its text."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    first, last = words(data, starts, ~SPACE[data])
    return run_hashes(data, first, last), np.searchsorted(starts, first, "right") - 1


def shingles(data: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, in order, and the index of its text."""
    words, doc = word_hashes(data, starts)
    if not len(words):
        return words, doc
    per = np.bincount(doc, minlength=len(starts) - 1)
    begin = np.concatenate([[0], np.cumsum(per)])
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - n + 1), U)
        for j in range(n):
            full = full * U(0x9E3779B97F4A7C15) + words[j : j + len(full)]
        ok = doc[: len(full)] == doc[n - 1 :] if len(full) else np.zeros(0, bool)
        out, at = mix(full[ok]), doc[: len(full)][ok]
        short = np.flatnonzero((per > 0) & (per < n))
        if len(short):
            h = np.zeros(len(short), U)
            for j in range(n - 1):
                has = per[short] > j
                h[has] = h[has] * U(0x9E3779B97F4A7C15) + words[begin[short][has] + j]
            out, at = np.concatenate([out, mix(h)]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def shingle_counts(data: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of hash: hash, index of the text, times it occurs there."""
    h, doc = shingles(data, starts, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.concatenate([at, [len(h)]]))


def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    return dict(zip(batch.schema.names, batch.columns, strict=True))
