"""64-bit perceptual hashes held in signed longs. Compare them by their bits, never by order."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def from_hex(text: Column) -> Column:
    """16 hexadecimal digits as a signed long."""
    return F.conv(text, 16, -10).cast("long")


def to_hex(value: Column) -> Column:
    return F.format_string("%016x", value)


def from_signs(values: Column, n: int = 64) -> Column:
    """Bit i is set where value i is above 0."""
    bits = F.transform(F.slice(values, 1, n), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _bands(n: int) -> list[tuple[int, int]]:
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def band_plan(threshold: int, n_hashes: int = 1) -> tuple[list[tuple[int, int]], int]:
    """Bands (shift, width) of the 64 bits and the radius r, such that hashes within threshold differ by r bits at most in some band.

    Wider bands have more keys a hash and far fewer other hashes in a bucket: of plans with a radius up
    to 3 the one with the fewest keys and candidates together for so many hashes.
    """

    def cost(n: int) -> float:
        radius = threshold // n
        return sum((keys := sum(comb(w, r) for r in range(radius + 1))) + n_hashes * keys / 2.0**w for _, w in _bands(n))

    n = min((m for m in range(3, 65) if threshold // m <= 3), key=cost)
    return _bands(n), threshold // n


def band_keys(value: Column, plan: tuple[list[tuple[int, int]], int], near: bool) -> Column:
    """Keys (band, bits) of a hash; with near, of all bits within the radius."""
    bands, radius = plan
    out = []
    for i, (shift, width) in enumerate(bands):
        own = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))
        flips = [sum(1 << b for b in c) for r in range(radius + 1 if near else 1) for c in combinations(range(width), r)]
        out.append(_flipped(own, flips, i))
    return F.concat(*out)


def _flipped(own: Column, flips: list[int], band: int) -> Column:
    return F.transform(
        F.array(*[F.lit(f).cast("long") for f in flips]),
        lambda f: F.struct(F.lit(band).alias("band"), own.bitwiseXOR(f).alias("bits")),
    )
