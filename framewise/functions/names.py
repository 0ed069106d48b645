"""Frame file names: when a frame was taken, chronological order, time bounds, suffixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two conventions for names, and the form of a time bound.
NAME = r"^(\d{4})-(\d{2})-(\d{2})[T_](\d{2})-(\d{2})(?:-(\d{2}))?(?:-(\d+))?(?:_(\d+))?"
BOUND = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?$"
PARTS = ("year", "month", "day", "hour", "minute", "second", "micros", "idx")
SUFFIXES = ("png", "jpg", "jpeg")


def taken(name: Column) -> Column:
    """Struct of eight numbers, parts that a name omits being 0; null for names without a time. Not checked against the calendar."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(name, NAME, i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when(name.rlike(NAME), F.struct(*[part(i).alias(p) for i, p in enumerate(PARTS, 1)]))


def chronological(name: Column, descending: bool = False) -> list[Column]:
    """Sort keys: by time, names without a time last by name. Descending is the whole order reversed, so those come first."""
    return ordered(taken(name), name, descending)


def ordered(at: Column, name: Column, descending: bool = False) -> list[Column]:
    """As chronological, with the time of each name given."""
    keys = [at.isNull(), at, name]
    return [k.desc() if descending else k.asc() for k in keys]


#: What a bound that stops early goes on with: the first and the last moment it can mean.
OPEN = {"low": "00000000000000", "high": "99999999235959"}


def bound(value: str | None, side: str) -> str | None:
    """A time bound as 14 digits (year to second), what is left out taken from OPEN[side]. Empty: None; not in the form BOUND: ValueError."""
    text = (value or "").strip()
    if not value:
        return None
    if not re.match(BOUND, text):
        raise ValueError(f"no time bound: {value!r}")
    digits = re.sub(r"\D", "", text)
    return digits + OPEN[side][len(digits) :]


def between(name: Column, start: str | None = None, end: str | None = None) -> Column:
    """Whether a frame was taken in the bounds, both included; names without a time only pass if there are none."""
    low, high = bound(start, "low"), bound(end, "high")
    if low is None and high is None:
        return F.lit(True)
    # Fourteen digits of fixed width order as the numbers do, and need one regular expression.
    second = F.rpad(F.regexp_replace(name, f"(?s){NAME}.*$", "$1$2$3$4$5$6"), 14, "0")
    out = name.rlike(NAME)
    if low:
        out = out & (second >= F.lit(low))
    if high:
        out = out & (second <= F.lit(high))
    return F.coalesce(out, F.lit(False))


def has_image_suffix(name: Column, any_case: bool = False) -> Column:
    return (F.lower(name) if any_case else name).rlike(r"\.(png|jpe?g)$")


def is_safe(name: Column) -> Column:
    """A bare file name of an image, without a path."""
    return name.rlike(r"^[^/]+\.(png|jpe?g)$")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def with_suffix(suffix: Column, default: str) -> Column:
    """A suffix in lower case if it is one of an image, else the default."""
    low = F.lower(suffix)
    return F.when(low.isin(*[f".{s}" for s in SUFFIXES]), low).otherwise(F.lit(default))


def batch_name(timestamp: Column, index: Column, suffix: Column) -> Column:
    """Name of a frame saved in a batch: the timestamp with dashes, an index, the suffix."""
    return F.concat(F.regexp_replace(timestamp, "[:.]", "-"), F.lit("_"), index.cast("string"), suffix)
