"""Domains of labels and features, and the filters over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed labels and features.
LABELS = ("ad", "content", "ignore")
NETWORK_LOGOS = ("Fox", "FS1", "FS2", "NBC", "CW", "USA", "Prime", "TNT", "other", "none")
LOGO_POSITIONS = ("upper_left", "upper_right", "lower_left", "lower_right", "center", "not_visible", "unknown")
SCOREBOARD_POSITIONS = ("top", "bottom", "left", "upper_left", "right", "none", "unknown")
FEATURES = {"network_logo": NETWORK_LOGOS, "logo_position": LOGO_POSITIONS, "scoreboard_position": SCOREBOARD_POSITIONS}
UNSET = "__unset__"
PER_PAGE, MOST_PER_PAGE = 100, 500


def empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def selected(value: Column, wanted: str | None) -> Column:
    """An empty selection lets all pass, UNSET those without a value, else those with just that value."""
    if not wanted:
        return F.lit(True)
    return empty(value) if wanted == UNSET else F.coalesce(value == wanted, F.lit(False))


def all_selected(wanted: dict[str, str | None]) -> Column:
    return reduce(lambda a, b: a & b, [selected(F.col(c), w) for c, w in wanted.items()], F.lit(True))


def incomplete(label: str = "label") -> Column:
    return reduce(lambda a, b: a | b, [empty(F.col(c)) for c in (label, *FEATURES)])


def require(name: str, value: str | None, allowed: tuple[str, ...]) -> None:
    """ValueError for a selection outside the domain."""
    if value and value != UNSET and value not in allowed:
        raise ValueError(f"invalid {name}: {value!r}")


def require_page(page: int, per_page: int, order: str) -> None:
    if page < 1 or not 1 <= per_page <= MOST_PER_PAGE or order not in ("asc", "desc"):
        raise ValueError(f"invalid page {page}, per_page {per_page} or order {order!r}")


def in_domain(column: str) -> Column:
    """Whether a recorded value, if any, is in its domain."""
    allowed = LABELS if column == "label" else FEATURES[column]
    return F.col(column).isNull() | F.col(column).isin(*allowed)
