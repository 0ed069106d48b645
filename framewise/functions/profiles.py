"""Classifier profiles: ordered, cheap tests first, each row leaving at its first answer.

A profile is a function of (image, known override, scorers) that returns (source, type, reason,
reply). It runs inside one vectorised UDF, because Spark does not skip Python UDFs within CASE. The
scorers are given by the caller: template images, and functions that ask a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import pixels, shapes

Result = tuple[str, str, str, str | None]


@dataclass
class Scorers:
    """templates by name; rectangle names the known box in a frame, if any; ask_quick and ask_full call a model (None: never asked); off names checks that are left out."""

    templates: dict[str, list[np.ndarray]] = field(default_factory=dict)
    off: frozenset[str] = frozenset()
    rectangle: Callable[[np.ndarray], str | None] = shapes.ad_box
    ask_quick: Callable[[np.ndarray], bool] | None = None
    ask_full: Callable[[np.ndarray], Result] | None = None

    def best(self, img: np.ndarray, name: str) -> float:
        """The best match of the templates of a name; 0 if the check is off."""
        return max((pixels.match(img, t)[0] for t in self.templates.get(name, [])), default=0.0) if name not in self.off else 0.0


# The size that frames are brought to, windows in it (x from, x to, y from, y to), thresholds.
HEIGHT, WIDTH = 1080, 1920
PEACOCK_WINDOW = (1740, 1880, 40, 140)
USA_WINDOW = (1750, 1890, 50, 140)
FOX = {"logo": 0.55, "side_by_side": 0.8}
NBC = {"side_by_side": 0.8, "peacock": 0.55, "usa": 0.65, "mask_low": 0.01, "mask_high": 0.90}
HBO = {"in_progress": 0.85, "be_back": 0.85}
NHRA = {"logo": 0.8}


def _model(img: np.ndarray, s: Scorers, quick: bool) -> Result:
    if quick and s.ask_quick is not None and not s.ask_quick(img):
        return "llm", "ad", "model_quick_reject", None
    if s.ask_full is not None:
        return s.ask_full(img)
    return "llm", "unknown", "no_model", None


def nascar_on_fox(img: np.ndarray, s: Scorers) -> Result:
    """Logo top right, split screen top left, known rectangles, then the model: quick question, full prompt."""
    if s.best(pixels.white_only(pixels.crop(img, bottom=1 / 8, left=5 / 6)), "logo") >= FOX["logo"]:
        return "opencv", "content", "network_logo", None
    if s.best(pixels.white_only(pixels.crop(img, bottom=1 / 5, right=1 / 5)), "side_by_side") >= FOX["side_by_side"]:
        return "opencv", "ad", "side_by_side", None
    if s.rectangle(img) is not None:
        return "opencv", "ad", "matched_rectangle", None
    return _model(img, s, quick=True)


def nascar_on_nbc(img: np.ndarray, s: Scorers) -> Result:
    """Split screen first, then either logo in its window, then the model: quick question, full prompt.

    The peacock is matched in colour; the white word mark only where the mask of its window is neither
    empty nor full, as a uniform patch tells nothing.
    """
    if s.best(pixels.white_only(pixels.crop(img, bottom=1 / 5, right=1 / 5)), "side_by_side") >= NBC["side_by_side"]:
        return "opencv", "ad", "side_by_side", None
    if s.best(pixels.window(img, *PEACOCK_WINDOW), "peacock") >= NBC["peacock"]:
        return "opencv", "content", "network_logo", None
    masked = pixels.white_only(pixels.window(img, *USA_WINDOW))
    if NBC["mask_low"] <= pixels.mask_share(masked) <= NBC["mask_high"] and s.best(masked, "usa") >= NBC["usa"]:
        return "opencv", "content", "network_logo", None
    return _model(img, s, quick=True)


def nascar_on_hbo_max(img: np.ndarray, s: Scorers) -> Result:
    """Two banners, on the frame as it is; no model."""
    if s.best(img, "in_progress") >= HBO["in_progress"]:
        return "opencv", "content", "commercial_break_racing", None
    if s.best(img, "be_back") >= HBO["be_back"]:
        return "opencv", "ad", "well_be_back", None
    return "default", "content", "default_fallback", None


def nhra_on_fox(img: np.ndarray, s: Scorers) -> Result:
    """Logo, else an advertisement."""
    if s.best(pixels.white_only(pixels.crop(img, bottom=1 / 8, left=5 / 6)), "logo") >= NHRA["logo"]:
        return "opencv", "content", "network_logo", None
    return "default", "ad", "default_ad", None


PROFILES: dict[str, Callable[[np.ndarray, Scorers], Result]] = {
    f.__name__: f for f in (nascar_on_fox, nascar_on_hbo_max, nascar_on_nbc, nhra_on_fox)
}


def profile_names() -> list[str]:
    return sorted(PROFILES)


def classified(frames: DataFrame, profile: str, scorers: Scorers, override: str | None = "override") -> DataFrame:
    """frames (height, width, data and, if named, override) with result: (source, type, reason, reply).

    Frames are brought to WIDTH x HEIGHT first, as windows and templates are of that size. A frame with an
    override never reaches the profile. KeyError for an unknown profile.
    """
    run = PROFILES[profile]

    @F.pandas_udf("struct<source:string,type:string,reason:string,reply:string>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for height, width, data, known in parts:
            out = [
                ("phash_override", k, "phash_override", None) if k is not None else run(pixels.resized(pixels.image(h, w, d), HEIGHT, WIDTH), scorers)
                for h, w, d, k in zip(height, width, data, known, strict=True)
            ]
            yield pd.DataFrame(out, columns=["source", "type", "reason", "reply"])

    known: Column = F.col(override) if override else F.lit(None).cast("string")
    return frames.withColumn("result", score("height", "width", "data", known))
