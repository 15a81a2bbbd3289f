"""How usable a captured frame is: level and reasons from sharpness and light."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Below or above them a frame is dark or blurred, or very much so."""

    luma: float = 105
    very_luma: float = 72
    dark_pixel: int = 60
    dark_share: float = 0.42
    very_dark_share: float = 0.62
    focus: float = 320
    very_focus: float = 140
    of_peak: float = 0.55
    very_of_peak: float = 0.32
    least_peak: float = 200


LIMITS = Limits()

# What the user is told.
GUIDANCE = {
    "none": "書類全体が写るようにしてください",
    "good": "シャッターを押してください",
    "dark,blur": "明るさとピントを調整してください",
    "dark": "もう少し明るくしてください",
    "blur": "手ブレ注意：端末を安定させてください",
}

# Stroke, fill and corner colour of the frame drawn around the page.
COLORS = {
    "good": ("#10b981", "rgba(16, 185, 129, 0.15)", "#059669"),
    "fair": ("#f59e0b", "rgba(245, 158, 11, 0.16)", "#d97706"),
    "poor": ("#ef4444", "rgba(239, 68, 68, 0.16)", "#dc2626"),
}


def capture_quality(focus: Column, luma: Column, dark_share: Column, peak: Column, at: Limits = LIMITS) -> Column:
    """struct(level, reasons). A peak below ``least_peak`` takes no part; null metrics speak for nothing."""
    no = lambda c: F.coalesce(c, F.lit(False))
    known_peak = peak >= at.least_peak
    dark = no((luma < at.luma) | (dark_share > at.dark_share))
    very_dark = no((luma < at.very_luma) | (dark_share > at.very_dark_share))
    blur = no((focus < at.focus) | (known_peak & (focus < peak * at.of_peak)))
    very_blur = no((focus < at.very_focus) | (known_peak & (focus < peak * at.very_of_peak)))
    level = F.when(very_dark | very_blur | (dark & blur), "poor").when(dark | blur, "fair").otherwise("good")
    reasons = F.filter(F.array(F.when(dark, "dark"), F.when(blur, "blur")), lambda r: r.isNotNull())
    return F.struct(level.alias("level"), reasons.alias("reasons"))


def guidance(level: Column, reasons: Column) -> Column:
    dark, blur = F.array_contains(reasons, "dark"), F.array_contains(reasons, "blur")
    out = F.when(level == "none", GUIDANCE["none"]).when(level == "good", GUIDANCE["good"])
    return out.when(dark & blur, GUIDANCE["dark,blur"]).when(dark, GUIDANCE["dark"]).otherwise(GUIDANCE["blur"])


def frame_colors(level: Column) -> Column:
    """struct(stroke, fill, corner); ``none`` looks like ``good``."""
    def of(name: str) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(("stroke", "fill", "corner"), COLORS[name], strict=True)])

    return F.when(level.isin("good", "none"), of("good")).when(level == "fair", of("fair")).when(level == "poor", of("poor"))
