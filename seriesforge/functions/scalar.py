"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounded to an integer, ties to even."""
    return F.rint(x).cast("long")


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def finite_int(text: Column) -> Column:
    """The text as a number, if it is a finite one, cut to an integer; else null."""
    n = text.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(9e18)), n.cast("long"))


def odd_window(n: Column, most: int = 31) -> Column:
    """The largest odd window of at most ``most`` rows that a series of n rows holds."""
    return F.least(F.lit(most), n - (1 - n % 2))


def radius_bounds(width: Column, height: Column) -> tuple[Column, Column]:
    """Least and largest plausible circle radius in a frame of this size."""
    side = F.least(width, height)
    low = F.greatest(F.lit(18), half_even(side * 0.045))
    return low, F.greatest(low + 8, half_even(side * 0.11))


def letterbox(width: Column, height: Column, target: int = 1024) -> dict[str, Column]:
    """Scale and borders that fit a frame into a square, keeping its shape."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    new_w, new_h = half_even(width * scale), half_even(height * scale)
    left, top = F.floor((target - new_w) / 2), F.floor((target - new_h) / 2)
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_left": left, "pad_top": top, "pad_right": target - new_w - left, "pad_bottom": target - new_h - top}


def display_scale(width: Column, height: Column, most_width: int = 1280, most_height: int = 720) -> Column:
    """The factor that fits a frame on a screen; never above 1."""
    return F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)


def crop_window(x: Column, y: Column, r: Column, width: Column, height: Column, least: int = 20) -> Column:
    """The square around a circle, kept inside the frame: struct of x0, y0, x1, y1; null if a side is under ``least`` pixels."""
    x0, y0 = (clamp(c - r, 0, size).cast("int") for c, size in ((x, width), (y, height)))
    x1, y1 = (clamp(c + r, 0, size).cast("int") for c, size in ((x, width), (y, height)))
    window = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), window)


def small_jump(distance: Column, radius: Column) -> Column:
    """Whether a circle's centre moved no further than geometry allows: 70 pixels, or 0.85 of its radius if that is more."""
    return distance <= F.greatest(F.lit(70.0), 0.85 * radius)


def is_mask(logit: Column) -> Column:
    """Whether a pixel with this logit belongs to the mask."""
    return logit > 0
