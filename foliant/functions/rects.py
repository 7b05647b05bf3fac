"""Rectangles of a page as columns: ``left, right, top, bottom``, y growing upwards."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(left, right, top, bottom) -> Column:
    of = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(of(left).alias("left"), of(right).alias("right"), of(top).alias("top"), of(bottom).alias("bottom"))


def ratio(a: Column, b: Column) -> Column:
    """The smaller of two magnitudes over the larger, 1 for two zeros, 0 for numbers of two signs."""
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return F.when(high == 0, 1.0).when((a < 0) != (b < 0), 0.0).otherwise(low / high)


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b))


def width(r: Column) -> Column:
    return r["right"] - r["left"]


def height(r: Column) -> Column:
    return r["top"] - r["bottom"]


def area(r: Column) -> Column:
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def _shared(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(F.least(high_a, high_b) - F.greatest(low_a, low_b), F.lit(0.0))


def shared_width(a: Column, b: Column) -> Column:
    return _shared(a["left"], a["right"], b["left"], b["right"])


def shared_height(a: Column, b: Column) -> Column:
    return _shared(a["bottom"], a["top"], b["bottom"], b["top"])


def overlap(a: Column, b: Column) -> Column:
    """The shared area as a part of the smaller one; 0 if either is empty."""
    least = F.least(area(a), area(b))
    return F.when(least == 0, 0.0).otherwise(shared_width(a, b) * shared_height(a, b) / least)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["left"], b["left"]), F.greatest(a["right"], b["right"]), F.greatest(a["top"], b["top"]), F.least(a["bottom"], b["bottom"]))


def contains(a: Column, b: Column, slack: float = 0.0) -> Column:
    return (b["left"] >= a["left"] - slack) & (b["right"] <= a["right"] + slack) & (b["top"] <= a["top"] + slack) & (b["bottom"] >= a["bottom"] - slack)


def aligned(a: Column, b: Column, slack: float) -> Column:
    """``left``, ``right`` or ``centre`` where the edges or middles of two lie within ``slack``; null if none does."""
    middle = lambda r: (r["left"] + r["right"]) / 2
    near = lambda x, y: F.abs(x - y) <= slack
    return F.when(near(a["left"], b["left"]), "left").when(near(a["right"], b["right"]), "right").when(near(middle(a), middle(b)), "centre")


def gap(a: Column, b: Column) -> Column:
    """The distance between the nearest edges: 0 where they touch or overlap."""
    across = F.greatest(F.greatest(a["left"], b["left"]) - F.least(a["right"], b["right"]), F.lit(0.0))
    along = F.greatest(F.greatest(a["bottom"], b["bottom"]) - F.least(a["top"], b["top"]), F.lit(0.0))
    return F.sqrt(across * across + along * along)
