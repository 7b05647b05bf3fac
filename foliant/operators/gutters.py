"""Columns of a page, also nested ones: regions are cut at the best gutter until none is left.

A sweep over sorted edges counts how many lines cross each place. A stretch that no line crosses, or
only few (titles over several columns), is a gutter if it is wide enough and has columns on both
sides; its score weighs width, crossing lines, balance and how far the two sides stand beside each
other. Where a band of other columns hides a gutter, the region is cut at the gap between
the bands. A page is a group of its own and bounds the work of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: A column takes this part of the page's width at least, a gutter so many font sizes.
LEAST_COLUMN, LEAST_GUTTER = 1 / 6, 1.2
#: Lines that may cross a gutter, as a part of a region's lines; and the score from which one counts.
MOST_CROSSING, LEAST_SCORE = 0.2, 0.004
#: Bands are parted by gaps of so many times a region's usual one.
BAND = 1.6


def stretches(low: np.ndarray, high: np.ndarray, most: int) -> Iterator[tuple[float, float, int]]:
    """``start, end, crossing`` of the widest stretches between edges that at most ``most`` intervals cross; the outer ones are left out."""
    edges = np.concatenate((low, high))
    step = np.repeat((1, -1), len(low))
    order = np.lexsort((step, edges))  # of equal edges an end comes first
    edges, active = edges[order], np.cumsum(step[order])
    free = np.flatnonzero(active[:-1] <= most)
    for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1) if len(free) else ():
        yield float(edges[run[0]]), float(edges[run[-1] + 1]), int(active[run].max())


class Page:
    """The boxes of one page's lines, y growing upwards."""

    def __init__(self, left: np.ndarray, right: np.ndarray, top: np.ndarray, bottom: np.ndarray, size: np.ndarray, width: float) -> None:
        self.left, self.right, self.top, self.bottom, self.size, self.width = left, right, top, bottom, size, width

    def gutter(self, some: np.ndarray) -> tuple[float, float, int]:
        """``score, middle, crossing`` of the best gutter of a region; score 0 if it has none."""
        best = (0.0, 0.0, 0)
        left, right = self.left[some], self.right[some]
        height = self.top[some].max() - self.bottom[some].min()
        least = LEAST_GUTTER * float(np.median(self.size[some]))
        for most in sorted({0, int(len(some) * MOST_CROSSING)}):
            for start, end, crossing in stretches(left, right, most):
                if end - start < least:
                    continue
                middle = (start + end) / 2
                over = (left < middle) & (right > middle)
                before, after = some[~over & (right <= middle)], some[~over & (left >= middle)]
                if not len(before) or not len(after):
                    continue
                wide = min(self.right[before].max() - self.left[before].min(), self.right[after].max() - self.left[after].min())
                beside = min(self.top[before].max(), self.top[after].max()) - max(self.bottom[before].min(), self.bottom[after].min())
                if wide < LEAST_COLUMN * self.width or beside <= 0:
                    continue
                if over.any() and self.stand_beside(some[over], some[~over]):
                    continue
                balance = min(len(before), len(after)) / max(len(before), len(after))
                score = (end - start) / self.width * (1 - crossing / len(some)) ** 4 * balance**0.5 * min(1.0, beside / max(height, 1e-9))
                best = max(best, (score, middle, int(over.sum())))
        return best if best[0] >= LEAST_SCORE else (0.0, 0.0, 0)

    def stand_beside(self, some: np.ndarray, others: np.ndarray) -> bool:
        """Whether any line of ``some`` has one of ``others`` at its height: it belongs to a band of other columns."""
        begun = np.searchsorted(np.sort(self.bottom[others]), self.top[some], side="left")
        ended = np.searchsorted(np.sort(self.top[others]), self.bottom[some], side="right")
        return bool((begun > ended).any())

    def bands(self, some: np.ndarray) -> list[np.ndarray]:
        """A region in bands from the top, parted by gaps that are wider than its usual ones."""
        gaps = [(start, end) for start, end, _ in stretches(self.bottom[some], self.top[some], 0)]
        if not gaps:
            return [some]
        usual = float(np.median([b - a for a, b in gaps]))
        cuts = sorted(((a + b) / 2 for a, b in gaps if b - a > BAND * usual), reverse=True)
        place = np.searchsorted(-np.array(cuts), -self.top[some])
        return [some[place == k] for k in range(len(cuts) + 1) if (place == k).any()]

    def regions(self) -> list[np.ndarray]:
        """The lines of each region, in reading order. Neighbouring regions without a gutter of their own are one."""
        out: list[tuple[bool, np.ndarray]] = []
        todo = [(np.arange(len(self.left)), False)]
        while todo:
            some, alone = todo.pop()
            score, middle, crossing = self.gutter(some) if len(some) > 1 else (0.0, 0.0, 0)
            if not score:
                bands = self.bands(some) if len(some) > 3 else [some]
                if len(bands) > 1 and any(len(b) > 1 and self.gutter(b)[0] for b in bands):
                    todo += [(b, alone) for b in reversed(bands)]
                else:
                    out.append((alone, some))
                continue
            over = (self.left[some] < middle) & (self.right[some] > middle)
            if not crossing:
                todo += [(some[self.left[some] >= middle], True), (some[self.right[some] <= middle], True)]
                continue
            # What crosses the gutter parts the columns above it from those below it.
            edge = np.sort(-self.top[some[over]])
            place = np.searchsorted(edge, -self.top[some], side="right")
            parts: list[tuple[np.ndarray, bool]] = []
            for k in range(len(edge) + 1):
                crossing_lines, rest = some[over & (place == k)], some[~over & (place == k)]
                parts += [(x, alone) for x in (crossing_lines, rest) if len(x)]
            todo += reversed(parts)
        joined: list[tuple[bool, np.ndarray]] = []
        for alone, some in out:
            if joined and not alone and not joined[-1][0]:
                joined[-1] = (False, np.concatenate((joined[-1][1], some)))
            else:
                joined.append((alone, some))
        return [some for _, some in joined]


def columns(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """``lines_`` with ``column``: regions of a page in reading order, from 0; within one, lines go from the top down.

    ``lines_(doc_id, page, left, right, top, bottom, font_size, ...)``, ``pages(doc_id, page, width)``.
    """
    rows = lines_.join(pages.select("doc_id", "page", F.col("width").alias("_width")), ["doc_id", "page"])
    rest = [c for c in lines_.columns if c not in ("doc_id", "page")]
    whole = rows.groupBy("doc_id", "page", "_width").agg(F.collect_list(F.struct(*rest)).alias("_lines"))
    of = lambda c: F.transform("_lines", lambda x: x[c].cast("double"))
    boxes = map(of, ("left", "right", "top", "bottom", "font_size"))
    whole = whole.select("doc_id", "page", "_lines", _numbers(*boxes, F.col("_width").cast("double")).alias("_columns"))
    each = whole.select("doc_id", "page", F.explode(F.zip_with("_lines", "_columns", lambda x, n: F.struct(x.alias("line"), n.alias("column")))).alias("_x"))
    return each.select("doc_id", "page", *[F.col(f"_x.line.{c}").alias(c) for c in rest], F.col("_x.column").alias("column"))


@F.pandas_udf(ArrayType(IntegerType()))
def _numbers(left: pd.Series, right: pd.Series, top: pd.Series, bottom: pd.Series, size: pd.Series, width: pd.Series) -> pd.Series:
    """The region of each line of each page."""
    out = []
    for one in zip(left, right, top, bottom, size, width):
        number = np.zeros(len(one[0]), dtype=np.int32)
        for k, some in enumerate(Page(*one).regions()):
            number[some] = k
        out.append(number)
    return pd.Series(out)
