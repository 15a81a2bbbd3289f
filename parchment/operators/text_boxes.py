"""From a text detector's probability map to ordered boxes on the page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.jsnum import round_half_up
from .corners import DEVIATION, MEAN
from .page_images import as_array, resized

LONG_SIDE, STEP = 2240, 32
BINARY, LEAST_PERIMETER, LEAST_SCORE, UNCLIP = 0.3, 12.0, 0.5, 1.8
RECT = "contour int, cx double, cy double, rw double, rh double, angle double, score double"
#: The eight neighbours in clockwise order, from the left.
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def detector_size(w: Column, h: Column) -> Column:
    """The detector's input: the longer side brought to 2240, both sides to multiples of 32."""
    factor = F.lit(float(LONG_SIDE)) / F.greatest(w, h)
    return g.size(*[round_half_up(v * factor / STEP) * STEP for v in (w, h)])


def detector_tensor(image, w: int, h: int) -> np.ndarray:
    """[1, 3, h, w], normalised by channel; one gray channel counts for all three."""
    small = resized(as_array(image), w, h).astype(np.float64)
    rgb = np.repeat(small, 3, axis=2) if small.shape[2] == 1 else small[..., :3]
    scaled = rgb / (255.0 * np.array(DEVIATION)) - np.array(MEAN) / np.array(DEVIATION)
    return scaled.transpose(2, 0, 1).astype(np.float32)[None]


def _trace(mask: np.ndarray, start: tuple[int, int], backtrack: int, left: set, right: set) -> list[tuple[int, int]]:
    """The border from ``start`` on, clockwise, neighbours first tried after direction ``backtrack``.

    Pixels whose left or right neighbour was tried and is empty are added to ``left`` or ``right``: that side belongs to this border.
    """
    border, here, came, first = [start], start, backtrack, None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            y, x = here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]:
                break
            if d == 0:
                left.add(here)
            elif d == 4:
                right.add(here)
        else:
            return border
        if first is None:
            first = (y, x)
        elif here == start and (y, x) == first:
            return border[:-1]
        here, came = (y, x), (d + 4) % 8
        border.append(here)


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of all areas, and borders around their holes, each as points (x, y).

    A pixel may lie on several borders, as on both sides of a line of one pixel's width; each of its empty sides lies on one.
    """
    found, left, right = [], set(), set()
    padded = np.pad(mask, 1)[1:-1]
    for empty, side, direction in ((~padded[:, :-2], left, 0), (~padded[:, 2:], right, 4)):
        for y, x in np.argwhere(mask & empty).tolist():
            if (y, x) not in side:
                line = _trace(mask, (y, x), direction, left, right)
                side.add((y, x))
                found.append(line)
    return [np.array([(x, y) for y, x in line], float) for line in found]


def _hull(points: np.ndarray) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def smallest_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, w, h, degrees of the smallest rectangle around points; one of its sides lies on their hull."""
    hull = _hull(points)
    edges = np.roll(hull, -1, axis=0) - hull
    edges = edges[np.hypot(*edges.T) > 0] if len(hull) > 1 else np.array([[1.0, 0.0]])
    best = None
    for ex, ey in edges:
        n = np.hypot(ex, ey)
        axis, up = np.array([ex, ey]) / n, np.array([-ey, ex]) / n
        a, b = hull @ axis, hull @ up
        w, h = np.ptp(a), np.ptp(b)
        if best is None or w * h < best[0] - 1e-9:
            centre = axis * (a.max() + a.min()) / 2 + up * (b.max() + b.min()) / 2
            best = (w * h, centre[0], centre[1], w, h, float(np.degrees(np.arctan2(ey, ex))))
    return best[1:]


def _inside_score(p: np.ndarray, line: np.ndarray) -> float:
    """Mean probability on and within a closed border."""
    x0, y0 = line.min(axis=0).astype(int)
    x1, y1 = line.max(axis=0).astype(int)
    x, y = np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1))
    hit = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(line, np.roll(line, -1, axis=0), strict=True):
        if ay != by:
            hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    hit[(line[:, 1] - y0).astype(int), (line[:, 0] - x0).astype(int)] = True
    return float(p[y0 : y1 + 1, x0 : x1 + 1][hit].mean())


def text_rects(maps: DataFrame, id_col: str = "image_id", map_col: str = "p", w_col: str = "map_w", h_col: str = "map_h") -> DataFrame:
    """id, contour and the rotated rectangle and score of each border in a probability map (rows in order, as an array).

    Borders under 12 pixels long or with a mean probability under one half are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, values, w, h in pdf.itertuples(index=False):
                p = np.asarray(values, np.float32).reshape(int(h), int(w))
                for i, line in enumerate(contours(p > BINARY)):
                    if np.hypot(*(np.roll(line, -1, axis=0) - line).T).sum() >= LEAST_PERIMETER and (score := _inside_score(p, line)) >= LEAST_SCORE:
                        rows.append((key, i, *smallest_rect(line), score))
            yield pd.DataFrame(rows, columns=[id_col, "contour", "cx", "cy", "rw", "rh", "angle", "score"])

    kind = maps.schema[id_col].dataType.simpleString()
    return maps.select(id_col, map_col, w_col, h_col).where(F.col(map_col).isNotNull()).mapInPandas(run, f"`{id_col}` {kind}, {RECT}")


def boxes_on_page(rects: DataFrame, map_w: str = "map_w", map_h: str = "map_h", page_w: str = "page_w", page_h: str = "page_h") -> DataFrame:
    """All columns plus box: the rectangle grown, ordered, and in the page's pixels; boxes under 4 pixels go."""
    w, h = g.unclipped(F.col("rw"), F.col("rh"), UNCLIP)
    corners = g.sort_corners(g.rotated_rect(F.col("cx"), F.col("cy"), w, h, F.col("angle")))
    placed = rects.withColumn("_corners", corners)
    box = g.box_to_original(F.col("_corners"), F.col(page_w) / F.col(map_w), F.col(page_h) / F.col(map_h), F.col(page_w), F.col(page_h))
    return placed.withColumn("box", box).drop("_corners").where("box is not null")


def in_reading_order(boxes: DataFrame, id_col: str = "image_id", tie: str = "contour") -> DataFrame:
    """Adds line_no: from the top by mean y alone, to nine decimals, ties by ``tie``. A page's boxes are one window."""
    from pyspark.sql import Window

    # Unrounded, boxes on one height would stand as the errors of their sums have it.
    order = Window.partitionBy(id_col).orderBy(F.round(g.mean_y(F.col("box")), 9), tie)
    return boxes.withColumn("line_no", F.row_number().over(order) - 1)
