"""Corners, boxes and sizes as Catalyst expressions. A quad is an array of four struct(x double, y double)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsnum import bind, clamp, round_half_up

POINT = "struct<x:double,y:double>"
A4_RATIO = 1.4142
ZOOM = (1.0, 5.0)
DOUBLE_TAP_ZOOM, DOUBLE_TAP_MS = 2.5, 300


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def at(q: Column, i: int) -> Column:
    """A point of a quad; null beyond its end."""
    return F.get(q, F.lit(i))


def quad(*points: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def box_to_quad(box: Column) -> Column:
    """An array of [x, y] pairs as points."""
    return F.transform(box, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def _by(field: str):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def sort_corners(q: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left; any other number of points as it is. Ties keep their order."""
    def corners(by_x: Column) -> Column:
        halves = F.array(*[F.array_sort(F.slice(by_x, k, 2), _by("y")) for k in (1, 3)])
        return bind(halves, lambda h: F.array(*[at(at(h, side), i) for side, i in ((0, 0), (1, 0), (1, 1), (0, 1))]))

    return bind(q, lambda p: F.when(F.size(p) == 4, bind(F.array_sort(p, _by("x")), corners)).otherwise(p))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def quad_area(q: Column) -> Column:
    """Shoelace area."""
    total = F.lit(0.0)
    for i in range(4):
        a, b = at(q, i), at(q, (i + 1) % 4)
        total = total + (a["x"] * b["y"] - a["y"] * b["x"])
    return 0.5 * F.abs(total)


def is_valid_shape(q: Column, most_cos: float, most_ratio: float = 1.3) -> Column:
    """Whether no inner angle's cosine exceeds ``most_cos`` and no pair of opposite edges differs by more than ``most_ratio``.

    Coinciding corners, and any number of points but four, are no valid shape.
    """
    edge = [distance(at(q, i), at(q, (i + 1) % 4)) for i in range(4)]
    good = F.lit(True)
    for i in range(4):
        before, here, after = at(q, (i + 3) % 4), at(q, i), at(q, (i + 1) % 4)
        dot = (before["x"] - here["x"]) * (after["x"] - here["x"]) + (before["y"] - here["y"]) * (after["y"] - here["y"])
        good = good & (F.abs(F.try_divide(dot, edge[(i + 3) % 4] * edge[i])) <= most_cos)
    for a, b in ((edge[0], edge[2]), (edge[3], edge[1])):
        good = good & (F.try_divide(F.greatest(a, b), F.least(a, b)) <= most_ratio)
    return F.when(F.size(q) == 4, F.coalesce(good, F.lit(False))).otherwise(False)


def default_corners(w: Column, h: Column) -> Column:
    """A centred rectangle of A4 shape: three quarters of the shorter side, at most four fifths of the longer one."""
    w, h = w.cast("double"), h.cast("double")
    tall = h > w
    tall_h = F.least(w * 0.75 * A4_RATIO, h * 0.8)
    wide_w = F.least(h * 0.75 * A4_RATIO, w * 0.8)
    # A side that isn't capped is taken as it is, and not by way of the other one.
    rect_w = F.when(tall, F.when(w * 0.75 * A4_RATIO > h * 0.8, tall_h / A4_RATIO).otherwise(w * 0.75)).otherwise(wide_w)
    rect_h = F.when(tall, tall_h).otherwise(F.when(h * 0.75 * A4_RATIO > w * 0.8, wide_w / A4_RATIO).otherwise(h * 0.75))
    x0, y0 = (w - rect_w) / 2, (h - rect_h) / 2
    return quad((x0, y0), (x0 + rect_w, y0), (x0 + rect_w, y0 + rect_h), (x0, y0 + rect_h))


def to_pixels(q: Column, w: Column, h: Column) -> Column:
    """From 0..1 to pixels, kept within the image."""
    return F.transform(q, lambda p: point(clamp(p["x"] * w, 0, w.cast("double")), clamp(p["y"] * h, 0, h.cast("double"))))


def clamp_corners(q: Column, w: Column, h: Column) -> Column:
    """Points kept within the image, in order; null unless there are four and the image has pixels."""
    inside = F.transform(q, lambda p: point(clamp(p["x"], 0, w.cast("double")), clamp(p["y"], 0, h.cast("double"))))
    return F.when((F.size(q) == 4) & (w > 0) & (h > 0), sort_corners(inside))


def edge_sizes(q: Column) -> tuple[Column, Column]:
    """The longer of the two horizontal, and of the two vertical edges; not rounded."""
    a, b, c, d = (at(q, i) for i in range(4))
    return F.greatest(distance(a, b), distance(d, c)), F.greatest(distance(a, d), distance(b, c))


def size(w: Column, h: Column) -> Column:
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def page_size(q: Column) -> Column:
    """Whole pixels of the rectified page, 1 at least."""
    return size(*[F.greatest(F.lit(1.0), round_half_up(e)) for e in edge_sizes(q)])


def fit_within(w: Column, h: Column, most: int) -> Column:
    """The size with the longer side reduced to ``most``; never enlarged."""
    over, wide = (w > most) | (h > most), w > h
    new_w = F.when(over, F.when(wide, F.lit(float(most))).otherwise(round_half_up(w * most / h))).otherwise(w)
    new_h = F.when(over, F.when(wide, round_half_up(h * most / w)).otherwise(F.lit(float(most)))).otherwise(h)
    return size(new_w, new_h)


def scaled_size(w: Column, h: Column, most: int) -> Column:
    """Like fit_within, but by one factor for both sides."""
    factor = F.lit(float(most)) / F.greatest(w, h)
    over = F.greatest(w, h) > most
    return size(F.when(over, round_half_up(w * factor)).otherwise(w), F.when(over, round_half_up(h * factor)).otherwise(h))


def document_roi(q: Column, w: Column, h: Column, most: int = 300) -> Column:
    """struct(sx, sy, sw, sh, dw, dh): what to cut out within the corners, and the size to reduce it to.

    The box around the corners within the image, 8 % smaller on each side; null if it is under 16 pixels wide or high.
    """
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    x0, x1 = F.greatest(F.lit(0.0), F.array_min(xs)), F.least(w.cast("double"), F.array_max(xs))
    y0, y1 = F.greatest(F.lit(0.0), F.array_min(ys)), F.least(h.cast("double"), F.array_max(ys))
    bw, bh = x1 - x0, y1 - y0
    sw = F.greatest(F.lit(8), F.floor(bw - bw * 0.08 * 2)).cast("int")
    sh = F.greatest(F.lit(8), F.floor(bh - bh * 0.08 * 2)).cast("int")
    to = fit_within(sw, sh, most)
    rect = F.struct(F.floor(x0 + bw * 0.08).cast("int").alias("sx"), F.floor(y0 + bh * 0.08).cast("int").alias("sy"), sw.alias("sw"), sh.alias("sh"), to["width"].alias("dw"), to["height"].alias("dh"))
    return F.when((F.size(q) == 4) & (bw >= 16) & (bh >= 16), rect)


def whole_frame_roi(w: Column, h: Column, most: int = 320) -> Column:
    """The whole frame in the form of document_roi."""
    factor = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    small = lambda v: F.greatest(F.lit(1.0), round_half_up(v * factor)).cast("int")
    return F.struct(F.lit(0).alias("sx"), F.lit(0).alias("sy"), w.cast("int").alias("sw"), h.cast("int").alias("sh"), small(w).alias("dw"), small(h).alias("dh"))


def to_display(p: Column, image_w: Column, image_h: Column, shown_w: Column, shown_h: Column) -> Column:
    none = (image_w == 0) | (shown_w == 0)
    return F.when(none, point(F.lit(0.0), F.lit(0.0))).otherwise(point(F.try_divide(p["x"], image_w) * shown_w, F.try_divide(p["y"], image_h) * shown_h))


def to_image(p: Column, image_w: Column, image_h: Column, shown_w: Column, shown_h: Column) -> Column:
    x, y = F.try_divide(p["x"], shown_w) * image_w, F.try_divide(p["y"], shown_h) * image_h
    return F.when(shown_w == 0, point(F.lit(0.0), F.lit(0.0))).otherwise(point(clamp(x, 0, image_w.cast("double")), clamp(y, 0, image_h.cast("double"))))


def move_corner(q: Column, index: Column, to: Column, image_w: Column, image_h: Column, shown_w: Column, shown_h: Column) -> Column:
    """Corner ``index`` put where ``to`` lies on the display, kept within it; the order of the corners stays."""
    bounded = point(clamp(to["x"], 0, shown_w.cast("double")), clamp(to["y"], 0, shown_h.cast("double")))
    new = to_image(bounded, image_w, image_h, shown_w, shown_h)
    return F.transform(q, lambda p, i: F.when(i == index, new).otherwise(p))


def scale_quad(q: Column, fx: Column, fy: Column) -> Column:
    return F.transform(q, lambda p: point(p["x"] * fx, p["y"] * fy))


def rotated_rect(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The corners of a rectangle turned about its centre."""
    turn = degrees * math.pi / 180.0
    cos, sin = F.cos(turn), F.sin(turn)
    return quad(*[((sx * w / 2) * cos - (sy * h / 2) * sin + cx, (sx * w / 2) * sin + (sy * h / 2) * cos + cy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def unclipped(w: Column, h: Column, ratio: float = 1.8) -> tuple[Column, Column]:
    """Sides grown by twice area * ratio / perimeter."""
    grow = F.coalesce(F.try_divide(w * h * ratio, 2 * (w + h)), F.lit(0.0))
    return w + 2 * grow, h + 2 * grow


def box_to_original(q: Column, fx: Column, fy: Column, w: Column, h: Column, least: float = 4.0) -> Column:
    """A text box in the pixels of the page, kept within it; null if its top or left edge is shorter than ``least``."""
    moved = F.transform(q, lambda p: point(F.least(F.greatest(F.lit(0.0), p["x"] * fx), w.cast("double")), F.least(F.greatest(F.lit(0.0), p["y"] * fy), h.cast("double"))))
    return bind(moved, lambda m: F.when((distance(at(m, 1), at(m, 0)) >= least) & (distance(at(m, 3), at(m, 0)) >= least), m))


def mean_y(q: Column) -> Column:
    return (at(q, 0)["y"] + at(q, 1)["y"] + at(q, 2)["y"] + at(q, 3)["y"]) / 4


def contained_size(natural_w: Column, natural_h: Column, box_w: Column, box_h: Column, zoom: Column) -> Column:
    """struct(width, height) of an image shown as large as the box allows, times ``zoom``."""
    ratio, box = natural_w / natural_h, box_w / box_h
    return F.struct((F.when(ratio > box, box_w).otherwise(box_h * ratio) * zoom).alias("width"), (F.when(ratio > box, box_w / ratio).otherwise(box_h) * zoom).alias("height"))


def bounded_pan(p: Column, shown: Column, box_w: Column, box_h: Column) -> Column:
    """A shift by which an image that is larger than its box still covers it."""
    mx = F.greatest(F.lit(0.0), (shown["width"] - box_w) / 2)
    my = F.greatest(F.lit(0.0), (shown["height"] - box_h) / 2)
    inside = point(F.greatest(-mx, F.least(mx, p["x"])), F.greatest(-my, F.least(my, p["y"])))
    return F.when((shown["width"] == 0) | (shown["height"] == 0), p).otherwise(inside)


def zoom_level(zoom: Column) -> Column:
    return clamp(zoom, *ZOOM)


def square_to_quad(q: Column) -> Column:
    """struct(a, b, c, d, e, f, g, h): (u, v) of the unit square to ((a u + b v + c) / s, (d u + e v + f) / s) with s = g u + h v + 1.

    (0, 0), (1, 0), (1, 1), (0, 1) go to the quad's points in their order. Null unless there are four points, no three of them in a line.
    """

    def solved(p: Column) -> Column:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((at(p, i)["x"], at(p, i)["y"]) for i in range(4))
        sides = F.struct((x1 - x2).alias("ax"), (y1 - y2).alias("ay"), (x3 - x2).alias("bx"), (y3 - y2).alias("by"), (x0 - x1 + x2 - x3).alias("sx"), (y0 - y1 + y2 - y3).alias("sy"))

        def rest(s: Column) -> Column:
            area = s["ax"] * s["by"] - s["bx"] * s["ay"]
            g, h = F.try_divide(s["sx"] * s["by"] - s["bx"] * s["sy"], area), F.try_divide(s["ax"] * s["sy"] - s["sx"] * s["ay"], area)

            def whole(k: Column) -> Column:
                g, h = k["g"], k["h"]
                names = {"a": x1 - x0 + g * x1, "b": x3 - x0 + h * x3, "c": x0, "d": y1 - y0 + g * y1, "e": y3 - y0 + h * y3, "f": y0, "g": g, "h": h}
                m = F.struct(*[v.alias(n) for n, v in names.items()])
                # Three points in a line leave no way back.
                flat = [(at(p, i)["x"] - at(p, (i + 1) % 4)["x"]) * (at(p, (i + 2) % 4)["y"] - at(p, (i + 1) % 4)["y"]) == (at(p, (i + 2) % 4)["x"] - at(p, (i + 1) % 4)["x"]) * (at(p, i)["y"] - at(p, (i + 1) % 4)["y"]) for i in range(4)]
                return F.when(g.isNotNull() & h.isNotNull() & ~(flat[0] | flat[1] | flat[2] | flat[3]), m)

            return bind(F.struct(g.alias("g"), h.alias("h")), whole)

        return bind(sides, rest)

    return bind(q, lambda p: F.when(F.size(p) == 4, solved(p)))


def _row(m: Column, i: int) -> list[Column]:
    return [F.lit(1.0) if i == 2 and j == 2 else m["abcdefgh"[3 * i + j]] for j in range(3)]


def perspective(from_: Column, to: Column) -> Column:
    """The matrix, in the form of square_to_quad, that takes four points to four others; null where either four have three in a line."""

    def combined(both: Column) -> Column:
        m = [_row(both["from"], i) for i in range(3)]
        # The adjugate goes back to the unit square, up to a factor.
        back = [[m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
        t = [_row(both["to"], i) for i in range(3)]
        whole = F.array(*[t[i][0] * back[0][j] + t[i][1] * back[1][j] + t[i][2] * back[2][j] for i in range(3) for j in range(3)])
        return bind(whole, lambda w: F.struct(*[F.try_divide(F.get(w, F.lit(k)), F.get(w, F.lit(8))).alias(n) for k, n in enumerate("abcdefgh")]))

    pair = F.struct(square_to_quad(from_).alias("from"), square_to_quad(to).alias("to"))
    return bind(pair, lambda b: F.when(b["from"].isNotNull() & b["to"].isNotNull(), combined(b)))


def project(m: Column, x: Column, y: Column) -> Column:
    """Where a matrix takes a point; null on its horizon."""
    s = m["g"] * x + m["h"] * y + 1.0
    return point(F.try_divide(m["a"] * x + m["b"] * y + m["c"], s), F.try_divide(m["d"] * x + m["e"] * y + m["f"], s))
