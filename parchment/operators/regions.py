"""Areas and holes of masks on tables of pixels: their borders, lengths, contents, hulls and smallest rectangles.

Pixels are packed into rows of images before they move; runs of one image get their names together, in batches of rows sorted by image.

Ink is connected by sides and corners, what lies between by sides only. So one border, and no more, parts an area of ink from a
background that it touches: a border is named by the two, ``ink`` and ``paper``. Its length follows from the squares of two
by two pixels along it, what it encloses from running sums along rows, its hull from the ends of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsnum import bind
from ..sources.shared import checkpointed

KEYS = ("image_id",)
#: A run of pixels is named by its row and first column, both counted from -1.
ROW = 1 << 21
POINT = "struct<y:int,x:int>"


def packed_rows(pixels: DataFrame, on: Column, value: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, arrays x, on, p: the pixels from 0, 0 on, those of a batch that share a row of an image in one; so they move packed."""
    own = pixels.where("y >= 0 and x >= 0").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(on, F.lit(False)).alias("on"), value.cast("double").alias("p"))
    names = [*keys, "y", "x", "on", "p"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(names[:-3], use_threads=False).aggregate([(c, "list") for c in names[-3:]])
            yield from rows.select([*names[:-3], *[f"{c}_list" for c in names[-3:]]]).rename_columns(names).combine_chunks().to_batches()

    return own.mapInArrow(pack, f"{_kinds(own, *keys)}, y int, x array<int>, on array<boolean>, p array<double>")


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` nodes that each can reach over links a, b."""
    label = np.arange(n)
    while True:
        before, least = label.copy(), np.minimum(label[a], label[b])
        # A node and what it was named after both learn the smaller name; then names are followed to their ends.
        for ends in (label[a], label[b], a, b):
            np.minimum.at(label, ends, least)
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
        if (label == before).all():
            return label


def _named(y: np.ndarray, lengths: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each pixel of rows of whole images the name of the first run of its area or background; ``on`` holds the rows of ``lengths`` pixels, y -1 begins an image."""
    begins = np.cumsum(lengths) - lengths
    edge = np.ones(len(on), bool)
    edge[1:] = on[1:] != on[:-1]
    edge[begins] = True
    start = np.flatnonzero(edge)
    run = np.cumsum(edge) - 1
    row = np.repeat(np.arange(len(y)), lengths)[start]
    end = np.append(start[1:], len(on)) - 1
    # The runs of the row below that each run meets, by sides, or by corners too if it is ink.
    upper = np.flatnonzero(y[np.minimum(row + 1, len(y) - 1)] == y[row] + 1)
    down, reach = lengths[row[upper]], on[start[upper]].astype(int)
    low = begins[row[upper] + 1]
    first = run[np.maximum(start[upper] + down - reach, low)]
    last = run[np.minimum(end[upper] + down + reach, low + down - 1)]
    n = last - first + 1
    a = np.repeat(upper, n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    same = on[start[a]] == on[start[b]]
    label = _smallest_reachable(len(start), a[same], b[same])
    name = (y[row].astype(np.int64) + 1) * ROW + start - begins[row]
    return name[label][run]


def _framed(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """For each row of whole images and of their frames, from row and column -1 on: the image's first row in ``rows``, y, inner, width; and on and p of all pixels.

    Missing pixels are empty, of repeated ones the greatest values count.
    """
    begin = np.flatnonzero(rows["begins"].to_numpy())
    h, w = (rows[c].to_numpy()[begin].astype(np.int64) + 3 for c in ("h", "w"))
    base = np.cumsum(h * w) - h * w
    image = np.cumsum(rows["begins"].to_numpy()) - 1
    lists = [rows[c].combine_chunks() for c in ("x", "on", "p")]
    lists = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in lists]
    x, flags, values = (c.flatten() for c in lists)
    n = np.diff(lists[0].offsets.to_numpy())
    at = np.repeat(base[image] + (rows["y"].to_numpy() + 1) * w[image] + 1, n) + x.to_numpy()
    on = np.zeros((h * w).sum(), bool)
    on[at[flags.to_numpy(zero_copy_only=False)]] = True
    known = values.is_valid().to_numpy(zero_copy_only=False)
    p, seen = np.full(len(on), -np.inf), np.zeros(len(on), bool)
    np.maximum.at(p, at[known], values.drop_null().to_numpy())
    seen[at[known]] = True
    y = np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h) - 1
    return np.repeat(begin, h), y.astype(np.int32), (y >= 0) & (y < np.repeat(h, h) - 2), np.repeat(w, h), on, np.where(seen, p, 0.0)


def labelled(pixels: DataFrame, on: Column, value: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, inner and arrays on, p, label, sum of all rows of whole images and of a frame around them (not inner), from row and column -1 on.

    label names the first run of a pixel's area or background; sum is that of p along the row so far. Missing pixels are empty, of repeated ones the
    greatest values count. Packed rows come by image, and the images of a batch get their names together; none is split.
    """
    parts = packed_rows(pixels, on, value, keys).repartition(*keys)
    image = Window.partitionBy(*keys).orderBy("y")
    whole = image.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumns({"begins": F.row_number().over(image) == 1, "h": F.max("y").over(whole), "w": F.max(F.array_max("x")).over(whole)})

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting)
            first, y, inner, w, ink, p = _framed(rows)
            label = _named(y, w, ink)
            sums = np.concatenate([np.cumsum(row) for row in np.split(p, np.cumsum(w)[:-1])])
            places = pa.array(np.concatenate(([0], np.cumsum(w))), pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(c)) for c in (ink, p, label, sums)]
            own = rows.select(list(keys)).take(first)
            yield from pa.Table.from_arrays([*own.columns, pa.array(y), pa.array(inner), *lists], [*keys, "y", "inner", "on", "p", "label", "sum"]).combine_chunks().to_batches()

        for batch in batches:
            first = np.flatnonzero(batch.column("begins").to_numpy(zero_copy_only=False))
            if first.size:
                # What is before the last image of the batch is whole.
                waiting.append(batch.slice(0, first[-1]))
                if sum(w.num_rows for w in waiting):
                    yield from done()
                waiting = []
                batch = batch.slice(first[-1])
            waiting.append(batch)
        if sum(w.num_rows for w in waiting):
            yield from done()

    return parts.mapInArrow(name, f"{_kinds(parts, *keys)}, y int, inner boolean, on array<boolean>, p array<double>, label array<long>, sum array<double>")


def areas(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, label, on, size, mean, top, left, bottom, right of the areas and backgrounds in ``labelled`` rows, the outer background without its frame."""
    cells = lines.where("inner").select(*keys, "y", (F.size("p") - 1).alias("_w"), F.posexplode(F.arrays_zip("on", "p", "label")).alias("_x", "c")).where("_x > 0 and _x < _w")
    inner = cells.select(*keys, "y", (F.col("_x") - 1).alias("x"), "c.*")
    return inner.groupBy(*keys, "label", "on").agg(F.count("*").alias("size"), F.avg("p").alias("mean"), F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"))


def borders(lines: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each border of ``labelled`` rows: keys, ink, paper, border_no, outer, length, score, rows.

    border_no follows the first pixel with its paper on the left; outer tells areas' borders from those of holes. length is that of the closed line
    over the centres of the border's pixels, score the mean value on and within it, rows an array of struct(y, left, right) by y.
    """
    below = Window.partitionBy(*keys).orderBy("y")
    every = ["on", "label", "p", "sum"]
    pairs = lines.repartition(*keys).withColumns({f"_{c}": F.lead(c).over(below) for c in every[:3]}).where("_on is not null")
    at = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("on") - 2)))
    own = {"on": F.get("on", "i"), "r_on": F.get("on", F.col("i") + 1), "b_on": F.get("_on", "i"), "br_on": F.get("_on", F.col("i") + 1)}
    # Squares of one kind have no border.
    mixed = at.where(~((own["on"] == own["r_on"]) & (own["on"] == own["b_on"]) & (own["on"] == own["br_on"])))
    own |= {"label": F.get("label", "i"), "r_label": F.get("label", F.col("i") + 1), "b_label": F.get("_label", "i"), "br_label": F.get("_label", F.col("i") + 1)}
    own |= {"p": F.get("p", "i"), "r_p": F.get("p", F.col("i") + 1), "b_p": F.get("_p", "i"), "sum": F.get("sum", "i")}
    square = mixed.select(*keys, "y", (F.col("i") - 1).alias("x"), *[c.alias(k) for k, c in own.items()])
    y, x, total = F.col("y"), F.col("x"), F.col("sum")
    here, right, under, both = [{c: F.col(k + c) for c in every[:2]} for k in ("", "r_", "b_", "br_")]

    def named(ink: dict[str, Column], paper: dict[str, Column], **more: Column) -> Column:
        parts = {"long_steps": F.lit(0), "steps": F.lit(0), "inside": F.lit(0.0), "n_inside": F.lit(0).cast("long"), "y": F.lit(None).cast("int"), "x": F.lit(None).cast("int"), "p": F.lit(0.0), "left": F.lit(False)} | more
        return F.struct(ink["label"].alias("ink"), paper["label"].alias("paper"), *[c.alias(k) for k, c in parts.items()])

    # Sides between a pixel and its right or lower neighbour, with what lies to the left of those between columns.
    cracks = [
        F.when(here["on"] & ~right["on"], named(here, right, inside=total, n_inside=(x + 1).cast("long"), y=y, x=x, p=F.col("p"))),
        F.when(~here["on"] & right["on"], named(right, here, inside=-total, n_inside=-(x + 1).cast("long"), y=y, x=x + 1, p=F.col("r_p"), left=F.lit(True))),
        F.when(here["on"] & ~under["on"], named(here, under, y=y, x=x, p=F.col("p"))),
        F.when(~here["on"] & under["on"], named(under, here, y=y + 1, x=x, p=F.col("b_p"))),
    ]
    # Squares: two beside each other are a step along, three or two across a step over the corner.
    corners = [here, right, under, both]
    n = sum((c["on"].cast("int") for c in corners[1:]), corners[0]["on"].cast("int"))
    ink = {"label": F.coalesce(*[F.when(c["on"], c["label"]) for c in corners])}
    paper = {"label": F.coalesce(*[F.when(~c["on"], c["label"]) for c in corners])}
    across = (n == 2) & (here["on"] == both["on"])
    other = {"label": F.when(here["on"], under["label"]).otherwise(both["label"])}
    first = {"label": F.when(here["on"], right["label"]).otherwise(here["label"])}
    bends = [
        F.when((n == 2) & ~across, named(ink, paper, steps=F.lit(1))),
        F.when(n == 3, named(ink, paper, long_steps=F.lit(1))),
        F.when(across, named(ink, first, long_steps=F.lit(1))),
        F.when(across, named(ink, other, long_steps=F.lit(1))),
    ]
    parts = square.select(*keys, F.explode(F.array(*cracks, *bends)).alias("s")).where("s is not null").select(*keys, "s.*")
    # A pixel with its paper on several sides counts once on the border.
    pixels = parts.groupBy(*keys, "ink", "paper", "y", "x").agg(F.sum("steps").alias("steps"), F.sum("long_steps").alias("long_steps"), F.sum("inside").alias("inside"), F.sum("n_inside").alias("n_inside"), F.max("p").alias("p"), F.max("left").alias("left"))
    rows = pixels.groupBy(*keys, "ink", "paper", "y").agg(F.sum("steps").alias("steps"), F.sum("long_steps").alias("long_steps"), F.sum("inside").alias("inside"), F.sum("n_inside").alias("n_inside"), F.sum("p").alias("p"), F.count("x").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(F.when(F.col("left"), F.col("x"))).alias("first"))
    ends = F.sort_array(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("y", F.col("x0").alias("left"), F.col("x1").alias("right")))))
    found = rows.groupBy(*keys, "ink", "paper").agg(F.sum("steps").alias("steps"), F.sum("long_steps").alias("long_steps"), F.sum("inside").alias("inside"), F.sum("n_inside").alias("n_inside"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.min(F.when(F.col("first").isNotNull(), F.struct("y", "first"))).alias("start"), ends.alias("rows"))
    outer = F.col("n_inside") > 0
    score = F.when(outer, F.col("inside") / F.col("n_inside")).otherwise((F.col("p") - F.col("inside")) / (F.col("n") - F.col("n_inside")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return found.select(*keys, "ink", "paper", number.alias("border_no"), outer.alias("outer"), (F.col("steps") + F.col("long_steps") * math.sqrt(2)).alias("length"), score.alias("score"), "rows")


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def hull(rows: Column) -> Column:
    """The convex hull, as an array of struct(y, x) in order, of rows' ends by y: two folds, each of which takes back what a new point makes hollow."""

    def chain(points: Column, side: int) -> Column:
        def add(line: Column, p: Column) -> Column:
            # What has to go is at the end: the line so far bends one way only.
            stays = F.filter(F.sequence(F.lit(1), F.size(line) - 1), lambda k: side * _turn(F.get(line, k - 1), F.get(line, k), p) > 0)
            kept = F.when(F.size(line) < 2, F.size(line)).otherwise(F.size(stays) + 1)
            return F.concat(F.slice(line, 1, kept), F.array(p))

        return F.aggregate(points, F.array().cast(f"array<{POINT}>"), add)

    ends = lambda c: F.transform(rows, lambda r: F.struct(r["y"].alias("y"), r[c].alias("x")))
    # Down along the right ends, and back up along the left ones.
    return F.array_distinct(F.concat(chain(ends("right"), 1), F.reverse(chain(ends("left"), -1))))


def smallest_rect(hull_points: Column) -> Column:
    """struct(area, angle, rw, rh, cx, cy): the smallest rectangle around a hull, one side of it along an edge; of equal ones that with the least angle.

    Areas are compared to nine, angles in degrees from 0 to 90 to nine decimals. A single point has no sides.
    """

    def around(points: Column) -> Column:
        def along(edge: Column) -> Column:
            def measured(d: Column) -> Column:
                a = F.transform(points, lambda p: p["x"] * d["x"] + p["y"] * d["y"])
                b = F.transform(points, lambda p: p["y"] * d["x"] - p["x"] * d["y"])
                ends = F.struct(F.array_min(a).alias("a0"), F.array_max(a).alias("a1"), F.array_min(b).alias("b0"), F.array_max(b).alias("b1"))

                def rect(e: Column) -> Column:
                    w, h = e["a1"] - e["a0"], e["b1"] - e["b0"]
                    u, v = (e["a1"] + e["a0"]) / 2, (e["b1"] + e["b0"]) / 2
                    parts = {"area": F.round(w * h, 9), "angle": F.round(F.degrees(F.atan2(d["y"], d["x"])), 9), "rw": w, "rh": h, "cx": u * d["x"] - v * d["y"], "cy": u * d["y"] + v * d["x"]}
                    return F.struct(*[c.cast("double").alias(k) for k, c in parts.items()])

                return bind(ends, rect)

            return bind(edge, measured)

        def direction(i: Column) -> Column:
            a, b = F.get(points, i), F.get(points, (i + 1) % F.size(points))
            dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")
            # The same rectangle has four directions; that from 0 to 90 degrees counts.
            x = F.when((dx > 0) & (dy >= 0), dx).when((dx <= 0) & (dy > 0), dy).when((dx < 0) & (dy <= 0), -dx).otherwise(-dy)
            y = F.when((dx > 0) & (dy >= 0), dy).when((dx <= 0) & (dy > 0), -dx).when((dx < 0) & (dy <= 0), -dy).otherwise(dx)
            n = F.sqrt(x * x + y * y)
            return F.struct((x / n).alias("x"), (y / n).alias("y"))

        level = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
        edges = F.when(F.size(points) < 2, F.array(level)).otherwise(F.transform(F.sequence(F.lit(0), F.size(points) - 1), direction))
        return F.array_min(F.transform(edges, along))

    return bind(hull_points, around)


def text_regions(maps: DataFrame, value_col: str = "p", threshold: float = 0.3, least_length: float = 12.0, least_score: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, contour and the rotated rectangle (cx, cy, rw, rh, angle), score and outer of each border in a table of probabilities (keys, y, x and a value).

    Values over ``threshold`` are ink. Borders shorter than ``least_length`` or with a mean value under ``least_score`` are left out; contour
    numbers all of an image's borders. Missing pixels and null values are empty, of repeated rows of a pixel the greatest counts; an
    empty table has no rows. Other columns are not looked at.
    """
    v = F.col(value_col)
    found = borders(labelled(maps, v > threshold, v, keys), keys).where((F.col("length") >= least_length) & (F.col("score") >= least_score))
    # Written out, as filters on what comes of a rectangle would be pushed below it, with the rectangle in them again and again.
    return checkpointed(found.withColumn("_r", smallest_rect(hull(F.col("rows"))))).select(*keys, F.col("border_no").alias("contour"), "_r.cx", "_r.cy", "_r.rw", "_r.rh", "_r.angle", "score", "outer")
