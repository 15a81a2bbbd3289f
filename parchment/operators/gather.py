"""Images drawn anew from tables of pixels: rectified, resized, text lines cut out, ranked neighbourhoods.

A table of pixels has the key columns, y, x and values 0..255. Its pixels are put together in square tiles, each with a margin
of its neighbours' pixels. A pixel of the new image knows its place in the old one, and so the one tile that holds all it is
made of. What moves is the tiles, as arrays, and for each block of a new image the tiles that it needs, whatever the size of an
image; new pixels come into being where block and tile have met. Places, tiles and new pixels are NumPy in Arrow batches, so many
pixels at once (AT_ONCE); what is grouped and joined is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.jsnum import round_half_up
from . import pixels as px
from .regions import _kinds

TILE = 32
#: The side of the blocks of a new image, each of which asks for the tiles that it needs.
BLOCK = 64
#: How many pixels are in memory as arrays at once; a tile or a block has fewer.
AT_ONCE = 1 << 17
#: How many pixels before and after its own place a pixel is made of.
LINEAR, CUBIC = (0, 1), (1, 2)
KEYS = ("image_id",)
#: The values of an image by name, for each of its pixels.
Numbers = Callable[[str], np.ndarray]
#: Numbers, y and x of new pixels to their x and y in the old image, not a number where they have none.
Place = Callable[[Numbers, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _at_least_one(c: Column) -> Column:
    return F.greatest(F.lit(1), c.cast("int"))


def _runs(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` things at most, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _spread(low_y: np.ndarray, high_y: np.ndarray, low_x: np.ndarray, high_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of its rectangle, y and x of each pixel of rectangles, row by row."""
    across = high_x - low_x + 1
    n = (high_y - low_y + 1) * across
    row = np.repeat(np.arange(len(n)), n)
    down, right = np.divmod(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), across[row])
    return row, low_y[row] + down, low_x[row] + right


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tiles(pixels: DataFrame, values: Sequence[str], before: int, after: int, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """keys, _ty, _tx, _top, _left, _columns and ``_<value>`` arrays, row by row, of each tile with its margin.

    Repeated rows of a pixel count once. A tile with two different rows for a pixel, a pixel missing or null has null arrays.
    """
    own = pixels.where("y >= 0 and x >= 0").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("short").alias(v) for v in values])
    names, lists = [*keys, "_ty", "_tx"], ["_place", *[f"_{v}" for v in values]]
    side = tile + before + after
    kinds, arrays = _kinds(own, *keys), ", ".join(f"`_{v}` array<short>" for v in values)

    def reached(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, last = np.maximum(0, (c - after) // tile), (c + before) // tile
        for k in range((last - first).max() + 1):
            yield first + k, first + k <= last

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pixels of a batch that share a tile in one row, so that they move together."""
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = _ints(batch, "y"), _ints(batch, "x")
            dealt = [(at := np.flatnonzero(a & b), ty[at], tx[at]) for ty, a in reached(y) for tx, b in reached(x)]
            at, ty, tx = (np.concatenate(c) for c in zip(*dealt, strict=True))
            place = (y[at] - ty * tile + before) * side + x[at] - tx * tile + before
            moved = [batch.column(c).take(pa.array(at)) for c in [*keys, *values]]
            rows = pa.Table.from_arrays([*moved[: len(keys)], pa.array(ty, pa.int32()), pa.array(tx, pa.int32()), pa.array(place, pa.int32()), *moved[len(keys) :]], [*names, *lists])
            rows = rows.group_by(names, use_threads=False).aggregate([(c, "list") for c in lists])
            yield from rows.select([*names, *[f"{c}_list" for c in lists]]).rename_columns([*names, *lists]).combine_chunks().to_batches()

    def put_together(part: pa.RecordBatch) -> pa.RecordBatch:
        n = pc.list_value_length(part.column("_place")).to_numpy().astype(np.int64)
        code = np.repeat(np.arange(len(n)) * side * side, n) + part.column("_place").flatten().to_numpy()
        order = np.argsort(code)
        code = code[order]
        first = np.append(True, code[1:] != code[:-1])
        of, place = np.divmod(code, side * side)
        raw, there = {}, {}
        clash = np.zeros(len(n), bool)
        for c in lists[1:]:
            flat = part.column(c).flatten()
            raw[c], there[c] = (a.to_numpy(zero_copy_only=False)[order] for a in (flat.fill_null(0), flat.is_valid()))
            clash[of[1:][~first[1:] & ((raw[c][1:] != raw[c][:-1]) | (there[c][1:] != there[c][:-1]))]] = True
        (y, x), of = np.divmod(place[first], side), of[first]
        begin = np.searchsorted(of, np.arange(len(n)))
        count = np.diff(np.append(begin, len(of)))
        top, bottom, left, right = y[begin], y[begin + count - 1], np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
        whole = ~clash & (count == (bottom - top + 1) * (right - left + 1))
        found = []
        for c in lists[1:]:
            sound = whole & np.logical_and.reduceat(there[c][first], begin)
            ends = pa.array(np.append(0, np.cumsum(np.where(sound, count, 0))), pa.int32())
            found.append(pa.ListArray.from_arrays(ends, pa.array(raw[c][first][np.repeat(sound, count)], pa.int16()), mask=pa.array(~sound)))
        places = [_ints(part, "_ty") * tile - before + top, _ints(part, "_tx") * tile - before + left, right - left + 1]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *[pa.array(c, pa.int32()) for c in places], *found], [*names, "_top", "_left", "_columns", *lists[1:]])

    def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _runs(pc.list_value_length(batch.column("_place")).to_numpy()):
                yield put_together(batch.slice(start, stop - start))

    # What moves is few bytes and much work, here and below, so partitions are not to be put together for their size.
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = own.mapInArrow(pack, f"{kinds}, _ty int, _tx int, _place array<int>, {arrays}").repartition(parts, *names)
    held = packed.groupBy(*names).agg(F.collect_list(F.struct(*lists)).alias("_all"))
    return held.select(*names, *[F.flatten(F.col("_all")[c]).alias(c) for c in lists]).mapInArrow(whole_tiles, f"{kinds}, _ty int, _tx int, _top int, _left int, _columns int, {arrays}")


def cubic_weights(f: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    """The weights of the four pixels around a place ``f`` beyond the second one."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(1 + f), near(f), near(1 - f), far(2 - f)]


def gathered(images: DataFrame, place: Place, pixels: DataFrame, values: Sequence[str], cubic: bool = False, edges: bool = True, keys: Sequence[str] = KEYS, source_keys: Sequence[str] | None = None, level: bool = False, tile: int = TILE) -> DataFrame:
    """keys, y, x and values of each pixel of new images: the weighted pixels around its place in an image of src_w x src_h.

    ``images`` has keys, source_keys, src_w, src_h, _w and _h, the new size, and other numbers that ``place`` needs. With ``level``
    a new image higher than wide is turned right. Bilinear, or bicubic. Beyond the border its pixels are repeated; without ``edges`` all
    is 0 there. No place gives 0; null values where the source has no such image or a faulty tile (see tiles).
    """
    source_keys = list(source_keys or keys)
    before, after = CUBIC if cubic else LINEAR
    own = list(dict.fromkeys([*keys, *source_keys]))
    wanted = images.where("src_w > 0 and src_h > 0 and _w > 0 and _h > 0")
    numbers = [c for c in wanted.columns if c not in own]
    ends = ["_ty", "_tx", "_lowy", "_highy", "_lowx", "_highx"]

    def inside(c: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.clip(c, 0, most - 1)

    def of_each(batch: pa.RecordBatch, row: np.ndarray) -> Numbers:
        known = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in numbers}
        return lambda c: known[c][row]

    def placed(of: Numbers, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The place of each new pixel, the pixel before it, and the tile of that."""
        at_x, at_y = place(of, y, x)
        y0, x0 = (np.floor(np.where(np.isnan(c), -1e6, np.clip(c, -1e6, 1e9))).astype(np.int64) for c in (at_y, at_x))
        return at_y, at_x, y0, x0, inside(y0, of("src_h")) // tile, inside(x0, of("src_w")) // tile

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of a new image and tile that it needs, with the ends of its pixels there."""
        for batch in batches:
            w, h = _ints(batch, "_w"), _ints(batch, "_h")
            image, y, x = _spread(np.zeros_like(h), (h - 1) // BLOCK, np.zeros_like(w), (w - 1) // BLOCK)
            blocks = [y * BLOCK, np.minimum(y * BLOCK + BLOCK, h[image]) - 1, x * BLOCK, np.minimum(x * BLOCK + BLOCK, w[image]) - 1]
            for start, stop in _runs((blocks[1] - blocks[0] + 1) * (blocks[3] - blocks[2] + 1)):
                row, y, x = _spread(*[c[start:stop] for c in blocks])
                row += start
                *_, ty, tx = placed(of_each(batch, image[row]), y, x)
                order = np.lexsort((tx, ty, row))
                row, ty, tx, y, x = (c[order] for c in (row, ty, tx, y, x))
                begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])))
                found = [ty[begin], tx[begin], *[f.reduceat(c, begin) for c in (y, x) for f in (np.minimum, np.maximum)]]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(image[row[begin]])).columns, *[pa.array(c, pa.int32()) for c in found]], [*batch.schema.names, *ends])

    def drawn(part: pa.RecordBatch) -> pa.RecordBatch:
        row, y, x = _spread(*[_ints(part, c) for c in ends[2:]])
        at_y, at_x, y0, x0, ty, tx = placed(of_each(part, row), y, x)
        # Other tiles have the rest of the block.
        here = np.flatnonzero((ty == _ints(part, "_ty")[row]) & (tx == _ints(part, "_tx")[row]))
        row, y, x, at_y, at_x, y0, x0 = (c[here] for c in (row, y, x, at_y, at_x, y0, x0))
        of, columns = of_each(part, row), _ints(part, "_columns")
        taps, weights, outside, known = [], [], [], True
        for at, c0, size, first, n in ((at_y, y0, of("src_h"), "_top", None), (at_x, x0, of("src_w"), "_left", columns[row])):
            f = np.where(np.isnan(at), 0.0, at - c0)
            weights.append(cubic_weights(f) if cubic else [1 - f, f])
            near = [c0 + k for k in range(-before, after + 1)]
            outside.append([None if edges else (c < 0) | (c >= size) for c in near])
            taps.append([inside(c, size) - _ints(part, first)[row] for c in near])
            known &= (taps[-1][0] >= 0) & (True if n is None else taps[-1][-1] < n)
        across = columns[row]
        arrays = []
        for v in values:
            held = part.column(f"_{v}")
            n = pc.fill_null(pc.list_value_length(held), 0).to_numpy().astype(np.int64)
            lines = n // np.maximum(columns, 1)
            sound = known & (taps[0][-1] < lines[row])
            flat = np.append(held.flatten().to_numpy(), 0)
            arrays.append((sound, flat, np.where(sound, (np.cumsum(n) - n)[row], 0)))
        totals = [np.zeros(len(row)) for _ in values]
        for down, a, out_y in zip(taps[0], weights[0], outside[0], strict=True):
            for right, b, out_x in zip(taps[1], weights[1], outside[1], strict=True):
                weight, at = a * b, down * across + right
                for total, (sound, flat, base) in zip(totals, arrays, strict=True):
                    old = flat[np.where(sound, base + at, len(flat) - 1)]
                    total += weight * (old if edges else np.where(out_y | out_x, 0, old))
        if level:
            turn = of("_h") > of("_w")
            y, x = np.where(turn, x, y), np.where(turn, of("_h") - 1 - y, x)
        new = [pa.array(np.clip(np.rint(t), 0, 255).astype(np.int32), mask=~sound) for t, (sound, *_) in zip(totals, arrays, strict=True)]
        return pa.RecordBatch.from_arrays([*part.select(own).take(pa.array(row)).columns, pa.array(y, pa.int32()), pa.array(x, pa.int32()), *new], [*own, "y", "x", *values])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low_y, high_y, low_x, high_x = (_ints(batch, c) for c in ends[2:])
            for start, stop in _runs((high_y - low_y + 1) * (high_x - low_x + 1)):
                yield drawn(batch.slice(start, stop - start))

    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = wanted.repartition(parts, *own).mapInArrow(ask, f"{_kinds(wanted, *wanted.columns)}, {', '.join(f'{c} int' for c in ends)}")
    # Sizes are guessed from those of files, which know nothing of the pixels made of them: tiles are never to be sent to all by way of the driver.
    held = tiles(pixels, values, before, after, source_keys, tile).hint("merge")
    met = asked.repartition(parts, *source_keys, "_ty", "_tx").join(held, [*source_keys, "_ty", "_tx"], "left")
    return met.mapInArrow(draw, f"{_kinds(wanted, *own)}, y int, x int, {', '.join(f'`{v}` int' for v in values)}")


def _along(c: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the centre of the pixel ``c`` of ``n`` lies among ``of``."""
    return np.maximum(0.0, np.minimum(of - 1.0, (c + 0.5) * of / n - 0.5))


def _projected(across: str, down: str) -> Place:
    """The place by the matrix _ma .. _mh from the unit square; on its horizon there is none."""

    def place(of: Numbers, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = x / of(across), y / of(down)
        s = of("_mg") * u + of("_mh") * v + 1.0
        s = np.where(s == 0, np.nan, s)
        return (of("_ma") * u + of("_mb") * v + of("_mc")) / s, (of("_md") * u + of("_me") * v + of("_mf")) / s

    return place


def _with_matrix(images: DataFrame) -> DataFrame:
    """Those with a matrix _m, in parts."""
    return images.where("_m is not null").select("*", *[F.col("_m")[c].alias(f"_m{c}") for c in "abcdefgh"]).drop("_m")


def rectified_pixels(pages: DataFrame, pixels: DataFrame, values: Sequence[str] = ("r", "g", "b"), corners_col: str = "corners", size_col: str = "page_size", keys: Sequence[str] = KEYS, source_keys: Sequence[str] | None = None) -> DataFrame:
    """keys, y, x and values of each page: the quad in ``corners_col`` (in order) stretched to the size in ``size_col``.

    ``pages`` has also src_w and src_h, the size of the image with ``source_keys``; several pages may come of one image. Pages
    without four corners, or with three of them in a line, have no pixels. Bilinear; zero outside of the image.
    """
    m, size = g.square_to_quad(F.col(corners_col)), F.col(size_col)
    ready = pages.select(*dict.fromkeys([*keys, *(source_keys or keys)]), "src_w", "src_h", m.alias("_m"), size["width"].alias("_w"), size["height"].alias("_h"))
    return gathered(_with_matrix(ready), _projected("_w", "_h"), pixels, values, False, False, keys, source_keys)


def resized_pixels(images: DataFrame, pixels: DataFrame, values: Sequence[str] = ("r", "g", "b"), size_col: str = "size", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x and values of each image of ``images`` (keys, src_w, src_h and a size), bilinear with pixel centres on half coordinates."""
    size = F.col(size_col)
    known = images.select(*keys, "src_w", "src_h", size["width"].alias("_w"), size["height"].alias("_h"))
    return gathered(known, lambda of, y, x: (_along(x, of("_w"), of("src_w")), _along(y, of("_h"), of("src_h"))), pixels, values, keys=keys)


def region_pixels(regions: DataFrame, pixels: DataFrame, values: Sequence[str] = ("r", "g", "b"), roi_col: str = "roi", keys: Sequence[str] = KEYS, source_keys: Sequence[str] | None = None) -> DataFrame:
    """keys, y, x and values of what is cut out at ``roi_col`` (functions.geometry.document_roi), brought to its size. What lies beyond the image is cut off."""
    r = F.col(roi_col)
    known = regions.select(*dict.fromkeys([*keys, *(source_keys or keys)]), "src_w", "src_h", *[r[n].alias(f"_{n}") for n in ("sx", "sy", "sw", "sh", "dw", "dh")])
    known = known.withColumns({"_cw": F.least("_sw", F.col("src_w") - F.col("_sx")), "_ch": F.least("_sh", F.col("src_h") - F.col("_sy"))}).where("_cw > 0 and _ch > 0")
    known = known.withColumnsRenamed({"_dw": "_w", "_dh": "_h"})
    place = lambda of, y, x: (of("_sx") + _along(x, of("_w"), of("_cw")), of("_sy") + _along(y, of("_h"), of("_ch")))
    return gathered(known, place, pixels, values, keys=keys, source_keys=source_keys)


def assess_documents(pages: DataFrame, pixels: DataFrame, most: int = 320, corners_col: str = "corners", id_col: str = "page_id", source_keys: Sequence[str] = KEYS) -> DataFrame:
    """id, focus, luma, dark_ratio, level and reasons of each page within its corners, or of its whole image where they give no region.

    ``pages`` has an id, source_keys, corners, src_w and src_h; ``pixels`` r, g and b. Pages without pixels have no row.
    """
    w, h = F.col("src_w"), F.col("src_h")
    roi = F.coalesce(g.document_roi(F.col(corners_col), w, h, most), g.whole_frame_roi(w, h, most))
    cut = region_pixels(pages.withColumn("_roi", roi), pixels, roi_col="_roi", keys=(id_col,), source_keys=source_keys)
    gray = cut.select(id_col, "y", "x", px.gray(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    return px.assess_images(gray, image_col=id_col)


def line_pixels(lines: DataFrame, pixels: DataFrame, values: Sequence[str] = ("v",), box_col: str = "box", keys: Sequence[str] = ("image_id", "line_no"), source_keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x and values of text lines cut out and made level; those higher than wide are turned right by 90 degrees.

    A line is as large as the longer of its opposite sides, cut off to whole pixels and 1 at least. Bicubic, the border repeated.
    ``lines`` has src_w and src_h too; boxes without four corners or with three in a line have no pixels.
    """
    w, h = g.edge_sizes(F.col(box_col))
    ready = lines.select(*dict.fromkeys([*keys, *source_keys]), "src_w", "src_h", w.alias("_fw"), h.alias("_fh"), g.square_to_quad(F.col(box_col)).alias("_m"))
    sized = _with_matrix(ready).withColumns({"_w": _at_least_one(F.col("_fw")), "_h": _at_least_one(F.col("_fh"))})
    return gathered(sized, _projected("_fw", "_fh"), pixels, values, True, True, keys, source_keys, True)


def median_pixels(pixels: DataFrame, size: int = 13, value_col: str = "v", keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """keys, y, x and the median of each pixel's neighbourhood of ``size`` (odd), the border repeated. Faulty tiles (see tiles) have no pixels."""
    half, most = size // 2, size * size
    held = tiles(pixels, [value_col], half, half, keys, tile).where(F.col(f"_{value_col}").isNotNull())
    steps = np.arange(size) - half

    def middles(part: pa.RecordBatch, ends: list[np.ndarray]) -> pa.RecordBatch:
        row, y, x = _spread(*ends)
        top, left, columns = (_ints(part, c) for c in ("_top", "_left", "_columns"))
        n = pc.list_value_length(part.column(f"_{value_col}")).to_numpy().astype(np.int64)
        down = np.clip(y[:, None] + steps - top[row, None], 0, (n // columns - 1)[row, None])
        right = np.clip(x[:, None] + steps - left[row, None], 0, (columns - 1)[row, None])
        at = (np.cumsum(n) - n)[row, None, None] + down[:, :, None] * columns[row, None, None] + right[:, None, :]
        around = part.column(f"_{value_col}").flatten().to_numpy()[at.reshape(-1, most)]
        found = np.partition(around, most // 2, axis=1)[:, most // 2] if len(row) else np.zeros(0)
        return pa.RecordBatch.from_arrays([*part.select(list(keys)).take(pa.array(row)).columns, *[pa.array(c, pa.int32()) for c in (y, x, found.astype(np.int32))]], [*keys, "y", "x", value_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, left, columns, low_y, low_x = (_ints(batch, c) * k for c, k in (("_top", 1), ("_left", 1), ("_columns", 1), ("_ty", tile), ("_tx", tile)))
            n = pc.list_value_length(batch.column(f"_{value_col}")).to_numpy()
            # Tiles of the margin alone, beyond the image, have no pixels of their own.
            high_y = np.maximum(low_y - 1, np.minimum(low_y + tile, top + n // columns) - 1)
            high_x = np.maximum(low_x - 1, np.minimum(low_x + tile, left + columns) - 1)
            for start, stop in _runs((high_y - low_y + 1) * (high_x - low_x + 1), max(1, AT_ONCE * 8 // most)):
                yield middles(batch.slice(start, stop - start), [c[start:stop] for c in (low_y, high_y, low_x, high_x)])

    return held.mapInArrow(run, f"{_kinds(held, *keys)}, y int, x int, `{value_col}` int")


def paper_background(images: DataFrame, pixels: DataFrame, size: int = 13, value_col: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x and the paper's brightness without the writing on it: at a quarter of the size the brightest of each neighbourhood, then the median, enlarged again.

    ``images`` has keys, src_w and src_h of gray images; sides of a quarter's size are 1 at least.
    """
    quarter = lambda c: F.greatest(F.lit(1.0), round_half_up(F.col(c) * 0.25))
    known = images.select(*keys, "src_w", "src_h", g.size(quarter("src_w"), quarter("src_h")).alias("size"))
    small = resized_pixels(known, pixels, [value_col], "size", keys)
    for across, order in (("y", "x"), ("x", "y")):  # the brightest of a square: of the rows, then of the columns
        small = px.along_lines(small, across, order, size, value_col, keys)
    still = median_pixels(small, size, value_col, keys)
    back = known.select(*keys, F.col("size.width").alias("src_w"), F.col("size.height").alias("src_h"), g.size(F.col("src_w"), F.col("src_h")).alias("full"))
    return resized_pixels(back, still, [value_col], "full", keys)


def enhanced_documents(images: DataFrame, pixels: DataFrame, value_col: str = "v", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, y, x, value and bg of gray pages: divided by their paper's brightness, stretched, and darkened below the clip."""
    bg = paper_background(images, pixels, 13, value_col, keys).withColumnRenamed(value_col, "bg")
    # As with tiles: Spark would guess so many pixels to be a small table, and gather them in the driver to send them to all.
    return px.document_tones(pixels.select(*keys, "y", "x", value_col).join(bg.hint("merge"), [*keys, "y", "x"]), list(keys), value_col)
