"""Images as tables of pixels (image, y, x, and values 0..255): whatever is a value per pixel or a sum per image stays in Catalyst.

Stencils are joins-free: a pixel's neighbours come from windows over its row and its column. An image is
one window, so a task holds the pixels of one image at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.capture_quality import LIMITS, capture_quality
from ..functions.jsnum import saturate_u8, truncate_u8

GAMMA, CLIP = 2.2, 220
SATURATION_GAIN, COLORED, COLORED_SHARE = 1.25, 12, 0.005


def gray(r: Column, g: Column, b: Column) -> Column:
    return saturate_u8(r * 0.299 + g * 0.587 + b * 0.114)


def hsv_saturation_value(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Saturation and value of the 8-bit form."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, 0).otherwise(saturate_u8((top - low) * 255.0 / F.greatest(top, F.lit(1)))), top


def tone_curve(v: Column) -> Column:
    """255 from ``CLIP`` on, below it a power of the value's share, cut off to whole numbers."""
    return F.when(v >= CLIP, 255).otherwise(truncate_u8(F.pow(v / float(CLIP), F.lit(GAMMA)) * 255.0))


def tone_table(spark) -> DataFrame:
    """v, tone for 0..255."""
    return spark.range(256).select(F.col("id").cast("int").alias("v"), tone_curve(F.col("id")).alias("tone"))


def divided(v: Column, background: Column) -> Column:
    return F.when(background == 0, 0).otherwise(saturate_u8(v * 255.0 / F.greatest(background, F.lit(1))))


def stretched(v: Column, low: Column, high: Column) -> Column:
    """From low..high to 0..255; flat images stay as they are."""
    factor = F.lit(255.0) / F.greatest(high - low, F.lit(1))
    return F.when(high > low, saturate_u8(v * factor - low * factor)).otherwise(v)


def stretch(pixels: DataFrame, image_col: str | list[str] = "image_id", value_col: str = "v") -> DataFrame:
    own = Window.partitionBy(image_col)
    return pixels.withColumn(value_col, stretched(F.col(value_col), F.min(value_col).over(own), F.max(value_col).over(own)))


def rotate90(pixels: DataFrame, clockwise: bool = True, image_col: str = "image_id") -> DataFrame:
    """Coordinates after a right turn, or a left one."""
    own = Window.partitionBy(image_col)
    far = F.max("y" if clockwise else "x").over(own)
    y, x = (F.col("x"), far - F.col("y")) if clockwise else (far - F.col("x"), F.col("y"))
    return pixels.withColumns({"_y": y, "_x": x}).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def laplacian(pixels: DataFrame, image_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """Adds lap: the sum of the four neighbours less four times the value; borders are mirrored without repeating the edge."""
    # Dealt out by image, pixels need no further shuffle for their rows, their columns and the sums of the image.
    pixels = pixels.repartition(image_col)
    row = Window.partitionBy(image_col, "y").orderBy("x")
    column = Window.partitionBy(image_col, "x").orderBy("y")
    v = F.col(value_col)

    def sides(w) -> Column:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        return F.coalesce(before, after, v) + F.coalesce(after, before, v)

    return pixels.withColumn("_row", sides(row)).withColumn("lap", (F.col("_row") + sides(column) - 4 * v).cast("double")).drop("_row")


def gaussian_line(size: int) -> list[float]:
    """The weights of a Gaussian kernel of ``size`` (odd) along one axis; for 3 the deviation is 1, beyond it follows from the size."""
    deviation = 1.0 if size == 3 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * deviation**2)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def smoothed(pixels: DataFrame, size: int, mirrored: bool = False, image_col: str = "image_id", value_col: str = "v", out: str = "blur") -> DataFrame:
    """Adds ``out``: the Gaussian mean of each pixel's neighbourhood, to whole numbers.

    Beyond the border the outermost pixel is repeated; with ``mirrored`` (``size`` 3 only) the one next to it is
    taken instead. Neighbours come from windows over the row and then the column, so an image moves once.
    """
    if mirrored and size != 3:
        raise ValueError("only a kernel of 3 is mirrored")
    line, half = gaussian_line(size), size // 2

    def along(value: Column, keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        total = value * line[half]
        for d in range(1, half + 1):
            before, after = F.lag(value, d).over(w), F.lead(value, d).over(w)
            ends = (F.coalesce(before, after, value), F.coalesce(after, before, value)) if mirrored else (F.coalesce(before, first), F.coalesce(after, last))
            total = total + ends[0] * line[half - d] + ends[1] * line[half + d]
        return total

    across = pixels.repartition(image_col).withColumn("_across", along(F.col(value_col), [image_col, "y"], "x"))
    return across.withColumn(out, saturate_u8(along(F.col("_across"), [image_col, "x"], "y"))).drop("_across")


def sharpened_for_ocr(pixels: DataFrame, image_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """1.3 times each gray pixel less 0.3 times its 3x3 Gaussian mean."""
    near = smoothed(pixels, 3, True, image_col, value_col, "_blur")
    return near.withColumn(value_col, saturate_u8(F.col(value_col) * 1.3 - F.col("_blur") * 0.3)).drop("_blur")


def monochrome(pixels: DataFrame, size: int = 15, less: int = 10, image_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """255 where a gray pixel is lighter than its Gaussian neighbourhood less ``less``, else 0."""
    near = smoothed(pixels, size, False, image_col, value_col, "_blur")
    return near.withColumn(value_col, F.when(F.col(value_col) > F.col("_blur") - less, 255).otherwise(0)).drop("_blur")


def along_lines(pixels: DataFrame, across: str, order: str, size: int, value_col: str = "v", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Each pixel as the brightest of the ``size`` pixels around it on its line of equal ``across``."""
    near = Window.partitionBy(*keys, across).orderBy(order).rowsBetween(-(size // 2), size // 2)
    return pixels.withColumn(value_col, F.max(value_col).over(near))


def brightest(pixels: DataFrame, size: int = 13, image_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """Each pixel as the brightest of its neighbourhood of ``size``: a maximum over rows, then one over columns."""
    rows = along_lines(pixels.repartition(image_col), "y", "x", size, value_col, [image_col])
    return along_lines(rows, "x", "y", size, value_col, [image_col])


def capture_metrics(pixels: DataFrame, image_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """image, focus (variance of the Laplacian), luma (mean) and dark_ratio of gray images, in one aggregation."""
    v = F.col(value_col)
    dark = F.avg(F.when(v <= LIMITS.dark_pixel, 1.0).otherwise(0.0))
    # The sums are of whole numbers, and so do not depend on the order.
    n, total, squares = F.count("lap"), F.sum(F.col("lap").cast("long")), F.sum((F.col("lap") * F.col("lap")).cast("long"))
    focus = (squares - total * total / n) / n
    return laplacian(pixels, image_col, value_col).groupBy(image_col).agg(focus.alias("focus"), F.avg(v).alias("luma"), dark.alias("dark_ratio"))


def assess_images(pixels: DataFrame, peak: Column | None = None, image_col: str = "image_id") -> DataFrame:
    """capture_metrics plus level and reasons."""
    m = capture_metrics(pixels, image_col)
    found = m.withColumn("_q", capture_quality(F.col("focus"), F.col("luma"), F.col("dark_ratio"), F.lit(0.0) if peak is None else peak))
    return found.select(*m.columns, "_q.level", "_q.reasons")


def best_filter(pixels: DataFrame, image_col: str = "image_id") -> DataFrame:
    """image, color_ratio (share of pixels with a saturation above 12) and mode, from columns r, g, b of the rectified page."""
    s, _ = hsv_saturation_value(F.col("r"), F.col("g"), F.col("b"))
    ratio = pixels.groupBy(image_col).agg(F.avg(F.when(s > COLORED, 1.0).otherwise(0.0)).alias("color_ratio"))
    return ratio.withColumn("mode", F.when(F.col("color_ratio") > COLORED_SHARE, "color_enhanced").otherwise("document_enhanced"))


def document_tones(pixels: DataFrame, image_col: str | list[str] = "image_id", value_col: str = "v", background_col: str = "bg") -> DataFrame:
    """The tail of the document filter over its background: divide, stretch, tone curve."""
    flat = stretch(pixels.withColumn(value_col, divided(F.col(value_col), F.col(background_col))), image_col, value_col)
    return flat.withColumn(value_col, tone_curve(F.col(value_col)))


def above(p: Column, threshold: float = 0.3) -> Column:
    """Whether a probability counts as text."""
    return p > threshold


def normalized(v: Column, mean: float, deviation: float) -> Column:
    """A channel's value as the corner and text models take it."""
    return v / F.lit(255.0 * deviation) - F.lit(mean / deviation)


def explode_image(images: DataFrame, image_col: str = "image", id_col: str = "image_id") -> DataFrame:
    """image_id, y, x, c0, c1, c2 of packed images; absent channels are null. Only for the kernels that need pixels as rows."""
    i = F.col("image")
    flat = images.select(F.col(id_col).alias("image_id"), F.col(image_col).alias("image")).where(i.isNotNull() & (i["width"] > 0) & (i["height"] > 0))
    # The bytes stay with their row until each pixel has taken its own from them.
    rows = flat.withColumn("y", F.explode(F.sequence(F.lit(0), i["height"] - 1)))
    rows = rows.withColumn("line", F.substring(i["data"], F.col("y") * i["width"] * i["channels"] + 1, i["width"] * i["channels"]))
    rows = rows.select("image_id", "y", i["channels"].alias("channels"), F.hex("line").alias("line"), F.explode(F.sequence(F.lit(0), i["width"] - 1)).alias("x"))

    def channel(k: int) -> Column:
        at = (F.col("x") * F.col("channels") + k) * 2 + 1
        return F.when(F.col("channels") > k, F.conv(F.substring("line", at, F.lit(2)), 16, 10).cast("int"))

    return rows.select("image_id", "y", "x", *[channel(k).alias(f"c{k}") for k in range(3)])
