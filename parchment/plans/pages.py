"""Queries on pixels: capture metrics, tones, filters, and the pages and boxes that come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import page_images, pixels, text_boxes, text_lines
from ..sources.images import png_bytes
from .inputs import GRAY_SQL, RGBA_SQL, gray_pixels, quads, rgba_pixels, table
from .registry import query

_LAP = """lap AS (SELECT image_id, v, coalesce(l, r, v) + coalesce(r, l, v) + coalesce(u, d, v) + coalesce(d, u, v) - 4 * v AS lap FROM (
  SELECT *, lag(v) OVER rw AS l, lead(v) OVER rw AS r, lag(v) OVER cl AS u, lead(v) OVER cl AS d FROM gray_px
  WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cl AS (PARTITION BY image_id, x ORDER BY y)))"""
_METRICS = "metrics AS (SELECT image_id, (sum(lap * lap)::DOUBLE - sum(lap)::DOUBLE * sum(lap)::DOUBLE / count(*)) / count(*) AS focus, avg(v) AS luma, avg(CASE WHEN v <= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dark FROM lap GROUP BY image_id)"


@query(f"""WITH {GRAY_SQL}, {_LAP}, {_METRICS}, judged AS (SELECT *, luma < 105 OR dark > 0.42 AS d, luma < 72 OR dark > 0.62 AS dd, focus < 320 AS b, focus < 140 AS bb FROM metrics)
SELECT image_id, round(focus, 4) AS focus, round(luma, 6) AS luma, round(dark, 6) AS dark_ratio, CASE WHEN dd OR bb OR (d AND b) THEN 'poor' WHEN d OR b THEN 'fair' ELSE 'good' END AS level,
  concat_ws(',', CASE WHEN d THEN 'dark' END, CASE WHEN b THEN 'blur' END) AS reasons FROM judged""")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, brightness and level of every gray image."""
    a = pixels.assess_images(gray_pixels(spark, sf_dir))
    return a.select("image_id", F.round("focus", 4).alias("focus"), F.round("luma", 6).alias("luma"), F.round("dark_ratio", 6).alias("dark_ratio"), "level", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {GRAY_SQL}, based AS (SELECT *, max(v) OVER (PARTITION BY image_id, y) AS bg FROM gray_px),
even AS (SELECT image_id, y, x, CASE WHEN bg = 0 THEN 0 ELSE least(255, round_even(v * 255.0::DOUBLE / greatest(bg, 1), 0))::INT END AS v FROM based),
ends AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM even),
flat AS (SELECT image_id, y, x, CASE WHEN hi > lo THEN least(255, greatest(0, round_even(v * (255.0::DOUBLE / greatest(hi - lo, 1)) - lo * (255.0::DOUBLE / greatest(hi - lo, 1)), 0)))::INT ELSE v END AS v FROM ends)
SELECT image_id, y, x, CASE WHEN v >= 220 THEN 255 ELSE trunc(pow(v / 220.0::DOUBLE, 2.2::DOUBLE) * 255)::INT END AS v FROM flat""")
def document_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by the background (here each row's brightest pixel), stretch and tone curve."""
    from pyspark.sql import Window

    px = gray_pixels(spark, sf_dir).withColumn("bg", F.max("v").over(Window.partitionBy("image_id", "y")))
    return pixels.document_tones(px).select("image_id", "y", "x", "v")


@query(f"WITH {GRAY_SQL}, far AS (SELECT *, max(y) OVER (PARTITION BY image_id) AS my, max(x) OVER (PARTITION BY image_id) AS mx FROM gray_px) SELECT 'right' AS turn, image_id, x AS y, my - y AS x, v FROM far UNION ALL SELECT 'left', image_id, mx - x, y, v FROM far")
def rotated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = gray_pixels(spark, sf_dir)
    right, left = (pixels.rotate90(px, clockwise).withColumn("turn", F.lit(n)) for clockwise, n in ((True, "right"), (False, "left")))
    return right.unionByName(left).select("turn", "image_id", "y", "x", "v")


def _sql_smoothed(size: int, place: str) -> str:
    """CTEs from gray_px to smooth: sums of weighted neighbours along each row, then along each column, of 8x8 images."""
    line = ", ".join(f"{w!r}e0" for w in pixels.gaussian_line(size))
    weights = f"weights AS (SELECT (i - {size // 2})::INT AS d, list_value({line})[i + 1] AS weight FROM range({size}) r(i))"
    rows = f"across AS (SELECT p.image_id, p.y, p.x, sum(n.v * weight) AS m FROM gray_px p, weights JOIN gray_px n ON n.image_id = p.image_id AND n.y = p.y AND n.x = {place.format('p.x + d')} GROUP BY ALL)"
    columns = f"smooth AS (SELECT p.image_id, p.y, p.x, round_even(sum(n.m * weight), 0)::INT AS blur FROM across p, weights JOIN across n ON n.image_id = p.image_id AND n.x = p.x AND n.y = {place.format('p.y + d')} GROUP BY p.image_id, p.y, p.x)"
    return f"{weights}, {rows}, {columns}"


@query(f"""WITH {GRAY_SQL}, {_sql_smoothed(3, "(7 - abs(7 - abs({})))")} SELECT image_id, y, x, least(255, greatest(0, round_even(1.3::DOUBLE * v - 0.3::DOUBLE * blur, 0)))::INT AS v FROM gray_px JOIN smooth USING (image_id, y, x)""")
def sharpened_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gray image sharpened for recognition."""
    return pixels.sharpened_for_ocr(gray_pixels(spark, sf_dir)).select("image_id", "y", "x", "v")


@query(f"""WITH {GRAY_SQL}, {_sql_smoothed(15, "least(7, greatest(0, {}))")} SELECT image_id, y, x, CASE WHEN v > blur - 10 THEN 255 ELSE 0 END AS v FROM gray_px JOIN smooth USING (image_id, y, x)""")
def monochrome_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gray image in black and white, by each pixel's neighbourhood."""
    return pixels.monochrome(gray_pixels(spark, sf_dir)).select("image_id", "y", "x", "v")


@query(f"WITH {GRAY_SQL} SELECT p.image_id, p.y, p.x, max(n.v)::INT AS v FROM gray_px p JOIN gray_px n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 2 AND abs(n.y - p.y) <= 2 GROUP BY p.image_id, p.y, p.x")
def paper_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brightest of each pixel's 5x5 neighbourhood: paper without thin strokes."""
    return pixels.brightest(gray_pixels(spark, sf_dir), 5).select("image_id", "y", "x", "v")


_HSV = "hsv AS (SELECT *, greatest(r, g, b) AS top, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round_even((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b, 1), 0)::INT END AS s, round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0)::INT AS gray FROM rgba_px)"


@query(f"WITH {RGBA_SQL}, {_HSV} SELECT image_id, round(avg(CASE WHEN s > 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS color_ratio, CASE WHEN avg(CASE WHEN s > 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.005 THEN 'color_enhanced' ELSE 'document_enhanced' END AS mode FROM hsv GROUP BY image_id")
def best_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.best_filter(rgba_pixels(spark, sf_dir))
    return found.select("image_id", F.round("color_ratio", 6).alias("color_ratio"), "mode")


@query(f"""WITH {RGBA_SQL}, {_HSV}, ends AS (SELECT *, min(top) OVER (PARTITION BY image_id) AS lo, max(top) OVER (PARTITION BY image_id) AS hi FROM hsv)
SELECT image_id, y, x, gray, s AS saturation, least(255, round_even(s * 1.25::DOUBLE, 0))::INT AS raised, CASE WHEN hi > lo THEN least(255, greatest(0, round_even(top * (255.0::DOUBLE / greatest(hi - lo, 1)) - lo * (255.0::DOUBLE / greatest(hi - lo, 1)), 0)))::INT ELSE top END AS value,
  round(r / (255.0::DOUBLE * 0.229::DOUBLE) - 0.485::DOUBLE / 0.229::DOUBLE, 6) AS model_r, r / 255.0::DOUBLE > 0.3 AS is_text FROM ends""")
def color_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray, saturation (as it is and raised), stretched value, and a channel as the corner model takes it."""
    px = rgba_pixels(spark, sf_dir)
    r, gr, b = F.col("r"), F.col("g"), F.col("b")
    s, top = pixels.hsv_saturation_value(r, gr, b)
    flat = pixels.stretch(px.withColumns({"saturation": s, "value": top, "gray": pixels.gray(r, gr, b)}), value_col="value")
    return flat.select("image_id", "y", "x", "gray", "saturation", pixels.saturate_u8(F.col("saturation") * 1.25).alias("raised"), "value", F.round(pixels.normalized(r, 0.485, 0.229), 6).alias("model_r"), pixels.above(r / 255.0).alias("is_text"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32x24 RGB images, one for each vector: its 64 values as bytes, again and again."""
    level = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((e * 0.6 + 0.5) * 255))).cast("int")
    line = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(level(e)), 2, "0")), "")
    image = F.struct(F.lit(24).alias("height"), F.lit(32).alias("width"), F.lit(3).alias("channels"), F.unhex(F.repeat(line, F.lit(36))).alias("data"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), image.alias("image"))


@query()
def rectified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image rectified by its first quad, filtered and turned, and encoded as PNG."""
    q = quads(spark, sf_dir).where("q = 2").select(F.col("vec_id").alias("image_id"), g.sort_corners(g.to_pixels(F.col("pts"), F.lit(32), F.lit(24))).alias("corners"))
    modes = ["color_enhanced", "color_original", "document_enhanced", "document_original", "mono"]
    mode = F.element_at(F.array(*[F.lit(m) for m in modes]), (F.col("image_id") % 5 + 1).cast("int"))
    ready = _images(spark, sf_dir).join(q, "image_id").withColumns({"page_size": g.page_size(F.col("corners")), "mode": mode, "rotation": (F.col("image_id") % 4 * 90).cast("int")})
    done = page_images.rectify(ready, encode=png_bytes)
    return done.select("image_id", "page.width", "page.height", "page.channels", F.sha2("page.data", 256).alias("sha256"), F.octet_length("content").alias("png_bytes"), "error")


@query()
def prepared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image brought to a size and sharpened for recognition."""
    ready = page_images.prepare_for_ocr(_images(spark, sf_dir).withColumn("size", g.fit_within(F.lit(32), F.lit(24), 20)))
    return ready.select("image_id", "prepared.width", "prepared.height", F.sha2("prepared.data", 256).alias("sha256"))


@query()
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's best filter, and its sharpness, brightness and level within the corners of its first quad."""
    q = quads(spark, sf_dir).where("q = 2").select(F.col("vec_id").alias("image_id"), g.sort_corners(g.to_pixels(F.col("pts"), F.lit(32), F.lit(24))).alias("corners"))
    ready = _images(spark, sf_dir).join(q, "image_id")
    best = page_images.best_modes(ready).select("image_id", F.round("color_ratio", 6).alias("color_ratio"), "mode")
    level = page_images.assess_documents(ready)
    return best.join(level, "image_id").select("image_id", "color_ratio", "mode", F.round("focus", 4).alias("focus"), F.round("luma", 4).alias("luma"), F.round("dark_ratio", 6).alias("dark_ratio"), "level", F.array_join("reasons", ",").alias("reasons"))
