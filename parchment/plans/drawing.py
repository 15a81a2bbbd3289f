"""Queries on pages as tables of pixels: rectified, resized, lines cut out, the document filter with its whole background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.jsnum import bind
from ..operators import gather, pixels
from .geometry import sql_sorted
from .inputs import PAGE_SIZES_SQL, PAGES_SQL, QUADS_SQL, page_pixels, page_sizes, quads
from .pages import _LAP, _METRICS
from .registry import query

# ---- the same in SQL ------------------------------------------------------------------------------------------------


def _sql_matrix(of: str, w: str, h: str) -> str:
    """CTE matrices: all columns of ``of`` (with x0, y0 .. x3, y3 in order) and the matrix from w x h pixels, as parts a .. h."""
    return f"""sides AS (SELECT *, x1 - x2 AS ax, y1 - y2 AS ay, x3 - x2 AS bx, y3 - y2 AS by_, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM {of}),
bends AS (SELECT *, (sx * by_ - bx * sy) / nullif(ax * by_ - bx * ay, 0) AS mg, (ax * sy - sx * ay) / nullif(ax * by_ - bx * ay, 0) AS mh FROM sides),
matrices AS (SELECT *, x1 - x0 + mg * x1 AS ma, x3 - x0 + mh * x3 AS mb, x0 AS mc, y1 - y0 + mg * y1 AS md, y3 - y0 + mh * y3 AS me, y0 AS mf, ({w}) AS across, ({h}) AS down FROM bends
  WHERE mg IS NOT NULL AND {" AND ".join(f"(x{i} - x{j}) * (y{k} - y{j}) <> (x{k} - x{j}) * (y{i} - y{j})" for i, j, k in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1)))})"""


_IMAGES = "images AS (SELECT image_id, max(x) + 1 AS src_w, max(y) + 1 AS src_h, {lists} FROM {of} GROUP BY image_id)"


def _lists(of: str, *values: str) -> str:
    return _IMAGES.format(of=of, lists=", ".join(f"list({v} ORDER BY y, x) AS {v}s" for v in values))


def _sql_drawn(value: str, edges: bool, cubic: bool = False) -> str:
    """The weighted pixels around (u, v), with ly, lx and the weights wy, wx as lists."""
    before, n = (1, 4) if cubic else (0, 2)
    terms = []
    for j in range(n):
        for i in range(n):
            yy, xx = f"(ly + {j - before})", f"(lx + {i - before})"
            own = f"{value}s[(least(src_h - 1, greatest(0, {yy})) * src_w + least(src_w - 1, greatest(0, {xx})) + 1)::INT]"
            own = own if edges else f"(CASE WHEN {yy} >= 0 AND {yy} < src_h AND {xx} >= 0 AND {xx} < src_w THEN {own} ELSE 0 END)"
            terms.append(f"(wy[{j + 1}] * wx[{i + 1}]) * {own}")
    return f"least(255, greatest(0, round_even({' + '.join(terms)}, 0)))::INT AS {value}"


def _sql_cubic(f: str) -> str:
    a = "(-0.75::DOUBLE)"
    near = lambda d: f"(({a} + 2) * {d} - ({a} + 3)) * {d} * {d} + 1"
    far = lambda d: f"(({a} * {d} - 5 * {a}) * {d} + 8 * {a}) * {d} - 4 * {a}"
    return f"[{far(f'(1 + {f})')}, {near(f)}, {near(f'(1 - {f})')}, {far(f'(2 - {f})')}]"


def _sql_taps(of: str, cubic: bool = False) -> str:
    """CTE taps: ``of`` with ly, lx and weights of its places u, v."""
    weights = _sql_cubic if cubic else (lambda f: f"[1 - {f}, {f}]")
    return f"floors AS (SELECT *, floor(u)::INT AS lx, floor(v)::INT AS ly FROM {of}), taps AS (SELECT *, {weights('(u - lx)')} AS wx, {weights('(v - ly)')} AS wy FROM floors)"


_EDGES = [f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2)" for a, b in ((0, 1), (3, 2), (0, 3), (1, 2))]
_CORNERS = f"""moved AS (SELECT vec_id // 8 AS image_id, q, src_w, src_h, {", ".join(f"least(src_{s}, greatest(0, {c}{i} * src_{s})) AS p{c}{i}" for i in range(4) for c, s in (("x", "w"), ("y", "h")))} FROM quads JOIN page_sizes ON page_sizes.image_id = vec_id // 8 AND vec_id % 8 = 0),
sorted_quads AS (SELECT image_id, q, src_w, src_h, l[1].x AS x0, l[1].y AS y0, r[1].x AS x1, r[1].y AS y1, r[2].x AS x2, r[2].y AS y2, l[2].x AS x3, l[2].y AS y3 FROM ({sql_sorted("px", "py")} moved)))"""
_PAGE_CORNERS = f"{QUADS_SQL}, {PAGES_SQL}, {PAGE_SIZES_SQL}, {_CORNERS}"
_SUMS = "sum({v})::BIGINT AS sum_{v}, sum({v} * ((y * 7919 + x * 104729) % 10007))::BIGINT AS placed_{v}"
_PROJECTED = "SELECT *, (ma * (x / across) + mb * (y / down) + mc) / (mg * (x / across) + mh * (y / down) + 1) AS u, (md * (x / across) + me * (y / down) + mf) / (mg * (x / across) + mh * (y / down) + 1) AS v"


def _corners(spark: SparkSession, sf_dir: str, sizes: DataFrame) -> DataFrame:
    """image_id, q, corners, src_w, src_h: all eight quads of each page's first vector, in the page's pixels and in order."""
    q = quads(spark, sf_dir).where("vec_id % 8 = 0").select(F.floor(F.col("vec_id") / 8).cast("long").alias("image_id"), "q", "pts")
    return q.join(sizes, "image_id").select("image_id", "q", g.sort_corners(g.to_pixels(F.col("pts"), F.col("src_w"), F.col("src_h"))).alias("corners"), "src_w", "src_h")


def _summed(drawn: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of each image's values, plain and by place."""
    place = (F.col("y") * 7919 + F.col("x") * 104729) % 10007
    sums = [c for v in values for c in (F.sum(v).alias(f"sum_{v}"), F.sum(F.col(v) * place).alias(f"placed_{v}"))]
    return drawn.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), *sums)


_TO_PAGE = f"page_quads AS (SELECT *, greatest(1, round(greatest({_EDGES[0]}, {_EDGES[1]}))) AS pw, greatest(1, round(greatest({_EDGES[2]}, {_EDGES[3]}))) AS ph FROM sorted_quads)"


@query(f"""WITH {_PAGE_CORNERS}, {_TO_PAGE}, {_sql_matrix("page_quads", "pw", "ph")}, {_lists("page_px", "r", "g", "b")},
places AS ({_PROJECTED} FROM (SELECT m.*, y, x FROM matrices m, range(128) a(y), range(128) b(x) WHERE y < ph AND x < pw)), {_sql_taps("places")},
drawn AS (SELECT t.image_id, q, y, x, {", ".join(_sql_drawn(v, False) for v in "rgb")} FROM (SELECT * EXCLUDE (src_w, src_h) FROM taps) t JOIN images USING (image_id))
SELECT image_id, q, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height, {", ".join(_SUMS.format(v=v) for v in "rgb")} FROM drawn GROUP BY image_id, q""")
def rectified_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page rectified by each of its quads: the size, and sums over all pixels of each channel, plain and by place."""
    own = page_pixels(spark, sf_dir)
    pages = _corners(spark, sf_dir, page_sizes(own)).withColumn("page_size", g.page_size(F.col("corners")))
    return _summed(gather.rectified_pixels(pages, own, keys=("image_id", "q"), source_keys=("image_id",)), ["image_id", "q"], ["r", "g", "b"])


@query(f"""WITH {QUADS_SQL}, moved AS (SELECT vec_id, q, {", ".join(f"least({s}, greatest(0, {c}{i} * {s})) AS p{c}{i}" for i in range(4) for c, s in (("x", 640), ("y", 480)))} FROM quads),
sorted_quads AS (SELECT vec_id, q, l[1].x AS x0, l[1].y AS y0, r[1].x AS x1, r[1].y AS y1, r[2].x AS x2, r[2].y AS y2, l[2].x AS x3, l[2].y AS y3 FROM ({sql_sorted("px", "py")} moved))),
{_TO_PAGE}, {_sql_matrix("page_quads", "pw", "ph")}
SELECT vec_id, q, round(ma / across, 5) + 0.0::DOUBLE AS a, round(mb / down, 5) + 0.0::DOUBLE AS b, round(md / across, 5) + 0.0::DOUBLE AS d, round(me / down, 5) + 0.0::DOUBLE AS e, round(1000 * mg / across, 5) + 0.0::DOUBLE AS g1000, round(1000 * mh / down, 5) + 0.0::DOUBLE AS h1000,
  round((ma / 2 + mb / 2 + mc) / (mg / 2 + mh / 2 + 1), 5) AS centre_x, round((md / 2 + me / 2 + mf) / (mg / 2 + mh / 2 + 1), 5) AS centre_y FROM matrices""")
def page_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix from each quad's page to the frame, by way of four points and four others, and where the page's centre lies. Quads with three points in a line have none."""
    def solved(c: Column) -> Column:
        def matrix(size: Column) -> Column:
            w, h = size["width"].cast("double"), size["height"].cast("double")
            m = g.perspective(g.quad((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h)), c)
            return bind(m, lambda m: F.when(m.isNotNull(), F.struct(m.alias("m"), g.project(m, w / 2, h / 2).alias("p"))))

        return bind(g.page_size(c), matrix)

    found = bind(g.sort_corners(g.to_pixels(F.col("pts"), F.col("w"), F.col("h"))), solved)
    m = quads(spark, sf_dir).select("vec_id", "q", found.alias("s")).where("s is not null").select("vec_id", "q", "s.*")
    at = lambda n, k=1.0: F.round(F.col(f"m.{n}") * k, 5) + 0.0
    return m.select("vec_id", "q", at("a").alias("a"), at("b").alias("b"), at("d").alias("d"), at("e").alias("e"), at("g", 1000).alias("g1000"), at("h", 1000).alias("h1000"), F.round("p.x", 5).alias("centre_x"), F.round("p.y", 5).alias("centre_y"))


_ALONG = "greatest(0, least(src_{s} - 1, ({c} + 0.5::DOUBLE) * src_{s} / {n} - 0.5::DOUBLE)) AS {p}"


def _sql_resized(of: str, values: str, w: str, h: str, to: str) -> str:
    """CTE ``to``: the pixels of ``of`` brought to w x h, expressions of src_w and src_h."""
    n = f"{to}_"
    lists = _lists(of, *values).replace("images AS", f"{n}images AS", 1)
    taps = _sql_taps(f"{n}at").replace("floors", f"{n}floors").replace("taps AS", f"{n}taps AS")
    return f"""{lists}, {n}sizes AS (SELECT *, ({w})::INT AS nw, ({h})::INT AS nh FROM {n}images), {n}at AS (SELECT *, {_ALONG.format(s="w", c="x", n="nw", p="u")}, {_ALONG.format(s="h", c="y", n="nh", p="v")} FROM (SELECT s.*, y::INT AS y, x::INT AS x FROM {n}sizes s, range(128) a(y), range(128) b(x) WHERE y < nh AND x < nw)),
{taps}, {to} AS (SELECT image_id, y, x, {", ".join(_sql_drawn(v, True) for v in values)} FROM {n}taps)"""


@query(f"""WITH {PAGES_SQL}, {_sql_resized("page_px", "rgb", "CASE WHEN greatest(src_w, src_h) > 50 THEN CASE WHEN src_w > src_h THEN 50 ELSE round(src_w * 50 / src_h) END ELSE src_w END", "CASE WHEN greatest(src_w, src_h) > 50 THEN CASE WHEN src_w > src_h THEN round(src_h * 50 / src_w) ELSE 50 END ELSE src_h END", "fitted")},
{_sql_resized("page_px", "rgb", "96", "96", "model")}
SELECT 'fit' AS kind, image_id, y, x, r, g, b FROM fitted UNION ALL SELECT 'model', image_id, y, x, r, g, b FROM model""")
def resized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page reduced to 50 pixels at most, and brought to the square that a model takes."""
    own = page_pixels(spark, sf_dir)
    sizes = page_sizes(own)
    fit = gather.resized_pixels(sizes.withColumn("size", g.fit_within(F.col("src_w"), F.col("src_h"), 50)), own)
    model = gather.resized_pixels(sizes.withColumn("size", g.size(F.lit(96), F.lit(96))), own)
    return fit.withColumn("kind", F.lit("fit")).unionByName(model.withColumn("kind", F.lit("model"))).select("kind", "image_id", "y", "x", "r", "g", "b")


_GRAY_PAGES = f"{PAGES_SQL}, gray_page AS (SELECT image_id, y, x, least(255, greatest(0, round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0)))::INT AS v FROM page_px)"
_QUARTER = "greatest(1, round(src_{s} * 0.25::DOUBLE))"
_PAPER = f"""{_sql_resized("gray_page", "v", _QUARTER.format(s="w"), _QUARTER.format(s="h"), "small")},
bright AS (SELECT p.image_id, p.y, p.x, max(n.v)::INT AS v FROM small p JOIN small n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 6 AND abs(n.y - p.y) <= 6 GROUP BY p.image_id, p.y, p.x),
bright_images AS ({_lists("bright", "v").removeprefix("images AS (")},
still AS (SELECT image_id, y, x, list_sort([vs[(least(src_h - 1, greatest(0, y + d // 13 - 6)) * src_w + least(src_w - 1, greatest(0, x + d % 13 - 6)) + 1)::INT] FOR d IN range(169)])[85] AS v FROM bright JOIN bright_images USING (image_id)),
full_sizes AS (SELECT image_id, max(x) + 1 AS fw, max(y) + 1 AS fh FROM gray_page GROUP BY image_id),
{_sql_resized("still", "v", "(SELECT fw FROM full_sizes f WHERE f.image_id = still_wide_images.image_id)", "(SELECT fh FROM full_sizes f WHERE f.image_id = still_wide_images.image_id)", "still_wide")}"""


@query(f"""WITH {_GRAY_PAGES}, {_PAPER}, even AS (SELECT p.image_id, p.y, p.x, w.v AS bg, CASE WHEN w.v = 0 THEN 0 ELSE least(255, round_even(p.v * 255.0::DOUBLE / greatest(w.v, 1), 0))::INT END AS v FROM gray_page p JOIN still_wide w USING (image_id, y, x)),
ends AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM even),
flat AS (SELECT image_id, y, x, bg, CASE WHEN hi > lo THEN least(255, greatest(0, round_even(v * (255.0::DOUBLE / greatest(hi - lo, 1)) - lo * (255.0::DOUBLE / greatest(hi - lo, 1)), 0)))::INT ELSE v END AS v FROM ends)
SELECT image_id, y, x, bg, CASE WHEN v >= 220 THEN 255 ELSE trunc(pow(v / 220.0::DOUBLE, 2.2::DOUBLE) * 255)::INT END AS v FROM flat""")
def enhanced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the whole document filter, with the paper's brightness that it is divided by."""
    own = page_pixels(spark, sf_dir)
    gray = own.select("image_id", "y", "x", pixels.gray(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    return gather.enhanced_documents(page_sizes(own), gray).select("image_id", "y", "x", "bg", "v")


@query(f"""WITH {_PAGE_CORNERS}, gray_page AS (SELECT image_id, y, x, least(255, greatest(0, round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0)))::INT AS v FROM page_px),
boxed AS (SELECT *, greatest({_EDGES[0]}, {_EDGES[1]}) AS fw, greatest({_EDGES[2]}, {_EDGES[3]}) AS fh FROM sorted_quads), {_sql_matrix("boxed", "fw", "fh")}, {_lists("gray_page", "v")},
wholes AS (SELECT *, greatest(1, trunc(fw))::INT AS pw, greatest(1, trunc(fh))::INT AS ph FROM matrices),
places AS ({_PROJECTED} FROM (SELECT m.*, y, x FROM wholes m, range(128) a(y), range(128) b(x) WHERE y < ph AND x < pw)), {_sql_taps("places", True)},
drawn AS (SELECT t.image_id, q, CASE WHEN ph > pw THEN x ELSE y END AS y, CASE WHEN ph > pw THEN ph - 1 - y ELSE x END AS x, {_sql_drawn("v", True, True)} FROM (SELECT * EXCLUDE (src_w, src_h, v) FROM taps) t JOIN images USING (image_id))
SELECT image_id, q, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height, {_SUMS.format(v="v")} FROM drawn GROUP BY image_id, q""")
def line_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quad cut out of its gray page as a text line: the size, and sums over all pixels, plain and by place."""
    own = page_pixels(spark, sf_dir)
    gray = own.select("image_id", "y", "x", pixels.gray(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    lines = _corners(spark, sf_dir, page_sizes(own)).withColumnRenamed("corners", "box")
    return _summed(gather.line_pixels(lines, gray, keys=("image_id", "q")), ["image_id", "q"], ["v"])


_LINE = [f"{w!r}::DOUBLE" for w in pixels.gaussian_line(3)]


def _sql_near(value: str, before: str, after: str) -> str:
    return f"{value} * {_LINE[1]} + coalesce({before}, {after}, {value}) * {_LINE[0]} + coalesce({after}, {before}, {value}) * {_LINE[2]}"


@query(f"""WITH {_GRAY_PAGES}, {_sql_resized("gray_page", "v", "CASE WHEN greatest(src_w, src_h) > 50 THEN CASE WHEN src_w > src_h THEN 50 ELSE round(src_w * 50 / src_h) END ELSE src_w END", "CASE WHEN greatest(src_w, src_h) > 50 THEN CASE WHEN src_w > src_h THEN round(src_h * 50 / src_w) ELSE 50 END ELSE src_h END", "fitted")},
sides AS (SELECT *, lag(v) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS r FROM fitted), across AS (SELECT image_id, y, x, v, {_sql_near("v", "l", "r")} AS m FROM sides),
ends AS (SELECT *, lag(m) OVER (PARTITION BY image_id, x ORDER BY y) AS u, lead(m) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM across), smooth AS (SELECT image_id, y, x, v, least(255, greatest(0, round_even({_sql_near("m", "u", "d")}, 0)))::INT AS blur FROM ends)
SELECT image_id, y, x, least(255, greatest(0, round_even(v * 1.3::DOUBLE - blur * 0.3::DOUBLE, 0)))::INT AS v FROM smooth""")
def prepared_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gray page reduced to 50 pixels at most and sharpened for recognition."""
    own = page_pixels(spark, sf_dir)
    gray = own.select("image_id", "y", "x", pixels.gray(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    small = gather.resized_pixels(page_sizes(own).withColumn("size", g.fit_within(F.col("src_w"), F.col("src_h"), 50)), gray, ["v"])
    return pixels.sharpened_for_ocr(small).select("image_id", "y", "x", "v")


_WITHIN = f"""boxes AS (SELECT *, greatest(0, least(x0, x1, x2, x3)) AS bx, least(src_w, greatest(x0, x1, x2, x3)) AS ex, greatest(0, least(y0, y1, y2, y3)) AS by_, least(src_h, greatest(y0, y1, y2, y3)) AS ey FROM sorted_quads),
spans AS (SELECT *, ex - bx AS bw, ey - by_ AS bh, ex - bx >= 16 AND ey - by_ >= 16 AS own FROM boxes),
rects AS (SELECT *, CASE WHEN own THEN floor(bx + bw * 0.08::DOUBLE) ELSE 0 END AS sx, CASE WHEN own THEN floor(by_ + bh * 0.08::DOUBLE) ELSE 0 END AS sy, CASE WHEN own THEN greatest(8, floor(bw - bw * 0.08::DOUBLE * 2)) ELSE src_w END AS sw, CASE WHEN own THEN greatest(8, floor(bh - bh * 0.08::DOUBLE * 2)) ELSE src_h END AS sh FROM spans),
cuts AS (SELECT *, least(sw, src_w - sx) AS cw, least(sh, src_h - sy) AS ch, CASE WHEN greatest(sw, sh) <= 24 THEN sw WHEN own AND sw > sh THEN 24 WHEN own THEN round(sw * 24 / sh) ELSE greatest(1, round(sw * (24.0::DOUBLE / greatest(sw, sh)))) END AS dw,
  CASE WHEN greatest(sw, sh) <= 24 THEN sh WHEN own AND sw > sh THEN round(sh * 24 / sw) WHEN own THEN 24 ELSE greatest(1, round(sh * (24.0::DOUBLE / greatest(sw, sh)))) END AS dh FROM rects),
places AS (SELECT image_id * 8 + q AS page, image_id, y::INT AS y, x::INT AS x, sx + greatest(0, least(cw - 1, (x + 0.5::DOUBLE) * cw / dw - 0.5::DOUBLE)) AS u, sy + greatest(0, least(ch - 1, (y + 0.5::DOUBLE) * ch / dh - 0.5::DOUBLE)) AS v FROM cuts, range(24) a(y), range(24) b(x) WHERE y < dh AND x < dw), {_sql_taps("places")},
cut_px AS (SELECT page, y, x, {", ".join(_sql_drawn(n, True) for n in "rgb")} FROM taps JOIN images USING (image_id)),
gray_px AS (SELECT page AS image_id, y, x, least(255, greatest(0, round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0)))::INT AS v FROM cut_px)"""


@query(f"""WITH {_PAGE_CORNERS}, {_lists("page_px", "r", "g", "b")}, {_WITHIN}, {_LAP}, {_METRICS}, judged AS (SELECT *, luma < 105 OR dark > 0.42 AS d, luma < 72 OR dark > 0.62 AS dd, focus < 320 AS b, focus < 140 AS bb FROM metrics)
SELECT image_id AS page_id, round(focus, 4) AS focus, round(luma, 6) AS luma, round(dark, 6) AS dark_ratio, CASE WHEN dd OR bb OR (d AND b) THEN 'poor' WHEN d OR b THEN 'fair' ELSE 'good' END AS level,
  concat_ws(',', CASE WHEN d THEN 'dark' END, CASE WHEN b THEN 'blur' END) AS reasons FROM judged""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, brightness and level of every page within each of its quads, reduced to 24 pixels at most."""
    own = page_pixels(spark, sf_dir)
    pages = _corners(spark, sf_dir, page_sizes(own)).withColumn("page_id", F.col("image_id") * 8 + F.col("q"))
    a = gather.assess_documents(pages, own, most=24)
    return a.select("page_id", F.round("focus", 4).alias("focus"), F.round("luma", 6).alias("luma"), F.round("dark_ratio", 6).alias("dark_ratio"), "level", F.array_join("reasons", ",").alias("reasons"))
