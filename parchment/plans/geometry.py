"""Queries on corners, boxes and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filter_mode, naming
from ..functions import geometry as g
from ..operators import corners, text_boxes, text_lines
from .inputs import QUADS_SQL, quads, table
from .registry import query


def _flat(q: str, digits: int = 6) -> list:
    """x0, y0 .. x3, y3 of a quad."""
    return [F.round(F.col(q)[i][c], digits).alias(f"{c}{i}") for i in range(4) for c in "xy"]


# ---- the same rules in SQL, on quads as columns x0, y0 .. x3, y3 -------------------------------------------------------


def sql_sorted(x: str = "x", y: str = "y") -> str:
    """Columns TL, TR, BR, BL as structs (y, x), from pts."""
    pts = ", ".join(f"{{'x': {x}{i}, 'y': {y}{i}}}" for i in range(4))
    half = lambda a, b: f"list_sort([{{'y': s[{a}].y, 'x': s[{a}].x}}, {{'y': s[{b}].y, 'x': s[{b}].x}}])"
    return f"SELECT * EXCLUDE (s), {half(1, 2)} AS l, {half(3, 4)} AS r FROM (SELECT *, list_sort([{pts}]) AS s FROM"


def sql_xy(p: str, digits: int = 6) -> str:
    corner = ["l[1]", "r[1]", "r[2]", "l[2]"]
    return ", ".join(f"round({corner[i]}.{c}, {digits}) AS {c}{i}" for i in range(4) for c in "xy") if p == "sorted" else ""


def sql_distance(a: int, b: int) -> str:
    return f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2)"


def sql_area() -> str:
    return "0.5 * abs(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - y{i} * x{(i + 1) % 4})" for i in range(4)) + ")"


def sql_valid(most_cos: float, most_ratio: float) -> str:
    edge = [sql_distance(i, (i + 1) % 4) for i in range(4)]
    tests = [f"{e} > 0" for e in edge]
    for i in range(4):
        a, b = (i + 3) % 4, (i + 1) % 4
        dot = f"((x{a} - x{i}) * (x{b} - x{i}) + (y{a} - y{i}) * (y{b} - y{i}))"
        tests.append(f"abs({dot} / nullif({edge[a]} * {edge[i]}, 0)) <= {most_cos}")
    tests += [f"greatest({edge[a]}, {edge[b]}) / nullif(least({edge[a]}, {edge[b]}), 0) <= {most_ratio}" for a, b in ((0, 2), (3, 1))]
    return "coalesce(" + " AND ".join(tests) + ", false)"


def sql_default(c: str, i: int) -> str:
    """A coordinate of the default corners of w x h."""
    w, h = "w::DOUBLE", "h::DOUBLE"
    rw = f"CASE WHEN h > w THEN CASE WHEN {w} * 0.75 * 1.4142 > {h} * 0.8 THEN {h} * 0.8 / 1.4142 ELSE {w} * 0.75 END ELSE least({h} * 0.75 * 1.4142, {w} * 0.8) END"
    rh = f"CASE WHEN h > w THEN least({w} * 0.75 * 1.4142, {h} * 0.8) ELSE CASE WHEN {h} * 0.75 * 1.4142 > {w} * 0.8 THEN {w} * 0.8 / 1.4142 ELSE {h} * 0.75 END END"
    side, all_ = (rw, w) if c == "x" else (rh, h)
    start = f"({all_} - ({side})) / 2"
    return f"({start} + ({side}))" if (c, i) in (("x", 1), ("x", 2), ("y", 2), ("y", 3)) else f"({start})"


_DETECTED = f"""detected AS (SELECT *, (1 / (1 + exp(-logit)) >= 0.5 AND ({sql_area()}) BETWEEN 0.05 AND 0.90 AND {sql_valid(0.5, 1.4)}) AS found, {sql_area()} AS area FROM quads),
moved AS (SELECT vec_id, label, q, w, h, found, area, {", ".join(f"greatest(0, least({s}, {c}{i} * {s}))::DOUBLE AS p{c}{i}" for i in range(4) for c, s in (("x", "w"), ("y", "h")))} FROM detected),
ordered AS ({sql_sorted("px", "py")} moved)),
four AS (SELECT vec_id, label, q, w, h, found, area, l[1].x AS x0, l[1].y AS y0, r[1].x AS x1, r[1].y AS y1, r[2].x AS x2, r[2].y AS y2, l[2].x AS x3, l[2].y AS y3 FROM ordered),
judged AS (SELECT *, found AND {sql_valid(0.24, 1.25)} AS strict FROM four),
final AS (SELECT vec_id, label, q, w, h, found, area, strict, {", ".join(f"CASE WHEN strict THEN {c}{i} ELSE {sql_default(c, i)} END AS {c}{i}" for i in range(4) for c in "xy")} FROM judged)"""
_SIZE_W = f"greatest(1, round(greatest({sql_distance(0, 1)}, {sql_distance(3, 2)})))::INT"
_SIZE_H = f"greatest(1, round(greatest({sql_distance(0, 3)}, {sql_distance(1, 2)})))::INT"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corners.detect_corners(quads(spark, sf_dir))
    return found.withColumns({"area": g.quad_area(F.col("pts")), "size": g.page_size(F.col("page"))})


@query(f"WITH {QUADS_SQL}, {_DETECTED} SELECT label, count(*) AS n, round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS found_share, round(avg(CASE WHEN strict THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS strict_share, round(avg(area), 6) AS mean_area, max({_SIZE_W}) AS widest, max({_SIZE_H}) AS highest FROM final GROUP BY label")
def page_detection_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often pages are found, and how large: the flagship, with one shuffle of partial sums."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return _detected(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), share(F.col("corners").isNotNull()).alias("found_share"), share(F.col("strict")).alias("strict_share"), F.round(F.avg("area"), 6).alias("mean_area"), F.max("size.width").alias("widest"), F.max("size.height").alias("highest"))


@query(f"WITH {QUADS_SQL}, {_DETECTED} SELECT vec_id, q, found, strict, {', '.join(f'round({c}{i}, 6) AS {c}{i}' for i in range(4) for c in 'xy')}, {_SIZE_W} AS width, {_SIZE_H} AS height FROM final")
def corner_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model output with its page corners, by detection or by default."""
    return _detected(spark, sf_dir).select("vec_id", "q", F.col("corners").isNotNull().alias("found"), "strict", *_flat("page"), "size.width", "size.height")


_TURNED = "turned AS (SELECT vec_id, q, " + ", ".join(f"CASE vec_id % 4 {' '.join(f'WHEN {k} THEN {c}{(i + k) % 4}' for k in range(4))} END AS {c}{i}" for i in range(4) for c in "xy") + " FROM quads)"


@query(f"WITH {QUADS_SQL}, {_TURNED}, ordered AS ({sql_sorted()} turned)) SELECT vec_id, q, {sql_xy('sorted')}, round(sqrt((l[1].x - r[1].x) ** 2 + (l[1].y - r[1].y) ** 2), 6) AS top_edge FROM ordered")
def sorted_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("pts", ((i + F.col("vec_id")) % 4).cast("int")))
    s = quads(spark, sf_dir).withColumn("s", g.sort_corners(turn))
    return s.select("vec_id", "q", *_flat("s"), F.round(g.distance(F.col("s")[0], F.col("s")[1]), 6).alias("top_edge"))


_SIZES = "sizes AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 4000 + 1)::INT AS w, (o_custkey * 53 % 4000 + 1)::INT AS h FROM orders)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 37 % 4000 + 1).cast("int").alias("w"), (F.col("o_custkey") * 53 % 4000 + 1).cast("int").alias("h"))


def _sql_fit(m: int) -> tuple[str, str]:
    over = f"(w > {m} OR h > {m})"
    return f"(CASE WHEN {over} THEN CASE WHEN w > h THEN {m} ELSE round(w * {m}.0::DOUBLE / h) END ELSE w END)::INT", f"(CASE WHEN {over} THEN CASE WHEN w > h THEN round(h * {m}.0::DOUBLE / w) ELSE {m} END ELSE h END)::INT"


_PDF = "(CASE WHEN greatest(w, h) > 1600 THEN round({0} * (1600.0::DOUBLE / greatest(w, h))) ELSE {0} END)::INT"
_DET = "(round({0} * (2240.0::DOUBLE / greatest(w, h)) / 32) * 32)::INT"


@query(f"""WITH {_SIZES} SELECT k, {_sql_fit(1920)[0]} AS fit_w, {_sql_fit(1920)[1]} AS fit_h, {_PDF.format("w")} AS pdf_w, {_PDF.format("h")} AS pdf_h, {_DET.format("w")} AS det_w, {_DET.format("h")} AS det_h,
  least(1024, greatest(16, round(48 * (w::DOUBLE / h))))::INT AS line_w, greatest(1, round(w * least(1.0::DOUBLE, 320.0::DOUBLE / greatest(w, h))))::INT AS roi_w, round({sql_default("x", 0)}, 6) AS left_x, round({sql_default("y", 2)}, 6) AS bottom_y FROM sizes""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that an image is brought to for export, PDF, text detection, recognition and scoring; its default corners."""
    w, h = F.col("w"), F.col("h")
    s = _sizes(spark, sf_dir).withColumns({"fit": g.fit_within(w, h, 1920), "pdf": g.scaled_size(w, h, 1600), "det": text_boxes.detector_size(w, h), "roi": g.whole_frame_roi(w, h), "corners": g.default_corners(w, h)})
    both = [F.col(f"{c}.{side}").alias(f"{c}_{side[0]}") for c in ("fit", "pdf", "det") for side in ("width", "height")]
    return s.select("k", *both, text_lines.line_width(w, h).alias("line_w"), F.col("roi.dw").alias("roi_w"), F.round(F.col("corners")[0]["x"], 6).alias("left_x"), F.round(F.col("corners")[2]["y"], 6).alias("bottom_y"))


_BOUNDS = "bounds AS (SELECT vec_id, q, greatest(0, list_min([x0, x1, x2, x3]) * 640)::DOUBLE AS a, least(640, list_max([x0, x1, x2, x3]) * 640)::DOUBLE AS b, greatest(0, list_min([y0, y1, y2, y3]) * 480)::DOUBLE AS c, least(480, list_max([y0, y1, y2, y3]) * 480)::DOUBLE AS d FROM quads)"


@query(f"""WITH {QUADS_SQL}, {_BOUNDS}, cut AS (SELECT vec_id, q, floor(a + (b - a) * 0.08::DOUBLE)::INT AS sx, floor(c + (d - c) * 0.08::DOUBLE)::INT AS sy, greatest(8, floor((b - a) - (b - a) * 0.08::DOUBLE * 2))::INT AS sw, greatest(8, floor((d - c) - (d - c) * 0.08::DOUBLE * 2))::INT AS sh FROM bounds WHERE b - a >= 16 AND d - c >= 16)
SELECT vec_id, q, sx, sy, sw, sh, (CASE WHEN sw > 320 OR sh > 320 THEN CASE WHEN sw > sh THEN 320 ELSE round(sw * 320.0::DOUBLE / sh) END ELSE sw END)::INT AS dw, (CASE WHEN sw > 320 OR sh > 320 THEN CASE WHEN sw > sh THEN round(sh * 320.0::DOUBLE / sw) ELSE 320 END ELSE sh END)::INT AS dh FROM cut""")
def document_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.lit(640), F.lit(480)
    pixels = g.scale_quad(F.col("pts"), w.cast("double"), h.cast("double"))
    return quads(spark, sf_dir).withColumn("roi", g.document_roi(pixels, w, h, 320)).where("roi is not null").select("vec_id", "q", "roi.*")


@query(f"""WITH {QUADS_SQL}, px AS (SELECT vec_id, q, x0 * 640 AS x, y0 * 480 AS y FROM quads),
moved AS (SELECT *, least(320.0::DOUBLE, greatest(0.0::DOUBLE, x * 0.6::DOUBLE)) AS bx, least(200.0::DOUBLE, greatest(0.0::DOUBLE, y * 0.6::DOUBLE)) AS by_ FROM px)
SELECT vec_id, q, round(x / 640 * 320, 6) AS display_x, round(y / 480 * 200, 6) AS display_y, round(bx / 320 * 640, 6) AS moved_x, round(least(480, by_ / 200 * 480), 6) AS moved_y,
  round(least(greatest(0, x), 640), 6) AS clamped_x, (1 + q % 5)::DOUBLE AS zoom, round(CASE WHEN 4.0 / 3 > 1.6 THEN 320 ELSE 200 * (640.0::DOUBLE / 480) END * (1 + q % 5), 6) AS shown_w,
  round(greatest(-greatest(0, (200 * (640.0::DOUBLE / 480) * (1 + q % 5) - 320) / 2), least(greatest(0, (200 * (640.0::DOUBLE / 480) * (1 + q % 5) - 320) / 2), x - 320)), 6) + 0 AS pan_x FROM moved""")
def crop_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners on the display and back, a moved corner, zoom and pan."""
    n = lambda v: F.lit(float(v))
    iw, ih, dw, dh = n(640), n(480), n(320), n(200)
    q = quads(spark, sf_dir).withColumn("px", g.scale_quad(F.col("pts"), iw, ih))
    p = F.col("px")[0]
    shown = g.to_display(p, iw, ih, dw, dh)
    moved = g.move_corner(F.col("px"), F.lit(0), g.point(p["x"] * 0.6, p["y"] * 0.6), iw, ih, dw, dh)[0]
    inside = g.clamp_corners(F.array(p, p, p, p), iw, ih)[0]["x"]
    zoom = g.zoom_level((1 + F.col("q") % 5).cast("double"))
    size = g.contained_size(iw, ih, dw, dh, zoom)
    pan = g.bounded_pan(g.point(p["x"] - 320, p["y"]), size, dw, dh)
    out = {"display_x": shown["x"], "display_y": shown["y"], "moved_x": moved["x"], "moved_y": moved["y"], "clamped_x": inside, "zoom": zoom, "shown_w": size["width"], "pan_x": pan["x"]}
    return q.select("vec_id", "q", *[F.round(c, 6).alias(k) for k, c in out.items()])


_RECTS = "rects AS (SELECT vec_id, q AS contour, x0 * 200 AS cx, y0 * 100 AS cy, 4 + 100 * abs(x1 - x0)::DOUBLE AS rw, 1 + 10 * abs(y2 - y1)::DOUBLE AS rh, (q * 7 - 20)::DOUBLE AS angle FROM quads)"
_GROWN = "grown AS (SELECT *, rw + 2 * (rw * rh * 1.8::DOUBLE / (2 * (rw + rh))) AS w, rh + 2 * (rw * rh * 1.8::DOUBLE / (2 * (rw + rh))) AS h, angle * pi() / 180 AS t FROM rects)"
_TURN = ", ".join(f"({sx} * w / 2) * cos(t) - ({sy} * h / 2) * sin(t) + cx AS x{i}, ({sx} * w / 2) * sin(t) + ({sy} * h / 2) * cos(t) + cy AS y{i}" for i, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))


@query(f"""WITH {QUADS_SQL}, {_RECTS}, {_GROWN}, turned AS (SELECT vec_id, contour, {_TURN} FROM grown), ordered AS ({sql_sorted()} turned)),
onpage AS (SELECT vec_id, contour, {", ".join(f"least(greatest(0, {p}.x * 3), 600)::DOUBLE AS x{i}, least(greatest(0, {p}.y * 4), 400)::DOUBLE AS y{i}" for i, p in enumerate(("l[1]", "r[1]", "r[2]", "l[2]")))} FROM ordered),
kept AS (SELECT * FROM onpage WHERE {sql_distance(1, 0)} >= 4 AND {sql_distance(3, 0)} >= 4)
SELECT vec_id, contour, (row_number() OVER (PARTITION BY vec_id ORDER BY round((y0 + y1 + y2 + y3) / 4, 9), contour) - 1)::INT AS line_no, {", ".join(f"round({c}{i}, 6) AS {c}{i}" for i in range(4) for c in "xy")}, round(greatest({sql_distance(0, 1)}, {sql_distance(3, 2)}), 6) AS crop_w FROM kept""")
def text_box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotated rectangles grown, mapped to the page and put in reading order."""
    q = quads(spark, sf_dir)
    p = lambda i, c: F.col("pts")[i][c]
    rects = q.select("vec_id", F.col("q").alias("contour"), (p(0, "x") * 200).alias("cx"), (p(0, "y") * 100).alias("cy"), (4 + 100 * F.abs(p(1, "x") - p(0, "x"))).alias("rw"), (1 + 10 * F.abs(p(2, "y") - p(1, "y"))).alias("rh"), (F.col("q") * 7 - 20).cast("double").alias("angle"), F.lit(200).alias("map_w"), F.lit(100).alias("map_h"), F.lit(600).alias("page_w"), F.lit(400).alias("page_h"))
    lines = text_boxes.in_reading_order(text_boxes.boxes_on_page(rects), "vec_id")
    return lines.select("vec_id", "contour", "line_no", *_flat("box"), F.round(g.edge_sizes(F.col("box"))[0], 6).alias("crop_w"))


_MODES = "modes AS (SELECT event_id, user_id, ts, ['color_enhanced', 'color_original', 'document_enhanced', 'document_original', 'mono'][list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)] AS mode FROM events)"


@query(f"WITH {_MODES} SELECT event_id, mode, CASE WHEN mode LIKE 'color%' THEN 'color' ELSE 'document' END AS color, CASE WHEN mode LIKE '%enhanced' THEN 'enhanced' ELSE 'original' END AS enhancement, CASE WHEN mode = 'mono' THEN 'document_original' ELSE mode END AS combined, (sum(CASE WHEN event_id % 3 = 0 THEN 270 ELSE 90 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 360)::INT AS rotation FROM modes")
def filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes taken apart and put together, and the rotation after each turn of a session."""
    from ..operators.sessions import rotation_after

    kinds = ("click", "error", "purchase", "signup", "view")
    m = table(spark, sf_dir, "events").withColumn("mode", F.element_at(F.array(*[F.lit(x) for x in filter_mode.MODES]), F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")))
    mode = F.col("mode")
    turns = m.select("event_id", "mode", F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, -90).otherwise(90).alias("delta"))
    found = rotation_after(turns).withColumns({"color": filter_mode.color_mode(mode), "enhancement": filter_mode.enhancement_mode(mode)})
    return found.select("event_id", "mode", "color", "enhancement", filter_mode.combined_mode(F.col("color"), F.col("enhancement")).alias("combined"), "rotation")


@query("""SELECT page_id, host, host IN ('localhost', '127.0.0.1') OR starts_with(host, '192.168.') OR starts_with(host, '172.') OR starts_with(host, '10.') OR ends_with(host, '.local') AS is_local
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'localhost' WHEN 1 THEN '192.168.0.' || page_id WHEN 2 THEN '172.99.1.1' WHEN 3 THEN 'printer.local' WHEN 4 THEN '11.0.0.1' ELSE regexp_extract(url, '://([^/?#]*)', 1) END AS host FROM pages)""")
def local_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 6
    host = F.when(i == 0, "localhost").when(i == 1, F.concat(F.lit("192.168.0."), F.col("page_id").cast("string"))).when(i == 2, "172.99.1.1").when(i == 3, "printer.local").when(i == 4, "11.0.0.1").otherwise(F.regexp_extract("url", "://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), naming.is_local_host(host).alias("is_local"))
