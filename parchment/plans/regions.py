"""Queries on masks: areas, holes, their borders, and the text lines that come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import regions, text_boxes, text_lines
from .geometry import sql_distance, sql_sorted
from .inputs import table
from .registry import query

#: Maps of 32 x 24 probabilities, each of a vector's 64 values on 4 x 3 of them.
_MAP = "map_px AS (SELECT vec_id AS image_id, (i // 32)::INT AS y, (i % 32)::INT AS x, (embedding[(i // 96 * 8 + i % 32 // 4)::INT + 1]::DOUBLE * 2 + 0.3::DOUBLE)::FLOAT::DOUBLE AS p FROM embeddings, range(768) r(i))"
_LABELS = f"""{_MAP},
cells AS MATERIALIZED (SELECT i.image_id, y::INT AS y, x::INT AS x, coalesce(p > 0.3::DOUBLE, false) AS ink, coalesce(p, 0) AS p FROM (SELECT DISTINCT image_id FROM map_px) i CROSS JOIN range(-1, 25) a(y) CROSS JOIN range(-1, 33) b(x) LEFT JOIN map_px USING (image_id, y, x)),
begun AS (SELECT *, CASE WHEN lag(ink) OVER (PARTITION BY image_id, y ORDER BY x) IS DISTINCT FROM ink THEN x END AS b FROM cells),
in_runs AS MATERIALIZED (SELECT image_id, y, x, ink, p, max(b) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM begun),
runs AS MATERIALIZED (SELECT image_id, y, run, bool_and(ink) AS ink, max(x) AS e, (y + 1) * 1000 + run + 1 AS node FROM in_runs GROUP BY image_id, y, run),
links AS MATERIALIZED (SELECT a.image_id, a.node AS a, b.node AS b FROM runs a JOIN runs b ON a.image_id = b.image_id AND b.y = a.y + 1 AND a.ink = b.ink AND a.run <= b.e + a.ink::INT AND b.run <= a.e + a.ink::INT),
ties AS MATERIALIZED (SELECT image_id, a, b FROM links UNION ALL SELECT image_id, b, a FROM links),
named(image_id, node, label) USING KEY (image_id, node) AS (SELECT image_id, node, node FROM runs
  UNION (SELECT t.image_id, t.a, min(n.label) FROM named n JOIN ties t ON t.image_id = n.image_id AND t.b = n.node JOIN recurring.named o ON o.image_id = t.image_id AND o.node = t.a WHERE n.label < o.label GROUP BY t.image_id, t.a)),
lab AS MATERIALIZED (SELECT image_id, y, x, c.ink, p, label FROM in_runs c JOIN runs USING (image_id, y, run) JOIN named USING (image_id, node))"""
_SQUARES = """squares AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.ink AS o, a.label AS l, a.p, sum(a.p) OVER (PARTITION BY a.image_id, a.y ORDER BY a.x) AS s, r.ink AS ro, r.label AS rl, r.p AS rp, u.ink AS uo, u.label AS ul, u.p AS up, d.ink AS d_o, d.label AS dl FROM lab a
  LEFT JOIN lab r ON r.image_id = a.image_id AND r.y = a.y AND r.x = a.x + 1 LEFT JOIN lab u ON u.image_id = a.image_id AND u.y = a.y + 1 AND u.x = a.x LEFT JOIN lab d ON d.image_id = a.image_id AND d.y = a.y + 1 AND d.x = a.x + 1),
cracks AS MATERIALIZED (SELECT image_id, l AS ink, rl AS paper, y, x, p, s AS inside, x + 1 AS n_in, false AS lft FROM squares WHERE o AND NOT ro UNION ALL SELECT image_id, rl, l, y, x + 1, rp, -s, -(x + 1), true FROM squares WHERE NOT o AND ro
  UNION ALL SELECT image_id, l, ul, y, x, p, 0, 0, false FROM squares WHERE o AND NOT uo UNION ALL SELECT image_id, ul, l, y + 1, x, up, 0, 0, false FROM squares WHERE NOT o AND uo),
counted AS (SELECT *, o::INT + ro::INT + uo::INT + d_o::INT AS n, CASE WHEN o THEN l WHEN ro THEN rl WHEN uo THEN ul ELSE dl END AS ink, CASE WHEN NOT o THEN l WHEN NOT ro THEN rl WHEN NOT uo THEN ul ELSE dl END AS paper FROM squares WHERE d_o IS NOT NULL),
steps AS (SELECT image_id, ink, paper, CASE WHEN n = 3 THEN sqrt(2) ELSE 1 END AS step FROM counted WHERE n = 3 OR (n = 2 AND o <> d_o) UNION ALL SELECT image_id, ink, CASE WHEN o THEN rl ELSE l END, sqrt(2) FROM counted WHERE n = 2 AND o = d_o UNION ALL SELECT image_id, ink, CASE WHEN o THEN ul ELSE dl END, sqrt(2) FROM counted WHERE n = 2 AND o = d_o),
lengths AS (SELECT image_id, ink, paper, sum(step) AS length FROM steps GROUP BY ALL),
edge_px AS MATERIALIZED (SELECT DISTINCT image_id, ink, paper, y, x, p FROM cracks),
edge_sums AS (SELECT image_id, ink, paper, sum(p) AS p, count(*) AS n FROM edge_px GROUP BY ALL),
sides AS (SELECT image_id, ink, paper, sum(inside) AS inside, sum(n_in) AS n_in, min(y * 1000 + x) FILTER (lft) AS first FROM cracks GROUP BY ALL),
borders AS MATERIALIZED (SELECT image_id, ink, paper, (row_number() OVER (PARTITION BY image_id ORDER BY first) - 1)::INT AS contour, n_in > 0 AS outside, coalesce(length, 0) AS length, CASE WHEN n_in > 0 THEN inside / n_in ELSE (p - inside) / (n - n_in) END AS score FROM sides JOIN edge_sums USING (image_id, ink, paper) LEFT JOIN lengths USING (image_id, ink, paper)),
kept AS MATERIALIZED (SELECT * FROM borders WHERE length >= 12 AND score >= 0.5)"""
_TURNED = "CASE WHEN dx > 0 AND dy >= 0 THEN {0} WHEN dx <= 0 AND dy > 0 THEN {1} WHEN dx < 0 AND dy <= 0 THEN {2} ELSE {3} END"
_SMALLEST = f"""ends AS (SELECT image_id, contour, y, min(x) AS x0, max(x) AS x1 FROM kept JOIN edge_px USING (image_id, ink, paper) GROUP BY ALL),
points AS MATERIALIZED (SELECT image_id, contour, y, x0 AS x FROM ends UNION SELECT image_id, contour, y, x1 FROM ends),
hull_edges AS (SELECT a.image_id, a.contour, (b.x - a.x)::DOUBLE AS dx, (b.y - a.y)::DOUBLE AS dy FROM points a JOIN points b ON a.image_id = b.image_id AND a.contour = b.contour AND (a.y, a.x) <> (b.y, b.x)
  WHERE NOT EXISTS (SELECT 1 FROM points c WHERE c.image_id = a.image_id AND c.contour = a.contour AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
turned AS (SELECT DISTINCT image_id, contour, {_TURNED.format("dx", "dy", "-dx", "-dy")} AS ex, {_TURNED.format("dy", "-dx", "-dy", "dx")} AS ey FROM hull_edges),
units AS (SELECT DISTINCT image_id, contour, ex / sqrt(ex * ex + ey * ey) AS ux, ey / sqrt(ex * ex + ey * ey) AS uy FROM turned),
spans AS (SELECT image_id, contour, ux, uy, min(x * ux + y * uy) AS a0, max(x * ux + y * uy) AS a1, min(y * ux - x * uy) AS b0, max(y * ux - x * uy) AS b1 FROM units JOIN points USING (image_id, contour) GROUP BY ALL),
rects AS (SELECT image_id, contour, round((a1 - a0) * (b1 - b0), 9) AS area, round(degrees(atan2(uy, ux)), 9) AS angle, a1 - a0 AS rw, b1 - b0 AS rh, (a1 + a0) / 2 * ux - (b1 + b0) / 2 * uy AS cx, (a1 + a0) / 2 * uy + (b1 + b0) / 2 * ux AS cy FROM spans),
smallest AS MATERIALIZED (SELECT * FROM rects QUALIFY row_number() OVER (PARTITION BY image_id, contour ORDER BY area, angle, rw, rh) = 1)"""
_GROWN = "grown AS (SELECT *, rw + 2 * coalesce(rw * rh * 1.8::DOUBLE / nullif(2 * (rw + rh), 0), 0) AS w, rh + 2 * coalesce(rw * rh * 1.8::DOUBLE / nullif(2 * (rw + rh), 0), 0) AS h, angle * pi() / 180 AS t FROM smallest)"
_TURN = ", ".join(f"({sx} * w / 2) * cos(t) - ({sy} * h / 2) * sin(t) + cx AS x{i}, ({sx} * w / 2) * sin(t) + ({sy} * h / 2) * cos(t) + cy AS y{i}" for i, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))))
_ON_PAGE = f"""boxed AS (SELECT image_id, contour, {_TURN} FROM grown), ordered AS ({sql_sorted()} boxed)),
onpage AS (SELECT image_id, contour, {", ".join(f"least(greatest(0, {p}.x * 2), 64)::DOUBLE AS x{i}, least(greatest(0, {p}.y * 2), 48)::DOUBLE AS y{i}" for i, p in enumerate(("l[1]", "r[1]", "r[2]", "l[2]")))} FROM ordered),
fitting AS (SELECT * FROM onpage WHERE {sql_distance(1, 0)} >= 4 AND {sql_distance(3, 0)} >= 4)"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    cell = (F.floor(i / 96) * 8 + F.floor(i % 32 / 4)).cast("int")
    p = (F.get("embedding", cell) * 2 + 0.3).cast("float").cast("double")
    cells = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(767))))
    return cells.select(F.col("vec_id").alias("image_id"), F.floor(i / 32).cast("int").alias("y"), (i % 32).alias("x"), p.alias("p"))


@query(f"""WITH RECURSIVE {_LABELS} SELECT image_id, label::BIGINT AS first_run, ink, count(*) AS size, round(avg(p), 6) AS mean, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM lab WHERE y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 31 GROUP BY ALL""")
def mask_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All areas of ink, holes and backgrounds of every map, with their sizes."""
    p = F.col("p")
    a = regions.areas(regions.labelled(_maps(spark, sf_dir), p > 0.3, p))
    row = F.floor(F.col("label") / regions.ROW)
    name = row * 1000 + F.col("label") % regions.ROW
    return a.select("image_id", name.cast("long").alias("first_run"), F.col("on").alias("ink"), "size", F.round("mean", 6).alias("mean"), F.col("top").alias("y0"), F.col("left").alias("x0"), F.col("bottom").alias("y1"), F.col("right").alias("x1"))


@query(f"""WITH RECURSIVE {_LABELS}, {_SQUARES}, {_SMALLEST} SELECT image_id, contour, outside, round(score, 6) AS score, round(area, 6) AS area, round(angle, 6) + 0.0 AS angle, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy FROM smallest JOIN kept USING (image_id, contour)""")
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borders of every map that may hold text, with their scores and smallest rectangles."""
    r = regions.text_regions(_maps(spark, sf_dir))
    at = lambda c: F.round(c, 6) + 0.0
    return r.select("image_id", "contour", F.col("outer").alias("outside"), F.round("score", 6).alias("score"), F.round(F.col("rw") * F.col("rh"), 6).alias("area"), at("angle").alias("angle"), at("cx").alias("cx"), at("cy").alias("cy"))


@query(f"""WITH RECURSIVE {_LABELS}, {_SQUARES}, {_SMALLEST}, {_GROWN}, {_ON_PAGE},
sized AS (SELECT *, greatest({sql_distance(0, 1)}, {sql_distance(3, 2)}) AS w, greatest({sql_distance(0, 3)}, {sql_distance(1, 2)}) AS h FROM fitting)
SELECT image_id, contour, (row_number() OVER (PARTITION BY image_id ORDER BY round((y0 + y1 + y2 + y3) / 4, 9), contour) - 1)::INT AS line_no, round(score, 6) AS score, round(w, 6) AS width, round(h, 6) AS height FROM sized JOIN kept USING (image_id, contour)""")
def text_lines_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text boxes of every map on a page of twice its size, in reading order."""
    rects = regions.text_regions(_maps(spark, sf_dir)).withColumns({"map_w": F.lit(32), "map_h": F.lit(24), "page_w": F.lit(64), "page_h": F.lit(48)})
    lines = text_boxes.in_reading_order(text_boxes.boxes_on_page(rects))
    w, h = g.edge_sizes(F.col("box"))
    return lines.select("image_id", "contour", "line_no", F.round("score", 6).alias("score"), F.round(w, 6).alias("width"), F.round(h, 6).alias("height"))
