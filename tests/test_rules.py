"""Known cases of the rules, and the rules that browsers and Spark don't share."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.functions import capture_quality as cq
from parchment.functions import filter_mode, jsnum, naming
from parchment.functions import geometry as g
from parchment.sources import preferences

QUAD = "array<struct<x:double,y:double>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def quad(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points]) if points else F.array().cast(QUAD)


def pairs(points):
    return [(p["x"], p["y"]) for p in points]


def test_corners_are_sorted(spark):
    shuffled = [(200, 10), (10, 10), (10, 300), (200, 300)]
    assert pairs(value(spark, g.sort_corners(quad(shuffled)))) == [(10, 10), (200, 10), (200, 300), (10, 300)]
    box = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in [(80, 0), (0, 0), (0, 40), (80, 40)]])
    assert pairs(value(spark, g.sort_corners(g.box_to_quad(box)))) == [(0, 0), (80, 0), (80, 40), (0, 40)]


def test_other_numbers_of_points_stay(spark):
    for points in ([(0, 0), (1, 0), (1, 1)], []):
        assert pairs(value(spark, g.sort_corners(quad(points)))) == points
    assert value(spark, g.sort_corners(F.lit(None).cast(QUAD))) is None


def test_ties_keep_their_order(spark):
    points = [(0, 5), (0, 5), (0, 1), (3, 1)]
    left = sorted(sorted(points, key=lambda p: p[0])[:2], key=lambda p: p[1])
    assert pairs(value(spark, g.sort_corners(quad(points))))[0] == left[0]


def test_distance(spark):
    p = lambda x, y: g.point(F.lit(x), F.lit(y))
    assert values(spark, [g.distance(p(0, 0), p(3, 4)), g.distance(p(1, 1), p(1, 1))]) == [5, 0]


def test_shapes(spark):
    square, zero, trapeze = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (0, 0), (10, 10), (0, 10)], [(0, 0), (10, 0), (7, 10), (3, 10)]
    found = values(spark, [g.is_valid_shape(quad(q), 0.5, 1.4) for q in (square, zero, trapeze, square[:3])])
    assert found == [True, False, False, False]
    assert value(spark, g.is_valid_shape(F.lit(None).cast(QUAD), 0.5)) is False


def test_sizes(spark):
    fit = lambda w, h, m: tuple(value(spark, g.fit_within(F.lit(w), F.lit(h), m)))
    assert [fit(100, 50, 200), fit(4000, 3000, 1920), fit(3000, 4000, 1920), fit(2000, 2000, 1920)] == [(100, 50), (1920, 1440), (1440, 1920), (1920, 1920)]
    assert tuple(value(spark, g.page_size(quad([(0, 0), (0.2, 0), (0.2, 0.3), (0, 0.3)])))) == (1, 1)
    assert value(spark, g.document_roi(quad([(0, 0), (15, 0), (15, 90), (0, 90)]), F.lit(100), F.lit(100))) is None
    assert value(spark, g.whole_frame_roi(F.lit(640), F.lit(480)))["dw"] == 320
    assert tuple(value(spark, g.to_display(g.point(F.lit(1), F.lit(1)), F.lit(0), F.lit(0), F.lit(5), F.lit(5)))) == (0, 0)


def test_default_corners_have_a4_shape(spark):
    for w, h in ((640, 480), (480, 640), (1000, 300), (300, 1000), (500, 500)):
        p = pairs(value(spark, g.default_corners(F.lit(w), F.lit(h))))
        rw, rh = p[1][0] - p[0][0], p[2][1] - p[1][1]
        assert max(rw, rh) / min(rw, rh) == pytest.approx(1.4142)
        assert p[0][0] == pytest.approx(w - p[1][0]) and rw <= w * 0.8 + 1e-9 and rh <= h * 0.8 + 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=4, max_size=4, unique_by=(lambda p: p[0], lambda p: p[1])))
def test_sorting_twice_changes_nothing(spark, points):
    once = g.sort_corners(quad(points))
    a, b, c = values(spark, [once, g.sort_corners(once), g.sort_corners(quad(points[::-1]))])
    assert a == b == c


MODES = [("color_enhanced", "color", "enhanced"), ("color_original", "color", "original"), ("document_enhanced", "document", "enhanced"), ("document_original", "document", "original"), ("mono", "document", "original")]


@pytest.mark.parametrize("mode,color,enhancement", MODES)
def test_filter_modes(spark, mode, color, enhancement):
    m = F.lit(mode)
    assert values(spark, [filter_mode.color_mode(m), filter_mode.enhancement_mode(m)]) == [color, enhancement]
    again = value(spark, filter_mode.combined_mode(filter_mode.color_mode(m), filter_mode.enhancement_mode(m)))
    assert again == ("document_original" if mode == "mono" else mode)


def test_turning(spark):
    assert values(spark, [filter_mode.turned(F.lit(270)), filter_mode.turned(F.lit(0), clockwise=False)]) == [0, 270]


QUALITY = [(520, 140, 0.1, 0, "good", []), (520, 88.5, 0.2, 0, "fair", ["dark"]), (230, 140, 0.1, 0, "fair", ["blur"]), (800, 62, 0.3, 0, "poor", ["dark"]), (400, 140, 0.1, 1000, "fair", ["blur"]), (250, 140, 0.1, 1000, "poor", ["blur"]), (800, 120, 0.7, 0, "poor", ["dark"])]


@pytest.mark.parametrize("focus,luma,dark,peak,level,reasons", QUALITY)
def test_capture_quality(spark, focus, luma, dark, peak, level, reasons):
    q = value(spark, cq.capture_quality(*[F.lit(float(v)) for v in (focus, luma, dark, peak)]))
    assert (q["level"], q["reasons"]) == (level, reasons)


def test_guidance(spark):
    said = lambda level, *reasons: value(spark, cq.guidance(F.lit(level), F.array(*[F.lit(r) for r in reasons]).cast("array<string>")))
    assert said("none") == cq.GUIDANCE["none"] and said("good") == cq.GUIDANCE["good"]
    assert said("fair", "dark", "blur") == said("poor", "dark", "blur") == cq.GUIDANCE["dark,blur"]
    assert said("poor", "dark") == cq.GUIDANCE["dark"] and said("fair", "blur") == cq.GUIDANCE["blur"]
    assert value(spark, cq.frame_colors(F.lit("none")))["stroke"] == cq.COLORS["good"][0]


def test_preferences(spark):
    log = spark.createDataFrame([("a", "true", 1), ("a", "false", 2), ("b", '{"pages":2,"mode":"pdf"}', 1), ("c", "{not-json", 1), ("d", None, 1)], "key string, value string, seq long")
    got = {r["key"]: r["v"] for r in preferences.latest(log).select("key", preferences.load_json(F.col("value"), "7").alias("v")).collect()}
    assert got == {"a": "false", "b": '{"pages":2,"mode":"pdf"}', "c": "7", "d": "7"}
    more = preferences.saved(log, spark.createDataFrame([("a", True, 3)], "key string, value boolean, seq long"))
    assert {r["key"]: r["value"] for r in preferences.latest(more).collect()}["a"] == "true"


def test_numbers(spark):
    rounded = values(spark, [jsnum.round_half_up(F.lit(v)) for v in (-2.5, 2.5, -0.4, 0.49999999999999994)])
    assert rounded == [-2, 3, 0, 0]
    assert values(spark, [jsnum.fixed_exact(F.lit(v)) for v in (1.0005, 2.6755, 0.0625)]) == ["1.000", "2.675", "0.063"]
    assert values(spark, [jsnum.fixed(F.lit(v)) for v in (1.0005, 0.0625, 12.0)]) == ["1.001", "0.063", "12.000"]
    assert values(spark, [jsnum.trim_all(F.lit("　 a　b\t\n")), jsnum.is_blank(F.lit("　 \t"))]) == ["a　b", True]
    assert values(spark, [jsnum.saturate_u8(F.lit(v)) for v in (-3.0, 2.5, 3.5, 300.0)]) == [0, 2, 4, 255]
    assert values(spark, [jsnum.or_default(F.lit(v).cast("double"), 9) for v in (0, None, 4)]) == [9, 9, 4]
    assert value(spark, jsnum.truncate_u8(F.lit(3.99))) == 3 and math.isclose(value(spark, g.zoom_level(F.lit(9.0))), 5)


def test_names(spark):
    stamp = naming.time_stamp(F.lit("2024-03-04 05:06:07").cast("timestamp"))
    name = lambda i, kind: value(spark, naming.page_file_name(stamp, F.lit(i), kind))
    assert (name(0, "png"), name(1233, "jpeg")) == ("Scan_20240304_050607_001.png", "Scan_20240304_050607_1234.jpg")
    assert value(spark, naming.document_file_name(stamp, "pdf")) == "Scan_20240304_050607.pdf"
    hosts = ["localhost", "127.0.0.1", "192.168.1.2", "172.200.0.1", "10.1.1.1", "a.local", "example.com"]
    assert values(spark, [naming.is_local_host(F.lit(h)) for h in hosts]) == [True] * 6 + [False]
    assert value(spark, naming.export_key(F.array(F.lit(5), F.lit(7)), F.array(F.lit(1)))) == "2:5,7:1"


def test_roles_of_model_outputs(spark):
    from parchment.operators import corners

    cases = [["coords", "score"], ["b", "a"], ["score", "x", "coord_logit"], ["coord1", "coord2"], ["one"], [], None, ["logits", "coords", "score", "coords2"]]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, names array<string>").select("i", corners.output_roles(F.col("names")).alias("r")).orderBy("i").collect()
    assert [None if r["r"] is None else tuple(r["r"]) for r in got] == [None if c is None else corners.choose_outputs(c) for c in cases]
