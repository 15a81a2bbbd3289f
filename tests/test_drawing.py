"""Images drawn from tables of pixels equal the same kernels on packed images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchment.functions import geometry as g
from parchment.operators import gather, page_images
from parchment.plans import registry

QUAD = "array<struct<x:double,y:double>>"
SIZE = "struct<width:int,height:int>"


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(8)
    smooth = np.cumsum(rng.integers(-9, 10, (45, 71, 3)), axis=1) % 256
    return {1: rng.integers(0, 256, (45, 71, 3)), 2: smooth, 3: rng.integers(0, 256, (1, 5, 3)), 4: np.zeros((40, 33, 3), int), 5: rng.integers(0, 256, (66, 64, 3))}


@pytest.fixture(scope="module")
def table(spark, images):
    rows = [pd.DataFrame({"image_id": k, "y": np.repeat(np.arange(a.shape[0]), a.shape[1]), "x": np.tile(np.arange(a.shape[1]), a.shape[0])} | {c: a[..., i].ravel() for i, c in enumerate("rgb")}) for k, a in images.items()]
    return spark.createDataFrame(pd.concat(rows)).withColumns({c: F.col(c).cast("int") for c in ("y", "x", "r", "g", "b")}).cache()


@pytest.fixture(scope="module")
def sizes(spark, images):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in images.items()], "image_id long, src_w int, src_h int")


def packed(df, keys, values="rgb"):
    """Arrays by key from a table of pixels; every pixel is there once."""
    out = {}
    for key, own in df.toPandas().groupby(keys if len(keys) > 1 else keys[0]):
        own = own.sort_values(["y", "x"])
        h, w = own["y"].max() + 1, own["x"].max() + 1
        assert len(own) == h * w and own["y"].tolist() == np.repeat(np.arange(h), w).tolist()
        out[key] = np.stack([own[v].to_numpy().reshape(h, w) for v in values], axis=2)
    return out


def quads_of(rng, images):
    found = []
    for k, a in images.items():
        h, w = a.shape[:2]
        for n in range(3):
            x, y = (rng.uniform(-0.15, 0.35, 4) for _ in "xy")
            q = [(w * (u if u < 2 else u), h * v) for u, v in zip((x[0], 1 - x[1], 1 - x[2], x[3]), (y[0], y[1], 1 - y[2], 1 - y[3]), strict=True)]
            found.append((k, n, q))
    return found


@pytest.mark.parametrize("tile", [8, 32])
def test_rectified_pages(spark, images, table, sizes, tile, monkeypatch):
    monkeypatch.setattr(gather.gathered, "__defaults__", (*gather.gathered.__defaults__[:-1], tile))
    quads = quads_of(np.random.default_rng(tile), images)
    pages = spark.createDataFrame([(k, n, [{"x": float(x), "y": float(y)} for x, y in q], {"width": 50 + n, "height": 37 - n}) for k, n, q in quads], f"image_id long, n int, corners {QUAD}, page_size {SIZE}")
    got = packed(gather.rectified_pixels(pages.join(sizes, "image_id"), table, keys=("image_id", "n"), source_keys=("image_id",)), ["image_id", "n"])
    assert len(got) == len(quads)
    for k, n, q in quads:
        want = page_images.warped(images[k].astype(np.uint8), np.array(q), 50 + n, 37 - n)
        off = np.abs(got[k, n] - want.astype(int))
        assert off.max() <= 1 and (off > 0).mean() < 0.001  # two ways to solve for the matrix may part at a tie


def test_resized_pages(spark, images, table, sizes):
    wanted = {1: (30, 80), 2: (142, 90), 3: (9, 4), 4: (1, 1), 5: (64, 66)}
    to = spark.createDataFrame([(k, {"width": w, "height": h}) for k, (w, h) in wanted.items()], f"image_id long, size {SIZE}")
    got = packed(gather.resized_pixels(to.join(sizes, "image_id"), table), ["image_id"])
    for k, (w, h) in wanted.items():
        assert (got[k] == page_images.resized(images[k].astype(np.uint8), w, h)).all()


def test_text_lines(spark, images, table, sizes):
    quads = quads_of(np.random.default_rng(3), images)
    lines = spark.createDataFrame([(k, n, [{"x": float(x), "y": float(y)} for x, y in q]) for k, n, q in quads], f"image_id long, line_no int, box {QUAD}")
    got = packed(gather.line_pixels(lines.join(sizes, "image_id"), table, ["r", "g", "b"]), ["image_id", "line_no"])
    for k, n, q in quads:
        want = page_images.crop_line(images[k].astype(np.uint8), np.array(q))
        assert got[k, n].shape == want.shape
        off = np.abs(got[k, n] - want.astype(int))
        assert off.max() <= 1 and (off > 0).mean() < 0.001


@pytest.mark.parametrize("size", [3, 13])
def test_medians(images, table, size):
    got = packed(gather.median_pixels(table.withColumnRenamed("r", "v"), size, tile=16), ["image_id"], "v")
    for k, a in images.items():
        around = np.lib.stride_tricks.sliding_window_view(np.pad(a[..., 0], size // 2, mode="edge"), (size, size))
        assert (got[k][..., 0] == np.median(around, axis=(2, 3))).all()


def test_document_filter(spark, images, table, sizes):
    gray = table.select("image_id", "y", "x", F.expr("cast(rint(r * 0.299 + g * 0.587 + b * 0.114) as int)").alias("v"))
    got = packed(gather.enhanced_documents(sizes, gray), ["image_id"], ["v", "bg"])
    for k, a in images.items():
        v = page_images.gray(a.astype(np.uint8))
        assert (got[k][..., 1] == page_images.background(v)).all() and (got[k][..., 0] == page_images.enhanced_document(a.astype(np.uint8))).all()


def test_odd_pixels_and_pages(spark, table, sizes):
    """Repeated pixels count once; a missing, null or contradictory one spoils its tile only; pages without a quad have no pixels."""
    own = table.where("image_id = 1")
    quad = [{"x": 0.0, "y": 0.0}, {"x": 71.0, "y": 0.0}, {"x": 71.0, "y": 45.0}, {"x": 0.0, "y": 45.0}]
    line = [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 5.0}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 45.0}]
    size = {"width": 71, "height": 45}
    rows = [(1, 0, quad, size), (1, 1, None, size), (1, 2, quad[:3], size), (1, 3, line, size), (1, 4, quad, None), (1, 5, quad, {"width": 0, "height": 3}), (9, 6, quad, size), (None, 7, quad, size)]
    pages = spark.createDataFrame(rows, f"image_id long, n int, corners {QUAD}, page_size {SIZE}").withColumns({"src_w": F.lit(71), "src_h": F.lit(45), "_m": F.lit("mine"), "u": F.lit("mine"), "r": F.lit("mine"), "y": F.lit("mine")})
    draw = lambda px: gather.rectified_pixels(pages, px, keys=("image_id", "n"), source_keys=("image_id",)).toPandas()
    whole = draw(own.withColumns({"_ty": F.lit(1), "u": F.lit(2)}))
    assert sorted(set(whole["n"])) == [0, 6, 7] and len(whole) == 3 * 71 * 45
    assert whole[whole["n"] > 0]["r"].isna().all()
    first = whole[whole["n"] == 0].sort_values(["y", "x"])["r"].tolist()
    assert first == [r[0] for r in own.orderBy("y", "x").select("r").collect()]
    twice = draw(own.unionByName(own))
    assert twice[twice["n"] == 0].sort_values(["y", "x"])["r"].tolist() == first
    changed = (own.where("not (x = 3 and y = 4)"), own.unionByName(own.where("x = 3 and y = 4").withColumn("r", (F.col("r") + 1) % 256)), own.withColumn("r", F.when(~((F.col("x") == 3) & (F.col("y") == 4)), F.col("r"))))
    for px in changed:
        got = draw(px).query("n == 0")
        spoilt = got["r"].isna()
        assert (spoilt == ((got["x"] < 32) & (got["y"] < 32))).all()
    assert gather.rectified_pixels(pages.limit(0), own, keys=("image_id", "n"), source_keys=("image_id",)).count() == 0
    assert draw(own.limit(0)).query("n == 0")["r"].isna().all()
    assert gather.median_pixels(own.withColumnRenamed("r", "v").limit(0)).count() == 0
    assert gather.enhanced_documents(sizes.limit(0), own.withColumnRenamed("r", "v")).count() == 0


def test_quality_within_corners(spark, images, table, sizes):
    """As on packed images: within the corners, or of the whole image where they are too small or none."""
    quads = [*quads_of(np.random.default_rng(4), images), *[(k, 3, None) for k in images], *[(k, 4, [(0, 0), (9, 0), (9, 9), (0, 9)]) for k in images], *[(k, 5, [(a.shape[1] - 17, a.shape[0] - 17), (a.shape[1], a.shape[0] - 17), (a.shape[1], a.shape[0]), (a.shape[1] - 17, a.shape[0])]) for k, a in images.items()]]
    rows = [(10 * k + n, k, None if q is None else [{"x": float(x), "y": float(y)} for x, y in q]) for k, n, q in quads]
    pages = spark.createDataFrame(rows, f"page_id long, image_id long, corners {QUAD}")
    got = {r["page_id"]: r for r in gather.assess_documents(pages.join(sizes, "image_id"), table, 20).collect()}
    packed_ = spark.createDataFrame([(p, page_images.as_image(images[k].astype(np.uint8)), c) for p, k, c in rows], f"image_id long, image {page_images.IMAGE}, corners {QUAD}")
    w, h = F.col("image.width"), F.col("image.height")
    roi = F.coalesce(g.document_roi(F.col("corners"), w, h, 20), g.whole_frame_roi(w, h, 20))
    assert len(got) == len(rows)
    for r in packed_.select("image_id", "image", roi.alias("r")).collect():
        c = r["r"]
        cut = page_images.as_array(r["image"])[c["sy"] : c["sy"] + c["sh"], c["sx"] : c["sx"] + c["sw"]]
        own = got[r["image_id"]]
        assert [own["focus"], own["luma"], own["dark_ratio"]] == pytest.approx(page_images.measured(page_images.resized(cut, c["dw"], c["dh"])))


def test_perspective(spark):
    rng = np.random.default_rng(1)
    quads = [[(float(x), float(y)) for x, y in np.array([(0, 0), (9, 0), (9, 7), (0, 7)]) + rng.uniform(-2, 2, (4, 2))] for _ in range(40)]
    rows = [(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, (a, b) in enumerate(zip(quads[:20], quads[20:], strict=True))]
    rows += [(20, None, rows[0][1]), (21, rows[0][1][:3], rows[0][1]), (22, [{"x": float(i), "y": float(i)} for i in range(4)], rows[0][1]), (23, [rows[0][1][0]] * 4, rows[0][1])]
    df = spark.createDataFrame(rows, f"i int, a {QUAD}, b {QUAD}").withColumn("m", g.perspective(F.col("a"), F.col("b")))
    seen = df.select("i", "m", g.project(F.col("m"), F.lit(3.0), F.lit(4.0)).alias("p")).orderBy("i").collect()
    for i, (a, b) in enumerate(zip(quads[:20], quads[20:], strict=True)):
        want = page_images.homography(np.array(a), np.array(b))
        assert np.allclose([*seen[i]["m"], 1.0], want.ravel())
        u, v, s = want @ [3.0, 4.0, 1.0]
        assert np.allclose([seen[i]["p"]["x"], seen[i]["p"]["y"]], [u / s, v / s])
    assert all(r["m"] is None for r in seen[20:])


def test_new_pixels_do_not_move(spark, table, sizes):
    """What meets the tiles is a row for each block and tile, not one for each new pixel; odd values, and more than one number can pack, are as they were."""
    big = sizes.withColumn("size", F.struct(F.lit(200).alias("width"), F.lit(150).alias("height")))
    df = gather.resized_pixels(big, table)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan[plan.index("Join LeftOuter") :].splitlines() if "Aggregate" in line or "Generate" in line]
    assert "Aggregate" in below[0]
    many = table.selectExpr("image_id", "y", "x", "r", "g", "b", "cast(r as double) c0", "g - 300 c1", "b * 100 c2")
    held = {(r["image_id"], r["_ty"], r["_tx"]): r for r in gather.tiles(many, ["r", "g", "b", "c0", "c1", "c2"], 0, 1).where("image_id = 2").collect()}
    for r in held.values():
        assert r["_c0"] == r["_r"] and [v - 300 for v in r["_g"]] == r["_c1"] and [v * 100 for v in r["_b"]] == r["_c2"]
    twice = gather.resized_pixels(big.where("image_id = 3").unionByName(big.where("image_id = 3")), table)
    assert twice.count() == 2 * 200 * 150


def test_no_row_is_made_of_a_place(spark, table, sizes):
    """Places are numbers in batches, of images dealt out to all tasks; no pixel is exploded to find its tile or its place."""
    quad = F.array(*[g.point(F.lit(x), F.lit(y)) for x, y in ((1.0, 2.0), (60.0, 5.0), (50.0, 40.0), (3.0, 30.0))])
    for df in (gather.line_pixels(sizes.withColumns({"line_no": F.lit(0), "box": quad}), table, ["r"]), gather.rectified_pixels(sizes.withColumns({"corners": quad, "page_size": g.page_size(quad)}), table)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        assert "RepartitionByExpression" in plan[plan.index("Join LeftOuter") :].split("MapInArrow")[1]


def test_sizes_beyond_the_pixels(spark, images, table, sizes):
    """Where an image has fewer pixels than it is said to have, the rest is null and not of another row."""
    own = sizes.where("image_id = 1").withColumns({"src_w": F.lit(80), "src_h": F.lit(50), "size": F.struct(F.lit(80).alias("width"), F.lit(50).alias("height"))})
    got = gather.resized_pixels(own, table, ["r"]).toPandas()
    there = (got["y"] < 44) & (got["x"] < 70)
    assert len(got) == 80 * 50 and got[~there]["r"].isna().all()
    assert (got[there].sort_values(["y", "x"])["r"].to_numpy().reshape(44, 70) == images[1][:44, :70, 0]).all()


@pytest.mark.parametrize("name", ["enhanced_documents", "resized_pages", "line_crops"])
def test_pixels_do_not_pass_the_driver(spark, name):
    """However small the file that they are made of: no table of pixels or tiles is gathered to be sent to all."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and not [line for line in joins if "Broadcast" in line and ("_ty" in line or "y#" in line)]
