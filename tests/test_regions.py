"""Borders, contents, hulls and smallest rectangles of masks on tables of pixels, against the border follower on packed maps."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchment.operators import regions, text_boxes
from parchment.plans import registry


def spiral(n):
    a = np.zeros((n, n), bool)
    y, x, d = 0, 0, 0
    a[0, 0] = True
    for length in [n - 1, *[m for k in range(n - 1, 1, -2) for m in (k, k)]]:
        for _ in range(length):
            y, x = y + (0, 1, 0, -1)[d], x + (1, 0, -1, 0)[d]
            if not (0 <= y < n and 0 <= x < n):
                return a
            a[y, x] = True
        d = (d + 1) % 4
    return a


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(5)
    out = [rng.random((rng.integers(3, 15), rng.integers(3, 15))) < rng.choice([0.3, 0.5, 0.7]) for _ in range(60)]
    rings = np.zeros((15, 15), bool)
    for k in (0, 2, 4, 6):
        rings[k : 15 - k, k : 15 - k] = k % 4 == 0
    return [*out, rings, spiral(21), np.ones((4, 6), bool), np.zeros((3, 3), bool), np.eye(6, dtype=bool), np.ones((1, 9), bool), np.ones((1, 1), bool)]


@pytest.fixture(scope="module")
def table(spark, masks):
    rng = np.random.default_rng(6)
    rows = []
    for k, m in enumerate(masks):
        p = np.where(m, rng.uniform(0.31, 1, m.shape), rng.uniform(0, 0.29, m.shape)).round(3)
        rows.append(pd.DataFrame({"image_id": k, "y": np.repeat(np.arange(m.shape[0]), m.shape[1]), "x": np.tile(np.arange(m.shape[1]), m.shape[0]), "p": p.ravel()}))
    return spark.createDataFrame(pd.concat(rows)).withColumns({c: F.col(c).cast("int") for c in "yx"}).cache()


def maps_of(table):
    return {k: own.pivot(index="y", columns="x", values="p").to_numpy() for k, own in table.toPandas().groupby("image_id")}


def length_of(line):
    return float(np.hypot(*(np.roll(line, -1, axis=0) - line).T).sum())


def test_borders_equal_the_follower(table):
    cells = regions.labelled(table, F.col("p") > 0.3, F.col("p"))
    got = regions.borders(cells).select("*", regions.smallest_rect(regions.hull(F.col("rows"))).alias("r")).toPandas()
    for k, p in maps_of(table).items():
        want = text_boxes.contours(p > 0.3)
        own = got[got["image_id"] == k].sort_values("border_no")
        assert own["border_no"].tolist() == list(range(len(want)))
        for line, (_, b) in zip(want, own.iterrows(), strict=True):
            assert b["length"] == pytest.approx(length_of(line)) and b["score"] == pytest.approx(text_boxes._inside_score(p, line))
            cx, cy, w, h, _ = text_boxes.smallest_rect(line)
            assert b["r"]["area"] == pytest.approx(w * h, abs=1e-6)
            rows = {int(y): (int(line[line[:, 1] == y][:, 0].min()), int(line[line[:, 1] == y][:, 0].max())) for y in set(line[:, 1])}
            assert {r["y"]: (r["left"], r["right"]) for r in b["rows"]} == rows
            # All points of the border lie in the rectangle.
            r, a = b["r"], np.radians(b["r"]["angle"])
            along, up = (line - [r["cx"], r["cy"]]) @ [np.cos(a), np.sin(a)], (line - [r["cx"], r["cy"]]) @ [-np.sin(a), np.cos(a)]
            assert np.abs(along).max() <= r["rw"] / 2 + 1e-6 and np.abs(up).max() <= r["rh"] / 2 + 1e-6 and 0 <= r["angle"] < 90


def test_areas_and_holes(table, masks):
    got = regions.areas(regions.labelled(table, F.col("p") > 0.3, F.col("p"))).toPandas()

    def sizes(mask, around):
        seen, found = np.zeros(mask.shape, bool), []
        for start in np.argwhere(mask).tolist():
            if seen[tuple(start)]:
                continue
            todo, n = [tuple(start)], 0
            seen[tuple(start)] = True
            while todo:
                y, x = todo.pop()
                n += 1
                for dy, dx in around:
                    a, b = y + dy, x + dx
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                        seen[a, b] = True
                        todo.append((a, b))
            found.append(n)
        return Counter(found)

    sides = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    for k, m in enumerate(masks):
        own = got[got["image_id"] == k]
        assert Counter(own[own["on"]]["size"]) == sizes(m, [*sides, (1, 1), (1, -1), (-1, 1), (-1, -1)])
        h, w = m.shape
        outside = np.pad(~m, 1, constant_values=True)
        every = sizes(outside, sides)
        holes = own[~own["on"] & (own["top"] > 0) & (own["left"] > 0) & (own["bottom"] < h - 1) & (own["right"] < w - 1)]
        frame = 2 * (h + w) + 4
        paper = Counter(own[~own["on"]]["size"])
        # The outer background is one, through the frame.
        assert sum(every.values()) - len(holes) == 1 and paper[max(paper, default=0)] >= 0 and sum(k * n for k, n in every.items()) - frame == sum(k * n for k, n in paper.items())


def test_regions_equal_the_kernel(spark, table):
    got = regions.text_regions(table).toPandas()
    maps = maps_of(table)
    packed = spark.createDataFrame([(int(k), [float(x) for x in p.ravel()], p.shape[1], p.shape[0]) for k, p in maps.items()], "image_id long, p array<float>, map_w int, map_h int")
    want = text_boxes.text_rects(packed).toPandas()
    assert len(got) and set(zip(got["image_id"], got["contour"], strict=True)) == set(zip(want["image_id"], want["contour"], strict=True))
    both = got.merge(want, on=["image_id", "contour"])
    assert np.allclose(both["score_x"], both["score_y"], atol=1e-6) and np.allclose(both["rw_x"] * both["rh_x"], both["rw_y"] * both["rh_y"])


def test_odd_pixels(spark, table):
    """Missing pixels are empty, repeated ones count once; images of nulls have no regions."""
    own = table.where("image_id = 60")
    want = regions.text_regions(own).drop("image_id").collect()
    noise = own.withColumns({"label": F.lit("mine"), "run": F.lit(1), "on": F.lit("x"), "node": F.lit(0), "m": F.lit(None)})
    assert regions.text_regions(noise.unionByName(noise)).drop("image_id").collect() == want and want
    without = own.where("not (y = 7 and x = 7)")
    holed = own.withColumn("p", F.when(~((F.col("y") == 7) & (F.col("x") == 7)), F.col("p")))
    pick = lambda df: sorted(tuple(r) for r in regions.text_regions(df, least_score=0.0).drop("image_id").collect())
    assert pick(without) == pick(holed)
    assert regions.text_regions(own.withColumn("p", F.lit(None).cast("double"))).count() == 0
    assert regions.text_regions(own.limit(0)).count() == 0
    assert regions.text_regions(own.withColumn("image_id", F.lit(None).cast("long"))).count() in (0, len(want))


def test_pixels_move_packed(spark, table):
    """No single pixel is sent: rows are packed before the first exchange, and names come without rounds of their own."""
    cells = regions.labelled(table, F.col("p") > 0.3, F.col("p"))
    packed = regions.packed_rows(table, F.col("p") > 0.3, F.col("p"))
    n_rows = table.select("image_id", "y").distinct().count()
    # A row of an image may be cut where a batch ends.
    assert n_rows <= packed.count() <= n_rows + 40 and packed.agg(F.sum(F.size("x"))).first()[0] == table.count()
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_images_cut_by_batches_keep_their_names(spark, table):
    """Images that lie in several batches, in any order and with gaps, are named as they are in one."""
    p = F.col("p")
    pick = lambda df: sorted(map(tuple, df.select("image_id", "y", "label", "sum", "inner").collect()))
    want = pick(regions.labelled(table, p > 0.3, p))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        assert pick(regions.labelled(table.orderBy(F.rand(3)), p > 0.3, p)) == want
    finally:
        spark.conf.set(name, before)


def test_lines_on_one_height_stand_by_contour(spark, tmp_path):
    """Their mean y may differ in the last bits; the SQL compares nine decimals."""
    drawn = "........ ...##... .....#.. #....... #....#.# ##.#..#. #....... ...#....".replace(" ", "")
    spark.createDataFrame([(7, [0.3 if c == "#" else -0.15 for c in drawn], 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["text_lines_found"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["text_lines_found"]).fetchall()
    assert len(want) > 2 and sorted(map(tuple, got.collect())) == sorted(want)
