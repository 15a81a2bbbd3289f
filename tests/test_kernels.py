"""Pixel kernels, boxes, decoding and exports against small examples worked out by hand or by plain numpy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchment.operators import corners, exports, page_images, pixels, sessions, text_boxes, text_lines
from parchment.sources import files
from parchment.sources import images as sources


def image(a):
    return page_images.as_image(np.asarray(a, np.uint8))


def pixel_rows(spark, a):
    return spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")


def test_laplacian_variance(spark):
    a = np.random.default_rng(0).integers(0, 256, (5, 7))
    p = np.pad(a, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    m = pixels.capture_metrics(pixel_rows(spark, a)).first()
    assert m["focus"] == pytest.approx(lap.var()) and m["luma"] == pytest.approx(a.mean()) and m["dark_ratio"] == pytest.approx((a <= 60).mean())


def test_flat_and_single_pixel_images(spark):
    for a in (np.full((3, 3), 9), np.array([[200]])):
        m = pixels.assess_images(pixel_rows(spark, a)).first()
        assert m["focus"] == 0
        assert {r["v"] for r in pixels.stretch(pixel_rows(spark, a)).collect()} == {int(a[0, 0])}


def test_tone_curve_is_the_packed_one(spark):
    assert [r["tone"] for r in pixels.tone_table(spark).orderBy("v").collect()] == page_images.CURVE.tolist()


def test_pixel_form_equals_packed_form(spark):
    a = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    table = pixels.explode_image(spark.createDataFrame([(1, image(a))], f"image_id long, image {page_images.IMAGE}"))
    v = {(r["y"], r["x"]): (r["c0"], r["c1"], r["c2"], r["g"]) for r in table.withColumn("g", pixels.gray(F.col("c0"), F.col("c1"), F.col("c2"))).collect()}
    assert all(v[y, x][:3] == tuple(a[y, x]) and v[y, x][3] == page_images.gray(a)[y, x] for y in range(4) for x in range(6))
    packed = page_images.pack_gray(table.select("image_id", "y", "x", F.col("c0").alias("v"))).first()["image"]
    assert np.array_equal(page_images.as_array(packed)[..., 0], a[..., 0])


def test_rotation(spark):
    a = np.arange(6).reshape(2, 3)
    for clockwise, degrees in ((True, 90), (False, 270)):
        got = {(r["y"], r["x"]): r["v"] for r in pixels.rotate90(pixel_rows(spark, a), clockwise).collect()}
        want = page_images.rotated(a, degrees)
        assert got == {k: int(v) for k, v in np.ndenumerate(want)}
    assert np.array_equal(page_images.rotated(a, 45), a)


def test_warp_of_a_rectangle_is_a_crop():
    a = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    box = np.array([(4, 3), (24, 3), (24, 15), (4, 15)], float)
    assert np.array_equal(page_images.warped(a, box, 20, 12), a[3:15, 4:24])
    assert np.array_equal(page_images.warped(a, box, 20, 12, cubic=True), a[3:15, 4:24])
    outside = page_images.warped(a, box - [10, 0], 20, 12)
    assert not outside[:, :6].any()


def test_resize_keeps_flat_images():
    assert (page_images.resized(np.full((7, 9), 77, np.uint8), 4, 13) == 77).all()


def test_filters():
    rng = np.random.default_rng(3)
    page = np.repeat(rng.integers(200, 256, (40, 40, 1)), 3, axis=2).astype(np.uint8)
    page[10:14, 5:30] = 10
    document = page_images.FILTERS["document_enhanced"](page)
    assert document.shape == (40, 40) and document[12, 10] < 20 and (document[30:, 30:] > 150).mean() > 0.9
    mono = page_images.FILTERS["mono"](page)
    assert set(np.unique(mono)) <= {0, 255} and mono[10, 10] == 0
    color = np.zeros((2, 2, 3), np.uint8)
    color[0, 0], color[1, 1] = (200, 100, 100), (50, 50, 50)
    out = page_images.FILTERS["color_enhanced"](color)
    assert out[0, 0, 0] == 255 and out[0, 0, 1] < 128 and np.ptp(out[1, 1]) == 0
    assert page_images.FILTERS["color_original"](color) is color


def test_ocr_preparation_sharpens():
    a = np.zeros((5, 5, 3), np.uint8)
    a[:, 3:] = 100
    out = page_images.sharpened_for_ocr(a)
    assert out[2, 4] == 100 and out[2, 3] > 100 and out[2, 0] == 0


def test_failed_images_do_not_end_the_job(spark):
    rows = [(1, image(np.zeros((4, 4, 3))), None, (4, 4), "mono", 0), (2, None, [(0.0, 0.0)] * 4, (4, 4), "mono", 0), (3, image(np.zeros((4, 4, 3))), [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], (4, 4), "no such mode", 0)]
    df = spark.createDataFrame(rows, f"image_id long, image {page_images.IMAGE}, corners array<struct<x:double,y:double>>, page_size struct<width:int,height:int>, mode string, rotation int")
    assert [r["page"] for r in page_images.rectify(df).collect()] == [None] * 3


def test_pages_are_encoded_in_the_same_pass(spark):
    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rows = [(1, image(np.full((3, 4, 3), 9)), corners, (4, 3), "color_original", 0), (2, None, corners, (4, 3), "mono", 0)]
    df = spark.createDataFrame(rows, f"image_id long, image {page_images.IMAGE}, corners array<struct<x:double,y:double>>, page_size struct<width:int,height:int>, mode string, rotation int")
    good, bad = sorted(page_images.rectify(df, encode=sources.png_bytes).collect())
    assert bytes(good["content"]) == sources.png_bytes(page_images.as_array(good["page"])) and good["error"] is None
    assert bad["content"] is None and bad["error"] == "no image"

    def broken(pixels):
        raise ValueError("no encoder")

    assert [r["error"] for r in sorted(page_images.rectify(df, encode=broken).collect())] == ["ValueError: no encoder", "no image"]


@pytest.mark.parametrize("shape", [(6, 9), (1, 5), (20, 3), (1, 1)])
def test_stencils_on_tables_of_pixels_equal_the_packed_kernels(spark, shape):
    v = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    px = spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(shape[0]) for x in range(shape[1])], "image_id int, y int, x int, v int")

    def of(table):
        out = np.zeros(shape, np.uint8)
        for r in table.collect():
            out[r["y"], r["x"]] = r["v"]
        return out.tolist()

    assert of(pixels.sharpened_for_ocr(px)) == page_images.sharpened_for_ocr(v).tolist()
    assert of(pixels.monochrome(px)) == page_images.monochrome(v).tolist()
    padded = np.pad(v, 2)
    assert of(pixels.brightest(px, 5)) == [[int(padded[y : y + 5, x : x + 5].max()) for x in range(shape[1])] for y in range(shape[0])]


def test_png_round_trip(spark):
    a = np.random.default_rng(4).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    png = sources.png_bytes(a)
    size = int.from_bytes(png[33:37], "big")
    raw = np.frombuffer(zlib.decompress(png[41 : 41 + size]), np.uint8).reshape(3, 16)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and np.array_equal(raw[:, 1:].reshape(3, 5, 3), a)


def test_reading_and_writing_files(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 256, (6, 4, 3)).astype(np.uint8)
    df = spark.createDataFrame([("a.png", image(a)), ("b.png", None)], f"file_name string, image {page_images.IMAGE}").withColumn("e", sources.encoded(F.col("image")))
    done = files.write_files(df.select("file_name", "e.*"), str(tmp_path), error_col="error").collect()
    assert [r["error"] is None for r in sorted(done, key=lambda r: r["file_name"])] == [True, False]
    (tmp_path / "junk.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert np.array_equal(page_images.as_array(got["a.png"]["image"]), a) and not got["junk.png"]["valid"]


def test_data_urls(spark):
    url = sources.to_data_url(F.lit("image/png"), F.lit(b"\x01\x02"))
    r = spark.range(1).select(url.alias("u"), sources.from_data_url(url).alias("d"), sources.from_data_url(F.lit("x")).alias("n")).first()
    assert r["u"] == "data:image/png;base64,AQI=" and bytes(r["d"]["content"]) == b"\x01\x02" and r["n"] is None


def test_contours_of_thin_lines():
    ring = np.zeros((8, 8), bool)
    ring[1:7, 1:7] = True
    ring[2:6, 2:6] = False
    assert sorted(len(c) for c in text_boxes.contours(ring)) == [16, 20]  # both sides of a ring of one pixel's width; corners touch the hole at no side
    two = ring.copy()
    two[3, 1:7] = True
    assert len(text_boxes.contours(two)) == 3
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert len(text_boxes.contours(line)) == 1 and len(text_boxes.contours(line.T)) == 1
    diagonal = np.eye(6, dtype=bool)
    assert len(text_boxes.contours(diagonal)) == 1 and len(text_boxes.contours(diagonal[::-1])) == 1


def test_contours_of_a_frame():
    mask = np.zeros((12, 14), bool)
    mask[2:10, 2:12] = True
    mask[5:7, 5:9] = False
    found = text_boxes.contours(mask)
    assert len(found) == 2
    spans = sorted(tuple(np.ptp(line, axis=0)) for line in found)
    assert spans == [(5, 3), (9, 7)]
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert [len(c) for c in text_boxes.contours(dot)] == [1] and text_boxes.contours(np.zeros((3, 3), bool)) == []


def test_smallest_rect_of_a_turned_box():
    turn = np.radians(30)
    box = np.array([(0, 0), (20, 0), (20, 6), (0, 6)]) @ np.array([(np.cos(turn), np.sin(turn)), (-np.sin(turn), np.cos(turn))])
    _, _, w, h, _ = text_boxes.smallest_rect(box)
    assert sorted((w, h)) == pytest.approx([6, 20])


def test_text_boxes_from_a_map(spark):
    p = np.zeros((40, 60), np.float32)
    p[8:16, 10:50] = 0.9
    p[25:33, 10:30] = 0.8
    p[36, 2:4] = 0.9  # too short
    p[20:24, 40:58] = 0.4  # too unsure
    maps = spark.createDataFrame([(1, p.ravel().tolist(), 60, 40)], "image_id long, p array<float>, map_w int, map_h int")
    rects = text_boxes.text_rects(maps).withColumns({"map_w": F.lit(60), "map_h": F.lit(40), "page_w": F.lit(120), "page_h": F.lit(80)})
    lines = text_boxes.in_reading_order(text_boxes.boxes_on_page(rects)).orderBy("line_no").collect()
    assert len(lines) == 2
    assert lines[0]["box"][0]["y"] < lines[1]["box"][0]["y"] and lines[0]["box"][1]["x"] - lines[0]["box"][0]["x"] > 80


def test_decoding(spark):
    def steps(*best):
        return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in best])

    a, b, blank, beyond = (0, 0.9, 0, 0), (0, 0, 0.7, 0), (0.9, 0, 0, 0), (0, 0, 0, 0.9)
    decode = lambda *s: tuple(spark.range(1).select(text_lines.decode(steps(*s), ["a", "b"]).alias("d")).first()["d"])
    assert decode(a, a, blank, a, b)[0] == "aab" and decode(a, a, blank, a, b)[1] == pytest.approx(100 * (0.9 + 0.9 + 0.7) / 3)
    assert decode(blank, blank) == ("", 0) and decode(a, beyond, a)[0] == "aa"
    nan = (float("nan"),) * 4
    assert decode(nan, a, nan, a)[0] == "aa"
    assert decode((0, 5, 0, 0))[1] == pytest.approx(100 / (1 + np.exp(-5)))
    assert text_lines.dictionary("a\r\nb\n") == ["a", "b", ""]


def test_crop_of_an_upright_line_is_turned():
    line = text_lines.crop_line(np.zeros((50, 50, 3), np.uint8), np.array([(5, 5), (15, 5), (15, 45), (5, 45)], float))
    assert line.shape[:2] == (10, 40)
    assert text_lines.line_tensor(line).shape == (1, 3, 48, 192)


def test_model_outputs_and_tensors():
    assert corners.choose_outputs(["x_coords", "score"]) == ("x_coords", "score")
    assert corners.choose_outputs(["a", "b"]) == ("a", "b") and corners.choose_outputs(["a"]) is None
    t = corners.input_tensor(np.full((10, 20, 3), 255, np.uint8))
    assert t.shape == (1, 224, 224, 3) and t[0, 0, 0, 0] == pytest.approx((1 - 0.485) / 0.229, rel=1e-5)
    assert text_boxes.detector_tensor(image(np.zeros((4, 4, 1))), 32, 32).shape == (1, 3, 32, 32)


def test_text_of_a_page_and_copied_text(spark):
    p = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 2), (9, 2), (9, 4), (1, 4))])
    lines = spark.createDataFrame([(1, 1, " b ", 50.0), (1, 0, "a", 70.0), (1, 2, "　", 10.0)], "image_id long, line_no int, text string, confidence double").withColumns({"box": p, "source_w": F.lit(10), "source_h": F.lit(20)})
    page = text_lines.pages_of_words(text_lines.words_on_source(lines, F.lit(2.0), F.lit(3.0)), ["image_id"]).first()
    assert page["text"] == "a\n b " and tuple(page["words"][0]["bbox"]) == (2, 6, 18, 12)
    ocr = spark.createDataFrame([(1, 10, "z"), (1, 2, "y"), (1, 3, None)], "session long, page int, text string")
    assert sessions.copied_text(ocr).first()["text"] == "y" + sessions.PAGE_BREAK + "z"


def test_html(spark):
    word = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = [(1, 0, [("<a & 'b'>", 1.0, (10.0, 20.0, 30.0, 25.0)), ("　", 1.0, (0.0, 0.0, 1.0, 1.0))], 100.0, 200.0), (1, 1, None, None, None), (1, 2, [(" ", 1.0, (0.0, 0.0, 1.0, 1.0))], 0.0, 0.0)]
    html = exports.html_documents(spark.createDataFrame(rows, f"session long, page int, words array<{word}>, width double, height double")).first()["html"]
    assert "left: 10.000%; top: 10.000%; width: 20.000%; height: 2.500%; font-size: 3.500cqw;\">&lt;a &amp; &#039;b&#039;&gt;</div>" in html
    assert html.count('class="word"') == 1 and html.count(exports.NO_TEXT) == 1 and html.count("aspect-ratio: 1200 / 1697") == 2 and "aspect-ratio: 100 / 200" in html


def test_pdf(spark):
    word = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = [(1, 1, image(np.zeros((20, 10, 3))), [("hi (there)", 1.0, (1.0, 2.0, 3.0, 12.0)), ("漢字", 1.0, (0.0, 0.0, 1.0, 1.0))], 10.0, 20.0), (1, 0, image(np.zeros((4, 6, 1))), None, None, None), (2, 0, image(np.zeros((2, 3200, 3))), None, None, None)]
    pages = spark.createDataFrame(rows, f"session long, page int, image {page_images.IMAGE}, words array<{word}>, width double, height double")
    done = {r["session"]: bytes(r["pdf"]) for r in exports.pdf_documents(pages).collect()}
    assert done[1].count(b"/Type /Page ") == 2 and done[1].index(b"[0 0 6 4]") < done[1].index(b"[0 0 10 20]") and b"[0 0 1600 1]" in done[2]
    streams = [zlib.decompress(s.split(b"\nendstream")[0]) for s in done[1].split(b"stream\n")[1::2] if s[:1] == b"x"]
    assert any(b"8.000 Tf 1 0 0 1 1.000 8.000 Tm (hi \\(there\\)) Tj" in s for s in streams)
    start = int(done[1].rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert done[1][start : start + 4] == b"xref" and len(pdf_table(done[1])) == 13 and len(pdf_table(done[2])) == 10


def pdf_table(pdf):
    """The places in the table of a document, each of which has to be its object's."""
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    lines = pdf[at:].split(b"\n")
    assert lines[0] == b"xref" and lines[2] == b"0000000000 65535 f "
    n = int(lines[1].split()[1])
    places = [int(x.split()[0]) for x in lines[3 : 2 + n]]
    assert all(pdf[p:].startswith(b"%d 0 obj\n" % no) for no, p in enumerate(places, 1)) and f"/Size {n} ".encode() in pdf[at:]
    return places


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_in_parts(spark, packed):
    """Parts follow each other byte by byte; failed pages are told of, and others go on; no part is larger than a page."""
    rng = np.random.default_rng(2)
    bad = {"height": 9, "width": 9, "channels": 3, "data": b"short"}
    rows = [(1, i, image(rng.integers(0, 256, (3, 4, 3)))) for i in range(120)] + [(2, 0, bad), (2, 1, image(np.ones((2, 2, 1)))), (2, 1, image(np.ones((2, 2, 1)))), (2, 3, None), (3, 0, bad), (None, 0, image(np.ones((1, 1, 1)))), (None, 1, None)]
    df = spark.createDataFrame(rows, f"session long, page int, image {page_images.IMAGE}")
    pages = df.withColumns({"words": F.lit(None).cast("array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"), "width": F.lit(None).cast("double"), "height": F.lit(None).cast("double"), "key": F.lit("mine"), "no": F.lit("mine"), "first": F.lit("mine")})
    parts = exports.pdf_parts(pages, packed).toPandas()
    errors = parts[parts["no"].isna()]
    assert sorted(zip(errors["session"], errors["page"], strict=True)) == [(2, 0), (2, 3), (3, 0)] and errors["error"].notna().all()
    for session, n in ((1, 120), (2, 2)):
        own = parts[(parts["session"] == session) & parts["no"].notna()].sort_values("no")
        assert own["no"].tolist() == list(range(7 + 3 * n + 2))
        at = 0
        for start, content in zip(own["start"], own["content"], strict=True):
            assert start == at
            at += len(content)
        pdf = b"".join(own["content"])
        assert len(pdf_table(pdf)) == 7 + 3 * n and f"/Count {n} ".encode() in pdf and pdf.count(b"/Type /Page ") == n
    assert set(parts["session"]) == {1, 2, 3} and parts["content"].dropna().map(len).max() < 20000
    if packed:
        done = {r["session"]: r for r in exports.pdf_documents(pages).collect()}
        assert bytes(done[2]["pdf"]) == pdf and done[2]["failed"] == [0, 3] and done[3]["pdf"] is None and done[3]["failed"] == [0] and not done[1]["failed"]
        assert exports.pdf_parts(pages.limit(0)).count() == 0 and exports.pdf_documents(pages.limit(0)).count() == 0


def test_pages_are_drawn_by_few(monkeypatch):
    """Of a batch of many pages only a few are objects at a time, whatever the batch's size, and each has its own words."""
    drawn = []
    monkeypatch.setattr(exports, "_drawn", lambda row, packed: drawn.append(row) or (b"", b""))
    page = lambda i: {"session": 1, "page": i, "image": None, "size": {"width": 3, "height": 4}, "placed": [{"text": f"{i} {k}", "x": 1.0, "y": None, "size": 4.0} for k in range(i % 5)]}
    batch = pa.RecordBatch.from_pylist([page(i) for i in range(1001)])[1:]
    told = exports._drawn_by_few(batch, True)
    first = next(told)
    assert len(drawn) == first.num_rows == exports.AT_ONCE
    assert [r["page"] for r in first.to_pylist()] + [r["page"] for b in told for r in b.to_pylist()] == list(range(1, 1001))
    assert drawn == [page(i) for i in range(1, 1001)]


def test_images_are_measured_within_their_corners(spark):
    a = np.random.default_rng(8).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    a[:, 30:] = 20
    box = lambda x0, x1: [(x0, 0.0), (x1, 0.0), (x1, 40.0), (x0, 40.0)]
    rows = [(1, image(a), box(0.0, 30.0)), (2, image(a), box(30.0, 60.0)), (3, image(a), None), (4, None, box(0.0, 30.0)), (5, image(a), box(0.0, 9.0))]
    df = spark.createDataFrame(rows, f"image_id long, image {page_images.IMAGE}, corners array<struct<x:double,y:double>>")
    got = {r.image_id: r for r in page_images.assess_documents(df).collect()}
    assert got[1].level in ("good", "fair") and got[2].level == "poor" and got[2].reasons == ["dark", "blur"]
    cut = page_images.measured(a[3:36, 2:27])
    assert (got[1].focus, got[1].luma) == pytest.approx(cut[:2])
    assert (got[4].focus, got[4].luma) == (0, 128) and got[3].focus == got[5].focus == pytest.approx(page_images.measured(a)[0])
    modes = {r.image_id: r.mode for r in page_images.best_modes(df).collect()}
    assert modes == {1: "color_enhanced", 2: "document_enhanced", 3: "document_enhanced", 4: "document_enhanced", 5: "color_enhanced"}


def test_measures_are_those_of_the_pixel_form(spark):
    a = np.random.default_rng(9).integers(0, 256, (5, 7)).astype(np.uint8)
    m = pixels.capture_metrics(pixel_rows(spark, a)).first()
    assert (m["focus"], m["luma"], m["dark_ratio"]) == pytest.approx(page_images.measured(a))


def test_fallback_corners(spark):
    """A page that is only loosely one, and a missing one, give default corners."""
    q = "array<struct<x:double,y:double>>"
    loose = [(0.2, 0.2), (0.8, 0.2), (0.66, 0.8), (0.2, 0.8)]
    good = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]
    rows = [(1, good, 2.0), (2, loose, 2.0), (3, good, -2.0), (4, None, 2.0), (5, good, None), (6, good[:3], 2.0)]
    df = spark.createDataFrame(rows, f"k long, pts {q}, logit double").withColumns({"w": F.lit(640), "h": F.lit(480)})
    got = {r.k: r for r in corners.detect_corners(df).collect()}
    assert [got[k].strict for k in range(1, 7)] == [True, False, False, False, False, False]
    assert got[2].corners is not None and got[3].corners is got[4].corners is got[5].corners is got[6].corners is None
    assert got[1].page == got[1].corners and got[2].page == got[3].page == got[6].page != got[1].page
    same = df.select("k", corners.with_fallback(corners.detected(F.col("pts"), F.col("logit"), F.col("w"), F.col("h")), F.col("w"), F.col("h")).alias("p")).collect()
    assert {r.k: r.p for r in same} == {k: r.page for k, r in got.items()}


def test_pdf_text_of_any_script():
    import re
    import zlib

    from parchment.operators import exports

    image = {"height": 2, "width": 2, "channels": 1, "data": bytes(4)}
    placed = [{"text": t, "x": 1.0, "y": 2.0, "size": 4.0} for t in ("plain (word)", "日本語の文字", "emoji 😀")]
    pdf = b"\n".join([*exports._fonts(True), *exports._drawn({"image": image, "size": {"width": 2, "height": 2}, "placed": placed}, True)])
    streams = [zlib.decompress(m) for m in re.findall(rb"stream\n(.*?)\nendstream", pdf, re.S)]
    layer = next(s for s in streams if b"BT 3 Tr" in s)
    found = [bytes.fromhex(h.decode()).decode("utf-16-be") for h in re.findall(rb"/F2 [^<]*<([0-9a-f]+)> Tj", layer)]
    assert found == ["日本語の文字", "emoji 😀"] and rb"(plain \(word\)) Tj" in layer
    assert b"/Identity-H" in pdf and any(b"<6500> <65ff> <6500>" in s for s in streams)
