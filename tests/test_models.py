"""The model adapters, with small ONNX graphs written out by hand: a corner model and a recogniser."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import corners, page_images, text_lines


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def number(field, n):
    return varint(field << 3) + varint(n)


def block(field, body):
    body = body.encode() if isinstance(body, str) else body
    return varint(field << 3 | 2) + varint(len(body)) + body


def ints(name, values):
    return block(5, block(1, name) + b"".join(number(8, v) for v in values) + number(20, 7))


def integer(name, value):
    return block(5, block(1, name) + number(3, value) + number(20, 2))


def node(op, inputs, outputs, *attributes):
    return block(1, b"".join(block(1, i) for i in inputs) + b"".join(block(2, o) for o in outputs) + block(4, op) + b"".join(attributes))


def constant(name, values):
    a = np.atleast_2d(np.array(values, np.float32))
    return block(5, b"".join(number(1, d) for d in a.shape) + number(2, 1) + block(8, name) + block(9, struct.pack(f"<{a.size}f", *a.ravel())))


def value(field, name, dims):
    shape = b"".join(block(1, number(1, d) if isinstance(d, int) else block(2, d)) for d in dims)
    return block(field, block(1, name) + block(2, block(1, number(1, 1) + block(2, shape))))


def model(path, *parts):
    graph = b"".join(parts[:-1]) + block(2, "g") + parts[-1]
    path.write_bytes(number(1, 8) + block(7, graph) + block(8, block(1, "") + number(2, 13)))
    return str(path)


def image(a):
    return page_images.as_image(np.asarray(a, np.uint8))


def test_corner_model(spark, tmp_path):
    """Its coordinates are fixed, its score the mean of the normalised image: positive for bright images."""
    path = model(
        tmp_path / "corners.onnx",
        node("ReduceMean", ["image"], ["score"], ints("axes", [1, 2, 3]), integer("keepdims", 0)),
        node("Mul", ["score", "zero"], ["nothing"]),
        node("Add", ["nothing", "quad"], ["coords"]),
        constant("zero", [0] * 8),
        constant("quad", [0.2, 0.2, 0.8, 0.2, 0.8, 0.8, 0.2, 0.8]),
        value(11, "image", [1, 224, 224, 3]) + value(12, "score", [1]) + value(12, "coords", [1, 8]),
    )
    rows = [(1, image(np.full((50, 100, 3), 250))), (2, image(np.zeros((50, 100, 3)))), (3, None)]
    found = corners.infer_corners(spark.createDataFrame(rows, f"image_id long, image {page_images.IMAGE}"), path)
    got = {r["id"]: r for r in corners.detect_corners(found).collect()}
    assert [v for p in got[1]["corners"] for v in (p["x"], p["y"])] == pytest.approx([20, 10, 80, 10, 80, 40, 20, 40])
    assert got[2]["corners"] is None and got[2]["logit"] < 0 and len(got[2]["page"]) == 4
    assert got[3]["pts"] is None and got[3]["corners"] is None


def test_lines_from_boxes_to_words(spark, tmp_path):
    """The recogniser's steps are the columns of the line, and its numbers their rows: the brightest row is the letter."""
    path = model(
        tmp_path / "lines.onnx",
        node("ReduceMean", ["line"], ["gray"], ints("axes", [1]), integer("keepdims", 0)),
        node("Transpose", ["gray"], ["steps"], ints("perm", [0, 2, 1])),
        value(11, "line", [1, 3, 48, "w"]) + value(12, "steps", [1, "w", 48]),
    )
    page = np.zeros((120, 200, 3), np.uint8)
    page[10 + 5, 20:120] = 255  # row 5 of the first box
    page[65 + 7, 20:70] = page[65 + 9, 70:120] = 255  # rows 7, then 9 of the second
    box = lambda y: [(20.0, y), (120.0, y), (120.0, y + 48), (20.0, y + 48)]
    boxes = spark.createDataFrame([(1, 0, box(10.0)), (1, 1, box(65.0))], "image_id long, line_no int, box array<struct<x:double,y:double>>")
    images = spark.createDataFrame([(1, image(page)), (2, image(page))], f"image_id long, image {page_images.IMAGE}")
    letters = [chr(ord("A") + i) for i in range(47)]
    lines = text_lines.recognise(text_lines.crop_lines(boxes, images), path, letters)
    words = text_lines.words_on_source(lines.join(boxes, ["image_id", "line_no"]).withColumns({"source_w": F.lit(200), "source_h": F.lit(120)}), F.lit(1.0), F.lit(1.0))
    got = text_lines.pages_of_words(words, ["image_id"]).collect()
    assert [(r["image_id"], r["text"]) for r in got] == [(1, "E\nGI")]
    assert got[0]["words"][1]["confidence"] == pytest.approx(100) and tuple(got[0]["words"][0]["bbox"]) == (20, 10, 120, 58)
