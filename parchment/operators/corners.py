"""From a corner model's outputs to page corners: rejection, scaling, ordering, and a default where nothing is left."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .page_images import IMAGE, as_array, resized

INPUT_SIDE = 224
#: Mean and deviation of the training images, by channel.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LEAST_CONFIDENCE, LEAST_AREA, MOST_AREA = 0.5, 0.05, 0.90
RAW_SHAPE, STRICT_SHAPE, SMOOTH_SHAPE = (0.500, 1.4), (0.240, 1.25), (0.24, 1.25)


def confidence(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def detected(q: Column, logit: Column, w: Column, h: Column) -> Column:
    """Corners in pixels and in order; null where the model is unsure, the area is odd, or the shape is no page."""
    sure = confidence(logit) >= LEAST_CONFIDENCE
    area = g.quad_area(q).between(LEAST_AREA, MOST_AREA)
    return F.when(sure & area & g.is_valid_shape(q, *RAW_SHAPE), g.sort_corners(g.to_pixels(q, w, h)))


def with_fallback(found: Column, w: Column, h: Column) -> Column:
    """``found`` if it is a page by the strict limits, else default corners."""
    return F.coalesce(F.when(g.is_valid_shape(found, *STRICT_SHAPE), found), g.default_corners(w, h))


def detect_corners(outputs: DataFrame, quad_col: str = "pts", logit_col: str = "logit", w_col: str = "w", h_col: str = "h") -> DataFrame:
    """All columns plus corners (null: none), strict, and page corners with the fallback. Nulls in any input give no corners."""
    q, w, h = F.col(quad_col), F.col(w_col), F.col(h_col)
    found = outputs.withColumn("corners", detected(q, F.col(logit_col), w, h))
    strict = F.coalesce(g.is_valid_shape(F.col("corners"), *STRICT_SHAPE), F.lit(False))
    page = F.when(F.col("strict"), F.col("corners")).otherwise(g.default_corners(w, h))
    return found.withColumn("strict", strict).withColumn("page", page)


def choose_outputs(names: Sequence[str]) -> tuple[str, str] | None:
    """The names of coordinates and score: the last that say so, else the first two; None with fewer."""
    coords = [n for n in names if "coord" in n]
    scores = [n for n in names if "coord" not in n and ("score" in n or "logit" in n)]
    if coords and scores:
        return coords[-1], scores[-1]
    return (names[0], names[1]) if len(names) > 1 else None


def output_roles(names: Column) -> Column:
    """choose_outputs for an array of names: struct(coords, score), null with fewer than two names."""
    last = lambda own: F.element_at(F.filter(names, own), -1)
    coords = F.when(F.exists(names, lambda n: n.contains("coord")), last(lambda n: n.contains("coord")))
    scored = lambda n: ~n.contains("coord") & (n.contains("score") | n.contains("logit"))
    score = F.when(F.exists(names, scored), last(scored))
    both = coords.isNotNull() & score.isNotNull()
    pair = F.struct(F.when(both, coords).otherwise(F.get(names, F.lit(0))).alias("coords"), F.when(both, score).otherwise(F.get(names, F.lit(1))).alias("score"))
    return F.when(F.size(names) > 1, pair)


def input_tensor(pixels: np.ndarray, side: int = INPUT_SIDE) -> np.ndarray:
    """[1, side, side, 3], stretched and normalised by channel."""
    small = resized(pixels[..., :3], side, side).astype(np.float64)
    return (small / (255.0 * np.array(DEVIATION)) - np.array(MEAN) / np.array(DEVIATION)).astype(np.float32)[None]


def infer_corners(images: DataFrame, model_path: str, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """id, pts, logit, w, h by an ONNX model, with one session for each task. A failed image gives null pts and logit.

    ``model_path`` is a file that every executor can open, such as one sent with addFile.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])
        names = choose_outputs([o.name for o in session.get_outputs()])
        feed = session.get_inputs()[0].name
        for pdf in batches:
            rows = []
            for key, image in zip(pdf["id"], pdf["image"], strict=True):
                try:
                    coords, score = session.run(list(names), {feed: input_tensor(as_array(image))})
                    c = np.ravel(coords).astype(float)
                    pts, logit = [{"x": c[i], "y": c[i + 1]} for i in range(0, 8, 2)], float(np.ravel(score)[0])
                except Exception:  # one bad image must not end the job
                    pts, logit = None, None
                rows.append((key, pts, logit, image["width"] if image else None, image["height"] if image else None))
            yield pd.DataFrame(rows, columns=["id", "pts", "logit", "w", "h"])

    slim = images.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast(IMAGE).alias("image"))
    return slim.mapInPandas(run, f"id long, pts array<{g.POINT}>, logit double, w int, h int")
