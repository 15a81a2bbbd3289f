"""Pixel kernels for packed images, one image per row: numpy within Arrow batches, so pixels cross to Python once each way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.capture_quality import LIMITS, capture_quality

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
CURVE = np.array([255 if i >= 220 else int((i / 220) ** 2.2 * 255.0) for i in range(256)], np.uint8)


def as_array(image) -> np.ndarray:
    # A null image in a batch turns its neighbours' sizes into floats.
    shape = tuple(int(image[k]) for k in ("height", "width", "channels"))
    return np.frombuffer(image["data"], np.uint8).reshape(shape)


def as_image(pixels: np.ndarray) -> dict:
    pixels = pixels if pixels.ndim == 3 else pixels[..., None]
    return {"height": pixels.shape[0], "width": pixels.shape[1], "channels": pixels.shape[2], "data": np.ascontiguousarray(pixels, np.uint8).tobytes()}


def to_u8(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2])
    r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
    return to_u8(r * 0.299 + g * 0.587 + b * 0.114)


def resized(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, with pixel centres on half coordinates and edges repeated."""
    def places(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = places(h, pixels.shape[0])
    x0, x1, fx = places(w, pixels.shape[1])
    fy, fx = (f.reshape(s + (1,) * (pixels.ndim - 2)) for f, s in ((fy, (-1, 1)), (fx, (1, -1))))
    p, total = pixels.astype(np.float64), 0.0
    for y, wy in ((y0, 1 - fy), (y1, fy)):
        for x, wx in ((x0, 1 - fx), (x1, fx)):
            total = total + (wy * wx) * p[y][:, x]
    return to_u8(total)


def homography(from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The 3x3 matrix that maps four points to four others."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(from_, to, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)


def _cubic(f: np.ndarray, a: float = -0.75) -> np.ndarray:
    d = np.abs(np.stack([1 + f, f, 1 - f, 2 - f]))
    near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, far)


def warped(pixels: np.ndarray, corners: np.ndarray, w: int, h: int, cubic: bool = False, span: tuple[float, float] | None = None) -> np.ndarray:
    """The quad ``corners`` stretched to w x h (or to ``span``, of which w x h are seen). Bilinear with zeros outside, or bicubic with edges repeated."""
    across, down = span or (w, h)
    back = homography(np.array([(0, 0), (across, 0), (across, down), (0, down)], float), corners)
    x, y = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    u, v, q = np.tensordot(back, np.stack([x, y, np.ones_like(x)]), 1)
    u, v = u / q, v / q
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = u - x0, v - y0
    out = np.zeros((h, w, pixels.shape[2]))
    wx, wy = (_cubic(fx), _cubic(fy)) if cubic else (np.stack([1 - fx, fx]), np.stack([1 - fy, fy]))
    start = -1 if cubic else 0
    for j in range(len(wy)):
        for i in range(len(wx)):
            yy, xx = y0 + start + j, x0 + start + i
            inside = (yy >= 0) & (yy < pixels.shape[0]) & (xx >= 0) & (xx < pixels.shape[1])
            value = pixels[np.clip(yy, 0, pixels.shape[0] - 1), np.clip(xx, 0, pixels.shape[1] - 1)]
            out += (wy[j] * wx[i])[..., None] * (value if cubic else np.where(inside[..., None], value, 0))
    return to_u8(out)


def _windows(a: np.ndarray, k: int, mode: str) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, k // 2, mode=mode), (k, k))


def background(v: np.ndarray, k: int = 13) -> np.ndarray:
    """Paper without its writing, at a quarter of the size: the brightest of each neighbourhood, then the median, enlarged again."""
    h, w = v.shape
    small = resized(v, max(1, int(w * 0.25 + 0.5)), max(1, int(h * 0.25 + 0.5)))
    for axis in (0, 1):  # a maximum over a rectangle is one over rows, then columns
        pad = [(k // 2, k // 2) if i == axis else (0, 0) for i in (0, 1)]
        small = np.lib.stride_tricks.sliding_window_view(np.pad(small, pad, constant_values=0), k, axis=axis).max(axis=-1)
    rows = [np.median(_windows(small, k, "edge")[i], axis=(-1, -2)) for i in range(small.shape[0])]
    return resized(np.array(rows).astype(np.uint8), w, h)


def enhanced_document(pixels: np.ndarray) -> np.ndarray:
    v = gray(pixels).astype(np.float64)
    bg = background(v.astype(np.uint8)).astype(np.float64)
    flat = np.where(bg == 0, 0, to_u8(v * 255.0 / np.maximum(bg, 1))).astype(np.float64)
    low, high = flat.min(), flat.max()
    if high > low:
        flat = to_u8(flat * (255.0 / (high - low)) - low * (255.0 / (high - low)))
    return CURVE[flat.astype(np.uint8)]


def enhanced_color(pixels: np.ndarray) -> np.ndarray:
    """Value stretched to the full range, saturation raised by a quarter; other channels as they are."""
    rgb = pixels[..., :3].astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    sat = to_u8(np.where(top > 0, (top - low) * 255.0 / np.maximum(top, 1), 0)).astype(float)
    sat = to_u8(sat * 1.25).astype(float)
    v = top if top.max() == top.min() else to_u8((top - top.min()) * 255.0 / (top.max() - top.min())).astype(float)
    # The hue is where the channels lie between the lowest and the highest.
    place = np.where((top > low)[..., None], (rgb - low[..., None]) / np.maximum(top - low, 1)[..., None], 1.0)
    new = v[..., None] * (1 - sat[..., None] / 255.0 * (1 - place))
    return np.concatenate([to_u8(new), pixels[..., 3:]], axis=2)


def monochrome(pixels: np.ndarray, k: int = 15, less: int = 10) -> np.ndarray:
    """White where a pixel is lighter than its Gaussian neighbourhood less 10."""
    v = gray(pixels).astype(np.float64)
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma**2))
    line /= line.sum()
    padded = np.pad(v, k // 2, mode="edge")
    rows = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1) @ line
    mean = to_u8(np.lib.stride_tricks.sliding_window_view(rows, k, axis=0) @ line)
    return np.where(v > mean.astype(float) - less, 255, 0).astype(np.uint8)


FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "color_enhanced": enhanced_color,
    "color_original": lambda p: p,
    "document_enhanced": enhanced_document,
    "document_original": gray,
    "mono": monochrome,
}


def sharpened_for_ocr(pixels: np.ndarray) -> np.ndarray:
    """Gray, and 1.3 times it less 0.3 times its 3x3 Gaussian."""
    v = gray(pixels).astype(np.float64)
    side = np.exp(-0.5)
    line = np.array([side, 1, side]) / (1 + 2 * side)
    p = np.pad(v, 1, mode="reflect")
    blur = to_u8(np.lib.stride_tricks.sliding_window_view(p, (3, 3)).transpose(0, 1, 3, 2) @ line @ line)
    return to_u8(1.3 * v - 0.3 * blur)


def rotated(pixels: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by 90, 180 or 270; other angles change nothing."""
    return np.rot90(pixels, -(degrees // 90)) if degrees in (90, 180, 270) else pixels


def _each(images: DataFrame, work: Callable[[pd.Series], dict | None], inputs: list[str], id_col: str, out: str, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """id and ``out`` for each row; null where ``work`` gives none or fails, so one bad image doesn't end the job.

    With ``encode`` also content and error: the bytes of the result, made in the same pass, or why there are none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done, files = [], []
            for row in pdf[inputs].to_dict("records"):
                image, error = None, "no image"
                try:
                    image = work(row)
                except (ValueError, KeyError, TypeError, np.linalg.LinAlgError) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                done.append(image)
                if encode:
                    files.append(_encoded(image, encode) if image else (None, error))
            found = {id_col: pdf[id_col], out: pd.Series(done, dtype="object", index=pdf.index)}
            for i, name in enumerate(("content", "error") if encode else ()):
                found[name] = pd.Series([f[i] for f in files], dtype="object", index=pdf.index)
            yield pd.DataFrame(found)

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, *inputs).mapInPandas(run, f"`{id_col}` {kind}, `{out}` {IMAGE}" + (", content binary, error string" if encode else ""))


def _encoded(image: dict, encode: Callable[[np.ndarray], bytes]) -> tuple[bytes | None, str | None]:
    try:
        return encode(as_array(image)), None
    except (KeyError, ValueError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def filter_images(images: DataFrame, id_col: str = "image_id", image_col: str = "image", mode_col: str = "mode") -> DataFrame:
    """id and filtered, by each row's mode; null for an unknown mode."""
    work = lambda r: as_image(FILTERS[r[mode_col]](as_array(r[image_col])))
    return _each(images, work, [image_col, mode_col], id_col, "filtered")


def rectify(images: DataFrame, id_col: str = "image_id", image_col: str = "image", corners_col: str = "corners", size_col: str = "page_size", mode_col: str | None = "mode", rotation_col: str | None = "rotation", encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """id and page: rectified to the size in ``size_col``, filtered and turned, in one pass; with ``encode`` also content and error.

    The corners have to be in order (functions.geometry.sort_corners). Null without four of them or without pixels.
    """
    inputs = [c for c in (image_col, corners_col, size_col, mode_col, rotation_col) if c]

    def work(r) -> dict | None:
        pts, size = r[corners_col], r[size_col]
        if pts is None or len(pts) != 4 or r[image_col] is None:
            return None
        page = warped(as_array(r[image_col]), np.array([(p["x"], p["y"]) for p in pts], float), size["width"], size["height"])
        page = FILTERS[r[mode_col]](page) if mode_col else page
        return as_image(rotated(page, int(r[rotation_col]) if rotation_col else 0))

    return _each(images, work, inputs, id_col, "page", encode)


def resize_images(images: DataFrame, size_col: str = "size", id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    work = lambda r: as_image(resized(as_array(r[image_col]), r[size_col]["width"], r[size_col]["height"]))
    return _each(images, work, [image_col, size_col], id_col, "resized")


def prepare_for_ocr(images: DataFrame, size_col: str = "size", id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """Reduced to ``size_col`` (fit_within 2240), then sharpened."""
    def work(r) -> dict:
        return as_image(sharpened_for_ocr(resized(as_array(r[image_col]), r[size_col]["width"], r[size_col]["height"])))

    return _each(images, work, [image_col, size_col], id_col, "prepared")


def crop_line(pixels: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A text box made level, its sides cut off to whole pixels; turned by 90 degrees if it is higher than wide."""
    side = lambda i, j: float(np.hypot(*(box[i] - box[j])))
    across, down = max(side(1, 0), side(2, 3)), max(side(3, 0), side(2, 1))
    w, h = max(1, int(across)), max(1, int(down))
    line = warped(pixels, box, w, h, cubic=True, span=(across, down))
    return rotated(line, 90) if h > w else line


def rotate_images(images: DataFrame, degrees: int = 90, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    return _each(images, lambda r: as_image(rotated(as_array(r[image_col]), degrees)), [image_col], id_col, "rotated")


def pack_gray(pixels: DataFrame, id_col: str = "image_id", value_col: str = "v") -> DataFrame:
    """Packed gray images from a table of pixels, each image in one group of bounded size."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.col(value_col).alias("v")))), lambda s: F.lpad(F.hex(s["v"]), 2, "0"))
    data = F.unhex(F.array_join(ordered, ""))
    packed = pixels.groupBy(id_col).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), data.alias("data"))
    return packed.select(id_col, F.struct("height", "width", F.lit(1).alias("channels"), "data").cast(IMAGE).alias("image"))


def color_share(page: np.ndarray) -> float:
    """The share of pixels with a saturation above 12."""
    rgb = page[..., :3].astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    return float((to_u8(np.where(top > 0, (top - low) * 255.0 / np.maximum(top, 1), 0)) > 12).mean())


def best_modes(images: DataFrame, id_col: str = "image_id", image_col: str = "image", corners_col: str = "corners", side: int = 150) -> DataFrame:
    """id, color_ratio and mode: the page within the corners (in order), brought to 150 x 150, is a document unless over 0.5 % of it has colour.

    The relational form for pixels that are rows already is operators.pixels.best_filter. Images
    without four corners or without pixels are documents.
    """

    def run(image: pd.DataFrame, corners: pd.Series) -> pd.Series:
        out = []
        for row, pts in zip(image.to_dict("records"), corners, strict=True):
            try:
                quad = np.array([(p["x"], p["y"]) for p in pts], float)
                out.append(color_share(warped(as_array(row), quad, side, side)) if len(quad) == 4 else 0.0)
            except (ValueError, TypeError, KeyError, np.linalg.LinAlgError):
                out.append(0.0)
        return pd.Series(out, dtype="float64")

    ratio = F.pandas_udf(run, "double")(F.col(image_col).cast(IMAGE), F.col(corners_col))
    found = images.select(id_col, ratio.alias("color_ratio"))
    return found.withColumn("mode", F.when(F.col("color_ratio") > 0.005, "color_enhanced").otherwise("document_enhanced"))


def measured(pixels: np.ndarray) -> tuple[float, float, float]:
    """Variance of the Laplacian, mean, and share of dark pixels of the gray image, like operators.pixels.capture_metrics."""
    v = gray(pixels).astype(np.float64)
    p = np.pad(v, ((1, 1), (0, 0)), mode="reflect" if v.shape[0] > 1 else "edge")
    q = np.pad(v, ((0, 0), (1, 1)), mode="reflect" if v.shape[1] > 1 else "edge")
    lap = p[:-2] + p[2:] + q[:, :-2] + q[:, 2:] - 4 * v
    return float(lap.var()), float(v.mean()), float((v <= LIMITS.dark_pixel).mean())


def assess_documents(images: DataFrame, peak_col: str | None = None, id_col: str = "image_id", image_col: str = "image", corners_col: str = "corners") -> DataFrame:
    """id, focus, luma, dark_ratio, level, reasons of each image within its corners, or of the whole image where they give no region.

    The region is a Catalyst expression; only cutting out and measuring is done in Python. Images that can't
    be measured count as flat and half bright, as do missing ones.
    """
    w, h = F.col(f"{image_col}.width"), F.col(f"{image_col}.height")
    roi = F.coalesce(g.document_roi(F.col(corners_col), w, h, 320), g.whole_frame_roi(w, h, 320))

    def run(image: pd.DataFrame, rect: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, r in zip(image.to_dict("records"), rect.to_dict("records"), strict=True):
            try:
                cut = as_array(row)[int(r["sy"]) : int(r["sy"] + r["sh"]), int(r["sx"]) : int(r["sx"] + r["sw"])]
                out.append(measured(resized(cut, int(r["dw"]), int(r["dh"]))))
            except (ValueError, TypeError, KeyError, IndexError):
                out.append((0.0, 128.0, 0.0))
        return pd.DataFrame(out, columns=["focus", "luma", "dark_ratio"])

    metrics = F.pandas_udf(run, "focus double, luma double, dark_ratio double")(F.col(image_col).cast(IMAGE), roi)
    peak = F.col(peak_col).cast("double") if peak_col else F.lit(0.0)
    found = images.select(id_col, peak.alias("_peak"), metrics.alias("_m")).select(id_col, "_peak", "_m.*")
    judged = found.withColumn("_q", capture_quality(F.col("focus"), F.col("luma"), F.col("dark_ratio"), F.col("_peak")))
    return judged.select(id_col, "focus", "luma", "dark_ratio", "_q.level", "_q.reasons")
