"""Reading images, and PNG; files are in .files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.page_images import IMAGE, as_array


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, image (RGB order where there are channels) and valid (it has pixels); what can't be decoded has a null image.

    Original bytes are kept beside the pixels, not encoded again.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    decoded = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    fields = decoded.select(F.col("origin").alias("_origin"), "height", "width", "nChannels", "data")
    packed = fields.select("_origin", F.when(F.col("width") > 0, F.struct("height", "width", F.col("nChannels").alias("channels"), rgb_order(F.col("data"), F.col("nChannels")).alias("data"))).alias("image"))
    same = F.regexp_replace(raw["path"], "^file:/+", "/") == F.regexp_replace(packed["_origin"], "^file:/+", "/")
    return raw.join(packed, same, "left").select("path", "content", "image", F.col("image").isNotNull().alias("valid"))


def rgb_order(data: Column, channels: Column) -> Column:
    """Spark's image source gives blue, green, red."""

    def turn(raw: pd.Series, n: pd.Series) -> pd.Series:
        flip = lambda d, k: d if k < 3 else np.frombuffer(d, np.uint8).reshape(-1, k)[:, [2, 1, 0, *range(3, k)]].tobytes()
        return pd.Series([None if d is None else flip(d, int(k)) for d, k in zip(raw, n, strict=True)])

    return F.pandas_udf(turn, "binary")(data, channels)


def with_pixels(images: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    return images.where((F.col(w) > 0) & (F.col(h) > 0))


def from_data_url(url: Column) -> Column:
    """struct(mime, content) of a base64 data URL; null for anything else."""
    found = F.regexp_extract(url, "^data:([^;,]+);base64,", 1)
    return F.when(found != "", F.struct(found.alias("mime"), F.try_to_binary(F.regexp_replace(url, "^[^,]*,", ""), F.lit("base64")).alias("content")))


def to_data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def png_bytes(pixels: np.ndarray) -> bytes:
    kind = {1: 0, 3: 2, 4: 6}[pixels.shape[2]]
    h, w = pixels.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encoded(image: Column, encode: Callable[[np.ndarray], bytes] = png_bytes) -> Column:
    """struct(content, error): a failed page says why, and the others go on. ``encode`` may be any other encoder, such as one for JPEG."""

    def run(images: pd.DataFrame) -> pd.DataFrame:
        done = []
        for row in images.to_dict("records"):
            try:
                done.append((encode(as_array(row)), None))
            except (KeyError, ValueError, TypeError) as e:
                done.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(done, columns=["content", "error"])

    return F.pandas_udf(run, "content binary, error string")(image.cast(IMAGE))
