"""Recognised lines: decoding of a recogniser's steps, words on the page, and the text of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.jsnum import clamp, is_blank, round_half_up
from .page_images import IMAGE, as_array, crop_line, resized

#: A vocabulary of so many letters at most is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_LETTERS = 100_000
LINE_HEIGHT, LEAST_WIDTH, MOST_WIDTH = 48, 16, 1024
WORD = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"


def line_width(w: Column, h: Column) -> Column:
    """The recogniser's input width for a line of 48 pixels' height."""
    return clamp(round_half_up(LINE_HEIGHT * (w / h)), LEAST_WIDTH, MOST_WIDTH).cast("int")


def dictionary(text: str) -> list[str]:
    """The lines of a dictionary file; a final line end leaves an empty last entry."""
    return text.replace("\r\n", "\n").split("\n")


def best_step(values: Column) -> Column:
    """struct(value, index) of the first greatest number of a step; NaN never wins, and an empty step has index -1."""
    clean = F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (v > F.lit(float("-inf"))))
    top = F.array_max(clean)
    index = F.array_position(F.transform(values, lambda v: v.cast("double")), top) - 1
    return F.struct(top.alias("value"), F.coalesce(index, F.lit(-1)).cast("int").alias("index"))


def squashed(mean: Column) -> Column:
    """Means above 1 are taken for logits; those below 0 count as 0; times 100."""
    return 100 * F.when(mean > 1, 1 / (1 + F.exp(-mean))).when(mean < 0, 0.0).otherwise(F.coalesce(mean, F.lit(0.0)))


def decode(steps: Column, letters: list[str] | Column) -> Column:
    """struct(text, confidence) of an array of steps, each an array of numbers: index 0 is blank, i the i-th letter.

    A step speaks where its best index is not blank and not that of the step before; an index beyond the
    letters says nothing but still separates. confidence is the mean best value of the steps that spoke.
    """
    known = F.array(*[F.lit(c) for c in letters]) if isinstance(letters, list) else letters
    start = F.struct(F.lit(-1).alias("before"), F.lit("").alias("text"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        spoken = (s["index"] > 0) & (s["index"] <= F.size(known)) & (s["index"] != a["before"])
        text = F.when(spoken, F.concat(a["text"], F.get(known, s["index"] - 1))).otherwise(a["text"])
        total = F.when(spoken, a["total"] + s["value"]).otherwise(a["total"])
        return F.struct(s["index"].alias("before"), text.alias("text"), total.alias("total"), (a["n"] + F.when(spoken, 1).otherwise(0)).alias("n"))

    def finish(a: Column) -> Column:
        return F.struct(a["text"].alias("text"), squashed(F.try_divide(a["total"], a["n"])).alias("confidence"))

    return F.aggregate(F.transform(steps, best_step), start, step, finish)


def decode_rows(steps: DataFrame, letters: DataFrame, seq_col: str = "seq_id") -> DataFrame:
    """seq, text, confidence from a row per sequence, t and v with p; ``letters`` has index and letter.

    The relational form of decode, for recognisers whose vocabulary is too large to keep steps as
    nested arrays: one partial aggregation per step, one window per sequence.
    """
    p = F.when(~F.isnan("p"), F.col("p").cast("double"))
    best = steps.groupBy(seq_col, "t").agg(F.max(F.struct(p.alias("p"), (-F.col("v")).alias("_v"))).alias("b"))
    best = best.select(seq_col, "t", F.col("b.p").alias("p"), F.when(F.col("b.p").isNull(), -1).otherwise(-F.col("b._v")).alias("index"))
    before = F.lag("index", 1, -2).over(Window.partitionBy(seq_col).orderBy("t"))
    letters = F.broadcast(letters) if letters.count() <= BROADCAST_LETTERS else letters
    named = best.withColumn("_before", before).join(letters, "index", "left")
    spoken = (F.col("index") > 0) & F.col("letter").isNotNull() & (F.col("index") != F.col("_before"))
    said = F.array_sort(F.collect_list(F.when(spoken, F.struct("t", "letter", "p"))))
    found = named.groupBy(seq_col).agg(said.alias("said"))
    text = F.array_join(F.transform("said", lambda s: s["letter"]), "")
    total = F.aggregate("said", F.lit(0.0), lambda a, s: a + s["p"])
    return found.select(seq_col, text.alias("text"), squashed(F.try_divide(total, F.size("said"))).alias("confidence"))


def words_on_source(lines: DataFrame, fx: Column, fy: Column) -> DataFrame:
    """Adds word, in the pixels of the source, from the first and third corner of box; lines of spaces only go, text stays untrimmed."""
    b = [g.at(F.col("box"), i) for i in range(3)]
    bbox = F.struct((b[0]["x"] * fx).alias("x0"), (b[0]["y"] * fy).alias("y0"), (b[2]["x"] * fx).alias("x1"), (b[2]["y"] * fy).alias("y1"))
    return lines.where(~is_blank(F.col("text"))).withColumn("word", F.struct("text", "confidence", bbox.alias("bbox")).cast(WORD))


def pages_of_words(words: DataFrame, by: list[str], order: str = "line_no", w_col: str = "source_w", h_col: str = "source_h") -> DataFrame:
    """``by`` and text (lines joined by line ends), words, width, height: one row per page. A page's words are bounded by its size."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), "word")))
    found = words.groupBy(*by).agg(F.transform(lines, lambda s: s["word"]).alias("words"), F.max(w_col).alias("width"), F.max(h_col).alias("height"))
    return found.select(*by, F.array_join(F.transform("words", lambda w: w["text"]), "\n").alias("text"), "words", "width", "height")


def line_tensor(line: np.ndarray) -> np.ndarray:
    """[1, 3, 48, w] in -1..1."""
    w = int(min(MOST_WIDTH, max(LEAST_WIDTH, np.floor(LINE_HEIGHT * line.shape[1] / line.shape[0] + 0.5))))
    small = resized(line, w, LINE_HEIGHT).astype(np.float64)
    rgb = np.repeat(small, 3, axis=2) if small.shape[2] == 1 else small[..., :3]
    return (rgb * (2.0 / 255.0) - 1.0).transpose(2, 0, 1).astype(np.float32)[None]


def crop_lines(boxes: DataFrame, images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """id, line_no and line: each box cut out of its image and made level. Images join once, boxes don't carry them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for image, boxes_ in zip(pdf["image"], pdf["boxes"], strict=True):
                pixels = as_array(image)
                for b in boxes_:
                    line = crop_line(pixels, np.array([(p["x"], p["y"]) for p in b["box"]]))
                    done.append((b["line_no"], {"height": line.shape[0], "width": line.shape[1], "channels": line.shape[2], "data": np.ascontiguousarray(line).tobytes()}))
            keys = np.repeat(pdf["id"].to_numpy(), pdf["boxes"].map(len))
            yield pd.DataFrame({"id": keys, "line_no": [d[0] for d in done], "line": [d[1] for d in done]})

    own = boxes.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line_no", "box"))).alias("boxes"))
    both = images.join(own, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast(IMAGE).alias("image"), "boxes")
    return both.mapInPandas(run, f"id long, line_no int, line {IMAGE}").withColumnRenamed("id", id_col)


def recognise(lines: DataFrame, model_path: str, letters: list[str], id_col: str = "image_id") -> DataFrame:
    """id, line_no, text, confidence of lines by an ONNX recogniser, with one session for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])
        feed = session.get_inputs()[0].name
        for pdf in batches:
            steps = [session.run(None, {feed: line_tensor(as_array(x))})[0][0].astype(float).tolist() for x in pdf["line"]]
            yield pd.DataFrame({"id": pdf["id"], "line_no": pdf["line_no"], "steps": steps})

    slim = lines.select(F.col(id_col).cast("long").alias("id"), "line_no", "line")
    found = slim.mapInPandas(run, "id long, line_no int, steps array<array<double>>")
    return found.withColumn("_d", decode(F.col("steps"), letters)).select(F.col("id").alias(id_col), "line_no", "_d.text", "_d.confidence")
