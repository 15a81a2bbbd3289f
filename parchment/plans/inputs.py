"""Capture data derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

LETTERS = ["a", "b", "c", "d", "e", "f", "g"]
_BASE = ((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight corner model outputs for each vector: vec_id, label, q, pts (0..1), logit, w, h."""
    v = _vectors(spark, sf_dir).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k = F.when(F.col("q") == 0, 0.25).when(F.col("q") == 1, 1.6).otherwise(1.0)
    at = lambda i: F.get("e", F.col("q") * 8 + i)
    pts = g.quad(*[tuple(0.5 + (base + 0.5 * at(2 * i + j) - 0.5) * k for j, base in enumerate(p)) for i, p in enumerate(_BASE)])
    return v.select("vec_id", "label", "q", pts.alias("pts"), (8 * F.get("e", F.lit(0))).alias("logit"), F.lit(640).alias("w"), F.lit(480).alias("h"))


def _sql_point(i: int) -> str:
    k = "(CASE q WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END)"
    x, y = (f"0.5::DOUBLE + ({_BASE[i][j]}::DOUBLE + 0.5::DOUBLE * embedding[q * 8 + {2 * i + j + 1}]::DOUBLE - 0.5::DOUBLE) * {k}" for j in (0, 1))
    return f"{x} AS x{i}, {y} AS y{i}"


QUADS_SQL = f"quads AS (SELECT vec_id, label, q::INT AS q, {', '.join(_sql_point(i) for i in range(4))}, 8 * embedding[1]::DOUBLE AS logit, 640 AS w, 480 AS h FROM embeddings, range(8) r(q))"


def _by4(*values: float) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("vec_id") % 4 + 1).cast("int"))


def _level(e: Column, c: Column, o: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((e * c + o) * 255 + 0.5))).cast("int")


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 images: image_id, y, x, v."""
    cells = _vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "e"))
    v = _level(F.col("e"), _by4(1, 0.1, 1, 0.1), _by4(0.5, 0.5, 0.38, 0.2))
    return cells.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


GRAY_SQL = """gray_px AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x,
  least(255, greatest(0, floor((embedding[i + 1]::DOUBLE * list_value(1.0::DOUBLE, 0.1, 1.0, 0.1)[vec_id % 4 + 1] + list_value(0.5::DOUBLE, 0.5, 0.38, 0.2)[vec_id % 4 + 1]) * 255 + 0.5)))::INT AS v
  FROM embeddings, range(64) r(i))"""


def rgba_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4 images: image_id, y, x, r, g, b, a."""
    cells = _vectors(spark, sf_dir).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    c = F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.01)
    of = lambda k: _level(F.get("e", F.col("i") * 4 + k), c, F.lit(0.5))
    return cells.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).alias("x"), *[of(k).alias(n) for k, n in enumerate("rgba")])


def _sql_channel(k: int) -> str:
    return f"least(255, greatest(0, floor((embedding[i * 4 + {k + 1}]::DOUBLE * (CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END) + 0.5::DOUBLE) * 255 + 0.5)))::INT AS {'rgba'[k]}"


RGBA_SQL = f"rgba_px AS (SELECT vec_id AS image_id, (i // 4)::INT AS y, (i % 4)::INT AS x, {', '.join(_sql_channel(k) for k in range(4))} FROM embeddings, range(16) r(i))"


#: The channels of a page take the vector's values from these places on.
_TURNS = {"r": 0, "g": 21, "b": 42}


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 64 columns: image_id, y, x, r, g, b. Eight vectors make a page, each of them eight rows; the last page may be lower."""
    v = _vectors(spark, sf_dir)
    cells = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(511)))).withColumns({"k": (F.col("vec_id") % 8).cast("int"), "row": F.floor(F.col("i") / 64).cast("int"), "x": F.col("i") % 64})
    place = F.col("row") * 8 + (F.floor(F.col("x") / 8) + F.col("x") + F.col("k")) % 8
    of = lambda turn: _level(F.get("e", ((place + turn) % 64).cast("int")), F.when(F.col("k") % 2 == 0, 0.9).otherwise(0.15), F.lit(0.55))
    return cells.select(F.floor(F.col("vec_id") / 8).cast("long").alias("image_id"), (F.col("k") * 8 + F.col("row")).alias("y"), "x", *[of(t).alias(n) for n, t in _TURNS.items()])


def _sql_page_channel(name: str) -> str:
    place = f"((i // 64 * 8 + (i % 64 // 8 + i % 64 + vec_id % 8) % 8 + {_TURNS[name]}) % 64)::INT"
    return f"least(255, greatest(0, floor((embedding[{place} + 1]::DOUBLE * (CASE WHEN vec_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.15::DOUBLE END) + 0.55::DOUBLE) * 255 + 0.5)))::INT AS {name}"


PAGES_SQL = f"page_px AS (SELECT (vec_id // 8)::BIGINT AS image_id, (vec_id % 8 * 8 + i // 64)::INT AS y, (i % 64)::INT AS x, {', '.join(map(_sql_page_channel, _TURNS))} FROM embeddings, range(512) r(i))"
PAGE_SIZES_SQL = "page_sizes AS (SELECT image_id, max(x) + 1 AS src_w, max(y) + 1 AS src_h FROM page_px GROUP BY image_id)"


def page_sizes(pixels: DataFrame) -> DataFrame:
    """image_id, src_w, src_h of images without missing pixels."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("src_w"), (F.max("y") + 1).alias("src_h"))


def ctc_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight steps of eight numbers: seq_id, steps."""
    i = F.col("vec_id") % 4
    value = lambda x, k: F.when(i == 0, x).when(i == 1, 8 * x).when(i == 2, x - 1).otherwise(x + F.when(k % 8 == 0, 2.0).otherwise(0.0))
    flat = F.transform("e", value)
    return _vectors(spark, sf_dir).withColumn("f", flat).select(F.col("vec_id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("f", t * 8 + 1, F.lit(8))).alias("steps"))


CTC_SQL = """ctc AS (SELECT vec_id AS seq_id, (i // 8)::INT AS t, (i % 8)::INT AS v,
  CASE vec_id % 4 WHEN 0 THEN embedding[i + 1]::DOUBLE WHEN 1 THEN 8 * embedding[i + 1]::DOUBLE WHEN 2 THEN embedding[i + 1]::DOUBLE - 1 ELSE embedding[i + 1]::DOUBLE + CASE WHEN i % 8 = 0 THEN 2 ELSE 0 END END AS p
  FROM embeddings, range(64) r(i))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera frame for each event, 33 ms apart with a pause after every twentieth and one of 40 seconds after every fortieth; sessions are users. Now and then no model is ready."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    k = F.get_json_object("props", "$.k").cast("double")
    i = F.col("event_id")
    outcome = F.when(i % 97 == 5, "unready").when(i % 101 == 0, "reset").when(i % 211 == 1, "hidden").when(i % 53 == 1, "wake").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "miss").otherwise("hit")
    shift = (i * 7919 % 41 - 20 + F.when(i % 7 == 0, 150).otherwise(0)).cast("double")
    skew = F.when(i % 11 == 0, 90.0).otherwise(0.0)
    box = g.quad((64 + shift, 48 + shift / 2), (400 + shift, 48 + shift / 2 + skew), (400 + shift, 400 + shift / 2), (64 + shift, 400 + shift / 2))
    own = e.withColumn("seq", n)
    return own.select(F.col("user_id").alias("session"), "seq", (F.col("seq") * 33 + F.floor(F.col("seq") / 20) * 900 + F.floor(F.col("seq") / 40) * 40000).cast("double").alias("frame_ms"), outcome.alias("outcome"), box.alias("quad"), F.lit(640.0).alias("w"), F.lit(480.0).alias("h"), (F.col("value") * 10).alias("focus"), (40 + 1.5 * k).alias("luma"), ((99 - k) / 150).alias("dark"))


FRAMES_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, json_extract_string(props, '$.k')::DOUBLE AS k,
    (event_id * 7919 % 41 - 20 + CASE WHEN event_id % 7 = 0 THEN 150 ELSE 0 END)::DOUBLE AS d, CASE WHEN event_id % 11 = 0 THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END AS skew FROM events),
frames AS (SELECT user_id AS session, n AS seq, (n * 33 + n // 20 * 900 + n // 40 * 40000)::DOUBLE AS frame_ms,
    CASE WHEN event_id % 97 = 5 THEN 'unready' WHEN event_id % 101 = 0 THEN 'reset' WHEN event_id % 211 = 1 THEN 'hidden' WHEN event_id % 53 = 1 THEN 'wake' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'miss' ELSE 'hit' END AS outcome,
    [64 + d, 48 + d / 2, 400 + d, 48 + d / 2 + skew, 400 + d, 400 + d / 2, 64 + d, 400 + d / 2] AS quad, value * 10 AS focus, 40 + 1.5::DOUBLE * k AS luma, (99 - k) / 150 AS dark FROM numbered)"""


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events from a conversation: captures and saves, and now and then a cancel, a step back or a new scan."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") + F.col("conv_id") % 5
    action = F.when(t % 3 == 0, "capture").when(t % 11 == 10, "start_new_scan").when(t % 7 == 5, "back_to_edit").when(t % 13 == 7, "cancel_edit").when(t % 17 == 8, "back_to_scanner").otherwise("save_page")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("color_enhanced", "color_original", "document_enhanced", "document_original")]), (F.col("turn") % 4 + 1).cast("int"))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), action.alias("action"), mode.alias("mode"), (F.col("turn") % 2 == 1).alias("enable_ocr"), F.when(t % 4 != 1, F.col("text")).alias("ocr_text"))


SCAN_EVENTS_SQL = """scan_events AS (SELECT conv_id AS session, turn AS seq,
    CASE WHEN t % 3 = 0 THEN 'capture' WHEN t % 11 = 10 THEN 'start_new_scan' WHEN t % 7 = 5 THEN 'back_to_edit' WHEN t % 13 = 7 THEN 'cancel_edit' WHEN t % 17 = 8 THEN 'back_to_scanner' ELSE 'save_page' END AS action,
    ['color_enhanced', 'color_original', 'document_enhanced', 'document_original'][turn % 4 + 1] AS mode, turn % 2 = 1 AS enable_ocr, CASE WHEN t % 4 <> 1 THEN text END AS ocr_text
    FROM (SELECT *, turn + conv_id % 5 AS t FROM conversations))"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every conversation turn on a grid of ten columns: session, page, word_no, text, x0..y1, confidence, page_w, page_h."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    w = c.select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("page"), F.posexplode(F.split("text", " ")).alias("word_no", "text"))
    col, row = F.col("word_no") % 10, F.floor(F.col("word_no") / 10)
    x0, y0 = (col * 100 + 7).cast("double"), (row * 20 + 3).cast("double")
    return w.select("session", "page", "word_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + 83).alias("x1"), (y0 + 15).alias("y1"), (F.col("word_no") % 101).cast("double").alias("confidence"), F.when(F.col("page") % 5 == 4, 0.0).otherwise(1000.0).alias("page_w"), F.lit(1414.0).alias("page_h"))


WORDS_SQL = """split_words AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE text IS NOT NULL),
ocr_words AS (SELECT conv_id AS session, turn::INT AS page, i::INT AS word_no, ws[i + 1] AS text, (i % 10 * 100 + 7)::DOUBLE AS x0, (i // 10 * 20 + 3)::DOUBLE AS y0,
    (i % 10 * 100 + 90)::DOUBLE AS x1, (i // 10 * 20 + 18)::DOUBLE AS y1, (i % 101)::DOUBLE AS confidence, CASE WHEN turn % 5 = 4 THEN 0.0::DOUBLE ELSE 1000.0::DOUBLE END AS page_w, 1414.0::DOUBLE AS page_h
    FROM split_words, range(len(ws)) r(i))"""


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, page, words, width, height; a turn without a text is a page where nothing was recognised."""
    w = ocr_words(spark, sf_dir)
    bbox = F.struct("x0", "y0", "x1", "y1")
    words = F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.struct("text", "confidence", bbox.alias("bbox")).alias("word")))), lambda s: s["word"])
    known = w.groupBy("session", "page").agg(words.alias("words"), F.max("page_w").alias("width"), F.max("page_h").alias("height"))
    all_pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("page"))
    return all_pages.join(known, ["session", "page"], "left")
