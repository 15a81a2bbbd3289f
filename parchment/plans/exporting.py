"""Queries on recognised text, preferences, names and exported documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import exports, sessions, text_lines
from ..sources import files, preferences
from ..sources.shared import shared_folder
from .inputs import CTC_SQL, LETTERS, WORDS_SQL, ctc_steps, ocr_words, table, word_pages
from .pages import _images
from .registry import query

_BEST = "best AS (SELECT seq_id, t, max(p) AS p, arg_min(v, (-p, v)) AS i FROM ctc GROUP BY seq_id, t), stepped AS (SELECT *, lag(i, 1, -1) OVER (PARTITION BY seq_id ORDER BY t) AS before FROM best)"
_SAID = "said AS (SELECT seq_id, coalesce(string_agg(CASE WHEN i > 0 AND i <= 7 AND i <> before THEN ['a', 'b', 'c', 'd', 'e', 'f', 'g'][i] END, '' ORDER BY t), '') AS text, avg(CASE WHEN i > 0 AND i <= 7 AND i <> before THEN p END) AS m FROM stepped GROUP BY seq_id)"
_DECODED = f"WITH {CTC_SQL}, {_BEST}, {_SAID} SELECT seq_id, text, round(100 * CASE WHEN m > 1 THEN 1 / (1 + exp(-m)) WHEN m < 0 THEN 0 ELSE coalesce(m, 0) END, 6) AS confidence FROM said"


@query(_DECODED)
def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and confidence of every sequence of steps."""
    d = ctc_steps(spark, sf_dir).withColumn("d", text_lines.decode(F.col("steps"), LETTERS))
    return d.select("seq_id", "d.text", F.round("d.confidence", 6).alias("confidence"))


@query(_DECODED)
def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a row per number."""
    rows = ctc_steps(spark, sf_dir).select("seq_id", F.posexplode("steps").alias("t", "s")).select("seq_id", "t", F.posexplode("s").alias("v", "p"))
    letters = spark.createDataFrame(list(enumerate(LETTERS, 1)), "index int, letter string")
    d = text_lines.decode_rows(rows, letters)
    return d.select("seq_id", "text", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {WORDS_SQL}, kept AS (SELECT *, x0 * 2 AS sx0, y1 * 2.5::DOUBLE AS sy1 FROM ocr_words WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT session, page, count(*) AS n_words, md5(string_agg(text, chr(10) ORDER BY word_no)) AS text_md5, round(sum(sx0), 4) AS sum_x0, round(max(sy1), 6) AS last_y, round(avg(confidence), 6) AS confidence FROM kept GROUP BY session, page""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words put on their source page, and pages of them in order."""
    w = ocr_words(spark, sf_dir)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = w.withColumn("box", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))
    pages = text_lines.pages_of_words(text_lines.words_on_source(lines, F.lit(2.0), F.lit(2.5)), ["session", "page"], "word_no", "page_w", "page_h")
    total = lambda f: F.aggregate("words", F.lit(0.0), lambda a, x: a + f(x))
    n = F.size("words")
    return pages.select("session", "page", n.cast("long").alias("n_words"), F.md5("text").alias("text_md5"), F.round(total(lambda x: x["bbox"]["x0"]), 4).alias("sum_x0"), F.round(F.array_max(F.transform("words", lambda x: x["bbox"]["y1"])), 6).alias("last_y"), F.round(total(lambda x: x["confidence"]) / n, 6).alias("confidence"))


_PREFS = "prefs AS (SELECT event_type || user_id AS key, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN '{not-json' WHEN event_id % 89 = 0 THEN NULL ELSE props END AS value FROM events)"


def preference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq and value of a log of preferences, some of them malformed or missing."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), i.alias("seq"), F.when(i % 97 == 0, "{not-json").when(i % 89 == 0, None).otherwise(F.col("props")).alias("value"))


@query(f"""WITH {_PREFS}, newest AS (SELECT key, arg_max_null(value, seq) AS value FROM prefs GROUP BY key)
SELECT key, CASE WHEN json_valid(value) THEN value ELSE 'true' END AS value, coalesce(CASE WHEN json_valid(value) THEN json_extract_string(value, '$.k')::INT END, -1) AS k FROM newest""")
def latest_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value written for each key; missing and malformed ones give the default."""
    log = preference_log(spark, sf_dir)
    newest = preferences.latest(log).withColumn("value", preferences.load_json(F.col("value"), "true"))
    return newest.select("key", "value", F.coalesce(F.get_json_object("value", "$.k").cast("int"), F.lit(-1)).alias("k"))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, 'Scan_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || CASE WHEN o_orderkey % 1500 + 1 < 1000 THEN lpad((o_orderkey % 1500 + 1)::VARCHAR, 3, '0') ELSE (o_orderkey % 1500 + 1)::VARCHAR END || CASE WHEN o_orderkey % 2 = 0 THEN '.png' ELSE '.jpg' END AS page_file,
  'Scan_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.pdf' AS pdf_file FROM orders""")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = naming.time_stamp(F.col("o_orderdate"))
    i = F.col("o_orderkey") % 1500
    name = F.when(F.col("o_orderkey") % 2 == 0, naming.page_file_name(stamp, i, "png")).otherwise(naming.page_file_name(stamp, i, "jpeg"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), stamp.alias("stamp"), name.alias("page_file"), naming.document_file_name(stamp, "pdf").alias("pdf_file"))


@query("""SELECT conv_id AS session, string_agg(text, chr(10) || chr(10) || '--- ページ区切り ---' || chr(10) || chr(10) ORDER BY turn) AS text,
  count(*)::VARCHAR || ':' || string_agg(coalesce(length(text), 0)::VARCHAR, ',' ORDER BY turn) || ':' || coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (text IS NOT NULL), '') AS export_key FROM conversations GROUP BY conv_id""")
def copied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's text with page breaks, and the key that tells whether an export is out of date."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    numbered = sessions.page_indexes(c).select("session", "page", F.col("seq"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    ocr = c.where("text is not null").select("session", F.col("seq").cast("int").alias("page"), "text")
    paired = sessions.pages_with_text(numbered.withColumn("page", F.col("seq").cast("int")), ocr)
    rows = F.array_sort(F.collect_list(F.struct("page", "n", F.col("text").isNotNull().alias("has"))))
    keys = paired.groupBy("session").agg(rows.alias("r"))
    key = naming.export_key(F.transform("r", lambda s: s["n"]), F.transform(F.filter("r", lambda s: s["has"]), lambda s: s["page"]))
    return keys.join(sessions.copied_text(ocr), "session", "left").select("session", "text", key.alias("export_key"))


def _shown(expression: str) -> str:
    return f"round(({expression})::DECIMAL(38,18), 3)::DECIMAL(20,3)::VARCHAR"


_WORD = (
    "'<div class=\"word\" style=\"left: ' || "
    + " || ".join(f"{_shown(e)} || '{after}'" for e, after in (("x0 / w * 100", "%; top: "), ("y0 / h * 100", "%; width: "), ("(x1 - x0) / w * 100", "%; height: "), ("(y1 - y0) / h * 100", "%; font-size: "), ("(y1 - y0) / w * 100 * 0.70::DOUBLE", 'cqw;">')))
    + " || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') || '</div>' || chr(10)"
)
_NUMBER = "rtrim(rtrim({0}::DECIMAL(20,6)::VARCHAR, '0'), '.')"
_HTML = f"""WITH {WORDS_SQL}, known AS (SELECT *, coalesce(nullif(page_w, 0), 1200) AS w, coalesce(nullif(page_h, 0), 1697) AS h FROM ocr_words),
drawn AS (SELECT session, page, any_value(w) AS w, any_value(h) AS h, coalesce(string_agg({_WORD}, '' ORDER BY word_no) FILTER (regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''), '') AS body FROM known GROUP BY session, page),
shown AS (SELECT c.conv_id AS session, c.turn::INT AS page, '<!-- ' || (c.turn + 1) || ' -->' || chr(10) || '<div class="page" style="aspect-ratio: ' || {_NUMBER.format("coalesce(w, 1200)")} || ' / ' || {_NUMBER.format("coalesce(h, 1697)")} || ';">' || chr(10) || coalesce(body, '<div class="empty">{exports.NO_TEXT}</div>' || chr(10)) || '</div>' || chr(10) AS part FROM conversations c LEFT JOIN drawn d ON d.session = c.conv_id AND d.page = c.turn)
"""


@query(_HTML + "SELECT session, page, part FROM shown")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = word_pages(spark, sf_dir)
    return p.select("session", "page", exports.html_page(F.col("page"), F.col("words"), F.col("width"), F.col("height")).alias("part"))


@query(_HTML + f"SELECT session, md5('{exports.HEAD}' || string_agg(part, '' ORDER BY page) || '{exports.TAIL}') AS html_md5 FROM shown GROUP BY session")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.html_documents(word_pages(spark, sf_dir)).select("session", F.md5("html").alias("html_md5"))


_FILE = "'Scan_' || strftime(DATE '2024-01-01' + (s.session % 365)::INT, '%Y%m%d_%H%M%S') || '_' || s.session || '_' || lpad((s.page + 1)::VARCHAR, 3, '0') || '.html'"


@query(_HTML + f"SELECT {_FILE} AS file_name, CASE WHEN c.text IS NOT NULL THEN strlen(part) END AS bytes, CASE WHEN c.text IS NULL THEN 'no text' END AS error FROM shown s JOIN conversations c ON c.conv_id = s.session AND c.turn = s.page")
def exported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page, named by its session's one time stamp and its number, and an error for each page without text; what the writer says of them."""
    p = word_pages(spark, sf_dir)
    part = exports.html_page(F.col("page"), F.col("words"), F.col("width"), F.col("height"))
    stamp = naming.time_stamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("session") % 365).cast("int")).cast("timestamp"))
    name = F.concat(F.lit("Scan_"), stamp, F.lit("_"), F.col("session").cast("string"), F.lit("_"), F.lpad((F.col("page") + 1).cast("string"), 3, "0"), F.lit(".html"))
    known = F.col("words").isNotNull()
    ready = p.select(name.alias("file_name"), F.when(known, F.encode(part, "utf-8")).alias("content"), F.when(~known, "no text").alias("error"))
    return files.write_files(ready, f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}", error_col="error")


@query("""SELECT page_id, replace(replace(replace(replace(replace(html || ' it''s', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM pages""")
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", exports.escape_html(F.concat("html", F.lit(" it's"))).alias("escaped"))


@query(f"""WITH {WORDS_SQL} SELECT session, page, word_no, text, round(x0 * (1600 / page_w), 6) AS x, round(2262 - y1 * (2262 / page_h), 6) AS y, round(greatest((y1 - y0) * (2262 / page_h) * 0.8::DOUBLE, 4), 6) AS size FROM ocr_words WHERE page_w > 0""")
def pdf_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word is drawn on a PDF page of 1600 x 2262."""
    w = ocr_words(spark, sf_dir).where("page_w > 0")
    word = F.struct("text", "confidence", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    at = w.withColumn("at", exports.text_placement(word, F.lit(1600), F.lit(2262), F.col("page_w"), F.col("page_h")))
    return at.select("session", "page", "word_no", "at.text", *[F.round(f"at.{c}", 6).alias(c) for c in ("x", "y", "size")])


def _pictured(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Pages with an image each."""
    small = _images(spark, sf_dir).withColumnRenamed("image_id", "_i")
    count = small.agg(F.count("*")).scalar()
    return pages.withColumn("_i", (F.col("session") * 31 + F.col("page")) % count).join(small, "_i")


@query()
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF for each session: images with a text layer."""
    done = exports.pdf_documents(_pictured(spark, sf_dir, word_pages(spark, sf_dir)))
    return done.select("session", F.octet_length("pdf").alias("bytes"), F.sha2("pdf", 256).alias("sha256"))


def _length_of(body: str) -> int:
    return len(exports._stream("", body.encode(), False))


_IMAGE_OBJECT = len(exports._stream("/Type /XObject /Subtype /Image /Width 32 /Height 24 /ColorSpace /DeviceRGB /BitsPerComponent 8", bytes(32 * 24 * 3), False))
_TEXT_OBJECT = _length_of("q 32 0 0 24 0 0 cm /I Do Q\nBT 3 Tr\nET")
_FIXED = ", ".join(f"({no}, {len(body)})" for no, body in [(1, exports.CATALOGUE), *enumerate(exports._fonts(False), 3)])


@query(f"""WITH pages AS (SELECT conv_id AS session, turn::INT AS page, (conv_id + turn) % 11 = 0 AS failed FROM conversations), good AS (SELECT session, page, row_number() OVER (PARTITION BY session ORDER BY page) - 1 AS nth FROM pages WHERE NOT failed),
counts AS (SELECT session, count(*) AS n, string_agg((nth * 3 + 10)::VARCHAR || ' 0 R', ' ' ORDER BY nth) AS kids FROM good GROUP BY session),
objects AS (SELECT session, no, len, NULL::INT AS page FROM counts, (VALUES {_FIXED}) f(no, len) UNION ALL SELECT session, 2, length('<< /Type /Pages /Count ' || n || ' /Kids [' || kids || '] >>'), NULL FROM counts
  UNION ALL SELECT session, 8 + nth * 3 + i, CASE i WHEN 0 THEN {_IMAGE_OBJECT} WHEN 1 THEN {_TEXT_OBJECT} ELSE length('<< /Type /Page /Parent 2 0 R /MediaBox [0 0 32 24] /Contents ' || (9 + nth * 3) || ' 0 R /Resources << /XObject << /I ' || (8 + nth * 3) || ' 0 R >> /Font << /F1 3 0 R /F2 4 0 R >> >> >>') END, page FROM good, range(3) r(i)),
sized AS (SELECT session, no, page, length(no::VARCHAR) + 15 + len AS size FROM objects), ends AS (SELECT session, 8 + 3 * any_value(n) AS o, 9 + sum(size) AS e FROM sized JOIN counts USING (session) GROUP BY session)
SELECT session, no::INT AS no, (9 + coalesce(sum(size) OVER (PARTITION BY session ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, size::INT AS size, page, false AS failed FROM sized
UNION ALL SELECT session, 0, 0, 9, NULL, false FROM counts UNION ALL SELECT session, NULL, NULL, NULL, page, true FROM pages WHERE failed
UNION ALL SELECT session, o, e, length('xref' || chr(10) || '0 ' || o || chr(10) || '0000000000 65535 f ' || chr(10) || 'trailer << /Size ' || o || ' /Root 1 0 R >>' || chr(10) || 'startxref' || chr(10) || e || chr(10) || '%%EOF' || chr(10)) + 20 * (o - 1), NULL, false FROM ends""")
def pdf_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each object of each session's document begins, and which pages failed: every eleventh image is too short for its size."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("page"))
    known = _pictured(spark, sf_dir, turns)
    data = F.when((F.col("session") + F.col("page")) % 11 == 0, F.substring("image.data", 1, 100)).otherwise(F.col("image.data"))
    word = "array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
    bare = known.withColumns({"image": F.col("image").withField("data", data), "words": F.lit(None).cast(word), "width": F.lit(None).cast("double"), "height": F.lit(None).cast("double")})
    parts = exports.pdf_parts(bare, packed=False)
    return parts.select("session", "no", "start", F.octet_length("content").alias("size"), "page", F.col("error").isNotNull().alias("failed"))
