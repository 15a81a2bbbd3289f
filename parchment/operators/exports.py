"""Exports of scanned pages: HTML that keeps the layout, and PDF with a text layer."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.jsnum import fixed, is_blank, or_default
from ..sources.shared import checkpointed
from .page_images import IMAGE, as_array, resized

PDF_LONG_SIDE, LEAST_FONT, FONT_SHARE = 1600, 4.0, 0.8
#: Pages that are drawn before they are passed on.
AT_ONCE = 16
# The size of a page of unknown size, the share of a word's height that its letters take, and the text for a page without words.
DEFAULT_PAGE = (1200, 1697)
HTML_FONT_SHARE = 0.70
NO_TEXT = "このページのOCRテキストデータはありません"

HEAD = """<!DOCTYPE html>
<html lang="ja">
<head>
<meta charset="UTF-8">
<meta name="viewport" content="width=device-width, initial-scale=1.0">
<title>Scan</title>
<style>
body { max-width: 60rem; margin: 1rem auto; color: black; background: whitesmoke; }
.page { container-type: inline-size; position: relative; margin-block: 1.5rem; outline: thin solid silver; background: white; }
.word { position: absolute; white-space: pre; line-height: 1; }
.empty { padding-top: 40cqw; text-align: center; font-size: 3cqw; }
@page { margin: 1cm; }
@media print { body { max-width: none; margin: 0; } .page { break-after: page; outline: none; } }
</style>
</head>
<body>
"""
TAIL = "</body>\n</html>"


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_word(word: Column, w: Column, h: Column, shown: Callable[[Column], Column] = fixed) -> Column:
    """One word as an element placed in per cent of its page. ``shown`` gives a number three decimals."""
    b = word["bbox"]
    wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
    numbers = [b["x0"] / w * 100, b["y0"] / h * 100, wide / w * 100, high / h * 100, high / w * 100 * HTML_FONT_SHARE]
    return F.format_string('<div class="word" style="left: %s%%; top: %s%%; width: %s%%; height: %s%%; font-size: %scqw;">%s</div>\n', *[shown(n) for n in numbers], escape_html(word["text"]))


def html_page(page: Column, words: Column, w: Column, h: Column) -> Column:
    """A page with its words in order. Words of spaces only are left out; a page without any word says so."""
    width, height = or_default(w.cast("double"), DEFAULT_PAGE[0]), or_default(h.cast("double"), DEFAULT_PAGE[1])
    some = F.coalesce(F.size(words), F.lit(0)) > 0
    drawn = F.array_join(F.transform(F.filter(words, lambda x: ~is_blank(x["text"])), lambda x: html_word(x, width, height)), "")
    body = F.when(some, drawn).otherwise(F.lit(f'<div class="empty">{NO_TEXT}</div>\n'))
    number = lambda c: F.regexp_replace(c.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.concat(F.lit("<!-- "), (page + 1).cast("string"), F.lit(' -->\n<div class="page" style="aspect-ratio: '), number(width), F.lit(" / "), number(height), F.lit(';">\n'), body, F.lit("</div>\n"))


def html_documents(pages: DataFrame) -> DataFrame:
    """session, html from a row per page with session, page, words, width, height (null where nothing was recognised)."""
    shown = pages.select("session", "page", html_page(F.col("page"), F.col("words"), F.col("width"), F.col("height")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("page", "part")))
    body = F.array_join(F.transform(parts, lambda s: s["part"]), "")
    return shown.groupBy("session").agg(F.concat(F.lit(HEAD), body, F.lit(TAIL)).alias("html"))


def text_placement(word: Column, image_w: Column, image_h: Column, ocr_w: Column, ocr_h: Column) -> Column:
    """struct(text, x, y, size) in points from the lower left corner."""
    b, fx, fy = word["bbox"], image_w / ocr_w, image_h / ocr_h
    size = F.greatest((b["y1"] - b["y0"]) * fy * FONT_SHARE, F.lit(LEAST_FONT))
    return F.struct(word["text"].alias("text"), (b["x0"] * fx).alias("x"), (image_h - b["y1"] * fy).alias("y"), size.alias("size"))


def pdf_size(w: Column, h: Column) -> Column:
    return g.scaled_size(w, h, PDF_LONG_SIDE)


def pdf_pages(pages: DataFrame) -> DataFrame:
    """session, page, image, size and placed: what is drawn on each page. Words of spaces only, and pages without text, place nothing."""
    size = pdf_size(F.col("image.width"), F.col("image.height"))
    sized = pages.withColumn("size", size)
    known = F.filter("words", lambda x: ~is_blank(x["text"]))
    at = lambda x: text_placement(x, F.col("size.width"), F.col("size.height"), F.col("width"), F.col("height"))
    placed = F.when((F.col("width") > 0) & (F.col("height") > 0), F.transform(known, at))
    return sized.select("session", "page", F.col("image").cast(IMAGE).alias("image"), "size", F.coalesce(placed, F.array().cast("array<struct<text:string,x:double,y:double,size:double>>")).alias("placed"))


def _stream(head: str, body: bytes, packed: bool = True) -> bytes:
    body = zlib.compress(body) if packed else body
    return f"<< {head} {'/Filter /FlateDecode ' if packed else ''}/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"


def _text_layer(placed) -> bytes:
    """Invisible text. Words beyond the standard font's letters are written as UTF-16 in a font without glyphs, of which only the meaning of its codes is known."""
    out = [b"BT 3 Tr"]
    for p in placed:
        try:
            font, letters = b"F1", b"(%s)" % p["text"].encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        except UnicodeEncodeError:
            font, letters = b"F2", b"<%s>" % p["text"].encode("utf-16-be", "surrogatepass").hex().encode()
        out.append(b"/%s %.3f Tf 1 0 0 1 %.3f %.3f Tm %s Tj" % (font, p["size"], p["x"], p["y"], letters))
    return b"\n".join([*out, b"ET"])


def _unicode_font(at: int, packed: bool = True) -> list[bytes]:
    """Four objects, numbered from ``at``: a font whose two-byte codes are UTF-16 units; it has no outlines, as its text is never drawn."""
    ranges = [f"<{i:02x}00> <{i:02x}ff> <{i:02x}00>" for i in range(256)]
    parts = "\n".join(f"{len(own)} beginbfrange\n" + "\n".join(own) + "\nendbfrange" for own in (ranges[i : i + 100] for i in range(0, 256, 100)))
    meaning = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Units def /CMapType 2 def\n1 begincodespacerange <0000> <ffff> endcodespacerange\n{parts}\nendcmap CMapName currentdict /CMap defineresource pop end end"
    return [
        f"<< /Type /Font /Subtype /Type0 /BaseFont /Units /Encoding /Identity-H /DescendantFonts [{at + 1} 0 R] /ToUnicode {at + 3} 0 R >>".encode(),
        f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Units /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 1000 /FontDescriptor {at + 2} 0 R >>".encode(),
        b"<< /Type /FontDescriptor /FontName /Units /Flags 4 /FontBBox [0 -200 1000 800] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 700 /StemV 80 >>",
        _stream("", meaning.encode(), packed),
    ]


#: Objects that each document begins with: the catalogue, the list of pages, and the fonts. Each page has three more: image, content, page.
FIXED, EACH = 7, 3
HEADER, CATALOGUE = b"%PDF-1.5\n", b"<< /Type /Catalog /Pages 2 0 R >>"


def _fonts(packed: bool) -> list[bytes]:
    return [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", *_unicode_font(4, packed)]


def _drawn(page: dict, packed: bool) -> tuple[bytes, bytes]:
    """The image and the content of a page that is as large in points as its image in pixels."""
    w, h = int(page["size"]["width"]), int(page["size"]["height"])
    pixels = as_array(page["image"])
    pixels = pixels if (pixels.shape[1], pixels.shape[0]) == (w, h) else resized(pixels, w, h)
    pixels = pixels[..., :3] if pixels.shape[2] > 1 else pixels
    kind = "DeviceRGB" if pixels.shape[2] == 3 else "DeviceGray"
    image = _stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{kind} /BitsPerComponent 8", pixels.tobytes(), packed)
    return image, _stream("", f"q {w} 0 0 {h} 0 0 cm /I Do Q\n".encode() + _text_layer(page["placed"]), packed)


def _drawn_by_few(batch: pa.RecordBatch, packed: bool) -> Iterator[pa.RecordBatch]:
    """session, page, image, text, w, h, error of pages as pdf_pages gives them, AT_ONCE of them at a time: as objects, words take many times their room in a batch."""
    types = [batch.schema.field("session").type, batch.schema.field("page").type, pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
    names = [f.name for f in batch.schema.field("placed").type.value_type]
    for at in range(0, batch.num_rows, AT_ONCE):
        few, rows = batch.slice(at, AT_ONCE), []
        ends = few.column("placed").offsets.to_pylist()
        words = [dict(zip(names, w, strict=True)) for w in zip(*(c.to_pylist() for c in few.column("placed").flatten().flatten()), strict=True)]
        for row, start, end in zip(few.drop_columns("placed").to_pylist(), ends, ends[1:], strict=False):
            row["placed"] = words[start - ends[0] : end - ends[0]]
            try:
                image, text = _drawn(row, packed)
                rows.append((row["session"], row["page"], image, text, row["size"]["width"], row["size"]["height"], None))
            except (ValueError, TypeError, KeyError, IndexError) as e:
                rows.append((row["session"], row["page"], None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["session", "page", "image", "text", "w", "h", "error"])


def pdf_parts(pages: DataFrame, packed: bool = True) -> DataFrame:
    """session, no, start, content, page, error: documents as rows, which in the order of no make up each session's file, byte by byte from start on.

    no 0 is the header, 1 to 7 are fixed objects, each page has three, and the table of places comes last. Pages (as pdf_pages takes
    them) are drawn one by one; numbers, and the places of all objects as running sums of their lengths, are settled on rows without the bytes, so no
    task holds more than a page. A page that can't be drawn is left out and has a row with its error, without no. Without
    ``packed`` streams are as they are. Pages without a session are left out, null images fail; pages of one number are in any order; a session
    of failed pages only has no document; an empty table gives no rows.
    """
    kind = pages.schema["session"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _drawn_by_few(batch, packed)

    ready = pdf_pages(pages.where("session is not null"))
    schema = f"session {kind}, page {pages.schema['page'].dataType.simpleString()}, image binary, text binary, w int, h int, error string"
    done = checkpointed(ready.mapInArrow(draw, schema).withColumn("key", F.monotonically_increasing_id()))
    good = done.where("error is null")

    # What the places follow from: rows without the bytes.
    whole = lambda no, length: F.length(no.cast("string")) + 15 + length  # noqa: E731  with "no 0 obj" before it and "endobj" after
    nth = F.row_number().over(Window.partitionBy("session").orderBy("page", "key")) - 1
    small = good.select("session", "page", "key", "w", "h", F.octet_length("image").alias("a"), F.octet_length("text").alias("b")).withColumn("nth", nth)
    small = small.withColumn("first", F.lit(FIXED + 1) + F.col("nth") * EACH)
    refers = ["<< /Type /Page /Parent 2 0 R /MediaBox [0 0 ", F.col("w"), " ", F.col("h"), "] /Contents ", F.col("first") + 1, " 0 R /Resources << /XObject << /I ", F.col("first"), " 0 R >> /Font << /F1 3 0 R /F2 4 0 R >> >> >>"]
    small = small.withColumn("node", F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in refers]))
    own = [whole(F.col("first"), F.col("a")), whole(F.col("first") + 1, F.col("b")), whole(F.col("first") + 2, F.length("node"))]
    before = Window.partitionBy("session").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("size", own[0] + own[1] + own[2]).withColumn("after", F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = F.array(F.col("after"), F.col("after") + own[0], F.col("after") + own[0] + own[1])
    small = small.withColumn("starts", starts.cast("array<long>"))
    count = small.groupBy("session").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "starts"))), lambda x: x["starts"])).alias("places"))
    kids = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat((i * EACH + FIXED + EACH).cast("string"), F.lit(" 0 R"))), " ")
    listed = F.concat(F.lit("<< /Type /Pages /Count "), F.col("n").cast("string"), F.lit(" /Kids ["), kids, F.lit("] >>"))
    fonts = _fonts(packed)
    bodies = [F.lit(CATALOGUE), F.encode(listed, "utf-8"), *map(F.lit, fonts)]
    lengths = [F.lit(len(CATALOGUE)), F.length(listed), *[F.lit(len(f)) for f in fonts]]
    at, fixed = F.lit(len(HEADER)), []
    for no, length in enumerate(lengths, 1):
        fixed.append(at)
        at = at + whole(F.lit(no), length)
    count = count.withColumns({"listed": listed, "fixed": F.array(*fixed).cast("array<long>"), "base": at.cast("long")})

    wrapped = lambda no, body: F.concat(F.encode(F.concat(no.cast("string"), F.lit(" 0 obj\n")), "utf-8"), body, F.lit(b"\nendobj\n"))
    part = lambda no, start, content: F.struct(no.cast("int").alias("no"), start.cast("long").alias("start"), content.alias("content"))
    every = F.concat("fixed", F.transform("places", lambda x: x + F.col("base")))
    end = F.col("base") + F.col("total")
    table = F.array_join(F.transform(every, lambda x: F.concat(F.lpad(x.cast("string"), 10, "0"), F.lit(" 00000 n \n"))), "")
    objects = F.size(every) + 1
    tail = F.concat(F.lit("xref\n0 "), objects.cast("string"), F.lit("\n0000000000 65535 f \n"), table, F.lit("trailer << /Size "), objects.cast("string"), F.lit(" /Root 1 0 R >>\nstartxref\n"), end.cast("string"), F.lit("\n%%EOF\n"))
    bodies[1] = F.encode(F.col("listed"), "utf-8")
    frame = [part(F.lit(0), F.lit(0), F.lit(HEADER)), *[part(F.lit(no), F.get("fixed", F.lit(no - 1)), wrapped(F.lit(no), body)) for no, body in enumerate(bodies, 1)], part(objects, end, F.encode(tail, "utf-8"))]
    nothing = [F.lit(None).cast(schema.split("page ")[1].split(",")[0]).alias("page"), F.lit(None).cast("string").alias("error")]
    around = count.select("session", F.explode(F.array(*frame)).alias("o")).select("session", "o.*", *nothing)
    drawn = good.select("key", "image", "text").join(small.select("session", "page", "key", "first", "node", "starts"), "key").join(count.select("session", "base"), "session")
    three = [part(F.col("first") + i, F.get("starts", F.lit(i)) + F.col("base"), wrapped(F.col("first") + i, body)) for i, body in enumerate((F.col("image"), F.col("text"), F.encode("node", "utf-8")))]
    inner = drawn.select("session", "page", F.explode(F.array(*three)).alias("o")).select("session", "o.*", "page", nothing[1])
    failed = done.where("error is not null").select("session", F.lit(None).cast("int").alias("no"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("binary").alias("content"), "page", "error")
    return around.unionByName(inner).unionByName(failed)


def pdf_documents(pages: DataFrame) -> DataFrame:
    """session, pdf and failed (pages left out): the parts of each document put together, one document in memory at a time; pdf is null if all its pages fail. For files of any size take pdf_parts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, failed, types = None, [], [], None

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], types), pa.array([b"".join(own) if own else None], pa.binary()), pa.array([failed], pa.list_(pa.int32()))], names=["session", "pdf", "failed"])

        for batch in batches:
            types = batch.schema.field("session").type
            for session, content, page in zip(*(batch.column(c) for c in ("session", "content", "page")), strict=True):
                session, content = session.as_py(), content.as_py()
                if (own or failed) and session != key:
                    yield whole()
                    own, failed = [], []
                key = session
                own.append(content) if content is not None else failed.append(page.as_py())
        if own or failed:
            yield whole()

    kind = pages.schema["session"].dataType.simpleString()
    parts = pdf_parts(pages).select("session", "no", "content", "page")
    return parts.repartition("session").sortWithinPartitions("session", "no", "page").mapInArrow(join, f"session {kind}, pdf binary, failed array<int>")
