"""Queries on camera frames and scan sessions: whatever depends on what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.capture_quality import COLORS, GUIDANCE, capture_quality, frame_colors, guidance
from ..operators import sessions
from ..streaming.detector import detect_frames, shutter_choice
from ..streaming.replay import replay
from .inputs import FRAMES_SQL, SCAN_EVENTS_SQL, frames, scan_events
from .registry import query

_PEAKED = "peaked AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 400.0::DOUBLE ELSE 100.0::DOUBLE END AS peak FROM frames)"
_JUDGED = """judged AS (SELECT *, luma < 105 OR dark > 0.42 AS d, luma < 72 OR dark > 0.62 AS dd, focus < 320 OR (peak >= 200 AND focus < peak * 0.55::DOUBLE) AS b, focus < 140 OR (peak >= 200 AND focus < peak * 0.32::DOUBLE) AS bb FROM peaked),
leveled AS (SELECT *, CASE WHEN seq % 19 = 0 THEN 'none' WHEN dd OR bb OR (d AND b) THEN 'poor' WHEN d OR b THEN 'fair' ELSE 'good' END AS level FROM judged)"""


@query(f"""WITH {FRAMES_SQL}, {_PEAKED}, {_JUDGED} SELECT session, seq, level, concat_ws(',', CASE WHEN d THEN 'dark' END, CASE WHEN b THEN 'blur' END) AS reasons,
  CASE WHEN level = 'none' THEN '{GUIDANCE["none"]}' WHEN level = 'good' THEN '{GUIDANCE["good"]}' WHEN d AND b THEN '{GUIDANCE["dark,blur"]}' WHEN d THEN '{GUIDANCE["dark"]}' ELSE '{GUIDANCE["blur"]}' END AS guidance,
  CASE level WHEN 'fair' THEN '{COLORS["fair"][0]}' WHEN 'poor' THEN '{COLORS["poor"][0]}' ELSE '{COLORS["good"][0]}' END AS stroke FROM leveled""")
def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, reasons, guidance and colour of each frame by itself."""
    f = frames(spark, sf_dir).withColumn("q", capture_quality(F.col("focus"), F.col("luma"), F.col("dark"), F.when(F.col("seq") % 2 == 0, 400.0).otherwise(100.0)))
    level = F.when(F.col("seq") % 19 == 0, "none").otherwise(F.col("q.level"))
    return f.select("session", "seq", level.alias("level"), F.array_join("q.reasons", ",").alias("reasons"), guidance(level, F.col("q.reasons")).alias("guidance"), frame_colors(level)["stroke"].alias("stroke"))


def _edge(a: int, b: int) -> str:
    return f"sqrt((c[{2 * a + 1}] - c[{2 * b + 1}]) ** 2 + (c[{2 * a + 2}] - c[{2 * b + 2}]) ** 2)"


def _shape() -> str:
    """Whether the list c of eight coordinates is a page by the limits for smoothed corners."""
    edge = [_edge(i, (i + 1) % 4) for i in range(4)]
    out = []
    for i in range(4):
        a, b = (i + 3) % 4, (i + 1) % 4
        dot = " + ".join(f"(c[{2 * a + k}] - c[{2 * i + k}]) * (c[{2 * b + k}] - c[{2 * i + k}])" for k in (1, 2))
        out.append(f"abs(({dot}) / nullif({edge[a]} * {edge[i]}, 0)) <= 0.24")
    out += [f"greatest({edge[a]}, {edge[b]}) / nullif(least({edge[a]}, {edge[b]}), 0) <= 1.25" for a, b in ((0, 2), (3, 1))]
    return "coalesce(" + " AND ".join(out) + ", false)"


_MEAN = "(" + " + ".join(f"sqrt((target[{i}] - smooth[{i}]) ** 2 + (target[{i + 1}] - smooth[{i + 1}]) ** 2)" for i in (1, 3, 5, 7)) + ") / 4"
_STEP = f"""
  SELECT session, seq, now, cached, lastv, smooth, seen, detected, scored, pending, stable, streak, key AS published_key, peak, ring, active, asleep, c AS corners, raw, told, key IS DISTINCT FROM old_key AND acted AS published
  FROM (SELECT *, CASE WHEN gone THEN 'none|' WHEN acted THEN stable || '|' || told ELSE old_key END AS key FROM (
  SELECT * REPLACE (CASE WHEN gone THEN NULL ELSE cached END AS cached, CASE WHEN gone THEN NULL ELSE lastv END AS lastv, CASE WHEN gone THEN NULL ELSE smooth END AS smooth, CASE WHEN gone THEN 'none' ELSE pending END AS pending,
    CASE WHEN gone THEN 'none' ELSE stable END AS stable, CASE WHEN gone THEN 0 ELSE streak END AS streak, CASE WHEN gone THEN 0 ELSE peak END AS peak, CASE WHEN gone THEN [] ELSE ring END AS ring, CASE WHEN gone AND outcome NOT IN ('reset', 'hidden') THEN '' ELSE told END AS told) FROM (
  SELECT *, act OR gone AS acted, CASE WHEN act AND stable NOT IN ('none', 'good') THEN reasons ELSE '' END AS told FROM (
  SELECT * REPLACE (CASE WHEN act AND streak >= CASE WHEN stable NOT IN ('good', 'none') AND raw = 'good' THEN 3 ELSE 2 END THEN raw ELSE stable END AS stable) FROM (
  SELECT * REPLACE (CASE WHEN act THEN CASE WHEN raw = pending THEN streak + 1 ELSE 1 END ELSE streak END AS streak, CASE WHEN act THEN raw ELSE pending END AS pending,
    CASE WHEN nopage THEN CASE WHEN peak * 0.92::DOUBLE < 50 THEN 0 ELSE peak * 0.92::DOUBLE END WHEN score THEN CASE WHEN focus > peak THEN focus ELSE peak * 0.995::DOUBLE + focus * 0.005::DOUBLE END ELSE peak END AS peak,
    CASE WHEN score THEN list_slice(list_append(ring, {{'f': focus, 's': -seq}}), -8, -1) ELSE ring END AS ring, CASE WHEN score THEN now ELSE scored END AS scored, CASE WHEN c IS NOT NULL OR outcome = 'wake' THEN now ELSE active END AS active,
    CASE WHEN outcome = 'hidden' OR (nopage AND now - active > 30000) THEN true WHEN outcome = 'wake' THEN false ELSE asleep END AS asleep),
    outcome IN ('reset', 'hidden') OR (nopage AND now - active > 30000) AS gone FROM (
  SELECT *, nopage OR score AS act, CASE WHEN nopage THEN 'none' WHEN score THEN CASE WHEN dd OR bb OR (d AND b) THEN 'poor' WHEN d OR b THEN 'fair' ELSE 'good' END END AS raw,
    CASE WHEN score THEN concat_ws(',', CASE WHEN b THEN 'blur' END, CASE WHEN d THEN 'dark' END) ELSE '' END AS reasons FROM (
  SELECT *, live AND c IS NULL AS nopage, live AND c IS NOT NULL AND now - scored > 50 AS score, luma < 105 OR dark > 0.42 AS d, luma < 72 OR dark > 0.62 AS dd,
    focus < 320 OR (peak >= 200 AND focus < peak * 0.55::DOUBLE) AS b, focus < 140 OR (peak >= 200 AND focus < peak * 0.32::DOUBLE) AS bb FROM (
  SELECT * EXCLUDE (c), CASE WHEN live AND {_shape()} THEN c END AS c FROM (
  SELECT *, smooth AS c FROM (
  SELECT * REPLACE (CASE WHEN NOT live THEN smooth WHEN target IS NULL THEN NULL WHEN smooth IS NULL OR {_MEAN} > 640 * 0.12::DOUBLE THEN target ELSE list_transform(range(1, 9), lambda i: smooth[i] + (target[i] - smooth[i]) * 0.35::DOUBLE) END AS smooth) FROM (
  SELECT *, CASE WHEN live THEN coalesce(cached, CASE WHEN now - seen < 800 THEN lastv END) END AS target FROM (
  SELECT * REPLACE (CASE WHEN ask AND outcome = 'hit' THEN quad WHEN ask AND outcome = 'miss' THEN NULL ELSE cached END AS cached, CASE WHEN ask AND outcome = 'hit' THEN quad ELSE lastv END AS lastv, CASE WHEN ask AND outcome = 'hit' THEN now ELSE seen END AS seen, CASE WHEN ask THEN now ELSE detected END AS detected) FROM (
  SELECT *, live AND now - detected > 300 AS ask FROM (
  SELECT s.session, f.seq, f.frame_ms AS now, s.cached, s.lastv, s.smooth, s.seen, s.detected, s.scored, s.pending, s.stable, s.streak, s.published_key AS old_key, s.peak, s.ring, coalesce(s.active, f.frame_ms) AS active, s.asleep,
    f.outcome, f.quad, f.focus, f.luma, f.dark, f.outcome NOT IN ('reset', 'hidden', 'wake', 'unready') AND NOT s.asleep AS live
  FROM scan s JOIN frames f ON f.session = s.session AND f.seq = s.seq + 1))))))))))))))"""
_FOLD = f"""WITH RECURSIVE {FRAMES_SQL},
scan AS (SELECT DISTINCT session, 0::BIGINT AS seq, 0.0::DOUBLE AS now, NULL::DOUBLE[] AS cached, NULL::DOUBLE[] AS lastv, NULL::DOUBLE[] AS smooth, 0.0::DOUBLE AS seen, 0.0::DOUBLE AS detected, 0.0::DOUBLE AS scored, 'none' AS pending, 'none' AS stable, 0 AS streak,
    NULL::VARCHAR AS published_key, 0.0::DOUBLE AS peak, []::STRUCT(f DOUBLE, s BIGINT)[] AS ring, NULL::DOUBLE AS active, false AS asleep, NULL::DOUBLE[] AS corners, NULL::VARCHAR AS raw, '' AS told, false AS published FROM frames
  UNION ALL {_STEP})"""


_DETECTED = f"{_FOLD} SELECT session, seq, round(sqrt(corners[1]), 6) AS root_x0, round(sqrt(corners[2]), 6) AS root_y0, round(sqrt(corners[5]), 6) AS root_x2, round(sqrt(corners[6]), 6) AS root_y2, raw AS raw_level, stable AS level, told AS reasons, published, round(sqrt(peak), 6) AS root_peak, coalesce(-list_max(ring).s, -1) AS best_seq, asleep FROM scan WHERE seq > 0"


def _told(d: DataFrame) -> DataFrame:
    at = lambda i, c: F.round(F.sqrt(F.get("corners", F.lit(i))[c]), 6).alias(f"root_{c}{i}")
    return d.select("session", "seq", at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y"), "raw_level", "level", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "published", F.round(F.sqrt("peak"), 6).alias("root_peak"), F.coalesce("best_seq", F.lit(-1)).alias("best_seq"), "asleep")


@query(_DETECTED)
def detected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady corners and level of each frame in its session, and the best recent frame. Numbers are given as roots, as those have no decimal ties to round."""
    return _told(detect_frames(frames(spark, sf_dir)))


@query(_DETECTED)
def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames sent through the stream, in slices of time and any order within them."""
    return _told(replay(frames(spark, sf_dir)).where("not late"))


@query(f"{_FOLD}, ends AS (SELECT session, arg_max(seq, seq) AS last_seq, arg_max_null(-list_max(ring).s, seq) AS best FROM scan WHERE seq > 0 GROUP BY session) SELECT session, coalesce(best, last_seq) AS seq, CASE WHEN best IS NULL THEN 'current' ELSE 'best' END AS source FROM ends")
def shutter_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frame a shutter press at the end of each session takes."""
    f = frames(spark, sf_dir)
    return shutter_choice(f, detect_frames(f)).select("session", "seq", "source")


_SESSION = f"""WITH RECURSIVE {SCAN_EVENTS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM scan_events),
fold AS (SELECT DISTINCT session, 0::BIGINT AS n, 'scan' AS step, []::BIGINT[] AS pages, []::VARCHAR[] AS modes, []::STRUCT(p BIGINT, t VARCHAR)[] AS ocr, 'pdf' AS export_mode, 'document_enhanced' AS current_mode, false AS has_image, false AS is_warped, false AS failed FROM scan_events
  UNION ALL SELECT f.session, e.n,
    CASE action WHEN 'capture' THEN 'edit' WHEN 'save_page' THEN 'export' WHEN 'cancel_edit' THEN CASE WHEN len(pages) > 0 THEN 'export' ELSE 'scan' END WHEN 'back_to_edit' THEN 'edit' ELSE 'scan' END,
    CASE action WHEN 'start_new_scan' THEN [] WHEN 'save_page' THEN list_append(pages, e.seq) WHEN 'back_to_edit' THEN pages[1:len(pages) - 1] ELSE pages END,
    CASE action WHEN 'start_new_scan' THEN [] WHEN 'save_page' THEN list_append(modes, e.mode) WHEN 'back_to_edit' THEN modes[1:len(modes) - 1] ELSE modes END,
    CASE WHEN action = 'start_new_scan' THEN [] WHEN action = 'save_page' AND e.enable_ocr AND e.ocr_text IS NOT NULL THEN list_append(ocr, {{'p': len(pages), 't': e.ocr_text}}) WHEN action = 'back_to_edit' THEN list_filter(ocr, lambda o: o.p <> len(pages) - 1) ELSE ocr END,
    CASE WHEN action = 'save_page' THEN CASE WHEN e.enable_ocr THEN 'pdf' ELSE 'jpeg' END ELSE export_mode END,
    CASE action WHEN 'capture' THEN 'document_enhanced' WHEN 'save_page' THEN e.mode WHEN 'back_to_edit' THEN coalesce(modes[len(modes)], 'document_enhanced') ELSE current_mode END,
    CASE action WHEN 'capture' THEN true WHEN 'save_page' THEN has_image WHEN 'back_to_edit' THEN has_image ELSE false END,
    CASE action WHEN 'capture' THEN false WHEN 'back_to_edit' THEN true ELSE is_warped END,
    CASE WHEN action = 'save_page' THEN e.enable_ocr AND e.ocr_text IS NULL WHEN action = 'cancel_edit' THEN failed ELSE false END
  FROM fold f JOIN numbered e ON e.session = f.session AND e.n = f.n + 1)"""


@query(f"""{_SESSION}, ends AS (SELECT session, max(n) AS n FROM fold GROUP BY session) SELECT session, step, array_to_string(pages, ',') AS pages, array_to_string(modes, ',') AS modes, md5(array_to_string(list_transform(ocr, lambda o: o.p::VARCHAR || '=' || o.t), ',')) AS ocr_md5, export_mode, current_mode, has_image, is_warped, failed AS ocr_failed
FROM fold JOIN ends USING (session, n)""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session after its last event."""
    s = sessions.fold_sessions(scan_events(spark, sf_dir))
    entries = F.transform(F.array_sort(F.map_entries("ocr")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return s.select("session", "step", joined("pages").alias("pages"), joined("modes").alias("modes"), F.md5(joined(entries)).alias("ocr_md5"), "export_mode", "current_mode", "has_image", "is_warped", F.col("ocr_error").isNotNull().alias("ocr_failed"))
