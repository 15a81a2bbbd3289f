"""Detection over a session's frames in order: steady corners, a steady quality level, and the best recent frame.

Frames have session, seq, frame_ms, outcome, quad (array of struct(x, y) in pixels), w, h, focus, luma, dark.
outcome is what the corner model says of the frame, if it is asked: ``hit`` (with quad), ``miss`` or
``error`` (failed or too slow); or ``unready`` (no model yet), or an event: ``reset``, ``hidden``, ``wake``.

Each frame depends on the one before, so a session is a sequence for one task; sessions spread over
tasks. In batch, frames pass in order in small Arrow batches, and only the current session's state is
held, so a session may be of any length. In a stream the same state is kept by session, with timers that
take waiting frames in order and end sessions that have gone silent.
"""

from __future__ import annotations

from array import array
from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import hypot, nan

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import geometry as g
from ..functions.capture_quality import LIMITS
from ..operators.corners import STRICT_SHAPE

DETECT_MS, TIMEOUT_MS, SCORE_MS, KEEP_MS, SLEEP_MS = 300, 2000, 50, 800, 30_000
SMOOTHING, JUMP, RING = 0.35, 0.12, 8
ENTER, RECOVER = 2, 3
MOST_COS, MOST_RATIO = 0.24, 1.25

FRAME = "session long, seq long, frame_ms double, outcome string, quad array<struct<x:double,y:double>>, w double, h double, focus double, luma double, dark double"
FRAME_COLUMNS = ["session", "seq", "frame_ms", "outcome", "quad", "w", "h", "focus", "luma", "dark"]
OUT = "session long, seq long, frame_ms double, corners array<struct<x:double,y:double>>, raw_level string, level string, reasons array<string>, published boolean, peak double, best_seq long, asleep boolean"
OUT_COLUMNS = ["session", "seq", "frame_ms", "corners", "raw_level", "level", "reasons", "published", "peak", "best_seq", "asleep"]


def page_shaped(q: list[list[float]], most_cos: float = MOST_COS, most_ratio: float = MOST_RATIO) -> bool:
    """functions.geometry.is_valid_shape for one quad in a state."""
    if len(q) != 4:
        return False
    edges = [hypot(q[i][0] - q[(i + 1) % 4][0], q[i][1] - q[(i + 1) % 4][1]) for i in range(4)]
    if min(edges) == 0:
        return False
    for i in range(4):
        (ax, ay), (x, y), (bx, by) = q[i - 1], q[i], q[(i + 1) % 4]
        if abs(((ax - x) * (bx - x) + (ay - y) * (by - y)) / (edges[i - 1] * edges[i])) > most_cos:
            return False
    return all(max(a, b) / min(a, b) <= most_ratio for a, b in ((edges[0], edges[2]), (edges[3], edges[1])))


def assessed(focus: float, luma: float, dark_share: float, peak: float) -> tuple[str, list[str]]:
    """functions.capture_quality.capture_quality for one frame."""
    dark = luma < LIMITS.luma or dark_share > LIMITS.dark_share
    very_dark = luma < LIMITS.very_luma or dark_share > LIMITS.very_dark_share
    known = peak >= LIMITS.least_peak
    blur = focus < LIMITS.focus or (known and focus < peak * LIMITS.of_peak)
    very_blur = focus < LIMITS.very_focus or (known and focus < peak * LIMITS.very_of_peak)
    level = "poor" if very_dark or very_blur or (dark and blur) else "fair" if dark or blur else "good"
    return level, [r for r, on in (("dark", dark), ("blur", blur)) if on]


@dataclass
class Scanner:
    """The state of a session."""

    cached: list | None = None
    last_valid: list | None = None
    smooth: list | None = None
    seen_ms: float = 0.0
    detected_ms: float = 0.0
    scored_ms: float = 0.0
    pending: str = "none"
    stable: str = "none"
    streak: int = 0
    published: str | None = None
    peak: float = 0.0
    ring: list = field(default_factory=list)
    active_ms: float | None = None
    asleep: bool = False
    last_ms: float | None = None

    def forget(self) -> None:
        """As new."""
        self.__init__()

    def reset(self) -> bool:
        """Back to the start, but for the clocks."""
        self.cached = self.last_valid = self.smooth = None
        self.ring, self.pending, self.stable, self.streak, self.peak = [], "none", "none", 0, 0.0
        return self._publish([])

    def _publish(self, reasons: list[str]) -> bool:
        key = f"{self.stable}|{','.join(sorted(reasons))}"
        changed, self.published = key != self.published, key
        return changed

    def _settle(self, raw: str, reasons: list[str]) -> tuple[bool, list[str]]:
        self.streak = self.streak + 1 if raw == self.pending else 1
        self.pending = raw
        need = RECOVER if self.stable not in ("good", "none") and raw == "good" else ENTER
        if self.streak >= need:
            self.stable = raw
        told = [] if self.stable in ("none", "good") else reasons
        return self._publish(told), told

    def _follow(self, now: float, outcome: str, quad: list | None, side: float) -> list | None:
        if now - self.detected_ms > DETECT_MS:
            if outcome == "hit" and quad:
                self.cached = self.last_valid = quad
                self.seen_ms = now
            elif outcome == "miss":
                self.cached = None
            self.detected_ms = now
        target = self.cached or (self.last_valid if self.last_valid and now - self.seen_ms < KEEP_MS else None)
        if target is None:
            self.smooth = None
        elif self.smooth is None or sum(hypot(t[0] - s[0], t[1] - s[1]) for t, s in zip(target, self.smooth, strict=True)) / 4 > side * JUMP:
            self.smooth = target
        else:
            self.smooth = [[s[0] + (t[0] - s[0]) * SMOOTHING, s[1] + (t[1] - s[1]) * SMOOTHING] for t, s in zip(target, self.smooth, strict=True)]
        return self.smooth if self.smooth and page_shaped(self.smooth) else None

    def step(self, f) -> tuple:
        """One frame, or event, to its row after session, seq and frame_ms."""
        if self.last_ms is not None and f.frame_ms - self.last_ms > END_MS:
            self.forget()
        now, told, published, corners, raw = f.frame_ms, [], False, None, None
        self.last_ms = now
        self.active_ms = now if self.active_ms is None else self.active_ms
        if f.outcome == "reset":
            published = self.reset()
        elif f.outcome == "hidden":
            published, self.asleep = self.reset(), True
        elif f.outcome == "wake":
            self.asleep, self.active_ms = False, now
        elif f.outcome != "unready" and not self.asleep:
            quad = [[p["x"], p["y"]] for p in f.quad] if f.quad is not None and len(f.quad) == 4 else None
            corners = self._follow(now, f.outcome, quad, max(f.w, f.h))
            if corners is None:
                self.peak *= 0.92
                self.peak = 0.0 if self.peak < 50 else self.peak
                raw = "none"
                published, told = self._settle(raw, [])
                if now - self.active_ms > SLEEP_MS:
                    self.asleep = True
                    published |= self.reset()
            else:
                self.active_ms = now
                if now - self.scored_ms > SCORE_MS:
                    raw, reasons = assessed(f.focus, f.luma, f.dark, self.peak)
                    self.peak = f.focus if f.focus > self.peak else self.peak * 0.995 + f.focus * 0.005
                    published, told = self._settle(raw, reasons)
                    self.ring = [*self.ring, [f.focus, int(f.seq)]][-RING:]
                    self.scored_ms = now
        best = max(self.ring, key=lambda r: (r[0], -r[1]))[1] if self.ring else None
        shown = None if corners is None else [{"x": x, "y": y} for x, y in corners]
        return shown, raw, self.stable, told, published, self.peak, best, self.asleep


def detect_frames(frames: DataFrame) -> DataFrame:
    """A row per frame in the form of OUT. Frames without a session, seq or time are left out; equal times follow seq.

    corners are smoothed and null while no page is held; level is the steady one; published says
    whether level or reasons have changed; best_seq is the sharpest of the last eight scored frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, scanner = None, Scanner()
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                if f.session != key:
                    key, scanner = f.session, Scanner()
                rows.append((f.session, f.seq, f.frame_ms, *scanner.step(f)))
            yield pd.DataFrame(rows, columns=OUT_COLUMNS).astype({"best_seq": "Int64"})

    ready = frames.select(*FRAME_COLUMNS).where("session is not null and seq is not null and frame_ms is not null")
    return ready.repartition("session").sortWithinPartitions("session", "frame_ms", "seq").mapInPandas(run, OUT)


#: A session that has had no frame for so long has ended; what comes later begins anew.
END_MS = 1_800_000
_POINTS = "array<array<double>>"
KEPT = f"cached {_POINTS}, last_valid {_POINTS}, smooth {_POINTS}, seen_ms double, detected_ms double, scored_ms double, pending string, stable string, streak int, published string, peak double, ring_focus array<double>, ring_seq array<long>, active_ms double, last_ms double, asleep boolean"
#: Up to AT_ONCE frames in a row: their numbers and those of NUMBERS side by side, as machine numbers.
WAITING, AT_ONCE = "seqs binary, outcomes array<string>, numbers binary", 1024
#: What a frame has in doubles; not a number stands for null, and a quad without four points has none.
NUMBERS = ["frame_ms", "w", "h", "focus", "luma", "dark", *[f"quad[{i}].{c}" for i in range(4) for c in "xy"]]
STREAM_OUT = OUT + ", late boolean"
#: As the processor gives it: corners are eight numbers.
_FLAT_OUT = STREAM_OUT.replace("corners array<struct<x:double,y:double>>", "corners array<double>")
_NOTHING = (None,) * (len(OUT_COLUMNS) - 3)
_TOLD = Row(*OUT_COLUMNS, "late")


def _kept(s: Scanner) -> tuple:
    return (s.cached, s.last_valid, s.smooth, s.seen_ms, s.detected_ms, s.scored_ms, s.pending, s.stable, s.streak, s.published, float(s.peak), [float(f) for f, _ in s.ring], [q for _, q in s.ring], s.active_ms, s.last_ms, s.asleep)


def _scanner(kept: tuple | None) -> Scanner:
    if kept is None:
        return Scanner()
    plain = lambda q: None if q is None else [list(p) for p in q]
    cached, last_valid, smooth, seen, detected, scored, pending, stable, streak, published, peak, focus, seq, active, last, asleep = kept
    return Scanner(plain(cached), plain(last_valid), plain(smooth), seen, detected, scored, pending, stable, streak, published, peak, [list(r) for r in zip(focus, seq, strict=True)], active, asleep, last)


class Detection(StatefulProcessor):
    """Frames wait in a list until the watermark has passed them, then a timer takes them in order through the session's scanner.

    Two timers at most are set: one for the earliest waiting frame, one for the end of the session. At its end nothing of a session is left.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.scanner = handle.getValueState("scanner", KEPT)
        self.waiting = handle.getListState("waiting", WAITING)
        #: When the next waiting frame is due and when the session ends, in ms; -1 for none.
        self.timers = handle.getValueState("timers", "due long, end long")

    def _set(self, due: int, end: int, old: tuple[int, int]) -> None:
        for was, now, other in ((old[0], due, end), (old[1], end, due)):
            if was not in (now, other, -1):
                self.handle.deleteTimer(was)
        for now in {due, end} - {*old, -1}:
            self.handle.registerTimer(now)
        self.timers.update((due, end))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        seqs, outcomes, numbers, due = array("q"), [], array("d"), None
        for f in rows:
            frame_ms = f.numbers[0]
            if frame_ms <= mark:
                yield _TOLD(*key, f.seq, frame_ms, *_NOTHING, True)
                continue
            seqs.append(f.seq)
            outcomes.append(f.outcome)
            numbers.extend(f.numbers)
            due = frame_ms if due is None or frame_ms < due else due
            if len(seqs) == AT_ONCE:
                self.waiting.appendValue((seqs.tobytes(), outcomes, numbers.tobytes()))
                seqs, outcomes, numbers = array("q"), [], array("d")
        if seqs:
            self.waiting.appendValue((seqs.tobytes(), outcomes, numbers.tobytes()))
        if due is not None:
            was, end = self.timers.get() or (-1, -1)
            # Whole milliseconds, after the watermark of now.
            due = max(int(mark) + 1, int(due) + 1)
            if was < 0 or due < was:
                self._set(due, end, (was, end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        due, end = self.timers.get() or (-1, -1)
        gone = expiredTimerInfo.getExpiryTimeInMs()
        if gone not in (due, end):
            return
        frames = [f for packed in self.waiting.get() for f in _frames(*packed)]
        ready = sorted((f for f in frames if f[1][0] <= mark), key=lambda f: (f[1][0], f[0]))
        rest = [f for f in frames if f[1][0] > mark]
        scanner = _scanner(self.scanner.get())
        if not frames and gone == end and int(scanner.last_ms or 0) + END_MS < mark:
            for state in (self.scanner, self.waiting, self.timers):
                state.clear()
            return
        for seq, numbers, outcome in ready:
            frame_ms, w, h, focus, luma, dark, *points = numbers
            quad = None if points[0] != points[0] else [{"x": x, "y": y} for x, y in zip(points[::2], points[1::2], strict=True)]
            corners, *told = scanner.step(_Frame(seq, frame_ms, outcome, quad, w, h, focus, luma, dark))
            told = [None if v != v else v for v in told]  # as a batch gives no number
            yield _TOLD(*key, seq, frame_ms, None if corners is None else [v for p in corners for v in (p["x"], p["y"])], *told, False)
        if ready:
            self.scanner.update(_kept(scanner))
            if rest:
                self.waiting.put([(array("q", [f[0] for f in own]).tobytes(), [f[2] for f in own], array("d", [v for f in own for v in f[1]]).tobytes()) for own in (rest[i : i + AT_ONCE] for i in range(0, len(rest), AT_ONCE))])
            else:
                self.waiting.clear()
        # The timer that has fired is no more. That of the end stays where it is while frames come, and is set anew when it fires too early.
        due, end = -1 if gone == due else due, -1 if gone == end else end
        next_end = end if end >= 0 else max(int(mark) + 1, int(scanner.last_ms or 0) + END_MS + 1)
        self._set(max(int(mark) + 1, int(min(f[1][0] for f in rest)) + 1) if rest else -1, next_end, (due, end))


def _frames(seqs: bytes, outcomes: list[str | None], numbers: bytes) -> Iterator[tuple]:
    """seq, numbers and outcome of the frames in a row of WAITING."""
    each = len(NUMBERS)
    of = array("d", numbers)
    for i, (seq, outcome) in enumerate(zip(array("q", seqs), outcomes, strict=True)):
        yield seq, of[each * i : each * (i + 1)], outcome


_Frame = namedtuple("_Frame", ["seq", "frame_ms", "outcome", "quad", "w", "h", "focus", "luma", "dark"])


def detect_stream(frames: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """The same over a stream of frames, with a column late.

    Frames are held until the watermark, ``delay`` behind the newest frame, has passed them, and then taken in order. Those that come
    later than that have rows of their own with late true and no more than session, seq and frame_ms; the scanner doesn't see
    them. The state of a session goes END_MS after its last frame. State is kept in RocksDB (see rocksdb_state).
    """
    whole = F.size("quad") == 4
    numbers = F.transform(F.array(*[F.when(whole, F.expr(c)) if c.startswith("quad") else F.col(c) for c in NUMBERS]), lambda v: F.coalesce(v, F.lit(nan)))
    timed = frames.select(*FRAME_COLUMNS, F.timestamp_millis(F.col("frame_ms").cast("long")).alias("at")).where("session is not null and seq is not null and frame_ms is not null").withWatermark("at", delay)
    # Without the time itself Spark doesn't drop late rows, and the processor can tell of them.
    # Each value costs a call in Python, so a frame has few: its numbers are one.
    told = timed.select("session", "seq", "outcome", numbers.alias("numbers")).groupBy("session").transformWithState(Detection(), _FLAT_OUT, "Append", "EventTime")
    corners = F.when(F.col("corners").isNotNull(), g.quad(*[(F.get("corners", F.lit(2 * i)), F.get("corners", F.lit(2 * i + 1))) for i in range(4)]))
    return told.withColumn("corners", corners)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; the session's own choice is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shutter_choice(frames: DataFrame, detected: DataFrame) -> DataFrame:
    """session, seq, source for each session's end: the best recent frame, else the last one as it is.

    ``source`` is ``best`` (its corners count) or ``current`` (corners are to be detected, with a default).
    """
    last = detected.groupBy("session").agg(F.max_by(F.struct("best_seq", "seq"), F.struct("frame_ms", "seq")).alias("l"))
    chosen = last.select("session", F.coalesce("l.best_seq", "l.seq").alias("seq"), F.when(F.col("l.best_seq").isNotNull(), "best").otherwise("current").alias("source"))
    return chosen.join(frames.select("session", "seq", "w", "h"), ["session", "seq"]).select("session", "seq", "source", "w", "h")


def shutter_captures(frames: DataFrame, detected: DataFrame, buffered: int = 1920, captured: int = 1600) -> DataFrame:
    """session, seq, source, size and corners of what a shutter press at each session's end takes.

    The best recent frame comes as it was buffered, with its steady corners, both reduced to ``buffered`` pixels. Without one the last frame is reduced to ``captured``
    pixels and its own corners count if they are strictly a page; else, and if none were seen, those of a page in the middle.
    """
    chosen = shutter_choice(frames, detected)
    steady = detected.select("session", "seq", "corners")
    seen = frames.select("session", "seq", F.when(F.col("outcome") == "hit", F.col("quad")).alias("quad"))
    known = chosen.join(steady, ["session", "seq"], "left").join(seen, ["session", "seq"], "left").dropDuplicates(["session"])
    best = F.col("source") == "best"
    size = F.when(best, g.fit_within(F.col("w"), F.col("h"), buffered)).otherwise(g.fit_within(F.col("w"), F.col("h"), captured))
    sized = known.withColumn("size", size)
    fx, fy = F.col("size.width") / F.col("w"), F.col("size.height") / F.col("h")
    own = F.when(best, F.col("corners")).otherwise(F.when(g.is_valid_shape(F.col("quad"), *STRICT_SHAPE), F.col("quad")))
    corners = F.coalesce(g.scale_quad(own, fx, fy), g.default_corners(F.col("size.width"), F.col("size.height")))
    return sized.select("session", "seq", "source", "size", corners.alias("corners"))
