"""Whatever depends on what came before: detection over frames, in batch and as a stream, and sessions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from parchment.operators.sessions import OCR_FAILED, fold_sessions
from parchment.plans import inputs
from parchment.streaming import detector as d
from parchment.streaming.replay import replay

PAGE = [{"x": 64.0, "y": 48.0}, {"x": 500.0, "y": 48.0}, {"x": 500.0, "y": 430.0}, {"x": 64.0, "y": 430.0}]


def frame(seq, ms, outcome="hit", quad=PAGE, focus=900.0, luma=150.0, dark=0.1, session=1):
    return (session, seq, float(ms), outcome, quad, 640.0, 480.0, focus, luma, dark)


def run(spark, rows):
    return [r.asDict(recursive=True) for r in d.detect_frames(spark.createDataFrame(rows, d.FRAME)).orderBy("session", "frame_ms", "seq").collect()]


def test_levels_need_a_streak(spark):
    focus = [900, 900, 900, 100, 100, 900, 900, 900, 900]
    rows = run(spark, [frame(i, 1000 + 60 * i, focus=float(f)) for i, f in enumerate(focus)])
    assert [r["level"] for r in rows] == ["none", "good", "good", "good", "poor", "poor", "poor", "good", "good"]
    assert [r["published"] for r in rows] == [True, True, False, False, True, True, False, True, False]  # reasons are those of the newest frame


def test_detection_is_asked_at_intervals(spark):
    other = [{"x": p["x"] + 9, "y": p["y"]} for p in PAGE]
    rows = run(spark, [frame(0, 400), frame(1, 500, quad=other), frame(2, 701, quad=other), frame(3, 800, "miss")])
    assert [r["corners"][0]["x"] for r in rows] == pytest.approx([64, 64, 64 + 9 * 0.35, 64 + 9 * (0.35 + 0.65 * 0.35)])


def test_corners_are_kept_for_a_while(spark):
    rows = run(spark, [frame(0, 400), frame(1, 800, "miss"), frame(2, 1199, "miss"), frame(3, 1201, "miss"), frame(4, 1600, "error")])
    assert [r["corners"] is not None for r in rows] == [True, True, True, False, False]
    kept = run(spark, [frame(0, 400), frame(1, 5000, "error")])
    assert kept[1]["corners"] is not None


def test_jumps_snap_and_odd_shapes_are_held_back(spark):
    far = [{"x": p["x"] + 120, "y": p["y"]} for p in PAGE]
    odd = [dict(PAGE[0]), dict(PAGE[1]), {"x": 300.0, "y": 430.0}, dict(PAGE[3])]
    rows = run(spark, [frame(0, 400), frame(1, 800, quad=far), frame(0, 400, quad=odd, session=2)])
    assert rows[1]["corners"][0]["x"] == 184 and rows[2]["corners"] is None and rows[2]["raw_level"] == "none"


def test_best_of_the_last_eight(spark):
    rows = run(spark, [frame(i, 400 + 60 * i, focus=float(f)) for i, f in enumerate([990, 500, 700, 700, 600, 500, 500, 500, 500, 400])])
    assert [r["best_seq"] for r in rows] == [0] * 8 + [2, 2]


def test_sleep_and_reset(spark):
    rows = run(spark, [frame(0, 400), frame(1, 500, "reset"), frame(2, 600, "error"), frame(3, 40_000, "miss"), frame(4, 40_100), frame(5, 40_200, "wake"), frame(6, 40_600)])
    assert [r["asleep"] for r in rows] == [False, False, False, True, True, False, False]
    assert rows[1]["level"] == "none" and rows[2]["corners"] is None and rows[6]["corners"] is not None
    assert run(spark, [frame(0, 400, "unready")])[0]["raw_level"] is None


def test_empty_input(spark):
    assert run(spark, []) == []


def streamed(spark, folder, parts, name):
    """The parts as files in this order, through the stream; and the rows of its state after each of them."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, d.FRAME).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for f in (folder / "in" / str(i)).iterdir():
            os.utime(f, (10**9 + i, 10**9 + i))
    source = spark.readStream.schema(d.FRAME).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with d.rocksdb_state(spark):
        query = d.detect_stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def lines(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.drop("late").collect())


def test_stream_equals_batch(spark, tmp_path):
    """Frames in any order within the delay, with nulls, a session that ends and begins anew, and late frames; in the end no state is left."""
    frames = inputs.frames(spark, "/root/testdata/sf0.001").where("session < 3 or session = 5")
    frames = frames.withColumns({c: F.when(F.col("seq") % n != 3, F.col(c)) for c, n in (("focus", 7), ("luma", 9), ("dark", 11), ("w", 13))}).select(*d.FRAME_COLUMNS)
    known = [tuple(r) for r in frames.orderBy(F.xxhash64("session", "seq")).collect()]
    again = [frame(1000 + i, 2.0 * d.END_MS + 50 * i, session=s, focus=700.0 + i) for s in (2, 5) for i in range(9)]
    again[3] = (2, None, 2.0 * d.END_MS + 155.5, None, None, None, None, None, None, None)
    nobody = [frame(1, 300, session=None), (6, 1, None, "hit", PAGE, 1.0, 1.0, 1.0, 1.0, 1.0)]
    want = spark.createDataFrame(known + again + nobody, d.FRAME)
    late = [frame(5000, 12.0, session=1), frame(5001, 12.0, session=77)]
    cut = sorted(f[2] for f in known)[len(known) // 2]
    first, second = [f for f in known if f[2] <= cut], [f for f in known if f[2] > cut]
    closing = lambda n: [frame(10**6, n * 10.0**7, session=999)]
    got, state = streamed(spark, tmp_path, [first + nobody, second, late + again[::-1], closing(1), closing(2), closing(3), closing(4)], "detected")
    assert lines(got.where("session <> 999 and not late")) == lines(d.detect_frames(want)) and len(known) > 3
    assert sorted((r["session"], r["seq"], r["frame_ms"], r["level"]) for r in got.where("late").collect()) == [(1, 5000, 12.0, None), (77, 5001, 12.0, None)]
    assert max(state) > 6 and state[-1] <= 4  # but for the session that moves the clock


class Stored:
    """A state of one key in memory, which counts the values that it is sent."""

    def __init__(self):
        self.rows, self.sent = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows)) if self.many else self.rows[0] if self.rows else None

    def put(self, rows):
        self.rows, self.sent = list(rows), self.sent + len(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows, self.sent = [*self.rows, *rows], self.sent + len(rows)

    def update(self, row):
        self.put([row])

    def appendValue(self, row):  # noqa: N802
        self.appendList([row])

    def clear(self):
        self.rows = []


def test_few_values_go_to_the_state():
    """Frames wait side by side in rows of the state, and what its timers are is only told when they change."""
    states, timers = {}, set()

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            states[name] = Stored()
            states[name].many = name == "waiting"
            return states[name]

        getListState = getValueState  # noqa: N815
        registerTimer, deleteTimer = timers.add, timers.discard  # noqa: N815

    class Told:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    processor = d.Detection()
    processor.init(Handle())
    flat = [v for p in PAGE for v in (p["x"], p["y"])]
    given = lambda i: d.namedtuple("F", "seq outcome numbers frame_ms quad w h focus luma dark")(i, "hit", [1000.0 + 60 * i, 640.0, 480.0, 900.0, 150.0, 0.1, *flat], 1000.0 + 60 * i, PAGE, 640.0, 480.0, 900.0, 150.0, 0.1)
    for start in (2000, 0, 1000):
        assert not list(processor.handleInputRows((1,), [given(i) for i in range(start, start + 1000)], Told(0)))
    assert states["waiting"].sent == 3 and states["timers"].sent == 2 and timers == {1001}
    mark = 1000 + 60 * 1499
    first = list(processor.handleExpiredTimer((1,), Told(mark), Told(1001)))
    assert [r.seq for r in first] == list(range(1500)) and states["waiting"].sent == 5
    end = 1000 + 60 * 1499 + d.END_MS + 1
    timers.discard(1001)
    assert timers == {mark + 61, end}
    second = list(processor.handleExpiredTimer((1,), Told(10**6), Told(mark + 61)))
    timers.discard(mark + 61)
    assert [r.seq for r in second] == list(range(1500, 3000)) and timers == {end}
    timers.discard(end)
    assert not list(processor.handleExpiredTimer((1,), Told(end), Told(end))) and timers == {1000 + 60 * 2999 + d.END_MS + 1}
    last = timers.pop()
    assert not list(processor.handleExpiredTimer((1,), Told(last), Told(last))) and not timers and not any(s.rows for s in states.values())


def test_replay_of_nothing(spark):
    assert replay(spark.createDataFrame([(1, 1, None, *[None] * 7)], d.FRAME)).count() == 0


def test_sessions_end(spark):
    rows = run(spark, [frame(0, 400), frame(1, 400 + d.END_MS, "error"), frame(2, 401 + 2 * d.END_MS, "error")])
    assert [r["best_seq"] for r in rows] == [0, 0, None]
    rows = run(spark, [frame(0, 400, "hidden"), frame(1, 400 + d.END_MS), frame(2, 401 + 2 * d.END_MS)])
    assert [r["asleep"] for r in rows] == [True, True, False]


def test_shutter_takes_reduced_frames_and_corners(spark):
    wide = lambda s, q, outcome: (s, 0, 400.0, outcome, q, 3840.0, 2160.0, 900.0, 150.0, 0.1)
    quad = [{"x": 6 * p["x"], "y": 4 * p["y"]} for p in PAGE]
    odd = [dict(quad[0]), dict(quad[1]), {"x": 1000.0, "y": 1800.0}, dict(quad[3])]
    # A frame too early to be asked for has no steady corners, and so no best one.
    early = lambda s, q, outcome: (s, 0, 200.0, *wide(s, q, outcome)[3:])
    frames = spark.createDataFrame([wide(1, quad, "hit"), early(2, quad, "hit"), early(3, odd, "hit"), early(4, None, "miss"), early(5, quad, "error")], d.FRAME)
    got = {r["session"]: r for r in d.shutter_captures(frames, d.detect_frames(frames)).collect()}
    assert [got[k]["source"] for k in range(1, 6)] == ["best", *["current"] * 4]
    assert tuple(got[1]["size"]) == (1920, 1080) and got[1]["corners"][2]["x"] == 1500 and got[1]["corners"][2]["y"] == 860
    assert tuple(got[2]["size"]) == (1600, 900) and got[2]["corners"][2]["x"] == 1250
    middle = [tuple(p) for p in got[3]["corners"]]
    assert middle == [tuple(p) for p in got[4]["corners"]] == [tuple(p) for p in got[5]["corners"]] and middle[0][0] + middle[1][0] == 1600


def events(spark, rows):
    return spark.createDataFrame([(1, i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)], "session long, seq long, action string, mode string, enable_ocr boolean, ocr_text string")


def test_session(spark):
    saved = ("save_page", "mono", True, "one")
    s = fold_sessions(events(spark, [("capture",), saved, ("capture",), ("save_page", "color_original", False), ("back_to_edit",)])).first()
    assert (s["step"], s["pages"], s["modes"], s["ocr"], s["export_mode"], s["current_mode"], s["is_warped"]) == ("edit", [1], ["mono"], {0: "one"}, "jpeg", "color_original", True)
    s = fold_sessions(events(spark, [("capture",), ("save_page", "mono", True), ("capture",), ("cancel_edit",)])).first()
    assert (s["step"], s["pages"], s["ocr"], s["has_image"], s["ocr_error"]) == ("export", [1], {}, False, None)
    s = fold_sessions(events(spark, [("save_page", "mono", True)])).first()
    assert s["ocr_error"] == OCR_FAILED and s["export_mode"] == "pdf"
    s = fold_sessions(events(spark, [saved, ("export_complete",), ("no such action",)])).first()
    assert (s["step"], s["pages"], s["export_mode"]) == ("scan", [], "pdf")
    s = fold_sessions(events(spark, [("back_to_edit",)])).first()
    assert (s["pages"], s["current_mode"]) == ([], "document_enhanced")
