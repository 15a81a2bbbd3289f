"""Tables kept by streams: order and repeats don't matter, and only what has changed is made again."""

from pyspark.sql import functions as F

from parchment.streaming import upkeep

LOG = "key string, seq long, value string"
WORDS = "array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"
PAGE = f"session long, page int, words {WORDS}, width double, height double, length int, has_text boolean"


def kept(spark, folder):
    return sorted((tuple(r) for r in upkeep.newest(spark, folder).select("key", "seq", "value").collect()), key=str)


def test_batches_may_repeat_and_come_in_any_order(spark, tmp_path):
    batches = [[("a", 3, "x"), ("b", 1, None), (None, 1, "n")], [("a", 2, "old"), ("b", 1, None), ("a", 3, "x")], [("b", 5, "new"), (None, 4, None), ("c", None, "c")]]
    folder = str(tmp_path / "t")
    for n, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again
            upkeep.upsert(spark.createDataFrame(rows, LOG), folder, n, ["key"], "seq")
    want = sorted([("a", 3, "x"), ("b", 5, "new"), (None, 4, None), ("c", None, "c")], key=str)
    assert kept(spark, folder) == want
    other = str(tmp_path / "u")
    for n, rows in enumerate(reversed(batches)):
        upkeep.upsert(spark.createDataFrame(rows, LOG), other, n, ["key"], "seq")
    assert kept(spark, other) == want
    upkeep.upsert(spark.createDataFrame([], LOG), other, 3, ["key"], "seq")
    assert kept(spark, other) == want


def test_a_stream_that_goes_on(spark, tmp_path):
    """A second run takes what is new; versions follow the batches."""
    for n, rows in enumerate(([("a", 1, "x")], [("a", 2, "y"), ("b", 1, "z")])):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = upkeep.keep_newest(stream, f"{tmp_path}/t", ["key"], "seq", f"{tmp_path}/state")
        query.awaitTermination(120)
        assert query.exception() is None
    assert kept(spark, f"{tmp_path}/t") == [("a", 2, "y"), ("b", 1, "z")]
    assert [tuple(r) for r in upkeep.version(spark, f"{tmp_path}/t", 0).select("key", "value").collect()] == [("a", "x")]


def test_only_changed_sessions_are_exported_again(spark, tmp_path):
    folder = str(tmp_path / "e")
    word = [("hi", 1.0, (0.0, 0.0, 1.0, 1.0))]
    first = [(1, 0, word, 10.0, 10.0, 2, True), (2, 0, None, None, None, 0, False), (None, 0, word, 1.0, 1.0, 2, True)]
    upkeep.refresh_exports(spark.createDataFrame(first, PAGE), folder, 0)
    more = [(1, 0, word, 10.0, 10.0, 2, True), (1, 1, word, 10.0, 10.0, 2, True), (3, 0, word, 10.0, 10.0, 2, True)]
    for _ in range(2):
        upkeep.refresh_exports(spark.createDataFrame(more, PAGE), folder, 1)
    got = {r["session"]: r for r in upkeep.newest(spark, folder).collect()}
    assert {k: (r["made_in"], r["export_key"]) for k, r in got.items()} == {1: (1, "2:2,2:0,1"), 2: (0, "1:0:"), 3: (1, "1:2:0")}
    assert got[1]["html"].count('class="page"') == 2
    upkeep.refresh_exports(spark.createDataFrame([], PAGE), folder, 2, gone=spark.createDataFrame([(2,)], "session long"))
    assert sorted(r["session"] for r in upkeep.newest(spark, folder).select("session").collect()) == [1, 3]
    assert upkeep.newest(spark, folder).where(F.col("made_in") == 2).count() == 0
