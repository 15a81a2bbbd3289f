"""Files of bytes read and written in parts: what is written is all there or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from parchment.sources import files

ROW = "file_name string, content binary, error string"


def listed(folder):
    return sorted(f for f in os.listdir(folder) if f[0] not in "._") if os.path.isdir(folder) else []


def test_rows_become_files_and_errors(spark, tmp_path):
    rows = [(f"p{i:03d}.bin", bytes([i]) * i, None) for i in range(40)] + [("x/../deep/y.bin", b"deep", None), ("none.bin", None, None), ("bad.bin", None, "ValueError: no image"), (None, b"1", None), ("", b"1", None), (".hidden", b"1", None), ("_list", b"1", None), ("empty.bin", b"", None)]
    folder = f"{tmp_path}/out"
    done = {r["file_name"]: (r["bytes"], r["error"]) for r in files.write_files(spark.createDataFrame(rows, ROW).repartition(5), folder, error_col="error").collect()}
    assert len(done) == len(rows) and done["p007.bin"] == (7, None) and done["empty.bin"] == (0, None)
    assert done["none.bin"] == (None, "no content") and done["bad.bin"] == (None, "ValueError: no image") and done[None] == (None, "no name")
    assert listed(folder) == sorted([f"p{i:03d}.bin" for i in range(40)] + ["y.bin", "empty.bin"]) and not os.listdir(f"{folder}/_temporary")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], bytes(r["content"]), r["error"]) for r in files.read_files(spark, folder).collect()}
    assert got == {n.rsplit("/", 1)[1] if "/" in n else n: (len(c), c, None) for n, c, e in rows if n and c is not None and n[0] not in "._"}
    again = files.write_files(spark.createDataFrame([("p001.bin", b"new", None)], ROW), f"file://{folder}").collect()
    assert [tuple(r) for r in again] == [("p001.bin", 3, None)] and len(listed(folder)) == 42
    assert files.write_files(spark.createDataFrame([], ROW), f"{tmp_path}/nothing").count() == 0


def test_a_task_that_fails_half_way_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rows = spark.range(100).repartition(4).select(F.format_string("f%03d", "id").alias("file_name"), F.expr("cast(if(id = 63, raise_error('lost'), 'text') as binary)").alias("content"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(rows, folder)
    assert listed(folder) == [] and not os.path.exists(f"{folder}/_written") and (not os.path.exists(f"{folder}/_temporary") or not os.listdir(f"{folder}/_temporary"))


def test_partitions_by_bytes(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02d}").write_bytes(b"x" * (i % 3) * 1000)
    (tmp_path / "_skip").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g").write_bytes(b"deep")
    parts = files.FileReader(str(tmp_path), 3 * files.OPENING + 4000).partitions()
    assert [len(p.paths) for p in parts] == [3, 3, 3, 3, 1] and [p.paths[0][0].rsplit("/", 1)[1] for p in parts] == ["f00", "f03", "f06", "f09", "g"]
    assert len(files.FileReader(str(tmp_path), 1).partitions()) == 13
    got = files.read_files(spark, str(tmp_path), 1)
    assert got.rdd.getNumPartitions() == 13 and got.agg(F.sum("bytes")).first()[0] == 12004
    (tmp_path / "none").mkdir()
    assert files.read_files(spark, f"{tmp_path}/none").count() == 0


def test_an_unreadable_file_is_an_error_row(tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    reader = files.FileReader(str(tmp_path), 10**9)
    (part,) = reader.partitions()
    part.paths.append((f"{tmp_path}/gone", 3))
    got = list(reader.read(part))
    assert got[0][2:] == (b"x", None) and got[1][2] is None and "gone" in got[1][3]
