"""Frames at rest sent through the stream in slices of time, and what the stream made of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .detector import END_MS, FRAME, FRAME_COLUMNS, STREAM_OUT, detect_stream, rocksdb_state

def replay(frames: DataFrame, slices: int = 3) -> DataFrame:
    """What detect_stream gives for frames that come slice by slice, each in any order; the stream's files stay in a folder of their own.

    The delay is the width of a slice, so that the files of one may come after each other. Frames of a session of its own, which
    isn't in the result, move the clock on until all sessions have ended.
    """
    spark = frames.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    ready = frames.select(*FRAME_COLUMNS).where("session is not null and seq is not null and frame_ms is not null")
    first, last, clock = ready.agg(F.min("frame_ms"), F.max("frame_ms"), F.max("session")).first()
    if first is None:
        return spark.createDataFrame([], STREAM_OUT)
    width = (last - first) / slices
    for i in range(slices):
        own = (F.col("frame_ms") >= first + i * width) & ((F.col("frame_ms") < first + (i + 1) * width) if i < slices - 1 else F.lit(True))
        ready.where(own).repartition(F.xxhash64("session", "seq")).write.parquet(f"{folder}/in/{i}")
    for i in (1, 2, 3):
        tick = [(clock + 1, i, last + i * (width + END_MS + 1000), "unready", None, None, None, None, None, None)]
        spark.createDataFrame(tick, FRAME).coalesce(1).write.parquet(f"{folder}/in/{slices + i}")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = spark.readStream.schema(FRAME).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    with rocksdb_state(spark):
        stream = detect_stream(source, f"{int(width) + 1} milliseconds")
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where(F.col("session") <= clock)
