"""The folder that all machines share, and results put there so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode without it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="shared-"))
    return _own[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
