"""Tables kept up to date by streams: the newest row of each key, and exports made again only where their session has changed.

A table is a folder with a version for each batch, named by the batch's number. A version is written from the one before and the
batch alone, so a batch that runs again writes the same once more, and readers of older versions are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import naming
from ..operators import exports

_SHOWN = "v"


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_SHOWN}={number}")


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The last version in a folder with one at least."""
    every = spark.read.parquet(folder)
    return every.where(F.col(_SHOWN) == every.agg(F.max(_SHOWN)).scalar()).drop(_SHOWN)


def upsert(rows: DataFrame, folder: str, number: int, keys: Sequence[str], seq_col: str) -> None:
    """Writes version ``number``: of each key the row with the greatest ``seq_col`` of the version before and of ``rows``.

    Repeated rows change nothing, nor does the order in which they come; of different rows with one key and number that with the greater other
    values stays. Null keys are one key; a null number is the least. Partial maxima by key, so no key's rows are gathered.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    every = version(spark, folder, number - 1).unionByName(rows) if number > 0 else rows
    best = F.max(F.struct(F.col(seq_col).alias("_seq"), *[F.col(c) for c in rest])).alias("_best")
    found = every.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
    found.select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/{_SHOWN}={number}")


def keep_newest(log: DataFrame, folder: str, keys: Sequence[str], seq_col: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the newest row of each key of a stream; what is there when it begins counts, and it ends then."""
    return _batches(log, checkpoint, lambda rows, number: upsert(rows, folder, number, keys, seq_col))


def _batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_keys(pages: DataFrame) -> DataFrame:
    """session and the key of its export, from pages with session, page, length and has_text."""
    rows = F.array_sort(F.collect_list(F.struct("page", "length", "has_text")))
    kept = pages.groupBy("session").agg(rows.alias("r"))
    key = naming.export_key(F.transform("r", lambda s: s["length"]), F.transform(F.filter("r", lambda s: s["has_text"]), lambda s: s["page"]))
    return kept.select("session", key.alias("export_key"))


def refresh_exports(pages: DataFrame, folder: str, number: int, gone: DataFrame | None = None) -> None:
    """Writes version ``number`` of the exports: session, export_key, html and made_in, the version that the document was made in.

    ``pages`` has session, page, words, width, height, length and has_text: all pages of the sessions that a batch touches. Only sessions whose key
    isn't that of their last export are exported; others, and sessions that aren't in ``pages``, keep what they have, but
    for those in ``gone``. Null sessions are left out; a page twice counts twice.
    """
    spark = pages.sparkSession
    known = export_keys(pages.where("session is not null"))
    old = version(spark, folder, number - 1) if number > 0 else None
    stale = known if old is None else known.join(old.select("session", "export_key"), ["session", "export_key"], "left_anti")
    made = exports.html_documents(pages.join(stale.select("session"), "session", "left_semi")).join(stale, "session").select("session", "export_key", "html", F.lit(number).alias("made_in"))
    if old is not None:
        kept = old.join(stale.select("session"), "session", "left_anti")
        made = made.unionByName(kept if gone is None else kept.join(gone.select("session"), "session", "left_anti"))
    made.write.mode("overwrite").parquet(f"{folder}/{_SHOWN}={number}")
