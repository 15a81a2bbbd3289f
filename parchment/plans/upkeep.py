"""Queries on tables that streams keep up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports
from ..sources import preferences
from ..sources.shared import shared_folder
from ..streaming import upkeep
from .exporting import _HTML, preference_log
from .inputs import table, word_pages
from .registry import ORACLE_SQL, query


@query(ORACLE_SQL["latest_preferences"])
def kept_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each key, kept by a stream that gets the log in four parts out of order, and the first part once more."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    log = preference_log(spark, sf_dir)
    for n, part in enumerate((2, 0, 3, 1, 2)):
        log.where(F.col("seq") % 4 == part).write.parquet(f"{folder}/in/{n}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    upkeep.keep_newest(stream, f"{folder}/table", ["key"], "seq", f"{folder}/state").awaitTermination()
    kept = upkeep.newest(spark, f"{folder}/table").withColumn("value", preferences.load_json(F.col("value"), "true"))
    return kept.select("key", "value", F.coalesce(F.get_json_object("value", "$.k").cast("int"), F.lit(-1)).alias("k"))


@query(_HTML + f"""SELECT s.session, md5('{exports.HEAD}' || string_agg(part, '' ORDER BY page) || '{exports.TAIL}') AS html_md5, CASE WHEN max(page) >= 3 THEN 1 ELSE 0 END AS made_in,
  count(*)::VARCHAR || ':' || string_agg(coalesce(length(text), 0)::VARCHAR, ',' ORDER BY page) || ':' || coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (text IS NOT NULL), '') AS export_key
FROM shown s JOIN conversations c ON c.conv_id = s.session AND c.turn = s.page GROUP BY s.session""")
def refreshed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of sessions of up to three pages, and then of all pages, twice: those that have not grown are not made again."""
    folder = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("page"), F.coalesce(F.length("text"), F.lit(0)).alias("length"), F.col("text").isNotNull().alias("has_text"))
    pages = word_pages(spark, sf_dir).join(texts, ["session", "page"])
    for number, most in enumerate((3, 10**9, 10**9)):
        upkeep.refresh_exports(pages.where(F.col("page") < most), folder, number)
    return upkeep.newest(spark, folder).select("session", F.md5("html").alias("html_md5"), "made_in", "export_key")
