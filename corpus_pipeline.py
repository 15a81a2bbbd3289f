"""From raw documents to training shards: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import shared_folder, table
from parchment.llm.decontamination import mark_contamination
from parchment.llm.mixing import mix_sources
from parchment.llm.quality_rules import quality_verdicts
from parchment.llm.sharding import shard_by_bytes
from parchment.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep; short ones may be good, so only those without a word go for their length.

    Null, empty and blank texts go. Whole texts are judged, each row by itself: equal rows share their fate, nulls in other columns don't matter,
    columns of other names stay as they are, and an empty table stays empty.
    """
    return quality_verdicts(docs, table(spark, sf_dir, "labels"), least_words=1).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Null and empty texts are copies of each other. Of rows that repeat id and text one stays, while unlike texts of one id (null is one) are
    documents of their own; whole texts are compared. Columns of other names stay as they are, and an empty table stays empty.
    """
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Whole texts are searched, each row by itself; columns of other names stay as they are, but one named contamination
    has the findings, and an empty table stays empty.
    """
    return mark_contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("contamination") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for each time that a document is taken.

    Null is a source of its own, the last; texts without words have size 0 and go with their block. Of equal rows any may be taken, and reruns take
    equal ones. Columns of other names stay as they are, and an empty table stays empty.
    """
    # Other columns may be named like those that the mixture adds.
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    return mix_sources(docs.withColumnsRenamed(names)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, shard and slot.

    Null texts have size 1; equal rows are numbered in any order and parted where a boundary falls among them. Columns named size, shard or slot
    are replaced, others stay, and an empty table stays empty.
    """
    return shard_by_bytes(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Hashes, learnt thresholds and draws have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
