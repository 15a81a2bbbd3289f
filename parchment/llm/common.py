"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java regular expressions. In Python, bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: that set by call, or in spark.checkpoint.dir. A temporary one only in local mode without either."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="checkpoints-"))
    return _own_dir[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no recomputation of its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def id_crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``: the contract's fold of a document (null id: null)."""
    return F.crc32(doc_id.cast("string")) % modulus


def positive_hash(*cols: Column, seed: int = 0) -> Column:
    """A hash of ``cols`` and ``seed`` in 0 .. 2^62-1."""
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))


def bounded_sample(rows: DataFrame, most: int, *by: str, seed: int) -> DataFrame:
    """At most ``most`` of the rows that differ in the columns ``by``: those with the smallest hashes of them.

    The bound holds however often a key comes: rows equal in ``by`` are one, and the rest of the hashes are
    ranked. Rows are counted first, so that only about twice ``most`` hashes are ranked.
    """
    share = min(1.0, 2.0 * most / max(1, rows.count()))
    marked = rows.withColumn("_rank", positive_hash(*map(F.col, by), seed=seed)).where(F.col("_rank") < int(share * 2**62))
    last = marked.select("_rank").distinct().orderBy("_rank").limit(most).agg(F.max("_rank")).first()[0]
    return marked.where(F.col("_rank") <= F.lit(-1 if last is None else last)).dropDuplicates(["_rank"]).drop("_rank")


def labelled_sample(docs: DataFrame, known: DataFrame, most: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """At most ``most`` of the rows of ``docs`` whose id is in ``known``, with the columns of ``known``; its ids occur once each.

    Some 2 * ``most`` ids, chosen by their hashes, are sent to the texts, so texts of other ids don't move; of the rows found there, which
    may be any number for an id, a bounded sample is left.
    """
    share = min(1.0, 2.0 * most / max(1, known.count()))
    ids = known.where(positive_hash(F.col(id_col), seed=seed) < int(share * 2**62))
    return bounded_sample(docs.select(id_col, text_col).join(F.broadcast(ids), id_col), most, id_col, text_col, seed=seed)


def once(udf):
    """``udf`` so marked that a filter on its outcome doesn't make it run a second time."""
    return udf.asNondeterministic()
