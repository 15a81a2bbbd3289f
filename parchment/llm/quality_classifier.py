"""Quality classifier: logistic regression on hashed word n-grams with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, id_crc_mod, labelled_sample, positive_hash, table
from .word_features import hashed_ngrams

BITS = 18


class Leader:
    """FTRL-proximal state: weights follow from the sums z and n."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _follower(state, number: int, passes: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Leads the shards of a partition through a round, each from the common state, and gives the coordinates that changed."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["id", "y", "at", "x", "shard"]), *batches])
        for shard, own in rows.groupby("shard"):
            z, n = state.value
            leader = Leader(z.copy(), n.copy())
            own = own.sort_values(["id", "y", "mark"]).reset_index(drop=True)
            order = np.random.default_rng(number)
            for i in np.concatenate([order.permutation(len(own)) for _ in range(passes)]):
                leader.learn(np.asarray(own["at"][i]), np.asarray(own["x"][i], np.float64), int(own["y"][i]))
            changed = np.flatnonzero((leader.n != n) | (leader.z != z))
            yield pd.DataFrame({"at": changed, "z": leader.z[changed], "n": leader.n[changed], "shard": int(shard)})

    return follow


def _mean(field: str) -> Column:
    """Over the array s, summed in its order, so that reruns agree to the last bit."""
    return F.aggregate(F.transform("s", lambda s: s[field]), F.lit(0.0), lambda total, x: total + x) / F.size("s")


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "y", shards: int = 6, rounds: int = 4, bits: int = BITS) -> np.ndarray:
    """Weights learnt from ``rows``, which are a bounded sample.

    The sample is dealt into shards by the hashes of its ids once, and stays so. In each round every shard
    follows its own leader from the common state, over its rows as often as 10,000 updates need; the
    states of the coordinates that shards changed are then averaged. The driver holds 2^bits numbers.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("y is not null and id is not null")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [hashed_ngrams(t, bits) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "at": [f[0].astype("int32") for f in found], "x": [f[1].astype("float32") for f in found], "shard": pdf["shard"], "mark": pdf["mark"]})

    dealt = known.withColumns({"shard": (positive_hash(F.col("id"), seed=11) % shards).cast("int"), "mark": F.xxhash64("text")}).repartitionById(shards, F.col("shard"))
    ready = checkpointed(dealt.mapInPandas(features, "id long, y int, at array<int>, x array<float>, shard int, mark long"))
    passes = min(20, -(-10000 // max(1, ready.count())))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for number in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        states = ready.mapInPandas(_follower(state, number, passes), "at long, z double, n double, shard int")
        mixed = states.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("shard", "z", "n"))).alias("s"))
        new = mixed.select("at", _mean("z").alias("z"), _mean("n").alias("n")).toPandas()
        z[new["at"]], n[new["at"]] = new["z"], new["n"]
        state.unpersist()
    return Leader(z, n).weights().astype(np.float32)


def score_texts(texts: Column, weights: np.ndarray, spark: SparkSession, bits: int = BITS) -> Column:
    """The probability of label 1, from the sparse dot product of a text's n-grams with the weights; null texts count as empty."""
    model = spark.sparkContext.broadcast(weights)

    def score(series: pd.Series) -> pd.Series:
        w = model.value
        found = (hashed_ngrams(t, bits) for t in series)
        return pd.Series([1 / (1 + np.exp(-np.clip(float(w[at] @ x), -35, 35))) for at, x in found], dtype="float64")

    return F.pandas_udf(score, T.DoubleType())(texts)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = 20000) -> DataFrame:
    """id, held_out, score and predicted for each row of ``docs``.

    Only labelled rows whose crc32 of the id is not a multiple of 5 are learnt from, and only their
    texts: at most ``sample`` rows, which differ in id or text and have the smallest hashes of them. A null id is not held out and not learnt from. Without labels every score is 0.5. Null
    labels are left out; of several labels of an id the lowest counts; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & (id_crc_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("_y")).withColumnRenamed("doc_id", id_col)
    weights = train(labelled_sample(docs, known, sample, id_col, text_col, seed=4), id_col, text_col, "_y")
    held = F.coalesce(id_crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col(id_col), held, score_texts(F.col(text_col), weights, spark).alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
