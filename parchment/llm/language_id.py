"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_crc_mod, positive_hash, table

DIMS = 4096
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, dims: int = DIMS, piece: int = 1 << 20) -> np.ndarray | None:
    """Counts of a whole text's hashed 1-, 2- and 3-character n-grams in lower case; None without a letter.

    What is no letter counts as a space, of which runs are one; n-grams of spaces only don't count.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    total = np.zeros(dims)
    for at in range(0, len(codes), piece):
        c = codes[at : at + piece + 2]
        own = min(piece, len(codes) - at)
        single = c[:own]
        pair = c[:-1][:own] * np.uint64(0x110000) + c[1:][:own]
        triple = (c[:-2] * np.uint64(0x110000) + c[1:-1])[:own] * np.uint64(0x110000) + c[2:][:own]
        for k, g in enumerate((single[single != 32], pair, triple)):
            mixed = (g + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return total


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def spherical_means(rows: np.ndarray, clusters: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows by cosine; fewer rows than clusters: fewer centroids."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:clusters]].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        for k in range(len(centres)):
            if (own := rows[nearest == k]).size:
                mean = own.mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def fit_centroids(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 600, clusters: int = 4, reject: float = 0.002) -> dict:
    """Inverse document frequencies, and the centroids and least accepted cosine of each language.

    At most ``per_language`` rows of each language are learnt from, which differ in id or text and have the smallest
    hashes of them; each language is clustered in a task of its own, which that number bounds.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), 2.0 * per_language / F.col("n"))
    some = rows.join(F.broadcast(sizes), "lang").withColumn("mark", positive_hash(F.col("id"), F.col("text"), seed=10)).where(F.col("mark").cast("double") <= share * float(2**62))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    last = some.select("lang", "mark").distinct().withColumn("nth", nth).where(F.col("nth") <= per_language).groupBy("lang").agg(F.max("mark").alias("last"))
    chosen = some.join(F.broadcast(last), "lang").where("mark <= last").dropDuplicates(["lang", "mark"])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, x, k, c) for i, x, k, t in zip(pdf["id"], pdf["lang"], pdf["mark"], pdf["text"], strict=True) if (c := ngram_counts(t)) is not None]
            yield pd.DataFrame({"id": pd.Series([f[0] for f in found], dtype="int64"), "lang": pd.Series([f[1] for f in found], dtype="object"), "mark": pd.Series([f[2] for f in found], dtype="int64"), "counts": [f[3].astype("float32") for f in found]})

    ready = checkpointed(chosen.select("id", "text", "lang", "mark").mapInPandas(vectors, "id long, lang string, mark long, counts array<float>"))

    def seen(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.array(pdf["counts"].tolist()).reshape(-1, DIMS)
        return pd.DataFrame({"n": [len(pdf)], "df": [(counts > 0).sum(axis=0).astype("float64")]})

    sums = ready.groupBy("lang").applyInPandas(seen, "n long, df array<double>").toPandas()
    if sums.empty:
        return {"langs": [], "idf": np.ones(DIMS), "centres": np.zeros((0, DIMS)), "of": np.zeros(0, np.int64), "least": np.zeros(0)}
    idf = np.log((1 + sums["n"].sum()) / (1 + np.sum(sums["df"].tolist(), axis=0))) + 0.05

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "mark"])
        unit = _weighted(np.array(pdf["counts"].tolist()).reshape(-1, DIMS), idf)
        centres = spherical_means(unit, clusters)
        least = float(np.quantile((unit @ centres.T).max(axis=1), reject))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": list(centres), "least": least})

    found = ready.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, least double").toPandas().sort_values("lang", kind="stable")
    langs = sorted(set(found["lang"]))
    return {"langs": langs, "idf": idf, "centres": np.array(found["centre"].tolist()), "of": found["lang"].map(langs.index).to_numpy(), "least": found.groupby("lang")["least"].first().loc[langs].to_numpy()}


def identify(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and rejected.

    lang_pred is the language of the centroid with the highest cosine to the text's TF-IDF vector,
    score that cosine; rejected is true where it lies below what nearly all learnt texts of the
    language reach. Null texts, those without a letter, and all texts if nothing was learnt: ``und``, 0,
    true. Repeated rows and ids are each judged by their own text; columns with the new names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_centroids(learn_from, id_col, text_col, lang_col, **fit))

    def nearest(texts: pd.Series) -> pd.DataFrame:
        m, out = model.value, []
        for t in texts:
            counts = ngram_counts(t) if m["langs"] else None
            if counts is None:
                out.append((UNKNOWN, 0.0, True))
                continue
            near = m["centres"] @ _weighted(counts, m["idf"])
            k = int(np.argmax(near))
            score = float(min(1.0, max(0.0, near[k])))
            out.append((m["langs"][m["of"][k]], score, bool(score < m["least"][m["of"][k]])))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    plain = docs.drop(*[c for c in ("lang_pred", "score", "rejected", "_near") if c not in (id_col, text_col)])
    return plain.withColumn("_near", F.pandas_udf(nearest, "lang_pred string, score double, rejected boolean")(F.col(text_col))).select(*plain.columns, "_near.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of all documents."""
    docs = table(spark, sf_dir, "documents")
    fold = id_crc_mod(F.col("doc_id"), 4)
    found = identify(docs.select("doc_id", "text"), docs.where(fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
