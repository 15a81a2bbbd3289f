"""Runs of words that repeat with a period: found in whole texts, and cut down to their first period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, table

#: The least number of words of a run, the words that are searched together, and the candidates extended together.
LEAST, TOGETHER, EXTENDED = 12, 1 << 18, 1 << 20
RUN = "struct<start:long,length:long,period:long>"


def block_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at each place: equal names for equal blocks, and only for them.

    A block of twice the length is named by the names of its halves. Only places whose both halves occur
    elsewhere too are compared; any other block is the only one of its kind and gets a name of its own.
    """
    places = np.arange(len(words))

    def named(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        names = places + len(counts)
        again = counts[of] > 1
        names[at[again]] = of[again]
        return names, at[again]

    names, at = named(words, places)
    levels, size = [names], 1
    while len(at) and 2 * size <= longest:
        twice = np.zeros(len(words) + size, bool)
        twice[at] = True
        at = at[twice[at + size]]
        names, at = named(names[at] * (len(words) + 1) + names[np.minimum(at + size, len(words) - 1)], at)
        if len(at):
            levels.append(names)
        size *= 2
    return levels


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on: block by block, the longest first."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        total += (levels[k][i + total] == levels[k][j + total]).astype(np.int64) << k
    return total


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j; i < j."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - total - (1 << k), j - total - (1 << k)
        total += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return total


def _candidates(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places on the grid of each period whose words are equal one period apart. Every run of two periods or more has one of its own period."""
    some, total = [], 0
    for q in range(1, longest // 2 + 1):
        grid = words[::q]
        at = np.flatnonzero(grid[1:] == grid[:-1])
        if len(at):
            some.append((at * q, np.full(len(at), q)))
            total += len(at)
        if some and (total >= EXTENDED or q == longest // 2):
            yield tuple(map(np.concatenate, zip(*some, strict=True)))
            some, total = [], 0
    if some:
        yield tuple(map(np.concatenate, zip(*some, strict=True)))


def runs_of(docs: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each document its runs as rows of start, length, period, by start and then period."""
    sizes = np.array([len(d) for d in docs], np.int64)
    longest = int(sizes.max(initial=0))
    if longest < least:
        return [np.zeros((0, 3), np.int64)] * len(docs)
    ids: dict[bytes, int] = {}
    # All documents in one row, each with names of its own and a word before and after it that is like no other.
    begins = np.cumsum(sizes + 1) - sizes
    own = np.repeat(np.arange(len(docs)), sizes)
    flat = np.fromiter((ids.setdefault(w, len(ids)) for d in docs for w in d), np.int64, int(sizes.sum()))
    words = -1 - np.arange(int(sizes.sum()) + len(docs) + 1)
    words[np.arange(len(flat)) + own + 1] = flat + own * len(ids)
    levels = block_names(words, longest)
    found = []
    for i, q in _candidates(levels[0], longest):
        start = i - _backward(levels, i, i + q)
        end = i + q + _forward(levels, i, i + q)
        whole = end - start >= np.maximum(least, 2 * q)
        some = np.unique(np.stack([start, end, q], axis=1)[whole], axis=0)
        if len(some):
            found.append(some)
    if not found:
        return [np.zeros((0, 3), np.int64)] * len(docs)
    every = np.unique(np.concatenate(found), axis=0)
    # What repeats with a period does so with its multiples; the smallest comes first.
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    doc = np.searchsorted(begins, every[:, 0], side="right") - 1
    runs = np.stack([every[:, 0] - begins[doc], every[:, 1] - every[:, 0], every[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], doc))
    runs, doc = runs[order], doc[order]
    cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
    return [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def _searched(texts: list[bytes | None], least: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed texts in the order given; documents of about the same length are searched together."""
    runs: list = [None] * len(texts)
    short: list = [b""] * len(texts)
    by_size = sorted(range(len(texts)), key=lambda i: len(texts[i] or b""))
    some: list[int] = []
    docs: list[list[bytes]] = []
    total = 0
    for nth, i in enumerate(by_size, 1):
        some.append(i)
        docs.append((texts[i] or b"").split())
        total += len(docs[-1])
        if total >= TOGETHER or nth == len(by_size):
            for k, words, own in zip(some, docs, runs_of(docs, least), strict=True):
                runs[k], short[k] = own, b" ".join(collapsed(words, own))
            some, docs, total = [], [], 0
    return runs, short


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` plus runs, an array of struct(start, length, period) by start and then period, and collapsed, the text without repetitions.

    A run is a stretch of words, ``least`` of them and two periods or more, that repeats with its smallest period and can't be extended. Words
    of a run after its first period are left out of collapsed, whose words are joined by single spaces. Null, empty and blank texts have no
    runs and an empty collapsed text. Whole texts are searched, in memory that grows with the longest one; each row is searched by itself, so
    repeated rows and ids are no matter. Columns named runs or collapsed are replaced; an empty table gives an empty one.
    """

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def searched(texts: pa.Array) -> pa.Array:
        runs, short = _searched(texts.cast(pa.binary()).to_pylist(), least)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, rows), pa.array(short, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    plain = docs.withColumn("_own_text", F.col(text_col).cast("string")).drop(*[c for c in ("runs", "collapsed", "_found") if c != text_col])
    found = plain.withColumn("_found", once(searched)(F.col("_own_text")))
    keep = [c for c in plain.columns if c not in ("_own_text", "runs", "collapsed")]
    return found.select(*keep, "_found.runs", "_found.collapsed")


def repeated(h: int, words: list[bytes]) -> list[bytes]:
    """The words as the contract plants them: by the hash ``h`` of the id, in a tenth of the documents those from some place on repeat."""
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def planted(doc_id: Column, text: Column) -> Column:
    """Each text with what the contract plants in it; null ids leave it as it is."""

    @F.arrow_udf("string")
    def changed(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        found = zip(hashes.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
        new = [t if h is None or h % 10 or not t else b" ".join(repeated(h, t.split())) for h, t in found]
        return pa.array(new, pa.binary()).cast(pa.string())

    return once(changed)(F.crc32(doc_id.cast("string")), text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text, of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longer = lambda a, b: F.when((b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))), b).otherwise(a)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), longer)).alias("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    ready = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
    return ready.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
