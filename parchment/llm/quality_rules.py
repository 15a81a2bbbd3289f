"""Quality rules: fixed limits, and an isolation forest on the rules' statistics, grown from all labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, once, positive_hash, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
STATS = 7
#: Scores are multiples of one in so many, so that the rows of each score can be counted.
STEPS = 1 << 16
_UPPER = bytes(range(65, 91))


def text_counts(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts of a whole text, and the statistics that the forest sees. Null: none, all zero.

    The statistics are word length, and the shares of symbols, of repeated lines, of words in repeated windows, of capitals,
    of distinct words, and of words that repeat the one before. Splits fall evenly over a statistic's range, so powers
    set how much of it is taken up by the small shares that many texts have (a quoted line, a licence).
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * STATS
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = 0
    if n > 3:
        pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
        window = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True)[1]
        hit = (np.bincount(window) > 1)[window]
        if hit.any():
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeat = int(cover.sum())
    upper = len(raw) - len(raw.translate(None, _UPPER))
    again = float(np.mean(ids[1:] == ids[:-1])) if n > 1 else 0.0
    stats = [chars / n, (symbols / chars) ** 0.5, (dup / len(lines)) ** 3, (repeat / n) ** 3, (upper / chars) ** 2, len(seen) / n**0.8, again**2]
    return [n, chars, symbols, dup, repeat], [float(x) for x in stats]


def base_failed(counts: np.ndarray, least_words: int = 50) -> np.ndarray:
    return (counts[:, 0] < least_words) | (100 * counts[:, 4] > 50 * counts[:, 0])


def grow_tree(rows: np.ndarray, times: np.ndarray, deepest: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Column, cut, left child and path length of each node of a tree over ``rows``, each of which stands for so many ``times``."""
    column, cut, left, length = [], [], [], []

    def node() -> int:
        column.append(-1), cut.append(0.0), left.append(0), length.append(0.0)
        return len(column) - 1

    todo = [(node(), rows, times, 0)]
    while todo:
        at, own, n, depth = todo.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        free = np.flatnonzero(high > low)
        if depth >= deepest or not free.size:
            length[at] = depth + Forest._rest(n.sum())
            continue
        column[at] = int(rng.choice(free))
        cut[at] = float(rng.uniform(low[column[at]], high[column[at]]))
        below = own[:, column[at]] < cut[at]
        left[at] = node()
        node()
        todo += [(left[at], own[below], n[below], depth + 1), (left[at] + 1, own[~below], n[~below], depth + 1)]
    return [np.array(column), np.array(cut), np.array(left), np.array(length)]


class Forest:
    """Isolation trees, kept as flat arrays so that whole batches descend together.

    Rows at hand give each tree ``size`` of them; ``grown_forest`` deals any number of rows out to the trees.
    """

    def __init__(self, rows: np.ndarray, trees: int = 300, size: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.trees = min(size, len(rows)), []
        for _ in range(trees):
            self.trees.append(self._grow(rows[rng.permutation(len(rows))[: self.size]], rng))

    @classmethod
    def of(cls, trees: list[list[np.ndarray]], size: float) -> Forest:
        """The forest of ``trees`` that were grown from ``size`` rows each, on average."""
        forest = cls.__new__(cls)
        forest.trees, forest.size = trees, size
        return forest

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        return grow_tree(rows, np.ones(len(rows), np.int64), int(np.ceil(np.log2(max(2, self.size)))), rng)

    @staticmethod
    def _rest(n: int) -> float:
        """Mean path length of an unsuccessful search among ``n``."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0 .. 1; short mean paths give high ones."""
        total = np.zeros(len(rows))
        for column, cut, left, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := column[at] >= 0).any():
                live = at[inner]
                at[inner] = left[live] + (rows[inner, column[live]] >= cut[live])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self._rest(self.size), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, most_good_lost: float, times: np.ndarray | None = None) -> float:
    """The threshold above which the share of bad rows exceeds that of good ones most, while at most ``most_good_lost`` of the good ones lie there.

    Of equal ones the highest. Without good rows nothing is rejected, without bad ones no good one. A score may stand for
    so many ``times``.
    """
    times = np.ones(len(scores), np.int64) if times is None else times
    at, place = np.unique(scores, return_inverse=True)
    own, other = (np.cumsum(np.bincount(place, np.where(of, times, 0), len(at))) for of in (good, ~good))
    if not len(at) or not own[-1]:
        return 1.0
    at, lost = at[::-1], 1 - own[::-1] / own[-1]
    caught = 1 - other[::-1] / other[-1] if other[-1] else np.zeros(len(at))
    return float(at[np.argmax(np.where(lost <= most_good_lost, caught - lost, -1.0))])


def _measured(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """quality, statistics and a hash of the id and text of all rows of ``docs`` whose id is in ``known``.

    All texts are measured where they are, and only what was measured meets the labels.
    """

    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([text_counts(t)[1] for t in texts], dtype="object")

    own = docs.select(F.col(id_col).alias("_id"), positive_hash(F.col(id_col), F.col(text_col), seed=2).alias("hash"), once(F.pandas_udf(measure, "array<double>"))(F.col(text_col)).alias("stats"))
    return own.where("_id is not null").join(known.select(F.col("doc_id").alias("_id"), "quality"), "_id").select("quality", "hash", "stats")


def grown_forest(rows: DataFrame, n: int, trees: int = 300, size: int = 256, seed: int = 7) -> Forest:
    """The forest of all ``n`` rows (hash, stats): each goes to one tree or more, so that a tree has about ``size`` rows, or a share of all if that is more.

    The trees are bands, as many as a row has trees; its hash names one in each band. Equal statistics of a tree are one row
    with their number, and each tree is grown in a task of its own; trees have 2 * ``size`` nodes or so, however many rows there are.
    """
    bands = min(trees, -(-trees * size // n))
    k = F.col("band")
    first, end = F.floor(k * trees / bands), F.floor((k + 1) * trees / bands)
    dealt = rows.select("stats", "hash", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    dealt = dealt.select("stats", (first + F.pmod(F.xxhash64("hash", k), end - first)).cast("int").alias("tree"))
    held = dealt.groupBy("tree", "stats").agg(F.count("*").alias("times"))
    deepest = int(np.ceil(np.log2(max(2, min(size, n)))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        column, cut, left, length = grow_tree(np.array(pdf["stats"].tolist()), pdf["times"].to_numpy(), deepest, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "column": [column], "cut": [cut], "left": [left], "length": [length]})

    grown = held.groupBy("tree").applyInPandas(grow, "tree int, column array<int>, cut array<double>, left array<int>, length array<double>").toPandas()
    parts = grown.sort_values("tree")[["column", "cut", "left", "length"]]
    return Forest.of([[np.asarray(x) for x in row] for row in parts.itertuples(index=False)], min(n, n * bands / trees))


def scored(model, stats: list) -> np.ndarray:
    """Scores as multiples of 1 / ``STEPS``; without a model 0."""
    if model is None or not len(stats):
        return np.zeros(len(stats))
    return np.round(model.score(np.array(stats, np.float64).reshape(-1, STATS)) * STEPS) / STEPS


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = 300, size: int = 256, most_good_lost: float = 0.03) -> tuple[Forest | None, float]:
    """A forest on the statistics of labelled texts, and the score above which documents are rejected.

    All labelled rows are in the trees, and all are scored to find the threshold. The trees split at random what all
    of them show, so texts with short paths are unlike the rest; the labels of good and of bad rows set the threshold.
    To the driver come the trees, and the numbers of good and of bad rows of each of ``STEPS`` scores at most. Without a labelled row
    nothing is scored or rejected.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = checkpointed(_measured(docs, known, id_col, text_col))
    n = rows.count()
    if not n:
        return None, 1.0
    forest = grown_forest(rows, n, trees, size)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    score = F.pandas_udf(lambda stats: pd.Series(scored(model.value, stats.tolist())), "double")
    counts = rows.select("quality", score("stats").alias("score")).groupBy("score", (F.col("quality") == 1).alias("good")).agg(F.count("*").alias("times")).toPandas()
    return forest, calibrate(counts["score"].to_numpy(), counts["good"].to_numpy(bool), most_good_lost, counts["times"].to_numpy())


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, **fit) -> DataFrame:
    """All columns of ``docs`` plus the five counts, base_failed, anomaly (0 to 1) and kept.

    base_failed: fewer than ``least_words`` words, or over half of them in repeated 3-word windows. kept: neither
    that nor an anomaly score above the calibrated threshold. Null and empty texts have no words and
    fail unless ``least_words`` is 0; any number of rows may have the same id, and each is judged by its text; equal scores
    have equal verdicts; columns of ``docs`` with the new names are replaced; an empty table gives an empty one.
    """
    forest, threshold = fit_forest(docs, labels, id_col, text_col, **fit)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [text_counts(t) for t in texts]
        counts = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
        failed = base_failed(counts, least_words)
        score = scored(model.value, [f[1] for f in found])
        out = pd.DataFrame(counts, columns=COUNTS)
        return out.assign(base_failed=failed, anomaly=score, kept=~failed & (score <= threshold))

    schema = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    plain = docs.drop(*[c for c in [*COUNTS, "base_failed", "anomaly", "kept", "_judged"] if c not in (id_col, text_col)])
    return plain.withColumn("_judged", once(F.pandas_udf(judge, schema))(F.col(text_col))).select(*plain.columns, "_judged.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and anomaly of all documents."""
    judged = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
