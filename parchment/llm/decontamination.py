"""Benchmark decontamination: BM25 over test items by block-max WAND, then verified overlap."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, once, table

_PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}*", b" " * 15)
FOUND = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"
#: Words in a piece of a question at most. A passage is twice as long, and one starts after each so many words, so any piece that a text holds lies in one.
PIECE = 64
#: So many texts with findings are sent to the tasks; with more, texts and findings are joined by a shuffle.
BROADCAST_TEXTS = 100_000
EPS = 1e-9


def tokens(text: str | None) -> list[bytes]:
    """Words without regard to case, with punctuation as spaces."""
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def _shingles(ids: list, width: int) -> list[tuple]:
    width = min(width, len(ids))
    return [tuple(ids[i : i + width]) for i in range(len(ids) - width + 1)] if ids else []


def pieces(words: list, width: int) -> list[list]:
    """``words`` cut so that each of its ``width``-word shingles lies in one piece."""
    step = PIECE - width + 1
    return [words[at : at + PIECE] for at in range(0, max(1, len(words) - width + 1), step)] if words else []


def least_score(weights: dict, shingles: list[tuple], overlap: float) -> float:
    """The least share of a piece's weight that a passage with ``overlap`` of its distinct shingles can have.

    A word is missing from the passage only if all shingles with it are. So what may be missing is bounded by the words that
    weigh most for the shingles they are in (each missing shingle counts for as many words as it has), and, as a run
    of missing shingles frees no more words than it has members, by as many of the heaviest words. And as one shingle at
    least is there, so are all its words: there is always some weight left.
    """
    often = Counter(shingles)
    spare = int(len(often) * (1 - overlap) + EPS)
    within = Counter(w for s in often for w in set(s))
    total = sum(weights.values())
    heaviest = sum(sorted(weights.values(), reverse=True)[: spare * max(often.values(), default=1)])
    room, light = float(spare * len(next(iter(often), ()))), 0.0
    for w in sorted(weights, key=lambda w: -weights[w] / within[w]):
        part = min(1.0, room / within[w])
        light, room = light + part * weights[w], room - part * within[w]
        if room <= 0:
            break
    lightest = min(sum(weights[w] for w in set(s)) for s in often)
    return max(lightest / total, 1 - min(heaviest, light) / total)


def shingle_keys(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words; equal runs have equal ones, and others seldom."""
    n = max(0, len(ids) - width + 1)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = (key + ids[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return key


class ItemIndex:
    """An inverted index of the pieces of test items, searched by block-max WAND.

    A posting's impact is its BM25 weight over the least weight that a passage with enough of the piece's shingles
    can have (``least_score``), so 1 is the threshold for all of them, and nothing that the verification would accept lies below. Pieces in the
    order of their items form blocks; each term has the greatest impact of each block it occurs in. A passage opens the blocks of
    the pieces of which it has one of the rarest shingles, one more of them than may be missing; no other piece can be verified.
    ``stats`` are those of all items, whatever part of them this index holds: number and mean length of pieces, and pieces by term.
    """

    def __init__(self, items: list[tuple[int, str, str | None]], stats: tuple[int, float, dict[bytes, int]], width: int, overlap: float, block: int = 16, k1: float = 1.2, b: float = 0.75):
        if not 0 < overlap <= 1:
            raise ValueError("an overlap over 0 and up to 1 is needed")
        n, mean, df = stats
        self.width, self.overlap, self.block = width, overlap, block
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.answers, self.own_pieces = [], [], []
        self.item_of, self.shingles, self.self_score = [], [], []
        self.at: list[list[int]] = []
        self.impact: list[list[float]] = []
        for item, question, answer in items:
            words = tokens(question)
            if not words:
                continue
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.answers.append({self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens(answer)})
            self.own_pieces.append([])
            for part in pieces(own, width):
                tf, cut = Counter(part), _shingles(part, width)
                idf = {t: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for t, w in zip(part, words[len(self.own_pieces[-1]) * (PIECE - width + 1) :], strict=False)}
                weight = {t: float(idf[t] * c * (k1 + 1) / (c + k1 * (1 - b + b * len(part) / max(mean, 1)))) for t, c in tf.items()}
                total, least = sum(weight.values()), least_score(weight, cut, overlap)
                self.at += [[] for _ in range(len(self.vocabulary) - len(self.at))]
                self.impact += [[] for _ in range(len(self.vocabulary) - len(self.impact))]
                for t, w in weight.items():
                    self.at[t].append(len(self.item_of))
                    self.impact[t].append(w / total / least)
                self.own_pieces[-1].append(len(self.item_of))
                self.item_of.append(len(self.ids))
                self.shingles.append(set(cut))
                self.self_score.append(least)
            self.ids.append(item)
        self.at += [[] for _ in range(len(self.vocabulary) - len(self.at))]
        self.impact += [[] for _ in range(len(self.vocabulary) - len(self.impact))]
        self.term_max = np.array([max(i, default=0.0) for i in self.impact])
        self.block_max: list[dict[int, float]] = []
        for at, impact in zip(self.at, self.impact, strict=True):
            most: dict[int, float] = defaultdict(float)
            for p, i in zip(at, impact, strict=True):
                most[p // block] = max(most[p // block], i)
            self.block_max.append(dict(most))
        often = Counter(cut for own in self.shingles for cut in own)
        gates: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
        for p, own in enumerate(self.shingles):
            spare = len(own) - max(1, int(np.ceil(overlap * len(own) - EPS)))
            for cut in sorted(own, key=lambda c: (often[c], c))[: spare + 1]:
                gates[len(cut)].append((cut, p))
        #: By the width of shingles: sorted keys of the rarest ones, and the blocks that each opens.
        self.gates = {}
        for width_, known in gates.items():
            key = np.array([shingle_keys(np.array(cut), width_)[0] for cut, _ in known], np.uint64)
            of = np.array([p // block for _, p in known], np.int64)
            order = np.lexsort((of, key))
            self.gates[width_] = key[order], of[order]

    def above(self, terms: list[int], start: int, end: int) -> list[tuple[int, float]]:
        """The pieces from ``start`` up to ``end`` whose impacts for ``terms`` add up to 1 or more, and the sums.

        Cursors over the terms' postings are kept in the order of their pieces. The pivot is the first piece at which the greatest impacts
        of the terms up to there reach 1; nothing before it can. If the block maxima there can't, the cursors go on to
        the first block that ends or the next cursor; else they go on to the pivot, which is scored once all are there.
        """
        tops, found, size = self.term_max, [], self.block
        cursors = [[start, t, 0, float(tops[t])] for t in terms]

        def go_on(c: list, to: int) -> None:
            at = self.at[c[1]]
            c[2] = bisect_left(at, to, c[2])
            c[0] = at[c[2]] if c[2] < len(at) else end

        for c in cursors:
            go_on(c, start)
        while True:
            cursors.sort(key=_piece)
            reach, p = 0.0, -1
            for p, c in enumerate(cursors):
                reach += c[3]
                if reach >= 1 - EPS:
                    break
            else:
                return found
            pivot = cursors[p][0]
            if pivot >= end:
                return found
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            block = pivot // size
            most = 0.0
            for c in cursors[: p + 1]:
                most += self.block_max[c[1]].get(block, 0.0)
            if most < 1 - EPS:
                to = (block + 1) * size
                if p + 1 < len(cursors):
                    to = max(pivot + 1, min(to, cursors[p + 1][0]))
                for c in cursors[: p + 1]:
                    go_on(c, to)
            elif cursors[0][0] == pivot:
                score = sum(self.impact[c[1]][c[2]] for c in cursors[: p + 1])
                if score >= 1 - EPS:
                    found.append((pivot, score))
                for c in cursors[: p + 1]:
                    go_on(c, pivot + 1)
            else:
                for c in cursors[: p + 1]:
                    if c[0] < pivot:
                        go_on(c, pivot)

    def search(self, text: str | None, answer_overlap: float) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of the items that the text holds.

        Every passage of the text asks for the pieces above the threshold, in the blocks that its shingles open.
        """
        words = tokens(text)
        if not words or not self.ids:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, tuple[float, float]] = {}
        for k, blocks in self.opened(ids):
            passage = ids[k * PIECE : (k + 2) * PIECE]
            terms = np.unique(passage[passage >= 0]).tolist()
            passage = passage.tolist()
            cut: dict[int, set] = {}
            for p, score in (hit for b in blocks for hit in self.above(terms, b * self.block, (b + 1) * self.block)):
                wanted, i = self.shingles[p], self.item_of[p]
                width = len(next(iter(wanted)))
                if width not in cut:
                    cut[width] = set(_shingles(passage, width)) if len(passage) >= width else set()
                if len(wanted & cut[width]) < self.overlap * len(wanted) - EPS:
                    continue
                answer = self.answers[i]
                told = len(answer.intersection(passage)) / len(answer) if answer else 1.0
                best[i] = max(best.get(i, (0.0, 0.0)), (told, score * self.self_score[p]))
        found = []
        for i, (told, score) in sorted(best.items()):
            if told >= answer_overlap - EPS and (share := self._held(i, ids)) >= self.overlap - EPS:
                found.append((self.ids[i], score, share, told))
        return found

    def opened(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Passages of a text that have one of the rarest shingles of a piece, and the blocks of these pieces. All passages are looked through at once."""
        pairs = []
        for width, (keys, blocks) in self.gates.items():
            missing = np.concatenate([[0], np.cumsum(ids < 0)])
            at = np.flatnonzero(missing[width:] == missing[:-width]) if len(ids) >= width else np.zeros(0, np.int64)
            key = shingle_keys(ids, width)[at]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = high - low
            place = np.repeat(at, n)
            block = blocks[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            # A shingle lies in the passage that starts before it, and in the one before if it ends there.
            passage = place // PIECE
            before = (passage > 0) & (place + width <= (passage + 1) * PIECE)
            pairs += [np.stack([passage, block]), np.stack([passage[before] - 1, block[before]])]
        if pairs and (every := np.concatenate(pairs, axis=1)).size:
            passage, block = np.unique(every, axis=1)
            cuts = np.flatnonzero(np.diff(passage, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(passage)], strict=True):
                yield int(passage[a]), block[a:b].tolist()

    def _held(self, i: int, ids: np.ndarray) -> float:
        """The share of an item's shingles in the text, each piece's counted in the passage that has most of them."""
        own = self.own_pieces[i]
        width = len(next(iter(self.shingles[own[0]])))
        wanted: dict[tuple, list[int]] = defaultdict(list)
        for p in own:
            for cut in self.shingles[p]:
                wanted[cut].append(p)
        held: dict[tuple[int, int], set] = defaultdict(set)
        known = ids.tolist()
        for at in range(len(known) - width + 1):
            cut = tuple(known[at : at + width])
            for p in wanted.get(cut, ()):
                # A shingle lies in a passage if it ends within it.
                for k in (at // PIECE - 1, at // PIECE):
                    if k >= 0 and at + width <= (k + 2) * PIECE:
                        held[p, k].add(cut)
        most: dict[int, int] = defaultdict(int)
        for (p, _), cuts in held.items():
            most[p] = max(most[p], len(cuts))
        return sum(most.values()) / sum(len(self.shingles[p]) for p in own)


def _piece(cursor: list) -> int:
    return cursor[0]


def item_statistics(items: DataFrame, width: int) -> tuple[int, float, DataFrame]:
    """Number and mean length of the pieces of all items' questions (column q), and how many pieces each word (term) is in."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [p for q in pdf["q"] for p in pieces(tokens(q), width)]
            yield pd.DataFrame({"n": pd.Series([len(p) for p in own], dtype="int32"), "terms": pd.Series([sorted(set(p)) for p in own], dtype="object")})

    parts = checkpointed(items.select("q").mapInPandas(cut, "n int, terms array<binary>"))
    n, mean = parts.agg(F.count("*"), F.avg("n")).first()
    return n, mean or 0.0, parts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def mark_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", question_col: str = "text", answer_col: str | None = None, overlap: float = 0.8, answer_overlap: float = 0.8, width: int = 5, most_items: int = 20000) -> DataFrame:
    """All columns of ``docs`` plus contamination: array of struct(item_id, score, question_overlap, answer_overlap), in the order of item_id.

    Every passage of every text asks a BM25 index of the items' questions, long ones in pieces of 64 words. A piece is retrieved if its score
    reaches the least that a passage with ``overlap`` (over 0) of its ``width``-word shingles can have, and if the passage has one of the piece's
    rarest shingles, of which it can't lack all; so neither hides anything. What is retrieved is verified: ``overlap`` of the question's shingles must be in the text (those of a piece in one passage), and
    ``answer_overlap`` of the answer's words in a passage that holds a piece. score is the greatest of the pieces' there, over a piece's score for itself.

    Statistics are those of all items. An index holds about ``most_items`` items; with more items there are several, one
    after the other, each with a pass over the texts of its own, and results are the same for any number of them. Items without
    words are left out; shorter questions are one shingle; equal items are each found; equal scores need no order, as all
    that pass are returned. Null and empty texts hold none. A column named contamination is replaced.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(question_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    plain = docs.drop(*(["contamination"] if text_col != "contamination" else []))
    parts = max(1, -(-asked.count() // most_items))
    n, mean, df = item_statistics(asked, width)
    df = checkpointed(df) if parts > 1 else df

    def asker(part: int) -> tuple[Callable, object]:
        own = asked.where(F.pmod(F.xxhash64("i", "q"), F.lit(parts)) == part) if parts > 1 else asked
        rows = sorted(((r["i"], r["q"], r["a"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or ""))
        if parts > 1:
            words = spark.createDataFrame([(w,) for w in {w for r in rows for w in tokens(r[1])}], "term binary")
            known = {bytes(r["term"]): r["df"] for r in df.join(F.broadcast(words), "term").collect()}
        else:
            known = {bytes(r["term"]): r["df"] for r in df.collect()}
        index = spark.sparkContext.broadcast(ItemIndex(rows, (n, mean, known), width, overlap))
        return once(F.pandas_udf(_asker(index, answer_overlap), FOUND)), index

    if parts == 1:
        return plain.withColumn("contamination", asker(0)[0](F.col(text_col)))
    # What a text holds depends on nothing but the text, so findings go by two hashes of it.
    marks = [F.xxhash64(text_col).alias("_h"), F.xxhash64(F.col(text_col), F.lit(9)).alias("_k")]
    found = None
    for part in range(parts):
        ask, index = asker(part)
        here = checkpointed(docs.select(*marks, ask(F.col(text_col)).alias("_found")).where(F.size("_found") > 0).dropDuplicates(["_h", "_k"]))
        index.destroy()
        found = here if found is None else found.unionByName(here)
    found = checkpointed(found.groupBy("_h", "_k").agg(F.flatten(F.collect_list("_found")).alias("_found")))
    found = found.select(F.col("_h").alias("_h2"), F.col("_k").alias("_k2"), "_found")
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    joined = plain.select("*", *marks).join(found, (F.col("_h") == F.col("_h2")) & (F.col("_k") == F.col("_k2")), "left")
    return joined.select(*plain.columns, F.coalesce(F.array_sort("_found"), F.array().cast(FOUND)).alias("contamination"))


def _asker(index, answer_overlap: float):
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, f, strict=True)) for f in index.value.search(t, answer_overlap)] for t in texts], dtype="object")

    return ask


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of the items that documents hold."""
    marked = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode_outer("contamination").alias("x")).where("x is not null").select("doc_id", "x.*")
