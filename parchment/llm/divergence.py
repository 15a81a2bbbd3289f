"""Audit of sources: how far each source's terms are from the other sources of its language, and from the language as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Shares are whole numbers of this part; a term counts twice more often than it occurs.
SCALE, EXTRA = 1_000_000_000, 2
LEAST_DOCS, TOP_TERMS = 10, 10
#: Bytes of text that are counted together, cells of a dense block of counts, and sources up to which a task keeps sums of all pairs.
PIECE, CELLS, SUMMED = 4 << 20, 1 << 20, 1024
#: What is no letter of ASCII ends a term, what is beyond ASCII belongs to it; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def encoded(terms: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms in UTF-8 order, and each term's place among them."""
    words = pa.array(terms, pa.binary()).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return words.dictionary.take(order), place[words.indices.to_numpy()]


def _counted(langs: list[str], sources: list[str], texts: list[bytes | None]) -> pa.RecordBatch:
    """Occurrences and documents of each term in each group of some documents."""
    groups: dict[tuple[str, str], int] = {}
    own = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, sources, strict=True)], np.int64)
    found = [terms_of(t) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    terms, ids = encoded([t for f in found for t in f])
    v, doc = max(1, len(terms)), np.repeat(np.arange(len(texts)), sizes)
    once = np.unique(doc * v + ids)
    by_term, by_doc = own[doc], own[once // v]
    # Rows of a group lie together, so that each group is a slice.
    order, order_once = np.argsort(by_term, kind="stable"), np.argsort(by_doc, kind="stable")
    ends, ends_once = (np.searchsorted(a, np.arange(len(groups) + 1)) for a in (by_term[order], by_doc[order_once]))
    out: list[tuple[np.ndarray, ...]] = []
    for g in range(len(groups)):
        n = np.bincount(ids[order[ends[g] : ends[g + 1]]], minlength=v)
        docs = np.bincount(once[order_once[ends_once[g] : ends_once[g + 1]]] % v, minlength=v)
        at = np.flatnonzero(n)
        out.append((np.full(len(at), g), at, n[at], docs[at]))
    g, at, n, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ())))
    keys = list(groups)
    lang, source = (pa.array([k[i] for k in keys], pa.string()).take(pa.array(g, pa.int64())) for i in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(at, pa.int64())).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()) if batch.num_rows else pa.array([], pa.binary())
        piece = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield _counted(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), texts[a:b].to_pylist())


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact by long division in steps of a thousand for totals below 9e15."""
    rest, out = counts + EXTRA, np.zeros(np.broadcast_shapes(counts.shape, np.shape(total)), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Comparison:
    """What the rows of one task say about each pair of sources and about the sources' own terms, dense block by block.

    ``groups``: for each language its sources in order, the sums of their kept terms, and the number of kept terms.
    """

    def __init__(self, groups: dict[str, tuple[list[str], np.ndarray, int]]):
        self.groups, self.sums = groups, {}

    def block(self, lang: str, sources: list[str], terms: list[bytes], n: np.ndarray) -> Iterator[tuple[str, str, str, str, int]]:
        names, totals, kept = self.groups[lang]
        place = {s: i for i, s in enumerate(names)}
        words, ids = encoded(terms)
        counts = np.zeros((len(names), len(words)), np.int64)
        counts[np.fromiter((place[s] for s in sources), np.int64, len(sources)), ids] = n
        p = shares(counts, (totals + 2 * kept)[:, None])
        q = shares(counts.sum(axis=0), totals.sum() + 2 * kept)
        total = self.sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64)) if len(names) <= SUMMED else None
        for a, name in enumerate(names):
            value = gaps(p[a], q)
            at = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            for i in at[np.lexsort((at, -value[at]))[:TOP_TERMS]]:
                yield lang, name, "term", words[int(i)].as_py().decode(), int(value[i])
            near = gaps(p[a], p[a + 1 :]).sum(axis=1)
            if total is not None:
                total[a, a + 1 :] += near
            else:
                yield from self._pairs(lang, names, a, near)

    def _pairs(self, lang, names, a, near) -> Iterator[tuple[str, str, str, str, int]]:
        for b, value in enumerate(near.tolist(), a + 1):
            yield lang, names[a], "pair", names[b], value
            yield lang, names[b], "pair", names[a], value

    def rest(self) -> Iterator[tuple[str, str, str, str, int]]:
        for lang, total in self.sums.items():
            names = self.groups[lang][0]
            for a in range(len(names)):
                yield from self._pairs(lang, names, a, total[a, a + 1 :])


def _batches_of(rows: Iterator[tuple], names: list[str], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*some, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == len(names) - 1 else pa.string()) for i, c in enumerate(columns)], names)

    for row in rows:
        some.append(row)
        if len(some) >= size:
            yield packed()
            some.clear()
    if some:
        yield packed()


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences) and first (1 in one row of each kept term, else 0) of the terms in ``least_docs`` documents of their language.

    Tasks count their own texts before anything moves, so a source that holds a third of all rows moves as few counts as any other.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    counted = plain.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    sums = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term's rows are as many as its language has sources.
    own = Window.partitionBy("lang", "term")
    marked = sums.withColumns({"all_docs": F.sum("docs").over(own), "nth": F.row_number().over(own.orderBy("source"))})
    return marked.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", (F.col("nth") == 1).cast("long").alias("first"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most_groups: int = 20_000) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language (part ``pair``), and each source's own terms (``term``).

    Kept terms, sorted and cut into ranges, are numbered within their range; a task sees the counts of a range as one
    vector per source. The groups' names and sums, ``most_groups`` of them at most (more: ValueError), are known to all tasks,
    since the result has a row for each pair of them. Null text, lang and source count as empty; texts without a term still
    make their group appear; every row counts as a document of its own, repeated rows and ids too; an empty table gives
    no rows. Other columns are not looked at. Equal values rank by item. A lone source of a language has no pairs.
    """
    spark = docs.sparkSession
    kept = checkpointed(kept_counts(docs, text_col, lang_col, source_col, least_docs))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    present = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    rows = present.join(totals, ["lang", "source"], "left").limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"over {most_groups} groups of language and source")
    of: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"].encode(), r["source"].encode())):
        of.setdefault(r["lang"], []).append(r)
    groups = {x: ([r["source"] for r in own], np.array([r["total"] or 0 for r in own], np.int64), sum(r["firsts"] or 0 for r in own)) for x, own in of.items()}
    known = spark.sparkContext.broadcast(groups)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Comparison(known.value)

        def found() -> Iterator[tuple]:
            lang, some = None, ([], [], [])
            for batch in batches:
                langs, terms = batch.column(0), batch.column(2).cast(pa.binary()).to_pylist()
                names, n = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                for i, x in enumerate(langs.to_pylist()):
                    most = CELLS // len(known.value[x][0]) if x != lang or not some[1] else most
                    # A block ends between terms, when a vector of all sources has enough cells.
                    if some[1] and (x != lang or (terms[i] != some[1][-1] and distinct >= max(1, most))):
                        yield from task.block(lang, some[0], some[1], np.array(some[2], np.int64))
                        some, distinct = ([], [], []), 0
                    distinct = (0 if not some[1] else distinct) + (not some[1] or terms[i] != some[1][-1])
                    lang = x
                    for column, value in zip(some, (names[i], terms[i], n[i]), strict=True):
                        column.append(value)
            if some[1]:
                yield from task.block(lang, some[0], some[1], np.array(some[2], np.int64))
            yield from task.rest()

        yield from _batches_of(found(), ["lang", "source", "part", "item", "value"])

    schema = "lang string, source string, part string, item string, value long"
    ranged = kept.select("lang", "source", "term", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    parts = ranged.mapInArrow(compare, schema)
    # Languages without a kept term have no vectors; their pairs don't differ.
    bare = [(x, s) for x, (names, _, v) in groups.items() if not v for s in names]
    alone = spark.createDataFrame(bare, "lang string, source string")
    flat = alone.join(alone.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = parts.unionByName(flat).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARE = "1 + ({n}::HUGEINT + 2) * 1000000000 // ({total}::HUGEINT + 2 * v)"
OP11_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_UPPER.lower()}') AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(c.n)::BIGINT AS total FROM c JOIN kept USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ({_SHARE.format(n="coalesce(c.n, 0)", total="coalesce(own.total, 0)")})::BIGINT AS p, ({_SHARE.format(n="k.n", total="s.total")})::BIGINT AS q
  FROM g JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN own USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
