"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table, words_of
from .components import connected_components

BITS = 64


def _mixed(h: np.ndarray, view: int) -> np.ndarray:
    """Another hash for each hash; view 0 keeps it."""
    if view:
        h = h + np.uint64(view * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprints(text: str | None, width: int = 4, views: int = 1) -> list[int]:
    """The 64 majority bits of the XXH64 hashes (seed 42) of all ``width``-word shingles, as a signed number.

    Further ``views`` are fingerprints of other hashes of the same shingles. A-Z are lower-cased, nothing
    else. Texts of fewer words are one shingle; null or no word: 0.
    """
    words = words_of(text)
    if not words:
        return [0] * views
    words = [w.lower() for w in words]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64)
    out = []
    for view in range(views):
        votes = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 1 << 16):
            votes += np.unpackbits(_mixed(h[at : at + (1 << 16)], view).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprint(text: str | None, width: int = 4) -> int:
    return fingerprints(text, width)[0]


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def block_masks(blocks: int) -> list[int]:
    """The bits of each of ``blocks`` blocks. ``distance`` changed bits leave ``blocks - distance`` of them as they were."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph on ``values`` that joins what differs in ``distance`` bits at most."""
    left, ends = np.arange(len(values)), []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            node = queue.pop()
            near = np.bitwise_count(values[left] ^ values[node]) <= distance
            if near.any():
                new = left[near]
                left = left[~near]
                ends.append(np.stack([np.full(len(new), node), new]))
                queue.extend(new.tolist())
    both = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _forests(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links ``row, x, y`` of a spanning forest for each row of ``values``: as _forest, for many files of equally many fingerprints at once."""
    files, size = values.shape
    tree, found = np.tile(np.arange(size), (files, 1)), []
    for y in range(1, size):
        near = np.bitwise_count(values[:, :y] ^ values[:, y, None]) <= distance
        own = np.flatnonzero(near.any(axis=1))
        if not own.size:
            continue
        known = tree[own, :y]
        met = (known[:, :, None] == known[:, None, :]) & near[own, None, :]
        # One link to each tree that y meets, to the first near fingerprint of it; then they are one tree.
        row, x = np.nonzero(near[own] & (met.argmax(axis=2) == np.arange(y)))
        found.append(np.stack([own[row], x, np.full(len(row), y)]))
        tree[own, :y] = np.where(met.any(axis=2), y, known)
    row, x, y = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return row, x, y


def blocks_for(nodes: int, distance: int, in_file: float = 0.1) -> int:
    """The fewest blocks whose files hold ``in_file`` of ``nodes`` random fingerprints or fewer on average; any number finds the same links."""
    blocks = distance + 2
    while blocks < distance + 5 and nodes / 2.0 ** (BITS * (blocks - distance) / blocks) > in_file:
        blocks += 1
    return blocks


def _bits(families: list[tuple[int, ...]]) -> int:
    return max(1, (len(families) - 1).bit_length())


def _file_names(fp: Column, families: list[tuple[int, ...]], masks: list[int]) -> tuple[Column, list[str]]:
    """An array with a struct for each family, the file of ``fp`` and ``view`` in it, and the struct's fields.

    The bits of its blocks side by side, view and family make one long, which takes half the room of three columns where all are sent; where
    they don't fit, the blocks stay beside it.
    """
    width = max(sum(masks[i].bit_count() for i in c) for c in families)
    view = F.col("view").cast("long")
    small = width + _bits(families) <= 54
    files = []
    for k, c in enumerate(families):
        # Eight bits of a view at least; any view fits where the blocks stay apart.
        name = F.shiftleft(view, _bits(families)).bitwiseOR(F.lit(k).cast("long"))
        if not small:
            files.append(F.struct(name.alias("file"), fp.bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))).alias("block")))
            continue
        bits, at = F.lit(0).cast("long"), 0
        for i in c:
            n, low = masks[i].bit_count(), (masks[i] & -masks[i]).bit_length() - 1
            own = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            bits, at = bits.bitwiseOR(F.shiftleft(own, at)), at + n
        files.append(F.struct(F.shiftleft(F.shiftleft(view, width).bitwiseOR(bits), _bits(families)).bitwiseOR(F.lit(k).cast("long")).alias("file")))
    return F.array(*files), ["file"] if small else ["file", "block"]


def near_links(prints: DataFrame, distance: int = 4, blocks: int | None = None, few: int = 32, chunk: int = 1024) -> DataFrame:
    """Links ``a, b`` that connect whatever nodes have fingerprints of one view that differ in ``distance`` bits or fewer, directly or over others.

    ``prints`` has long columns ``node`` and ``fp`` and ``view``, distinct. Each fingerprint is filed under every
    union of ``blocks - distance`` blocks, so a close pair meets at least once; by default there are more blocks, and longer
    unions of them, the more fingerprints there are, so that files stay short. Files of up to ``few``
    fingerprints are one row each, and many of them are verified at once; a link counts in the first file
    that it shares. Larger files are dealt into chunks of about ``chunk``; every two chunks meet in a task of
    bounded size. Either way a file gives the links of a spanning forest only, one fewer than it has fingerprints
    at most (for large ones: than each two chunks have). So no file gives all its pairs, and no connection is lost.
    """
    blocks = blocks or blocks_for(prints.where("view = 0").count(), distance)
    masks = block_masks(blocks)
    families = list(combinations(range(blocks), blocks - distance))
    # Nodes of one fingerprint in a view are tied to the smallest of them, and that alone is filed.
    same = Window.partitionBy("view", "fp").orderBy("node")
    known = prints.select("node", "fp", "view", F.first("node").over(same).alias("low"))
    fp = F.col("fp")
    file, key = _file_names(fp, families, masks)
    filed = known.where("node = low").select("node", fp, F.explode(file).alias("f")).select("node", fp, *[F.col(f"f.{k}") for k in key])
    shared = filed.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n > 1")
    few_of = shared.where(F.col("n") <= few).groupBy(*key).agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"))
    # A pair is in the first of its files if no block before the last of the family's agrees but those of the family.
    others = np.array([sum(1 << i for i in range(c[-1]) if i not in c) for c in families], np.uint64)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family = (batch.column("file").to_numpy() & ((1 << _bits(families)) - 1)).astype(np.int64)
            starts = batch.column("nodes").offsets.to_numpy()[:-1] - batch.column("nodes").offsets[0].as_py()
            sizes = batch.column("nodes").value_lengths().to_numpy()
            nodes, fps = batch.column("nodes").flatten().to_numpy(), batch.column("fps").flatten().to_numpy().view(np.uint64)
            for size in np.unique(sizes):
                alike = np.flatnonzero(sizes == size)
                step = max(1, (1 << 20) // int(size) ** 2)
                for at in range(0, len(alike), step):
                    own = alike[at : at + step]
                    places = starts[own, None] + np.arange(size)
                    row, x, y = _forests(fps[places], distance)
                    x, y = places[row, x], places[row, y]
                    differ, agree = fps[x] ^ fps[y], np.zeros(len(x), np.uint64)
                    for i, mask in enumerate(masks):
                        agree |= (differ & np.uint64(mask) == 0).astype(np.uint64) << np.uint64(i)
                    first = agree & others[family[own[row]]] == 0
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[x[first]]), pa.array(nodes[y[first]])], names=["a", "b"])

    pairs = few_of.mapInArrow(tie, "a long, b long")

    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    many = shared.where(F.col("n") > few).select(*key, "node", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    many = many.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy("int64")
        x, y = _forest(pdf["fp"].to_numpy("int64").view(np.uint64), distance)
        return pd.DataFrame({"a": nodes[x], "b": nodes[y]})

    # Dealt out anew, as the pairs of a large file's chunks would stay in that file's task.
    chunks = many.repartition(*key, "i", "j").groupBy(*key, "i", "j").applyInPandas(verify, "a long, b long")
    ties = known.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return ties.union(pairs).union(chunks)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``id, fp, component`` for each row of ``docs``, by SimHash fingerprints that link at ``distance`` bits.

    component is the smallest id that can be reached over links, the row's own included. Rows with a
    null or empty text have fingerprint 0 and link like others; equal ids and repeated rows each keep
    a row; a null id is its own, and takes no part in the minimum unless all ids of its component are null.
    An empty table gives an empty result. Other columns are ignored.
    """
    marked = checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), F.pandas_udf(_fingerprints, T.LongType())(F.col(text_col)).alias("fp")))
    groups = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("low")))
    linked = connected_components(near_links(groups.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("view")), distance, blocks))
    lows = groups.join(linked.withColumnRenamed("node", "fp"), "fp")
    # Written before it is joined: then a component of very many fingerprints can be split among tasks.
    smallest = checkpointed(lows.groupBy("component").agg(F.min("low").alias("smallest")))
    found = lows.join(smallest, "component").select("fp", "smallest")
    labels = groups.join(found, "fp", "left").select("fp", F.coalesce("smallest", "low").alias("component"))
    return marked.join(labels, "fp").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, views: int = 8, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id, then the smallest hash of its text; a null id comes last.

    Documents are linked if the fingerprints of ``width``-word shingles differ in ``distance`` bits or
    fewer in any of ``views`` views. One fingerprint misses many copies with a few changed words, as
    its distance scatters by several bits; several views of short shingles find nearly all of them.
    A document is a row's id and text, so unlike texts of one id are documents of their own, and rows that
    repeat both are one, of which any stays. Texts without a word, null ones included, share fingerprint 0 and
    form one group. Other columns are carried along; an empty table gives an empty one.

    Groups are settled on ids and hashes; the texts move once, with repeated rows combined before.
    """

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprints(t, width, views) for t in texts], dtype="object")

    # No id equals the text of another; a null one, as a struct of null, equals itself.
    own = [F.struct(F.col(id_col).cast("string").alias("id")).alias("_near_doc"), F.xxhash64(text_col).alias("_near_hash")]
    marked = checkpointed(docs.select(*own, F.col(id_col).cast("long").alias("id"), F.pandas_udf(prints, "array<long>")(F.col(text_col)).alias("fps")))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_near_hash", "_near_doc"))
    groups = checkpointed(marked.groupBy("fps").agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id()))
    viewed = groups.select("node", F.posexplode("fps").alias("view", "fp")).distinct()
    linked = connected_components(near_links(viewed, distance, blocks))
    kept = groups.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first._near_doc").alias("_near_doc"), F.col("first._near_hash").alias("_near_hash"))
    taken = [c for c in docs.columns if c not in ("_near_doc", "_near_hash")]
    return docs.select(*taken, *own).dropDuplicates(["_near_doc", "_near_hash"]).join(kept, ["_near_doc", "_near_hash"], "left_semi").select(*taken)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
