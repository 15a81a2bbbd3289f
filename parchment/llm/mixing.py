"""Mixing sources to target weights: exact block quotas, dealt out among output shards by a splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, positive_hash, table

WEIGHTS = (3.0, 1.0, 2.0)
#: So many blocks, of some 150 bytes each, are sent to all tasks; with more, rows and blocks are joined by a shuffle.
BROADCAST_BLOCKS = 100_000
#: Sources are planned on the driver, one row each.
MOST_SOURCES = 100_000


def target_sizes(sizes: Sequence[float], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight, none above ``most`` times its size; what exceeds that goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def splitting_tree(quotas: Sequence[int], leaves: int, seed: int) -> list[list[int]]:
    """How many blocks of each source each leaf gets, leaves being equally large to one block.

    Every inner node draws its left half's blocks without replacement, that is by the multivariate
    hypergeometric distribution; the quotas of the sources are met exactly.
    """
    rng = np.random.default_rng(seed)

    def split(own: np.ndarray, n: int) -> list[list[int]]:
        if n == 1:
            return [own.tolist()]
        left = n // 2
        total = int(own.sum())
        draw, rest, pool = np.zeros_like(own), total * left // n, total
        for i, here in enumerate(own.tolist()):
            pool -= here
            draw[i] = rng.hypergeometric(here, pool, rest) if rest and here and pool else min(rest, here)
            rest -= int(draw[i])
        return split(draw, left) + split(own - draw, n - left)

    return split(np.asarray(quotas, np.int64), leaves)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def filled(units: DataFrame, size: str, order: list[Column | str]) -> DataFrame:
    """``units`` with _got, how many of their _of pieces of ``size`` are taken, and with the _room that is left in their source.

    In every round, the units that still fit are taken from the front until one doesn't; rounds go on until nothing fits.
    """
    each = F.col(size)
    by_source = Window.partitionBy("_source").orderBy(*order)
    so_far, whole = by_source.rowsBetween(Window.unboundedPreceding, 0), by_source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = (F.col("_room") > 0) & (each <= F.col("_room")) & (F.col("_got") < F.col("_of"))
    while True:
        for _ in range(4):
            words = F.when(fits, (F.col("_of") - F.col("_got")) * each).otherwise(0)
            units = units.withColumn("_words", words).withColumn("_upto", F.sum("_words").over(so_far))
            room = F.floor((F.col("_room") - F.col("_upto") + F.col("_words")) / F.greatest(each, F.lit(1)))
            new = F.when(each == 0, F.col("_of") - F.col("_got")).otherwise(F.least(F.col("_of") - F.col("_got"), room))
            units = units.withColumn("_new", F.when(fits & (F.col("_upto") - F.col("_words") <= F.col("_room")), new).otherwise(0))
            units = units.withColumns({"_room": F.col("_room") - F.sum(F.col("_new") * each).over(whole), "_got": F.col("_got") + F.col("_new")}).drop("_words", "_upto", "_new")
        units = checkpointed(units)
        if units.where(fits).isEmpty():
            return units


def swapped(blocks: DataFrame, near: float = 0.002, rounds: int = 6) -> DataFrame:
    """``blocks`` after a taken one gave way to a larger one that was not, where a source is short of its target by a share above ``near``.

    Each round makes, for every such source, the one exchange that fills most of its room; a source of few long texts needs it.
    """
    for _ in range(rounds):
        short = (F.col("_room") > near * F.col("target")) & (F.col("_room") > 0)
        if blocks.where(short).isEmpty():
            break
        taken = F.col("_got") > 0
        marked = blocks.where(short).withColumn("_least", F.when(taken, F.col("words")).otherwise(F.col("words") - F.col("_room")))
        # The smallest taken block that leaves enough room for this one.
        above = Window.partitionBy("_source").orderBy(F.desc("_least"), F.desc(taken), "_block").rowsBetween(Window.unboundedPreceding, -1)
        paired = marked.withColumn("_out", F.last(F.when(taken, F.struct("words", "_block")), ignorenulls=True).over(above)).where(~taken)
        gain = F.col("words") - F.col("_out.words")
        best = paired.where(gain > 0).groupBy("_source").agg(F.max(F.struct(gain.alias("gain"), F.col("_block").alias("b"), F.col("_out._block").alias("a"))).alias("_best"))
        best = checkpointed(best)
        if best.isEmpty():
            break
        now = F.when(F.col("_block") == F.col("_best.b"), 1).when(F.col("_block") == F.col("_best.a"), 0).otherwise(F.col("_got")).cast("long")
        room = F.col("_room") - F.coalesce(F.col("_best.gain"), F.lit(0))
        blocks = checkpointed(blocks.join(F.broadcast(best), "_source", "left").withColumns({"_got": now, "_room": room}).drop("_best"))
    return blocks


def _some_of_equal_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _taken, true for _got of the rows of each key. As the rows of a key are equal, each partition has its share of them marked, and no task gets them all."""
    dealt = checkpointed(rows.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part", "_got").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    share = counts.withColumn("_share", F.col("_got") - F.coalesce(F.sum("_n").over(so_far), F.lit(0))).select(*keys, "_part", "_share")
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_block"))
    return dealt.join(share, [*keys, "_part"]).withColumn("_taken", nth <= F.col("_share")).drop("_part", "_share")


def plan_mixture(docs: DataFrame, source_col: str, text_col: str, id_col: str, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 5, block_bits: int = 12, edge_blocks: int = 16) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target and draws, an array of the shards that a row goes to.

    A source is cut into 2^block_bits blocks by a hash of its rows. It is taken as a whole as often as its
    target allows; for the rest all its blocks are gone through in a permuted order and those that still fit
    are taken, then single rows that still fit: from ``edge_blocks`` of the other blocks, then from twice as many, until
    no row of the source fits. Only one row per source and its quotas come to the driver, and more than
    MOST_SOURCES sources are refused. The plan depends on rows and parameters alone, not on how they are partitioned.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "draws"]
    plain = docs.drop(*[c for c in new if c not in (id_col, text_col, source_col)])
    # A source that is null differs from any text: structs of nulls can be joined on.
    source = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    mark = positive_hash(F.col(id_col), F.col(text_col), seed=seed)
    sized = plain.withColumns({"size": word_count(F.col(text_col)), "_source": source, "_mark": mark, "_block": F.shiftright(mark, 62 - block_bits)})
    blocks = checkpointed(sized.groupBy("_source", "_block").agg(F.sum("size").alias("words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")))

    sums = blocks.groupBy("_source").agg(F.sum("words").alias("words"), F.count("*").alias("blocks"))
    if sums.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums = sums.collect()
    sums = sorted(sums, key=lambda r: (r["_source"] == "-", r["_source"]))
    sizes = [r["words"] for r in sums]
    targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(sums))], share * sum(sizes), most)
    whole = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    quotas = F.broadcast(spark.createDataFrame([(r["_source"], s, t, w, t - w * s) for r, s, t, w in zip(sums, sizes, targets, whole, strict=True)], "_source string, source_size long, target double, _whole int, _rest double"))

    permuted = [F.xxhash64("_source", "_block", F.lit(seed)), "_block"]
    known = blocks.join(quotas, "_source").withColumns({"_room": F.floor("_rest"), "_of": F.lit(1).cast("long"), "_got": F.lit(0).cast("long")})
    known = swapped(filled(known, "words", permuted))
    # What remains is less than any block left: single rows that fit, from a few blocks first, then from twice as many.
    left = known.where("_got = 0").select("_source", "_block", "_room", "least", F.row_number().over(Window.partitionBy("_source").orderBy(*permuted)).alias("_nth"))
    rooms, picks, tried, more = None, None, 0, edge_blocks
    while True:
        here = left if rooms is None else left.drop("_room").join(F.broadcast(rooms), "_source")
        here = here.where((F.col("_nth") > tried) & (F.col("least") <= F.col("_room")))
        if here.isEmpty():
            break
        batch = here.where(F.col("_nth") <= tried + more).select("_source", "_block", "_room")
        slim = sized.select("_source", "_block", "_mark", "size").join(F.broadcast(batch) if more * len(sums) <= BROADCAST_BLOCKS else batch, ["_source", "_block"])
        units = slim.where((F.col("size") > 0) & (F.col("size") <= F.col("_room"))).groupBy("_source", "_block", "_mark", "size", "_room").agg(F.count("*").alias("_of")).withColumn("_got", F.lit(0).cast("long"))
        units = filled(units, "size", ["_mark", "size"])
        used = units.groupBy("_source").agg(F.min("_room").alias("_now"))
        before = left.groupBy("_source").agg(F.min("_room").alias("_room")) if rooms is None else rooms
        rooms = checkpointed(before.join(used, "_source", "left").select("_source", F.coalesce("_now", "_room").alias("_room")))
        taken = units.where("_got > 0").select("_source", "_block", "_mark", "size", "_of", "_got")
        picks = taken if picks is None else checkpointed(picks.unionByName(taken))
        tried, more = tried + more, 2 * more
    if picks is None:
        picks = spark.createDataFrame([], "_source string, _block long, _mark long, size long, _of long, _got long")
    n_picks, n_parts = picks.agg(F.count("*"), F.count_if(F.col("_got") < F.col("_of"))).first()
    edges = picks.select("_source", "_block", F.lit(2).alias("_edge")).distinct()
    known = known.drop("_room").join(edges, ["_source", "_block"], "left").withColumn("_state", F.when(F.col("_got") > 0, 1).otherwise(F.coalesce("_edge", F.lit(0))))
    known = known.withColumn("_n", F.col("_whole") + F.least(F.col("_state"), F.lit(1)))
    known = checkpointed(known)

    drawn = {r["_source"]: r["n"] for r in known.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    leaves = splitting_tree([drawn[r["_source"]] for r in sums], shards, seed) if sums else []
    ends = [(r["_source"], np.cumsum([leaf[i] for leaf in leaves]).tolist()) for i, r in enumerate(sums)]
    ends = F.broadcast(spark.createDataFrame(ends, "_source string, _ends array<long>"))
    # Every round takes each block once, in an order of its own; a shard draws the blocks from where the shard before ended.
    copies = known.where("_n > 0").select("_source", "_block", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_turn")).join(ends, "_source")
    in_turn = Window.partitionBy("_source").orderBy("_turn", F.xxhash64("_block", "_source", "_turn", F.lit(seed + 1)), "_block")
    copies = copies.withColumn("_at", F.row_number().over(in_turn)).withColumn("_shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))))
    dealt = copies.groupBy("_source", "_block").agg(F.array_sort(F.collect_list(F.struct("_turn", "_shard"))).alias("_dealt"))
    known = known.join(dealt, ["_source", "_block"], "left")
    to = F.coalesce(F.transform("_dealt", lambda x: x["_shard"]), F.array().cast("array<int>"))
    known = checkpointed(known.select("_source", "_block", "source_size", "target", "_state", "_whole", to.alias("_to")))

    # Few blocks come to the rows, so the texts needn't move for them.
    known = F.broadcast(known) if sum(r["blocks"] for r in sums) <= BROADCAST_BLOCKS else known
    rows = sized.join(known, ["_source", "_block"])
    inner = rows.where(F.col("_state") != 2).withColumn("_taken", F.col("_state") == 1)
    # Blocks of which single rows are taken; of equal rows, any.
    picks = picks.select("_source", "_mark", "size", "_of", "_got")
    edge = rows.where(F.col("_state") == 2).join(F.broadcast(picks) if n_picks <= BROADCAST_BLOCKS else picks, ["_source", "_mark", "size"], "left")
    part = F.coalesce(F.col("_got") < F.col("_of"), F.lit(False))
    edge_all = edge.where(~part).withColumn("_taken", F.col("_got").isNotNull()) if n_parts else edge.withColumn("_taken", F.col("_got").isNotNull())
    if n_parts:
        edge_all = edge_all.unionByName(_some_of_equal_rows(edge.where(part), ["_source", "_mark", "size"]))
    times = F.col("_whole") + F.when(F.col("_taken"), 1).otherwise(0)
    return inner.unionByName(edge_all.drop("_of", "_got")).select(*plain.columns, "size", "source_size", "target", F.slice("_to", F.lit(1), times).alias("draws"))


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The mixture: a row for each time that a row of ``docs`` is taken, with its output shard in ``mix_shard``.

    Sources weigh ``weights`` in the order of their code points, null last, and share ``share``
    times all words; none takes more than ``most`` times its words, so no row comes more than twice by
    default. Within a shard, rows are shuffled by a seeded hash. Rows without words are taken as
    their block is. Equal rows may be told apart by nothing, and any of them may be taken; reruns
    give equal rows. An empty table gives an empty mixture.
    """
    shards = how.get("shards", 8)
    planned = plan_mixture(docs, source_col, text_col, id_col, **how)
    columns = [c for c in planned.columns if c not in ("size", "source_size", "target", "draws", "mix_shard")]
    taken = planned.select(*columns, F.posexplode("draws").alias("_turn", "mix_shard"))
    local = F.xxhash64(F.col(id_col), F.col(text_col), "_turn", F.lit(how.get("seed", 5)))
    per = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    # Each part of a shard has a partition to itself; by a hash of the parts, some would share one.
    part = F.col("mix_shard") * per + F.pmod(F.col("_order"), F.lit(per)).cast("int")
    dealt = taken.withColumn("_order", local).repartitionById(shards * per, part)
    return dealt.sortWithinPartitions("mix_shard", "_order").select(*columns, "mix_shard")


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents, and the output shards that take them, joined by commas."""
    planned = plan_mixture(table(spark, sf_dir, "documents"), "source", "text", "doc_id")
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.array_join("draws", ",").alias("shards"))
