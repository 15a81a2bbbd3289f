"""Sharding by histogram sort: probe the key space until splitters are exact enough, then exchange once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, positive_hash, table

KEY_BITS = 62
#: Bits by which a round of probes refines an interval of the key space at most, and how many bins come to the driver in a round, or two for each open boundary if that is more.
STEP, BINS = 6, 1 << 18


@dataclass
class _Bin:
    """Keys with this prefix: of h, or of k among the rows of one h."""

    h: int | None
    prefix: int
    bits: int
    bytes: int
    rows: int
    bytes_below: int = 0
    rows_below: int = 0
    low: tuple[int, int] = (0, 0)
    high: tuple[int, int] = (0, 0)
    targets: list[int] = field(default_factory=list)

    def start(self, after: int = 0) -> tuple[int, int]:
        key = (self.prefix + after) << (KEY_BITS - self.bits)
        return (key, 0) if self.h is None else (self.h, key)


def _counted(keyed: DataFrame, by: list[Column]) -> DataFrame:
    return keyed.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(F.struct("h", "k")).alias("low"), F.max(F.struct("h", "k")).alias("high"))


def _bins(rows: list, bits: int) -> list[_Bin]:
    return [_Bin(r["of"], r["bin"], bits, r["bytes"], r["rows"], low=tuple(r["low"]), high=tuple(r["high"])) for r in rows]


def find_splitters(keyed: DataFrame, parts: int, total: int, first: list[_Bin], tolerance: float, whole: float = 0.0) -> list[tuple[tuple[int, int, int], int, int]]:
    """For each of the ``parts - 1`` inner boundaries: its key (h, k, m), and the bytes and rows below it.

    ``keyed`` has h, k and size. A boundary is settled when the bytes below it are within
    ``tolerance`` of a part from the ideal, at the nearer side of its probes, or when only rows of one key, and so of one size, are left
    between these: then m of these rows lie below it (0 else). A boundary within the rows of one h moves to their nearer end if ``whole`` bytes or fewer
    lie between. Each round counts bytes and rows in at most 2^STEP bins for each open boundary, and in fewer where many
    boundaries are open, so what comes to the driver depends on ``parts`` alone.
    """
    allowed = tolerance * total / parts
    settled: dict[int, tuple[tuple[int, int, int], int, int]] = {}

    def place(bins: list[_Bin], targets: list[int], bytes_below: int, rows_below: int) -> list[_Bin]:
        """Gives each target to the bin that holds its boundary; settles what can be, and returns bins to refine."""
        bins.sort(key=lambda b: b.prefix)
        todo, at = [], 0
        for b in bins:
            b.bytes_below, b.rows_below = bytes_below, rows_below
            bytes_below, rows_below = bytes_below + b.bytes, rows_below + b.rows
            while at < len(targets) and (total * targets[at] / parts <= bytes_below or b is bins[-1]):
                b.targets.append(targets[at])
                at += 1
        for b in bins:
            for t in b.targets[:]:
                ideal = total * t / parts
                below, above = ideal - b.bytes_below, b.bytes_below + b.bytes - ideal
                one_h = b.h is None and b.low[0] == b.high[0]
                if min(below, above) <= (max(allowed, whole) if one_h else allowed):
                    end = above < below
                    settled[t] = ((*b.start(int(end)), 0), b.bytes_below + end * b.bytes, b.rows_below + end * b.rows)
                    b.targets.remove(t)
                elif b.low == b.high:
                    m = min(b.rows, max(0, round(below * b.rows / b.bytes)))
                    settled[t] = ((*b.low, m), b.bytes_below + m * b.bytes // b.rows, b.rows_below + m)
                    b.targets.remove(t)
            if b.targets:
                todo.append(b)
        return todo

    todo = place(first, list(range(1, parts)), 0, 0)
    spark = keyed.sparkSession
    while todo:
        step = min(STEP, max(1, (BINS // len(todo)).bit_length() - 1))
        asks: dict[tuple[bool, int], list[_Bin]] = {}
        # Where only one h is left, go on by k, in a new bin: the old one still says where its keys are.
        todo = [replace(b, h=b.low[0], prefix=0, bits=0) if b.h is None and b.low[0] == b.high[0] else b for b in todo]
        for b in todo:
            asks.setdefault((b.h is None, b.bits), []).append(b)
        counts = None
        for (by_h, bits), own in asks.items():
            fine = min(KEY_BITS, bits + step)
            prefix = lambda c, n: F.shiftright(F.col(c), KEY_BITS - n)
            if by_h:
                wanted = F.broadcast(spark.createDataFrame([(b.prefix,) for b in own], "prefix long"))
                found = _counted(keyed.join(wanted, prefix("h", bits) == F.col("prefix")), [F.lit(None).cast("long").alias("of"), prefix("h", fine).alias("bin")])
            else:
                wanted = F.broadcast(spark.createDataFrame([(b.h, b.prefix) for b in own], "of long, prefix long"))
                found = _counted(keyed.join(wanted, (F.col("h") == F.col("of")) & (prefix("k", bits) == F.col("prefix"))), [F.col("of"), prefix("k", fine).alias("bin")])
            found = found.withColumns({"coarse": F.lit(bits), "fine": F.lit(fine)})
            counts = found if counts is None else counts.unionByName(found)
        inner: dict[tuple, list] = {}
        for r in counts.collect():
            inner.setdefault((r["of"], r["coarse"], r["bin"] >> (r["fine"] - r["coarse"])), []).append(r)
        again = []
        for b in todo:
            again += place(_bins(inner[b.h, b.bits, b.prefix], min(KEY_BITS, b.bits + step)), b.targets, b.bytes_below, b.rows_below)
        todo = again
    return [settled[t] for t in range(1, parts)]


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds _m, a number from 0 for the rows of each key (_h, _k), without bringing the rows of a key together.

    Rows are written out, sorted within their partitions, so that places in a partition stay; what is counted is rows by key and partition.
    """
    own = checkpointed(rows.sortWithinPartitions("_h", "_k")).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = own.groupBy("_h", "_k", "_part").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy("_h", "_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_h", "_k", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return own.join(shift, ["_h", "_k", "_part"]).withColumn("_m", F.col("_place") + F.col("_shift")).select(*rows.columns, "_m")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int | None = None, tolerance: float = 0.002, whole: float = 0.005) -> DataFrame:
    """All columns of ``docs`` plus size, shard and slot: shards of nearly equal bytes, in the order of a hash of the text, then of the id.

    size is the UTF-8 bytes of the text plus 1 (null: 1). Equal texts lie next to each other,
    and only a group that a boundary falls into is split, by the hash of its ids, if its nearer end is further than a share ``whole`` of a shard. Each shard consists of
    ``ranges_per_shard`` ranges of the key (by default as many as make up the shuffle partitions),
    whose boundaries are found by counting; rows move once, into their range. slot numbers a shard's rows
    from 0 in key order; rows equal in text and id are in any order, and a boundary that falls among them parts them by their number
    (these rows are written out once more). Null ids are one id. An empty table
    gives an empty result; columns of ``docs`` with the new names are replaced.
    """
    spark = docs.sparkSession
    plain = docs.drop(*[c for c in ("size", "shard", "slot") if c not in (id_col, text_col)])
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    keys = {"h": positive_hash(F.col(text_col), seed=31), "k": positive_hash(F.col(id_col), seed=32), "size": size}
    keyed = checkpointed(docs.select(*[c.alias(n) for n, c in keys.items()]))
    per = ranges_per_shard or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    parts = shards * per
    bits = (parts - 1).bit_length() + min(STEP, max(1, (BINS // parts).bit_length() - 1))
    first = _bins(_counted(keyed, [F.lit(None).cast("long").alias("of"), F.shiftright("h", KEY_BITS - bits).alias("bin")]).collect(), bits)
    total = sum(b.bytes for b in first)
    splitters = find_splitters(keyed, parts, total, first, tolerance, whole * total / shards) if first else [((0, 0, 0), 0, 0)] * (parts - 1)

    # What a row needs to find its range: for its first-round bin, the splitters at or below the bin's start and those inside.
    keys_below = sorted(s[0] for s in splitters)
    lookup = []
    for b in first:
        at, end = bisect_right(keys_below, b.start()), bisect_left(keys_below, b.start(1))
        lookup.append((b.prefix, at, keys_below[at:end]))
    bounds = F.broadcast(spark.createDataFrame(lookup, "_bin long, _base int, _inside array<struct<h:long,k:long,m:long>>"))
    rows_below = [0, *(s[2] for s in splitters)]
    ranges = F.broadcast(spark.createDataFrame([(i, i // per, rows_below[i] - rows_below[i // per * per]) for i in range(parts)], "_range int, shard int, _offset long"))
    marked = plain.withColumns({"size": size, "_h": keys["h"], "_k": keys["k"]})
    if parted := sorted({key[:2] for key in keys_below if key[2]}):
        # As many keys at most as there are boundaries.
        among = F.broadcast(spark.createDataFrame([(*key, True) for key in parted], "_h long, _k long, _parted boolean"))
        known = marked.join(among, ["_h", "_k"], "left")
        alike = _ranked(known.where("_parted").select(*marked.columns))
        marked = known.where("_parted is null").select(*marked.columns, F.lit(0).cast("long").alias("_m")).unionByName(alike)
    else:
        marked = marked.withColumn("_m", F.lit(0).cast("long"))
    marked = marked.withColumn("_bin", F.shiftright("_h", KEY_BITS - bits)).join(bounds, "_bin")
    own = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"), F.col("_m").alias("m"))
    marked = marked.withColumn("_range", F.col("_base") + F.size(F.filter("_inside", lambda s: s <= own))).drop("_bin", "_base", "_inside")
    moved = marked.repartitionById(parts, F.col("_range"))
    order = Window.partitionBy("_range").orderBy("_h", "_k")
    placed = moved.withColumn("_n", F.row_number().over(order)).join(ranges, "_range")
    return placed.select(*plain.columns, "size", "shard", (F.col("_offset") + F.col("_n") - 1).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
