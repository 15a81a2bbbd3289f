"""Sharding, mixing and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchment.llm import mixing, sharding

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def n_words(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def test_shards(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = sharding.op3_sharding(spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs.index) and set(got["shard"]) == set(range(8))
    assert (got["size"] == [len((docs.loc[i, "text"] or "").encode()) + 1 for i in got["doc_id"]]).all()
    assert (got["text_crc32"] == [zlib.crc32(docs.loc[i, "text"].encode()) for i in got["doc_id"]]).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum()
    assert (sizes.max() - sizes.min()) <= 2 * got["size"].max() + 0.01 * sizes.mean()
    assert (got.groupby("text_crc32")["shard"].nunique() > 1).sum() <= 7  # only a group at a boundary may be split
    again = sharding.op3_sharding(spark, SF).toPandas()
    assert set(map(tuple, again[["doc_id", "shard", "slot"]].to_numpy())) == set(map(tuple, got[["doc_id", "shard", "slot"]].to_numpy()))


@pytest.mark.parametrize("same", [0.0, 0.4, 1.0])
def test_one_text_may_hold_most_rows(spark, same):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < int(3000 * same), "the same text").otherwise(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = sharding.shard_by_bytes(docs, shards=5).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(sizes) == 5 and sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()


@pytest.mark.parametrize("ids", ["null", "same", "two"])
def test_equal_rows_are_parted(spark, ids):
    """Rows that nothing tells apart fall evenly on all shards, in several partitions too, and beside other texts."""
    doc_id = {"null": F.lit(None).cast("long"), "same": F.lit(7).cast("long"), "two": F.col("id") % 2}[ids]
    alike = spark.range(2000).select(doc_id.alias("doc_id"), F.lit("the same text").alias("text"), F.col("id").alias("own"))
    got = sharding.shard_by_bytes(alike).toPandas()
    assert sorted(got["own"]) == list(range(2000)) and got.groupby("shard").size().between(240, 260).all() and got["shard"].nunique() == 8
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") + 5000).alias("own"))
    both = sharding.shard_by_bytes(alike.repartition(7).unionByName(other), ranges_per_shard=5).toPandas()
    sizes = both.groupby("shard")["size"].sum()
    assert len(set(both["own"])) == 5000 == len(both) and sizes.max() < 1.02 * sizes.mean() and sizes.min() > 0.98 * sizes.mean()
    for found in (got, both):
        for _, own in found.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))


def test_many_ranges(spark, monkeypatch):
    """More ranges than bins in a round; small groups of equal texts stay whole at the shards' boundaries."""
    monkeypatch.setattr(sharding, "BINS", 64)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2((F.col("id") / 3).cast("int").cast("string"), 256)).alias("text"))
    got = sharding.shard_by_bytes(docs, shards=3, ranges_per_shard=500).toPandas()
    assert len(got) == 6000 and set(got["doc_id"]) == set(range(6000)) and set(got["shard"]) == {0, 1, 2}
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.02 * sizes.mean() and (got.groupby("text")["shard"].nunique() == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_shards_of_odd_rows(odd, clashing, empty):
    got = sharding.shard_by_bytes(odd).toPandas()
    assert len(got) == odd.count() and (got[got["text"].isna()]["size"] == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert sharding.shard_by_bytes(clashing).columns[-3:] == ["size", "shard", "slot"]
    assert sharding.shard_by_bytes(empty).count() == 0
    twice = odd.where("doc_id = 5")
    assert sharding.shard_by_bytes(twice).count() == 2


def plain_targets(sizes):
    """By the definition, for sources in order: shares of 150 % by weight, what is above twice the size reshared."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    full = {}
    while True:
        left = 1.5 * sum(sizes) - sum(full.values())
        free = [i for i in range(len(sizes)) if i not in full]
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            return [full.get(i, share.get(i)) for i in range(len(sizes))]
        full |= {i: 2 * sizes[i] for i in over}


def test_mixture(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = mixing.op5_mixing_sources(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs["doc_id"])
    docs["size"] = docs["text"].map(n_words)
    sizes = docs.groupby(docs["source"].fillna("\U0010ffff"))["size"].sum().sort_index()
    for (source, size), target in zip(sizes.items(), plain_targets(sizes.tolist()), strict=True):
        own = got.loc[docs[docs["source"].fillna("\U0010ffff") == source]["doc_id"]]
        assert (own["source_size"] == size).all() and np.allclose(own["target"], target)
        assert abs(own["taken"].sum() - target) <= 0.005 * target
        assert (own["taken"] <= 2 * own["size"]).all() and (own["taken"] % own["size"].where(own["size"] > 0, 1) == 0).all()
    again = mixing.op5_mixing_sources(spark, SF).toPandas().set_index("doc_id")
    assert (again["taken"].sort_index() == got["taken"].sort_index()).all()


def test_tree_meets_quotas():
    for quotas, leaves in (([5, 0, 17], 8), ([100, 3, 50], 7), ([0], 4), ([2], 3)):
        parts = mixing.splitting_tree(quotas, leaves, seed=1)
        assert np.sum(parts, axis=0).tolist() == quotas and len(parts) == leaves
        sums = np.sum(parts, axis=1)
        assert sums.max() - sums.min() <= leaves.bit_length()
    draws = np.array([mixing.splitting_tree([40, 20], 4, seed=s)[0] for s in range(300)])
    assert draws[:, 0].mean() == pytest.approx(10, abs=0.4) and draws[:, 0].std() == pytest.approx(np.sqrt(15 * (2 / 3) * (1 / 3) * (45 / 59)), rel=0.25)


def test_reruns_agree_whatever_the_partitions(spark):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for parts in ("3", "40", n):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows.append(sorted(map(tuple, mixing.op5_mixing_sources(spark, "/root/testdata/sf0.001").collect())))
    assert rows[0] == rows[1] == rows[2]


def plan_by_block(spark, docs, **how):
    planned = mixing.plan_mixture(docs, "source", "text", "doc_id", seed=5, **how)
    block = F.shiftright(mixing.positive_hash(F.col("doc_id"), F.col("text"), seed=5), 62 - 4)
    return planned.withColumn("block", block).select("doc_id", "source", "block", "draws").toPandas()


def test_the_tree_deals_the_blocks_out(spark, monkeypatch):
    """Every block's draws add up, by shard, to what the tree drew for its source; another tree gives other shards."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    own_tree, drawn = mixing.splitting_tree, []
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, s: drawn.append(own_tree(q, n, s)) or drawn[-1])
    got = plan_by_block(spark, docs, block_bits=4)
    blocks = got.groupby(["source", "block"])["draws"].max().reset_index()
    for i, source in enumerate(sorted(set(got["source"]))):
        to = [s for d in blocks[blocks["source"] == source]["draws"] for s in d]
        assert [to.count(s) for s in range(8)] == [leaf[i] for leaf in drawn[0]]
    # Within a round, the shards' blocks are disjoint: no block comes to a shard more often than there are rounds.
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, s: [list(q)] + [[0] * len(q)] * (n - 1))
    other = plan_by_block(spark, docs, block_bits=4)
    assert {s for d in other["draws"] for s in d} == {0}
    assert (other.set_index("doc_id")["draws"].map(len) == got.set_index("doc_id")["draws"].map(len)).all()


def test_mixture_rows_are_what_was_planned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = mixing.mix_sources(docs).toPandas()
    times = taken.groupby("doc_id").size()
    plan = mixing.op5_mixing_sources(spark, SF).toPandas().set_index("doc_id")
    some = plan[plan["size"] > 0]
    assert (some["taken"] == some["size"] * times.reindex(some.index).fillna(0)).all()
    assert taken["mix_shard"].between(0, 7).all()
    blocks = taken.groupby("mix_shard").size()
    assert blocks.min() > 0.7 * blocks.mean()


def test_mixture_by_shuffle_is_the_same(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, mixing.op5_mixing_sources(spark, "/root/testdata/sf0.001").collect()))
    a = rows()
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert rows() == a


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_long_text_leaves_no_target_unmet(spark, seed):
    docs = spark.createDataFrame([(i, f"w{i} " * (30_000 if i == 300 else 100), "a") for i in range(301)], "doc_id long, text string, source string")
    planned = mixing.plan_mixture(docs, "source", "text", "doc_id", share=0.5, seed=seed).select("size", "target", F.size("draws").alias("n")).toPandas()
    assert (planned["target"] == 30_000).all() and (planned["size"] * planned["n"]).sum() == 30_000


def test_rows_of_all_blocks_fill_what_blocks_leave(spark):
    """Most blocks are of texts too long to be taken; repeated rows are taken as often as they fit."""
    docs = spark.createDataFrame([(i, f"w{i} " * 5_000, "a") for i in range(40)] + [(100, "one two", "a")] * 300 + [(200 + i, f"few words {i}", "a") for i in range(300)], "doc_id long, text string, source string")
    planned = mixing.plan_mixture(docs, "source", "text", "doc_id", share=0.0035, block_bits=3, edge_blocks=1).select("size", "target", F.size("draws").alias("n")).toPandas()
    assert planned["target"][0] - (planned["size"] * planned["n"]).sum() < 2 and len(planned) == 640


def test_mixture_of_odd_rows(odd, clashing, empty, spark):
    planned = mixing.plan_mixture(odd, "source", "text", "doc_id").collect()
    assert len(planned) == odd.count()
    by = defaultdict(set)
    for r in planned:
        by[r.source].add((r.source_size, r.target))
        assert r.size == n_words(r.text) and len(r.draws) <= 2
    assert all(len(v) == 1 for v in by.values()) and None in by
    assert mixing.mix_sources(clashing).columns[-1] == "mix_shard" and mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(odd.where("text is null")).count() >= 0
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(one).count() in (1, 2)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = out.toPandas()
        if name != "shard":
            assert out.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    assert set(seen["near_dedup"]["doc_id"]) < set(seen["quality_rules"]["doc_id"])
    assert not seen["near_dedup"]["text"].duplicated().any()
    from parchment.llm import decontamination

    held = {r.doc_id for r in decontamination.op9_decontamination(spark, SF).collect()}
    assert set(seen["decontaminate"]["doc_id"]) == set(seen["near_dedup"]["doc_id"]) - held
    assert set(seen["mix"]["doc_id"]) <= set(seen["decontaminate"]["doc_id"]) and len(seen["shard"]) == len(seen["mix"])
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(seen["shard"])


def test_pipeline_of_an_empty_table(spark, empty):
    import corpus_pipeline

    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_of_odd_rows(spark, odd, clashing, empty, tmp_path):
    """Nulls, repeated rows, long texts and clashing names through every stage and through run; an empty table through run."""
    import os

    import corpus_pipeline

    for rows in (odd, clashing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "shard":
                assert out.columns == rows.columns
                if name == "decontaminate" and "contamination" in rows.columns:
                    out = out.withColumn("contamination", F.lit("mine"))
            else:
                assert out.columns[-3:] == ["size", "shard", "slot"] and set(rows.columns) <= set(out.columns)
            path = f"{tmp_path}/{len(rows.columns)}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        kept = docs.toPandas()
        assert len(kept) > 20 and kept["text"].notna().all() and (kept["text"].str.strip(SPACES) != "").all()
        assert kept.groupby("text").size().max() <= 2  # a mix takes a row twice at most
    for name, rows in (("odd", odd), ("empty", empty)):
        folder = tmp_path / name
        folder.mkdir()
        rows.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            os.symlink(f"{SF}/{other}.parquet", folder / f"{other}.parquet")
        got = corpus_pipeline.run(spark, str(folder))
        assert got.columns[-3:] == ["size", "shard", "slot"] and (got.count() > 20 if name == "odd" else got.count() == 0)
