"""SimHash against brute force, and connected components."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import simhash
from parchment.llm.components import connected_components

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text, width=4):
    w = [lower(x) for x in words(text)]
    if not w:
        return 0
    width = min(width, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints, ids, near):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if near(prints[i], prints[j]):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[find(i)] += [ids[i]] if ids[i] is not None else []
    return [min(low[find(i)], default=None) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = smallest_reachable(prints, [r.doc_id for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    assert got == {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)}
    assert len({c for *_, c in got}) < len(rows)


def test_odd_rows(spark, odd, odd_rows, clashing):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    want = smallest_reachable(prints, [r[0] for r in odd_rows], lambda a, b: (a ^ b).bit_count() <= 4)
    expected = sorted((repr(r[0]), p, repr(c)) for r, p, c in zip(odd_rows, prints, want, strict=True))
    for docs in (odd, clashing):
        got = simhash.simhash_components(docs).collect()
        assert sorted((repr(r.id), r.fp & (2**64 - 1), repr(r.component)) for r in got) == expected


def sentence(rng, n):
    return " ".join(f"word{rng.randrange(3000)}" for _ in range(n))


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value - (1 << 64) if value >> 63 else value


def test_links_lose_no_connection(spark):
    """Chains, and a group of many values that share most of their blocks, with files split into small chunks."""
    rng = random.Random(1)
    values = {rng.getrandbits(63) for _ in range(60)}
    for start in list(values)[:12]:
        chain = start
        for step in (1, 4, 4, 3, 5):
            chain = flipped(rng, chain & (2**64 - 1), step)
            values.add(chain)
    centre = rng.getrandbits(63)
    values |= {flipped(rng, centre, rng.randrange(1, 6)) for _ in range(150)}
    values = sorted(values)
    unsigned = np.array(values, np.int64).view(np.uint64)
    want = smallest_reachable([int(v) for v in unsigned], values, lambda a, b: (a ^ b).bit_count() <= 4)
    prints = spark.createDataFrame([(v, v, 0) for v in values], "node long, fp long, view int")
    for few, chunk, blocks in ((32, 1024, None), (3, 8, 7), (3, 8, 6), (10**6, 8, 5)):
        found = {r.node: r.component for r in connected_components(simhash.near_links(prints, blocks=blocks, few=few, chunk=chunk)).collect()}
        assert [found.get(v, v) for v in values] == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.where("a is null")).count() == 0


def test_near_copies_go(spark):
    """Exact copies, and copies with one or two changed words, leave one document; others stay."""
    rng = random.Random(2)
    rows, groups = [], []
    for g in range(40):
        base = sentence(rng, 150).split(" ")
        own = [" ".join(base)] * 2
        for _ in range(3):
            w = list(base)
            w[rng.randrange(150)] = "changed"
            own.append(" ".join(w))
        groups.append([len(rows) + i for i in range(len(own))])
        rows += [(len(rows) + i, t) for i, t in enumerate(own)]
    alone = [(10_000 + i, sentence(rng, 100)) for i in range(200)]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert {i for i, _ in alone} <= kept
    left = [sum(i in kept for i in g) for g in groups]
    assert all(n >= 1 for n in left) and all(g[0] in kept for g in groups)
    assert sum(n == 1 for n in left) >= 38  # a view's distance scatters, so a few copies stay


def test_near_copies_of_odd_rows(spark, odd, clashing, empty):
    kept = sorted(repr(r.doc_id) for r in simhash.drop_near_copies(odd).collect())
    assert kept == sorted(["1", "4", "5", "7", "8", "9", *[str(100 + i) for i in range(60)]])
    assert simhash.drop_near_copies(clashing).columns == clashing.columns
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.simhash_components(empty).count() == 0


def test_unlike_texts_of_one_id_both_stay(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 100) for _ in range(3))
    kept = lambda rows: sorted((repr(r.doc_id), r.text) for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(1, a), (5, a), (5, b)]) == sorted([("1", a), ("5", b)])
    assert kept([(5, a), (5, b), (7, a), (9, b)]) == sorted([("5", a), ("5", b)])
    assert kept([(5, a), (5, a), (5, a)]) == [("5", a)]
    assert kept([(None, a), (None, a), (3, a), (None, b), (None, b), (None, c)]) == sorted([("3", a), ("None", b), ("None", c)])


def test_more_fingerprints_more_blocks():
    sizes = [simhash.blocks_for(n, 5) for n in (1, 10**6, 10**8, 10**10, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 7 and sizes[-1] > sizes[0]


@pytest.mark.parametrize("text,want", [("a", "a"), ("A  b\tc", "a b c"), ("É x", "É x")])
def test_short_texts_are_one_shingle(text, want):
    assert simhash.fingerprint(text) & (2**64 - 1) == xxhash.xxh64_intdigest(want.encode(), 42)


def test_views_differ():
    a = simhash.fingerprints("one two three four five", 2, 4)
    assert len(set(a)) == 4 and a[0] == simhash.fingerprint("one two three four five", 2)
    assert simhash.fingerprints(None, 2, 3) == [0, 0, 0]


def test_files_have_one_name(spark):
    """What is sent for a file is one number where the blocks fit, and equal fingerprints of a view are filed once; links stay whole either way."""
    from itertools import combinations

    from pyspark.sql import functions as F

    for blocks, columns in ((6, ["file"]), (9, ["file"]), (64, ["file", "block"])):
        masks = simhash.block_masks(blocks)
        families = list(combinations(range(blocks), blocks - (4 if blocks < 64 else 1)))
        values = [0, -1, 1 << 62, -(1 << 63), 12345678901234567, 12345678901234566]
        prints = spark.createDataFrame([(v, w) for v in values for w in (0, 7)], "fp long, view int")
        file, key = simhash._file_names(F.col("fp"), families, masks)
        assert key == columns
        rows = prints.select("fp", "view", F.posexplode(file).alias("family", "f")).collect()
        named = {(tuple(r.f), r.view, r.family, (r.fp & (1 << 64) - 1) & sum(masks[i] for i in families[r.family])) for r in rows}
        # One name for each view, family and block, and one of these for each name.
        assert len(named) == len({n[0] for n in named}) == len({n[1:] for n in named})
    prints = spark.createDataFrame([(5, 9, 0), (3, 9, 0), (8, 9, 0), (8, 77, 1), (1, 77, 1), (2, -5, 1)], "node long, fp long, view int")
    assert {tuple(sorted((r.a, r.b))) for r in simhash.near_links(prints).collect()} == {(3, 5), (3, 8), (1, 8)}


def test_small_files_give_forests(spark):
    """Thirty-two fingerprints that are all near each other, and differ in one block, have 31 links in a view, not 496."""
    alike = [(1 << i) | (1 << j) for i in range(9) for j in range(i)][:32]
    prints = [(100 * view + n, (v << shift) + (view << 60), view) for view, shift in enumerate((0, 1, 11)) for n, v in enumerate(alike)]
    links = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame(prints, "node long, fp long, view int")).collect()}
    assert len(links) <= 3 * 31 and {n for n, *_ in prints} == {n for link in links for n in link}
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert found == {n: 100 * view for n, _, view in prints}


@pytest.mark.parametrize("size", [2, 3, 9, 32])
def test_forests_of_many_files(size):
    rng = np.random.default_rng(size)
    values = rng.integers(0, 1 << 9, (300, size)).astype(np.uint64)
    row, x, y = simhash._forests(values, 2)
    for i, own in enumerate(values.tolist()):
        links = [(int(a), int(b)) for r, a, b in zip(row, x, y, strict=True) if r == i]
        assert all((own[a] ^ own[b]).bit_count() <= 2 and a < b for a, b in links)
        want = smallest_reachable(own, list(range(size)), lambda a, b: (a ^ b).bit_count() <= 2)
        assert len(links) == size - len(set(want))
        parent = list(range(size))
        for _ in range(size):
            for a, b in links:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert parent == want
