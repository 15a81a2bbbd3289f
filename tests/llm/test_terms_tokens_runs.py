"""Divergence of sources, byte pair encoding, periodic runs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.llm import bpe, divergence, periodic

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Divergence


def plain_divergence(rows, least=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = {}, {}
    for lang, source, text in rows:
        terms = [t.translate(fold) for t in TERM.findall(text or "")]
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + (1_000_000_000 * (counts[t] + 2)) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, counts in sources.items():
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, k))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_divergence_of_all_documents(spark):
    got = rows_of(divergence.op11_source_divergence(spark, SF))
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(got) == len(set(got)) and set(got) == plain_divergence(docs[["lang", "source", "text"]].itertuples(index=False))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.OP11_SQL})").fetchall()) == set(got)


@pytest.mark.parametrize(("cells", "summed", "piece"), [(1 << 20, 1024, 4 << 20), (7, 1024, 50), (3, 1, 1)])
def test_divergence_of_odd_rows(spark, odd, odd_rows, clashing, empty, monkeypatch, cells, summed, piece):
    """Blocks of any size give the same, with one source that holds most rows."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SUMMED", summed)
    monkeypatch.setattr(divergence, "PIECE", piece)
    rng = random.Random(9)
    words = ["Ähre", "ähre", "Zoo", "zoo", "été", "a1b", "x-y", "日本", "the", "THE", "İx", "K"]
    more = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["en", "fr", None, ""]), rng.choice(["hot"] * 6 + ["a", "b", None, "", "Z", "é"]), 1) for i in range(300)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    want = plain_divergence([(r[2], r[3], r[1]) for r in [*odd_rows, *more]])
    got = rows_of(divergence.divergence(docs))
    assert len(got) == len(set(got)) and set(got) == want
    if piece > 50:
        assert set(rows_of(divergence.divergence(clashing))) == plain_divergence([(r[2], r[3], r[1]) for r in odd_rows])
        assert divergence.divergence(empty).count() == 0
        bare = spark.createDataFrame([(1, None, None, None, None), (2, "a", None, "x", 1)], odd.schema)
        assert set(rows_of(divergence.divergence(bare))) == {("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)}
        with pytest.raises(ValueError, match="groups"):
            divergence.divergence(docs, most_groups=3)


@given(st.lists(st.integers(0, 4 * 10**14), min_size=1, max_size=9), st.integers(1, 10**12))
def test_shares_are_exact(counts, kept):
    total = sum(counts) + 2 * kept
    got = divergence.shares(np.array(counts, np.int64), np.array(total, np.int64))
    assert got.tolist() == [1 + 10**9 * (c + 2) // total for c in counts]


# Byte pair encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_all_documents_as_the_library(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    got = bpe.op12_bpe(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index)
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        row = got.loc[i]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hexed(library.decode(ids, skip_special_tokens=False))


PARTS = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "  ", " \n\n x", "'ll", "'S", "aaaaaaaa", "\x85", "  ", "\x1c", "abcabcabcabc", "é́", "½Ⅷ٣"])), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=4))
def test_any_text_as_the_library(library, vocabulary, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [ids_of(x) for x in vocabulary.encode(texts)]
    assert got == want
    for text, ids in zip(texts, want, strict=True):
        assert vocabulary.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_decode_as_in_the_library(library, vocabulary, ids):
    assert vocabulary.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_every_character_as_the_library(library, vocabulary):
    """Each code point between letters, in one long text per plane of 4,096: classes of characters agree."""
    texts = ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 4096)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bad = [hex(4096 * k) for k, (a, b) in enumerate(zip(vocabulary.encode(texts), want, strict=True)) if ids_of(a) != b]
    assert not bad


def plain_bpe(symbols, ranks):
    """The lowest rank first, the leftmost of these first."""
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        _, i = min(found)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@pytest.mark.parametrize("few", [2, 24])
def test_merges_in_any_order_of_ranks(monkeypatch, few):
    """Vocabularies whose merges need later ones, so that a merge makes a pair of lower rank."""
    import json

    monkeypatch.setattr(bpe, "FEW", few)
    rng = random.Random(4)
    letters = bpe.byte_letters()
    for _ in range(60):
        tokens = list(letters)
        merges = []
        for _ in range(25):
            a, b = (rng.choice(["a", "b", "c", *tokens[256:]]) for _ in range(2))
            if (a, b) not in merges:
                merges.append((a, b))
                tokens += [a + b] * (a + b not in tokens)
        rng.shuffle(merges)
        raw = json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel"}}).encode()
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(20)]
        ranks = {p: i for i, p in enumerate(merges)}
        got = bpe.Vocabulary(raw).merged([p.encode() for p in pieces])
        assert [[tokens[i] for i in ids_of(ids)] for ids in got] == [plain_bpe(list(p), ranks) for p in pieces]


def test_small_parts_and_memory(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 5)
    monkeypatch.setattr(bpe, "FEW", 2)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "SHORT", 2)
    texts = ["the cat sat", "", None, "the cat sat on the mat", "x" * 5000, "日本語" * 50]
    assert [ids_of(x) for x in vocabulary.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_of_odd_rows(odd, clashing, empty, library):
    got = bpe.decode_ids(bpe.encode_texts(odd, PATH), PATH).toPandas()
    assert len(got) == odd.count() and (got["decoded"] == got["text"].fillna("")).all()
    assert [ids_of(x) for x in got["ids"]] == [library.encode(t, add_special_tokens=False).ids for t in got["text"].fillna("")]
    other = bpe.decode_ids(bpe.encode_texts(clashing.withColumns({"ids": F.lit(1), "decoded": F.lit(2)}), PATH), PATH)
    assert sorted(other.columns) == sorted([*clashing.columns, "ids", "decoded"]) and other.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.decode_ids(bpe.encode_texts(empty, PATH), PATH).count() == 0
    one = bpe.round_trip(clashing.withColumns({"ids": F.lit(1), "decoded": F.lit(2)}), PATH)
    assert sorted(one.columns) == sorted(other.columns) and one.where("decoded <> coalesce(text, '')").count() == 0
    assert sorted(map(bytes, got["ids"])) == sorted(bytes(r["ids"]) for r in bpe.round_trip(odd, PATH).collect())
    flat = bpe.encode_texts(odd, PATH).select(bpe.ids_array(F.col("ids")).alias("a"), "ids").collect()
    assert all(r["a"] == ids_of(r["ids"]) for r in flat)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
            bpe.Vocabulary(f.read())


# Periodic runs


def plain_runs(words, least=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70) | st.lists(st.sampled_from("abcd"), max_size=6).flatmap(lambda w: st.integers(1, 12).map(lambda k: w * k)), max_size=5), st.integers(2, 14))
def test_runs_by_comparing_all_periods(docs, least):
    got = periodic.runs_of([[w.encode() for w in d] for d in docs], least)
    assert [[tuple(r) for r in own.tolist()] for own in got] == [plain_runs(d, least) for d in docs]


def test_many_candidates_and_batches(monkeypatch):
    monkeypatch.setattr(periodic, "EXTENDED", 3)
    monkeypatch.setattr(periodic, "TOGETHER", 50)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b"] if i % 2 else ["a", "a", "a", "b"]) for _ in range(rng.randrange(120))).encode() for i in range(80)] + [None, b""]
    runs, short = periodic._searched(texts, 12)
    for text, own, kept in zip(texts, runs, short, strict=True):
        words = words_of((text or b"").decode())
        want = plain_runs(words)
        assert [tuple(r) for r in own.tolist()] == want and kept.decode() == plain_collapsed(words, want)


def test_runs_of_all_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    got = periodic.op13_periodic_runs(spark, SF).toPandas().set_index("doc_id").astype(object)
    assert sorted(got.index) == sorted(docs.index)
    seen = 0
    for i, text in docs.items():
        words = plain_planted(i, words_of(text))
        if len(words) > 1500:
            continue  # too slow to compare all periods here; batches of long texts are above
        runs = plain_runs(words)
        row = got.loc[i]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert row["n_runs"] == len(runs) and row["runs_sha256"] == hexed("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == hexed(plain_collapsed(words, runs))
        if best:
            seen += 1
            assert [row[c] for c in ("start", "length", "period", "exponent_milli")] == [*best, 1000 * best[1] // best[2]]
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
    assert seen > 10


def test_planting_and_odd_rows(spark, odd, odd_rows, clashing, empty):
    planted = odd.select("doc_id", "text", periodic.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    for r in planted:
        assert words_of(r["new"]) == (words_of(r["text"]) if r["doc_id"] is None else plain_planted(r["doc_id"], words_of(r["text"])))
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        words = words_of(r["text"])
        if len(words) < 3000:
            runs = plain_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == plain_collapsed(words, runs)
        else:
            assert not r["runs"] and r["collapsed"] == " ".join(words)
    other = periodic.periodic_runs(clashing.withColumns({"runs": F.lit(1), "collapsed": F.lit(2), "_found": F.lit(3)}))
    assert sorted(other.columns) == sorted([*clashing.columns, "runs", "collapsed"]) and other.count() == len(odd_rows)
    assert periodic.periodic_runs(empty).count() == 0
    long = spark.createDataFrame([(1, "x y z " * 30000), (2, "w " * 40000)], "doc_id long, text string")
    assert [[tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(long).orderBy("doc_id").collect()] == [[(0, 90000, 3)], [(0, 40000, 1)]]
