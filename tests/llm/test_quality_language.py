"""Quality rules, quality classifier and language identification: counts by brute force, models by held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parchment.llm import language_id, quality_classifier, quality_rules, word_features

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_counts(text):
    w = words(text)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)]


@pytest.fixture(scope="module")
def tables():
    return {n: pd.read_parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def test_rule_counts_equal_brute_force(spark, tables):
    got = quality_rules.op2_quality_rules(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(tables["documents"])
    for r in tables["documents"].itertuples():
        want = plain_counts(r.text)
        own = got.loc[r.doc_id]
        assert [own[c] for c in quality_rules.COUNTS] == want
        assert own["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (own["base_failed"] and own["kept"])


def test_rules_keep_good_documents(spark, tables):
    got = quality_rules.op2_quality_rules(spark, SF).toPandas().merge(tables["labels"], on="doc_id")
    own = got[~got["base_failed"]]
    good, bad = own[own["quality"] == 1]["kept"].mean(), own[own["quality"] == 0]["kept"].mean()
    assert good > 0.95 and (np.isnan(bad) or bad < 0.2)


def test_text_counts_of_odd_texts():
    for t in (None, "", " \n", "a", "a b", "a b c a b c", "x\n\nx\n x\nx", "日本 語 日本 語 日本", "a b a b a b a", "#\t*$\n<>%&|"):
        assert quality_rules.text_counts(t)[0] == plain_counts(t), t


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (300, 3)), [[9, 9, 9]]])
    score = quality_rules.Forest(rows).score(rows)
    assert score.argmax() == 300 and 0 < score.min() and score.max() < 1


def plain_path(tree, row):
    """Follows one row down one tree."""
    column, cut, left, length = tree
    at = 0
    while column[at] >= 0:
        at = left[at] + int(row[column[at]] >= cut[at])
    return length[at]


def expected_length(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def test_scores_by_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 2))
    forest = quality_rules.Forest(rows, trees=7, size=16)
    want = [2 ** (-np.mean([plain_path(t, r) for t in forest.trees]) / expected_length(16)) for r in rows]
    assert np.allclose(forest.score(rows), want)
    # A leaf's length is its depth, plus the mean path among the rows that it still holds.
    column, cut, left, length = forest._grow(rows[:16], np.random.default_rng(1))
    own = {0: (np.arange(16), 0)}
    for at in range(len(column)):
        held, depth = own[at]
        if column[at] < 0:
            assert np.isclose(length[at], depth + expected_length(len(held)))
        else:
            below = rows[held, column[at]] < cut[at]
            own[left[at]], own[left[at] + 1] = (held[below], depth + 1), (held[~below], depth + 1)


def test_threshold_by_brute_force():
    rng = np.random.default_rng(4)
    for most in (0.0, 0.05, 0.5):
        scores, good = np.round(rng.random(60), 2), rng.random(60) < 0.7
        scores[~good] += 0.2
        gain = lambda t: (scores[~good] > t).mean() - (scores[good] > t).mean()  # noqa: B023, E731
        best = max((t for t in set(scores) if (scores[good] > t).mean() <= most), key=lambda t: (round(gain(t), 9), t))
        assert quality_rules.calibrate(scores, good, most) == best
    assert quality_rules.calibrate(np.array([0.1, 0.5, 0.9]), np.array([True, True, False]), 0.0) == 0.5
    assert quality_rules.calibrate(np.array([0.1]), np.array([False]), 0.0) == 1.0


def test_no_single_rule_gives_the_verdicts(tables):
    """The forest's verdicts aren't those of a range of any one statistic."""
    m = tables["documents"].merge(tables["labels"], on="doc_id")
    stats = np.array([quality_rules.text_counts(t)[1] for t in m["text"]])
    good = (m["quality"] == 1).to_numpy()
    forest = quality_rules.Forest(stats)
    out = forest.score(stats) > quality_rules.calibrate(forest.score(stats), good, 0.03)
    assert out[~good].mean() > 0.9 and out[good].mean() <= 0.03
    for x in stats.T:
        agree = [((x > a) | (x < b)) == out for a in np.quantile(x, np.linspace(0.8, 1, 21)) for b in np.quantile(x, np.linspace(0, 0.2, 21))]
        assert max(np.mean(agree, axis=1)) < 0.995


def test_samples_are_bounded_in_rows(spark):
    """One id with very many rows, of unlike and of equal texts, brings no more rows than were asked for."""
    from parchment.llm.common import bounded_sample, labelled_sample

    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    known = docs.select("doc_id").distinct().withColumn("y", F.lit(1))
    assert labelled_sample(docs, known, 100, "doc_id", "text", seed=1).count() == 100
    assert labelled_sample(docs, known.where("doc_id = 7"), 100, "doc_id", "text", seed=1).count() <= 100
    assert bounded_sample(docs, 10**6, "doc_id", "text", seed=1).count() == 2501
    assert bounded_sample(docs.where("false"), 10, "doc_id", "text", seed=1).count() == 0
    many = docs.select("doc_id", F.concat(F.lit("some words "), "text").alias("text"), F.lit("en").alias("lang"))
    assert language_id.fit_centroids(many, "doc_id", "text", "lang", per_language=50)["langs"] == ["en"]


def test_rules_on_odd_rows(odd, clashing, empty, labels):
    got = quality_rules.quality_verdicts(odd, labels).collect()
    assert len(got) == odd.count() and all(not r.kept for r in got if r.text is None or not words(r.text))
    assert all(r.n_words == 20000 for r in got if r.doc_id == 4)
    assert "id" in quality_rules.quality_verdicts(clashing, labels).columns
    assert quality_rules.quality_verdicts(empty, labels).count() == 0
    nothing = quality_rules.quality_verdicts(odd, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) for r in nothing)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(y, s):
    order = s.rank()
    pos = (y == 1).sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_classifier_on_held_out_rows(spark, tables):
    got = quality_classifier.op4_quality_classifier(spark, SF).toPandas()
    assert len(got) == len(tables["documents"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: fold(i, 5) == 0)).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]].merge(tables["labels"], on="doc_id")
    assert auc(held["quality"], held["score"]) > 0.85
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_classifier_never_sees_held_out_labels(odd, labels):
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality_classifier.quality_scores(odd, x).collect()} for x in (labels, turned))
    assert a == b


def test_classifier_on_odd_rows(odd, clashing, empty, labels):
    got = quality_classifier.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert quality_classifier.quality_scores(clashing, labels).count() == odd.count()
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.where("false")).collect()} == {0.5}


def test_leader_learns_a_separable_rule():
    leader = quality_classifier.Leader(np.zeros(4), np.zeros(4))
    for _ in range(200):
        leader.learn(np.array([0, 1]), np.ones(2), 1)
        leader.learn(np.array([0, 2]), np.ones(2), 0)
    w = leader.weights()
    assert w[1] > 0 > w[2] and w[3] == 0


def plain_training(rows, bits, shards, rounds, shard_of):
    """FTRL by its definition in dictionaries: in each round every shard goes on from the mean state of the last."""
    import math

    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.5
    state = {}
    passes = min(20, -(-10000 // len(rows)))
    for number in range(rounds):
        ends = []
        for shard in range(shards):
            own = sorted((r for r in rows if shard_of[r[0]] == shard), key=lambda r: (r[0], r[2]))
            if not own:
                continue
            z, n = {k: v[0] for k, v in state.items()}, {k: v[1] for k, v in state.items()}
            order, touched = np.random.default_rng(number), set()
            for i in np.concatenate([order.permutation(len(own)) for _ in range(passes)]):
                at, x = word_features.hashed_ngrams(own[i][1], bits)
                x = x.astype("float32").astype(float)
                w = {}
                for k in at.tolist():
                    zk, nk = z.get(k, 0.0), n.get(k, 0.0)
                    w[k] = 0.0 if abs(zk) <= l1 else (math.copysign(l1, zk) - zk) / ((beta + math.sqrt(nk)) / alpha + l2)
                p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in zip(at.tolist(), x, strict=True))))))
                for k, v in zip(at.tolist(), x, strict=True):
                    g = (p - own[i][2]) * v
                    nk = n.get(k, 0.0)
                    z[k] = z.get(k, 0.0) + g - (math.sqrt(nk + g * g) - math.sqrt(nk)) / alpha * w[k]
                    n[k] = nk + g * g
                    touched.add(k)
            ends.append({k: (z[k], n[k]) for k in touched})
        for k in {k for e in ends for k in e}:
            own = [e[k] for e in ends if k in e]
            state[k] = (sum(o[0] for o in own) / len(own), sum(o[1] for o in own) / len(own))
    return {k: 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((beta + math.sqrt(n)) / alpha + l2) for k, (z, n) in state.items()}


def test_training_and_scores_by_brute_force(spark):
    rows = [(i, f"good words number {i} here" if i % 3 else f"bad {i} bad ## {i}", int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    from parchment.llm.common import positive_hash

    shard_of = {r.doc_id: r.s for r in df.select("doc_id", (positive_hash(F.col("doc_id"), seed=11) % 3).alias("s")).collect()}
    got = quality_classifier.train(df, shards=3, rounds=2, bits=10)
    want = plain_training(rows, 10, 3, 2, shard_of)
    assert np.allclose(got, [want.get(k, 0.0) for k in range(1 << 10)], atol=1e-5) and np.abs(got).max() > 0.1
    scores = df.select("text", quality_classifier.score_texts(F.col("text"), got, spark, 10).alias("s")).collect()
    for r in scores:
        at, x = word_features.hashed_ngrams(r.text, 10)
        assert r.s == pytest.approx(1 / (1 + np.exp(-sum(float(got[k]) * v for k, v in zip(at, x, strict=True)))), abs=1e-6)


def test_hashed_ngrams():
    at, x = word_features.hashed_ngrams("The  the\tDOG", 12)
    assert at[0] == 0 and x[0] == 1 and np.linalg.norm(x[1:]) <= 1 + 1e-9
    assert word_features.hashed_ngrams(None, 12)[0].tolist() == [0]
    a, b = (word_features.hashed_ngrams("x y " * n, 12) for n in (3, 3))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    long_ = word_features.hashed_ngrams("some words " * 100_000, 12)
    assert np.isfinite(long_[1]).all()


def test_language_on_held_out_rows(spark, tables):
    got = language_id.op10_language_id(spark, SF).toPandas().merge(tables["documents"], on="doc_id")
    assert len(got) == len(tables["documents"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: fold(i, 4) == 2)).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert set(got["lang_pred"]) <= set(tables["documents"]["lang"].dropna()) | {"und"}


def test_language_by_brute_force(spark):
    """TF-IDF, spherical means and cosines by their definitions, with n-grams hashed as documented."""
    rng = np.random.default_rng(5)
    words = {"aa": ["abra", "cad", "abca", "dabra"], "bb": ["zyx", "wvu", "xyzzy", "vux"]}
    rows = [(i, " ".join(rng.choice(words[x], 12)), x) for i in range(80) for x in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {t: language_id.ngram_counts(t) for _, t, _ in rows}
    hashed = lambda g: ((lambda m: ((m ^ (m >> 31)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 40)(g * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % language_id.DIMS
    text = f" {rows[0][1]} "
    plain = np.zeros(language_id.DIMS)
    for k in (1, 2, 3):
        for at in range(len(text) - k + 1):
            gram = text[at : at + k]
            if gram != " ":
                code = 0
                for c in gram:
                    code = (code * 0x110000 + ord(c)) & (1 << 64) - 1
                plain[hashed(code + k - 1)] += 1
    assert np.array_equal(plain, counts[rows[0][1]])
    model = language_id.fit_centroids(docs, "doc_id", "text", "lang", per_language=100, clusters=1)
    every = np.array([counts[t] for _, t, _ in rows])
    idf = np.log((1 + 80) / (1 + (every > 0).sum(axis=0))) + 0.05
    unit = np.log1p(every) * idf
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.allclose(model["idf"], idf) and model["langs"] == ["aa", "bb"]
    for k, x in enumerate(model["langs"]):
        own = unit[[i for i, r in enumerate(rows) if r[2] == x]]
        mean = own.mean(axis=0) / np.linalg.norm(own.mean(axis=0))
        assert np.allclose(model["centres"][k], mean, atol=1e-6)
        assert model["least"][k] == pytest.approx(np.quantile(own @ mean, 0.002), abs=1e-6)
    asked = spark.createDataFrame([(0, rows[0][1]), (1, "xyzzy vux other signs"), (2, "qqq kkk jjj"), (3, "12")], "doc_id long, text string")
    for r in language_id.identify(asked, docs, per_language=100, clusters=1).collect():
        c = language_id.ngram_counts(r.text)
        if c is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = np.log1p(c) * idf
        near = model["centres"] @ (v / np.linalg.norm(v))
        k = int(near.argmax())
        assert (r.lang_pred, r.rejected) == (model["langs"][k], bool(near[k] < model["least"][k])) and r.score == pytest.approx(max(0, near[k]), abs=1e-6)


def test_language_of_odd_rows(odd, clashing, empty):
    got = language_id.identify(odd, odd).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert letters or (r.score == 0 and r.rejected)
    assert language_id.identify(clashing, odd).count() == odd.count()
    assert language_id.identify(empty, odd).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_ngrams_in_pieces_are_the_same():
    text = "Ein langer Text, mit 12 Zahlen — und Zeichen. " * 30
    assert np.array_equal(language_id.ngram_counts(text), language_id.ngram_counts(text, piece=17))
    assert language_id.ngram_counts("12 !?") is None


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """Every labelled row is in the trees and counts for the threshold, however few rows a tree takes."""
    rng = np.random.default_rng(8)
    docs = pd.DataFrame({"doc_id": range(3000), "text": ["word " * rng.integers(1, 4) + "x" * int(k) for k in rng.integers(1, 90, 3000)]})
    known = pd.DataFrame({"doc_id": docs["doc_id"], "quality": (docs["doc_id"] % 10 != 0).astype(int)})
    d, k = spark.createDataFrame(docs), spark.createDataFrame(known)
    forest, threshold = quality_rules.fit_forest(d, k, trees=10, size=16)
    # Fewer places in trees than rows: each row is in one tree.
    assert len(forest.trees) == 10 and forest.size == 300
    score = quality_rules.scored(forest, [quality_rules.text_counts(t)[1] for t in docs["text"]])
    good = (known["quality"] == 1).to_numpy()
    assert threshold == quality_rules.calibrate(score, good, 0.03)
    rows = quality_rules._measured(d, k, "doc_id", "text")
    assert rows.count() == 3000
    # The same rows in another order give the same forest.
    again = quality_rules.fit_forest(d.repartition(7), k.repartition(3), trees=10, size=16)
    assert again[1] == threshold and all(np.array_equal(x, y) for a, b in zip(again[0].trees, forest.trees, strict=True) for x, y in zip(a, b, strict=True))


def test_each_row_is_dealt_to_as_many_trees_as_fill_them(spark):
    stats = [[float(i), 0.0] for i in range(700)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(stats)], "hash long, stats array<double>")
    seen = quality_rules.grown_forest(rows, 700, trees=20, size=100)
    assert len(seen.trees) == 20 and seen.size == 105 and len({t[1].tobytes() for t in seen.trees}) == 20
    # Few rows are in all trees.
    few = quality_rules.grown_forest(rows.where("hash < 9"), 9, trees=20, size=100)
    assert few.size == 9 and all(t[3].max() <= 9 for t in few.trees)
    times = quality_rules.grow_tree(np.array([[1.0], [2.0]]), np.array([5, 1]), 3, np.random.default_rng(1))
    assert sorted(times[3][times[0] < 0]) == sorted([1 + expected_length(5), 1 + expected_length(1)])
