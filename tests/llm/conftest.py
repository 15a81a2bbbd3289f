import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    long_text = sentence(rng, 20000)
    same = sentence(rng, 80)
    rows = [(1, None, "en", "web", 0), (2, "", None, None, None), (3, " \t\n\x0b\x0c\r ", "en", "web", 7), (4, long_text, "en", "web", 1), (5, same, "en", "books", 2), (5, same, "en", "books", 2), (6, same, "fr", "books", 2), (None, same, "fr", None, 2), (None, None, None, None, None), (7, "word", "en", "web", 4), (8, "日本語 のテキスト　です", "ja", "web", 4), (9, "﻿ 　", None, "web", 3)]
    return [*rows, *[(100 + i, sentence(rng, 60 + i % 40), "en", ("web", "books", "code")[i % 3], 1) for i in range(60)]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "slot", "target", "draws", "pii", "contamination", "lang_pred", "score", "rejected", "kept", "anomaly", "n_words", "id", "fp", "component", "h", "k", "_block", "quality", "mix_shard", "label", "x")
    return odd.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 4 != 0, 0) for i in range(60)] + [(None, True, 0), (4, None, None), (100, True, 0)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic")
