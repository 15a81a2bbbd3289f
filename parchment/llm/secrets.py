"""Secret scans: candidates from a pattern, false positives removed by a random forest learnt from labelled findings."""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .spans import with_matches

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}"
#: Signs of code that make a candidate readable, beside the frequent words of the corpus. Fixed values.
CODE_WORDS = "account|address|class|commit|config|copy|data|date|default|document|example|file|here|home|index|item|line|list|name|number|order|page|paragraph|part|path|python|report|section|sample|site|table|test|text|time|title|user|value|version|word|your"
#: So many of the corpus' most frequent words are the dictionary, and so many neighbouring words of findings have odds of their own.
DICTIONARY_WORDS, CONTEXT_WORDS = 1000, 200
#: Private key blocks, and web tokens of three parts: each one candidate as a whole.
BLOCK = r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----[A-Za-z0-9+/=\s:,.\\-]*?-----END [A-Z ]*+(?<=PRIVATE KEY)-----|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
ASSIGNED = r"(?i)(?:secret|passw(?:or)?d|pwd|token|api[_-]?key|auth|credential|private)[A-Za-z_-]*[\"']?\s*[:=]\s*[\"']?$"
NAMED = r"(?i)secret|passw|pwd|token|key|auth|credential|private"
INNOCENT = r"(?i)(?:commit|sha-?[0-9]+|md5|digest|checksum|uuid|id|version|isbn|order|number|example|sample)[\"']?[\s:=#]*[\"']?$"
KNOWN = r"(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[abp]-)"
PREFIX = f"^{KNOWN}"
_KEY = r"(?i:secret|passw(?:or)?d|pwd|token|api[_-]?key|auth|credential|private)"
_FRONT = _KEY + r"[A-Za-z_-]*+[\"']?\s*+[:=]\s*+(?:(?i:bearer|basic)\s++)?"
#: What stands before a password in an address.
_ADDRESS = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"']*+:"
_PREFIXED = rf"(?<![A-Za-z0-9+/_-]){KNOWN}[A-Za-z0-9+/_-]*"
#: What is assigned, whatever its signs and length, with what it is assigned to: up to the same quote, or else to a space, quote or one of ,;&<>. A password in an address, and what has a known prefix.
VALUE = rf"{_FRONT}(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[\"']?[^\s\"'`,;&<>]*[^\s\"'`,;&<>.)\]}}])|{_ADDRESS}[^\s/@\"']+(?=@)|{_PREFIXED}"
#: The part of such a match before the value, and behind it.
FRONT, BACK = rf"^(?:{_FRONT}[\"']?|{_ADDRESS})", r"[\"']$"
VALUED = rf"{_KEY}[A-Za-z_-]*+[\"']?\s*+[:=]|{KNOWN}|://[^\s/:@]*+:[^\s/@]+@"
#: Runs that are like any word of a text. Without a context that speaks for a secret they are not proposed.
ONE_WORD = "^(?:[A-Z]?[a-z]+|[A-Z]+)$"
FEATURES = ["length", "digits", "upper", "runs", "turns", "distinct", "hex", "numeric", "dashes", "coverage", "assigned", "named", "innocent", "prefix", "block", "quoted", "word_before", "word_after", "test_path", "repeats", "signs"]


def frequent_words(texts: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The ``most`` words of four letters and more that occur most often, in lower case; ties by the word."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()]


def _word_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, "([A-Za-z]+)[^A-Za-z]*$", 1))


def _word_after(after: Column) -> Column:
    return F.lower(F.regexp_extract(after, "^[^A-Za-z]*([A-Za-z]+)", 1))


def _features(hit: Column, before: Column, after: Column, path: Column, dictionary: list[str]) -> dict[str, Column]:
    n = F.length(hit).cast("double")
    share = lambda pattern: F.regexp_count(hit, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    words = {*dictionary, *CODE_WORDS.split("|")}
    # Runs of letters, cut before capitals too.
    runs = F.transform(F.regexp_extract_all(hit, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower)
    readable = F.aggregate(F.filter(runs, lambda w: (F.length(w) >= 4) & w.isin(*words)), F.lit(0), lambda a, w: a + F.length(w))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "runs": share("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"),
        "turns": share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(F.lower(hit), ""))) / n,
        "hex": flag(hit.rlike("^[0-9a-f]+$")),
        "numeric": flag(hit.rlike("^[0-9_-]+$")),
        "dashes": share("[/_-]"),
        "coverage": readable / n,
        "assigned": flag(before.rlike(ASSIGNED)),
        "named": flag(before.rlike(NAMED)),
        "innocent": flag(before.rlike(INNOCENT)),
        "prefix": flag(hit.rlike(PREFIX)),
        "block": flag(hit.rlike("^(?:-----BEGIN|eyJ)")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "test_path": flag(path.rlike("(?i)test|example|sample|fixture|mock|doc/")),
        "repeats": share(r"(.)\1\1+"),
        "signs": share("[^A-Za-z0-9+/_-]"),
    }


def _value_of(x: Column) -> Column:
    """The value alone in a match of VALUE, with what it is assigned to as words before it. A value that is a run has been found already."""
    front = F.regexp_extract(x["hit"], FRONT, 0)
    back = F.when(F.length(front) > 0, F.regexp_extract(x["hit"], BACK, 0)).otherwise("")
    value = F.substring(x["hit"], F.length(front) + 1, F.length(x["hit"]) - F.length(front) - F.length(back))
    s = x["s"] + F.length(front)
    return F.struct(s.alias("s"), (s + F.length(value)).alias("e"), value.alias("hit"), F.right(F.concat(x["before"], front), F.lit(48)).alias("before"), F.left(F.concat(back, x["after"]), F.lit(48)).alias("after"))


def candidates(docs: DataFrame, text_col: str, path_col: str | None, carry: list[str], dictionary: list[str] = ()) -> DataFrame:
    """A row per candidate: ``carry``, s, e, hit, the words next to it, and the features.

    Candidates are runs of 12 signs or more, except single words of letters; whatever is assigned to a
    name such as password or has a known prefix, single words too; private key blocks and web tokens as a whole, in which nothing else is
    proposed. A value may hold runs that are candidates themselves.
    """
    text = F.col(text_col)
    path = F.col(path_col) if path_col else F.lit(None).cast("string")
    slim = docs.select(*[F.col(c).alias(f"_c_{c}") for c in carry], text.alias("_text"), path.alias("_path"))
    own = lambda hit: ~hit.rlike(ONE_WORD)
    found = with_matches(slim, "_runs", F.col("_text"), CANDIDATE, F.col("_text").rlike("[0-9+/_-]|[A-Za-z][A-Z]"), lambda hit, before: own(hit))
    found = with_matches(found, "_assigned", F.col("_text"), VALUE, F.col("_text").rlike(VALUED), lambda hit, before: F.lit(True))
    found = found.withColumn("_values", F.filter(F.transform("_assigned", _value_of), lambda x: (x["s"] < x["e"]) & ~(x["hit"].rlike("^[A-Za-z0-9+/_-]{12,}$") & own(x["hit"])))).drop("_assigned")
    found = with_matches(found, "_blocks", F.col("_text"), BLOCK, F.contains("_text", F.lit("-----BEGIN")) | F.contains("_text", F.lit("eyJ")), lambda hit, before: F.lit(True))
    found = found.select(*[F.col(f"_c_{c}") for c in carry], "_path", F.transform("_blocks", lambda b: F.struct(b["s"], b["e"])).alias("_spans"), F.concat("_blocks", "_runs", "_values").alias("_found"))
    # explode() would have the optimizer test for empty arrays first, and build them twice for that.
    one = found.select(*[F.col(f"_c_{c}") for c in carry], "_path", "_spans", F.posexplode_outer("_found").alias("_nth", "x")).where("x is not null")
    one = one.where((F.col("_nth") < F.size("_spans")) | ~F.exists("_spans", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"])))
    flat = one.select(*[F.col(f"_c_{c}").alias(c) for c in carry], F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.hit").alias("hit"), F.col("x.before").alias("before"), F.col("x.after").alias("after"), F.col("_path").alias("path"))
    words = {"before_word": _word_before(F.col("before")), "after_word": _word_after(F.col("after"))}
    return flat.withColumns(words | _features(F.col("hit"), F.col("before"), F.col("after"), F.col("path"), dictionary)).drop("before", "after", "path")


def sample_findings(spark: SparkSession, n: int = 10000, dictionary: list[str] = ()) -> DataFrame:
    """Labelled findings for want of a table of them: ``n`` made-up texts with one candidate each, its path, and label 1 for secrets.

    Shape, context and path are drawn independently, and the label follows from all three, so that none gives it away: a hexadecimal
    run is a secret where it is assigned, but not as a commit or in a fixture; a known prefix is one nearly anywhere.
    """
    i = F.col("id")
    draw = lambda k, size: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(size)) + 1).cast("int")
    pick = lambda k, words: F.element_at(F.split(F.lit(" ".join(words)), " "), draw(k, len(words)))
    sha = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    wide = F.concat(F.translate(F.left(sha, F.lit(64)), "0123456789abcdef", "aK7xQmZ3tWr2PbVy"), F.translate(F.right(sha, F.lit(64)), "0123456789abcdef", "cD9fGhJ4nRs5TuLe"))
    capital = F.translate(sha, "0123456789abcdef", "ABK7QXM3ZTW2RPVY")
    letters = F.translate(sha, "0123456789abcdef", "aKjxQmZdtWrePbVy")
    number = F.concat(F.lit("4"), F.conv(F.substring(sha, 1, 15), 16, 10))
    nouns = list(dictionary)[:200] or ["horse", "battery", "staple", "river", "garden", "window", "silver", "monkey", "summer", "dragon", "letter"]
    noun, other, third = pick(1, nouns), pick(2, nouns), pick(3, nouns)
    size = draw(4, 20)
    part = lambda x, at, k: F.substring(x, at, k)
    # Shapes: how strongly each is a secret by itself, from -2 to 2.
    shapes = [
        (0, F.left(sha, F.lit(40))), (0, F.left(sha, 12 + size)), (1, F.left(wide, 16 + size)), (0, F.left(letters, 14 + size)),
        (2, F.concat(pick(5, ["AKIA", "ASIA"]), F.left(capital, F.lit(16)))), (2, F.concat(pick(6, ["ghp_", "gho_", "sk_live_", "sk-"]), F.left(wide, F.lit(32)))),
        (2, F.concat(F.lit("eyJ"), F.left(wide, F.lit(30)), F.lit("."), part(wide, 31, 50), F.lit("."), F.right(wide, F.lit(40)))),
        (2, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), wide, F.lit("\n-----END RSA PRIVATE KEY-----"))),
        (0, F.concat(noun, pick(7, ["!", "@$", "#", "."]), F.left(number, F.lit(3)))), (0, F.concat(F.initcap(noun), F.initcap(other), F.initcap(third))), (0, F.left(wide, 5 + size % 7)),
        (0, F.concat(F.left(letters, F.lit(4)), F.lit("-"), noun, F.lit("-"), other)), (-1, F.concat_ws("-", part(sha, 1, 8), part(sha, 9, 4), part(sha, 13, 4), part(sha, 17, 4), part(sha, 21, 12))),
        (-1, noun), (-2, F.left(number, F.lit(16))), (-2, F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T10-20-30"))), (-2, F.concat_ws("-", noun, other, third)),
        (-2, F.concat_ws("/", noun, other, third)), (-2, F.concat(F.lit("get"), F.initcap(noun), F.initcap(other), F.initcap(third))), (-2, F.concat(F.lit("your_example_"), noun)), (-2, F.concat_ws(".", noun, other)),
        (-2, pick(8, ["required", "string", "None", "null", "changed", "nobody", "getenv", "name"])),
    ]
    contexts = [
        (1, 'token = "', '" and'), (1, "password='", "' then"), (1, 'api_key: "', '", or'), (1, 'database_password="', '"'), (1, 'secret = "', '" in'), (0, "password=", " more"), (0, "export SECRET=", " end"), (0, "the token: ", " is"),
        (-1, "the value ", " of"), (-1, "see ", " there"), (-1, "in the ", " we"), (-1, "call ", " to"), (-2, "commit ", " by"), (-2, "sha256: ", " for"), (-2, "id ", " on"), (-2, "version ", " at"),
    ]
    paths = [(0, "src/app/settings.py"), (0, "deploy/prod.yaml"), (0, "web"), (0, None), (-2, "tests/fixtures/keys.json"), (-2, "docs/example.md")]
    at = lambda rows, k, field: F.element_at(F.array(*[F.lit(r[field]) if not isinstance(r[field], Column) else r[field] for r in rows]), draw(k, len(rows)))
    drawn = spark.range(n).select(at(shapes, 11, 1).alias("shape"), (at(shapes, 11, 0) + at(contexts, 12, 0) + at(paths, 13, 0)).alias("score"), at(contexts, 12, 1).alias("front"), at(contexts, 12, 2).alias("back"), F.element_at(F.array(*[F.lit(p[1]).cast("string") for p in paths]), draw(13, len(paths))).alias("path"))
    return drawn.select(F.concat(F.lit("words about "), "front", "shape", "back").alias("text"), "path", (F.col("score") >= 0).cast("int").alias("label"))


class Forest:
    """A random forest, the dictionary, and the odds of neighbouring words that its features need."""

    def __init__(self, dictionary: list[str], before: dict[str, float], after: dict[str, float], usual: float):
        self.dictionary, self.before, self.after, self.usual = list(dictionary), before, after, usual
        self.model: RandomForestClassificationModel | None = None

    def assembled(self, rows: DataFrame) -> DataFrame:
        def odds(word: str, known: dict[str, float]) -> Column:
            table = F.from_json(F.lit(json.dumps(known)), "map<string,double>")
            return F.coalesce(F.element_at(table, F.col(word)), F.lit(self.usual))

        rows = rows.withColumns({"word_before": odds("before_word", self.before), "word_after": odds("after_word", self.after)})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` of candidates plus score, the share of trees' votes for a secret."""
        if self.model is None:
            return rows.withColumn("score", F.lit(0.0))
        return self.model.transform(self.assembled(rows)).withColumn("score", vector_to_array(F.col("probability"))[1])


def train_forest(findings: DataFrame, text_col: str = "text", label_col: str = "label", path_col: str | None = None, dictionary: list[str] = (), seed: int = 17) -> Forest:
    """A forest learnt from labelled findings. Without a candidate of each label, every score is 0. Null labels are left out."""
    known = findings.where(F.col(label_col).isNotNull())
    rows = checkpointed(candidates(known, text_col, path_col, [label_col], dictionary).withColumn("label", F.col(label_col).cast("double")))
    n, share = rows.agg(F.count("*"), F.avg("label")).first()

    def odds(word: str) -> dict[str, float]:
        seen = rows.where(F.col(word) != "").groupBy(word).agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy(F.desc("n"), word).limit(CONTEXT_WORDS).collect()
        return {r[word]: (r["y"] + 5 * share) / (r["n"] + 5) for r in seen}

    forest = Forest(dictionary, odds("before_word") if n else {}, odds("after_word") if n else {}, share or 0.0)
    if n and 0 < share < 1:
        forest.model = RandomForestClassifier(numTrees=60, maxDepth=13, seed=seed, maxMemoryInMB=64, featureSubsetStrategy="onethird").fit(forest.assembled(rows).select("features", "label"))
    return forest


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.35) -> DataFrame:
    """id, s, e, secret_sha256, score, is_secret: every candidate in every text, with the forest's verdict.

    s and e are code points, end exclusive; the secret itself is not repeated. The forest sees length, kinds of signs and the
    changes between them, how much is words that are frequent in ``docs``, the path and the words next to the candidate.
    Null and empty texts have no candidates; repeated rows and ids each give their own; a null path is
    no test path; a secret lost is worse than a false alarm, so ``threshold`` is below one half; equal candidates in equal surroundings score the same; other columns are ignored. ``findings`` has text and label columns, and perhaps path; by
    default they are made up. Findings of one label only, or none, give scores of 0.
    """
    spark = docs.sparkSession
    dictionary = frequent_words(docs, text_col)
    known = sample_findings(spark, dictionary=dictionary) if findings is None else findings
    forest = train_forest(known, path_col="path" if "path" in known.columns else None, dictionary=dictionary)
    judged = forest.scored(candidates(docs, text_col, path_col, [id_col], dictionary))
    judged = judged.select(F.col(id_col), "s", "e", F.sha2("hit", 256).alias("secret_sha256"), "score")
    return judged.withColumn("is_secret", F.col("score") >= threshold)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, s, e, secret_sha256, score, is_secret of all candidates in all documents."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
