"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import with_matches

# The same matches as the plain patterns, leftmost and greedy; possessive and bounded on the left, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Signs of an account number by country, as in the IBAN registry.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
# A known country's number ends where its length says; others take in what follows, but no number of a known country.
_SIZED = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_SIZED}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_COUNTRIES})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

BASE = ("email", "ip", "card", "phone")
#: Words near a span that speak for its kind. Fixed values.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "\\bip\\b|address|server|host",
    "card": "card|visa|credit|carte|tarjeta|karte",
    "phone": "phone|\\btel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national": "ssn|social|security|national|\\bid\\b",
}
#: What a confirmed match is worth without context, and with it.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.8), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.8, 1.0), "national": (0.3, 0.8)}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 after its first four signs went to the end."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))
    signs = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97) == 1


def _confirmed(kind: str):
    byte = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"

    def card(hit: Column, before: Column) -> Column:
        d = _digits(hit)
        return F.when((F.length(hit) >= 13) & F.length(d).between(13, 19), luhn(d))

    return {
        "email": lambda hit, before: F.lit(True),
        "ip": lambda hit, before: hit.rlike(rf"^{byte}(?:\.{byte}){{3}}$"),
        "card": card,
        "phone": lambda hit, before: F.length(_digits(hit)).between(9, 15),
        "iban": lambda hit, before: mod97(hit),
        "national": lambda hit, before: ~hit.rlike("^(?:000|666|9)|-00-|-0000$") & F.lower(before).rlike(CONTEXT["national"]),
    }[kind]


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus pii: array of struct(kind, s, e, score, hit), by kind, then start.

    The four base kinds are kept whatever their score; account numbers must pass mod 97, and national
    numbers need a word nearby that speaks for them. Each kind is searched for itself, so spans of
    different kinds may overlap. Null and empty texts have none. Every row is judged by itself;
    a column named pii is replaced.
    """
    text = F.col(text_col)
    digit = text.rlike("[0-9]")
    where = {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"),
        "iban": digit & text.rlike(r"[A-Z]{2}[0-9]{2}"),
        "national": digit & text.rlike(r"[0-9]{3}-[0-9]{2}-"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national": NATIONAL}
    plain = docs.drop(*(["pii"] if text_col != "pii" else []))
    found = plain
    for kind, pattern in patterns.items():
        found = with_matches(found, f"_{kind}", text, pattern, where[kind], _confirmed(kind))

    def scored(kind: str) -> Column:
        low, high = SCORES[kind]
        near = lambda x: F.lower(F.concat(x["before"], F.lit(" "), x["after"])).rlike(CONTEXT[kind])
        return F.transform(f"_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(near(x), high).otherwise(low).alias("score"), x["hit"].alias("hit")))

    return found.select(*plain.columns, F.concat(*[scored(k) for k in patterns]).alias("pii"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, best_score of all documents."""
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    of = lambda kind: F.size(F.filter(pii, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in BASE]
    base = F.filter(pii, lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(pii).alias("spans"), F.array_max(F.transform(pii, lambda x: x["score"])).alias("best_score"))
