"""Preferences: JSON texts by key, the latest of each counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENABLE_OCR = "enable_ocr"


def load_json(value: Column, default: str) -> Column:
    """The JSON text, or ``default`` where it is missing or malformed."""
    return F.coalesce(F.when(F.try_parse_json(value).isNotNull(), value), F.lit(default))


def latest(log: DataFrame, key_col: str = "key", value_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """key, value as written last. Partial maxima by key, so no key's log is gathered."""
    return log.groupBy(key_col).agg(F.max_by(value_col, seq_col).alias(value_col))


def saved(log: DataFrame, changes: DataFrame, value_col: str = "value") -> DataFrame:
    """``log`` with ``changes`` (key, any value, seq) added as JSON; values that JSON can't hold are left out."""
    kind = changes.schema[value_col].dataType.typeName()
    made = F.to_json(value_col) if kind in ("struct", "map", "array") else F.regexp_replace(F.to_json(F.struct(F.col(value_col).alias("v"))), r'^\{"v":(.*)\}$', "$1")
    return log.unionByName(changes.withColumn(value_col, made).where(F.col(value_col).isNotNull()))
