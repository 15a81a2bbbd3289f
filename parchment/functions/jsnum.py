"""Number and text rules that differ between browsers and Spark, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a browser trims: all Unicode spaces, line ends and the byte order mark.
_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_up(c: Column) -> Column:
    """To the nearest whole number, ties towards plus infinity: -2.5 gives -2."""
    return F.when(c >= 0, F.round(c)).otherwise(F.floor(c + 0.5).cast("double"))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_column(low), F.least(as_column(high), c))


def or_default(c: Column, default: float) -> Column:
    """``default`` where ``c`` is null or zero."""
    return F.coalesce(F.nullif(c, F.lit(0).cast("double")), F.lit(float(default)))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Whether nothing but spaces of any kind is left; null is blank."""
    return F.coalesce(trim_all(text), F.lit("")) == ""


def saturate_u8(c: Column) -> Column:
    """Rounded to even and kept in 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(c).cast("int")))


def truncate_u8(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int")))


def fixed(c: Column, digits: int = 3) -> Column:
    """``digits`` decimals, by the shortest decimal form of the number."""
    return F.round(c.cast("decimal(38,18)"), digits).cast(f"decimal(20,{digits})").cast("string")


def fixed_exact(c: Column, digits: int = 3) -> Column:
    """``digits`` decimals, by the exact binary value of the number: 1.0005 gives 1.000."""
    step = Decimal(1).scaleb(-digits)

    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else str(Decimal(v).quantize(step, ROUND_HALF_UP)))

    return F.pandas_udf(shown, "string")(c)
