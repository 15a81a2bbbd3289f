"""Filter modes as colour and enhancement, and rotation by right angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("color_enhanced", "color_original", "document_enhanced", "document_original", "mono")


def color_mode(mode: Column) -> Column:
    return F.when(mode.isin("color_enhanced", "color_original"), "color").otherwise("document")


def enhancement_mode(mode: Column) -> Column:
    return F.when(mode.isin("color_enhanced", "document_enhanced"), "enhanced").otherwise("original")


def combined_mode(color: Column, enhancement: Column) -> Column:
    """The mode of both; what isn't ``color`` is a document, what isn't ``enhanced`` original."""
    return F.concat(F.when(color == "color", "color_").otherwise("document_"), F.when(enhancement == "enhanced", "enhanced").otherwise("original"))


def turned(degrees: Column, clockwise: bool = True) -> Column:
    return F.pmod(degrees + F.lit(90 if clockwise else -90), F.lit(360))
