"""Positions of all matches of a pattern, from built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches that are added up in one go; with more, sums of such groups come first, so the work stays near linear.
GROUP = 256


def with_matches(df: DataFrame, out: str, text: Column, pattern: str, where: Column, keep: Callable[[Column, Column], Column], context: int = 48) -> DataFrame:
    """``df`` plus column ``out``: array of struct(s, e, hit, before, after) of the non-overlapping matches that ``keep`` accepts.

    s and e are code points, end exclusive; before and after are up to ``context`` characters next to the match, no
    further than the neighbouring matches. ``keep(hit, before)`` is a condition. Texts for which
    ``where`` is not true, nulls included, give an empty array. The text between matches and the matches
    alternate, so their lengths add up to the positions.
    """
    item = "struct<gap:int,len:int,ok:boolean,hit:string,before:string,after:string>"
    empty = F.array().cast(f"array<{item}>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def described(hit: Column, i: Column) -> Column:
        gap, nxt = F.element_at(f"_gaps_{out}", i + 1), F.element_at(f"_gaps_{out}", i + 2)
        before = F.right(gap, F.lit(context))
        ok = F.coalesce(keep(hit, before), F.lit(False))
        return F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len"), ok.alias("ok"), F.when(ok, hit).alias("hit"), F.when(ok, before).alias("before"), F.when(ok, F.left(nxt, F.lit(context))).alias("after"))

    df = df.withColumns({f"_gaps_{out}": F.when(where, gaps), f"_hits_{out}": F.when(where, hits)})
    some = F.size(F.coalesce(f"_hits_{out}", F.array().cast("array<string>"))) > 0
    df = df.withColumn(f"_items_{out}", F.when(some & (F.size(f"_gaps_{out}") > 0), F.transform(f"_hits_{out}", described)).otherwise(empty)).drop(f"_gaps_{out}", f"_hits_{out}")
    items = F.col(f"_items_{out}")
    wanted = F.exists(items, lambda x: x["ok"])
    groups = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int"))
    part = lambda g: F.slice(items, g * GROUP + 1, F.lit(GROUP))
    df = df.withColumn(f"_sums_{out}", F.when(wanted, F.transform(groups, lambda g: F.aggregate(part(g), F.lit(0), lambda n, x: n + x["gap"] + x["len"]))))
    sums = F.col(f"_sums_{out}")
    found = "array<struct<s:int,e:int,hit:string,before:string,after:string>>"

    def walk(g: Column) -> Column:
        base = F.aggregate(F.slice(sums, F.lit(1), g), F.lit(0), lambda n, x: n + x)
        start = F.struct(base.alias("at"), F.array().cast(found).alias("found"))

        def step(a: Column, x: Column) -> Column:
            s, e = a["at"] + x["gap"], a["at"] + x["gap"] + x["len"]
            one = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct(e.alias("at"), F.when(x["ok"], F.array_append(a["found"], one)).otherwise(a["found"]).alias("found"))

        return F.aggregate(part(g), start, step, lambda a: a["found"])

    index = F.sequence(F.lit(0), F.size(sums) - 1)
    df = df.withColumn(out, F.when(F.size(sums) > 0, F.flatten(F.transform(index, walk))).otherwise(F.array().cast(found)))
    return df.drop(f"_items_{out}", f"_sums_{out}")
