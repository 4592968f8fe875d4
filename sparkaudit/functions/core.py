"""Column-expression helpers shared by all operators.

Every helper returns a Spark ``Column`` built from built-in functions, so it
stays inside whole-stage codegen (no Python UDF).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def literal_alternation(needles: Iterable[str]) -> str:
    """Java regex matching any of the literal needles."""
    return "|".join("\\Q" + n + "\\E" for n in needles)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when any literal needle is a substring of ``text`` (null-safe).

    Many needles become ONE regex of quoted literals: a single expression
    node keeps plans small and codegen fast."""
    needles = list(needles)
    t = F.coalesce(text, F.lit(""))
    if len(needles) <= 2:
        out = F.lit(False)
        for n in needles:
            out = out | t.contains(n)
        return out
    return t.rlike(literal_alternation(needles))


def first_contained(text: Column, needles: Iterable[str]) -> Column:
    """The first needle (in list order) contained in ``text``, else null."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for n in reversed(list(needles)):
        out = F.when(t.contains(n), F.lit(n)).otherwise(out)
    return out


def map_lookup(key: Column, mapping: dict, default=None) -> Column:
    """Literal-map lookup with a default (kept in codegen as CASE WHEN)."""
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def stable_id(n: int, *parts) -> Column:
    """``md5(p1:p2:...)[:n]`` — the ids of the audited records."""
    cols = [F.coalesce(col_or_lit(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", *cols)), 1, n)


def nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def join_sorted(arr: Column, sep: str = ",") -> Column:
    """Array -> sorted delimited string (order-insensitive compare form)."""
    return F.array_join(F.sort_array(arr), sep)
