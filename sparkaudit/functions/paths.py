"""Path predicates: test-file markers (F1), utility dirs, dispatch (F7),
sanitizer hints (F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import contains_any


def is_test_path(path: Column, variant: str = "filter") -> Column:
    """F1 ``is_test_path``.

    filter:  18 markers, case-folded, ``\\`` normalised to ``/``
    triage:  15 markers, case-folded
    confirm: 10 markers, case-sensitive
    """
    p = F.coalesce(path, F.lit(""))
    if variant == "filter":
        norm = F.regexp_replace(F.lower(p), r"\\", "/")
        return contains_any(norm, [x.lower().replace("\\", "/") for x in K.TEST_PATTERNS_FILTER])
    if variant == "triage":
        return contains_any(F.lower(p), [x.lower() for x in K.TEST_PATTERNS_TRIAGE])
    if variant == "confirm":
        return contains_any(p, K.TEST_PATTERNS_CONFIRM)
    raise ValueError(f"unknown variant {variant!r}")


def first_test_marker(path: Column) -> Column:
    """First triage marker (original spelling) found in the case-folded path."""
    low = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit(None).cast("string")
    for pat in reversed(K.TEST_PATTERNS_TRIAGE):
        out = F.when(low.contains(pat.lower()), F.lit(pat)).otherwise(out)
    return out


def is_utility_path(path: Column) -> Column:
    return contains_any(F.lower(F.coalesce(path, F.lit(""))), K.UTILITY_PATTERNS)


def needs_manual(call_chain: Column) -> Column:
    """any dynamic-dispatch regex over the space-joined call chain."""
    joined = F.array_join(F.coalesce(call_chain, F.array().cast("array<string>")), " ")
    return joined.rlike("|".join(f"(?:{p})" for p in K.MANUAL_PATTERNS))


def sanitizer_hint(flow_nodes: Column, hints=None) -> Column:
    """F8: any hint is a substring of any flow node."""
    hints = list(hints or K.SANITIZER_HINTS)
    nodes = F.coalesce(flow_nodes, F.array().cast("array<string>"))
    return F.exists(nodes, lambda n: contains_any(n, hints))


def entry_hint(path: Column) -> Column:
    return contains_any(F.lower(F.coalesce(path, F.lit(""))), K.ENTRY_POINT_HINTS)


__all__ = ["is_test_path", "first_test_marker", "is_utility_path", "needs_manual",
           "sanitizer_hint", "entry_hint", "first_contained"]
