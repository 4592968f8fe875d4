"""Oracle SQL fragments generated from the same fixed catalogues.

These strings are only used by the DuckDB oracle (``oracle_sql``); the Spark
side builds its own expressions from ``sparkaudit.catalogs``.
"""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal (standard quoting)."""
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


def first_contained(expr: str, needles, values=None) -> str:
    values = values or needles
    whens = " ".join(f"WHEN contains({expr}, {q(n)}) THEN {q(v)}" for n, v in zip(needles, values))
    return f"(CASE {whens} ELSE NULL END)"


def map_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {expr} = {q(k)} THEN {v if isinstance(v, int) else q(v)}"
                     for k, v in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


def in_list(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(q(v) for v in values)}))"
