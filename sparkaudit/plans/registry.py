"""Query registry: each entry pairs a Spark job with its DuckDB oracle SQL.

``register(name, views, oracle)``: ``oracle`` is the SQL that follows the view
CTEs.  It may start with ``,`` to add more CTEs after the views.  ``None``
means "no SQL form" (rows-only check against a brute-force test instead).
"""

from __future__ import annotations

from collections.abc import Callable

from sparkaudit.plans.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(name: str, views=(), oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        DOCS[name] = (fn.__doc__ or "").strip()
        if oracle is not None:
            body = oracle.strip()
            if views:
                if body.startswith(","):
                    ORACLES[name] = with_views("", views).rstrip() + "\n" + body
                else:
                    ORACLES[name] = with_views(body, views)
            else:
                ORACLES[name] = body
        return fn
    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    import importlib
    for m in _MODULES:
        importlib.import_module(f"sparkaudit.plans.{m}")


_MODULES = ["q_triage", "q_classify", "q_secrets", "q_endpoints", "q_graph", "q_rollup", "q_logs", "q_sinks", "q_context", "q_models", "q_intel", "q_rules", "q_surface", "q_ledger"]
