"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps
from pathlib import Path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("q_scan", "q_text", "q_dedup", "q_trie", "q_search")


def importable(spark) -> None:
    """Let Python workers import this package from where the driver has it, if they can't already."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def register(name: str, oracle: str | None = None):
    def keep(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"sparkaudit.llm.{m}")
