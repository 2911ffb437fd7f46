"""Registered queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("harmonizing", "selecting", "aggregating", "following", "measuring", "deciding", "extending", "modelling")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under `name`, with equivalent SQL where there is any."""

    def enter(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        if name in _FOUND:
            raise ValueError(f"two queries named {name}")
        _FOUND[name] = (run, sql)
        return f

    return enter


def _load() -> dict[str, tuple[Query, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"quillon.plans.{m}")
    return _FOUND


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _load().items() if s}
