"""All queries of the library, by name, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.plans.bindings import Tables, with_views

MODULES = ("listing", "joining", "counting", "ordering", "naming", "resolving", "claiming", "ingesting", "researching", "operating", "flowing")
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query, with its SQL twin over the same tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"dossier.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different people does each matter have? Rule tiers of the person resolution over all mentions."""
    _load()
    return _QUERIES["er_23_recanonicalize"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
