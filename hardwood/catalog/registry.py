"""Query registration: a Spark callable and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from hardwood.sources.adapters import load_view, view_ctes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_SRC: dict[str, str] = {}
_MODULES = ["team", "player", "season", "events", "profile", "rating", "winprob", "lineup", "ingest"]


class Inputs:
    """Views of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load_view(self.spark, self.sf_dir, name)


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register `fn(inputs)`; `sql` continues a WITH list that starts with the named views."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _SRC[name] = fn.__module__
        _QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            head = f"WITH {view_ctes(*views)}" if views else ""
            _ORACLES[name] = f"{head}{sql}" if views else sql
        return fn

    return wrap


def _load() -> None:
    for m in _MODULES:
        import_module(f"hardwood.catalog.{m}")


def query_table() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_texts() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
