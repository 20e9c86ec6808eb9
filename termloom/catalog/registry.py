"""Registry of named queries: a Spark builder and, where SQL can express it, the DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

MODULES = ["cleaning", "metrics", "vectors", "overlap", "labels", "storage", "reports", "runs", "job"]

_builders: dict[str, Builder] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in _builders:
            raise ValueError(f"query {name} is registered twice")
        _builders[name] = build
        if oracle is not None:
            _oracles[name] = oracle
        return build

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"termloom.catalog.{module}")


def builders() -> dict[str, Builder]:
    load()
    return dict(_builders)


def oracles() -> dict[str, str]:
    load()
    return dict(_oracles)
