"""Registered queries: each pairs a Spark query with the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from siteval.fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return register


def load() -> None:
    for module in MODULES:
        import_module(f"siteval.catalog.{module}")


MODULES = ["rows", "metric", "pair", "order", "scalar", "event", "sampler", "fitting", "source", "stream"]
