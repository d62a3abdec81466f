"""Named queries: a Spark callable, the inventory rows it covers and, where SQL can say it, the oracle text."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from joulemill.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}
PACKAGES = ("carbon", "operators", "sources", "functions", "plans", "streaming", "frames")


def query(name: str, covers: str, sql: str | None = None):
    """Register a ``Tables -> DataFrame`` function under ``name``."""

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return wrap


def load() -> dict[str, Query]:
    """Import every package module so that its queries register, then return them all."""
    for package in PACKAGES:
        module = importlib.import_module(f"joulemill.{package}")
        for info in pkgutil.iter_modules(module.__path__):
            importlib.import_module(f"joulemill.{package}.{info.name}")
    return QUERIES


def covered() -> dict[str, list[str]]:
    """Inventory row -> names of the queries that exercise it."""
    rows: dict[str, list[str]] = {}
    for q in load().values():
        for row in q.covers:
            rows.setdefault(row, []).append(q.name)
    return rows
