"""Queries of the training-data operators: name -> callable of (session, folder), and the oracle texts."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import joulemill.llm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``."""

    def wrap(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql.strip()
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def load() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Import the modules of the subpackage, so that their queries register."""
    for info in pkgutil.iter_modules(joulemill.llm.__path__):
        importlib.import_module(f"joulemill.llm.{info.name}")
    return QUERIES
