"""Registered queries of the library's own operators, each with the SQL that gives the same rows in DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgate.jobs.queries import changes, code, flows, history, review, scans, stores

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (scans, code, changes, review, history, flows, stores)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
