"""Registry of the runnable queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Named SELECTs the check SQL can refer to, in order of dependence.
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def full_sql(sql: str) -> str:
    """The SQL with every view it names put in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
