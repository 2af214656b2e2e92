"""Queries register with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.derive import DOMAIN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """sql follows the domain's tables as common table expressions, unless plain; None where SQL can't express the query."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if plain else DOMAIN + sql
        return f

    return add
