"""Registration of named queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opswatch.sources.tables import Tables, raw_tables
from opswatch.sources.views import NOW, VIEWS, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the views it names, and the views those name, prepended as common table expressions."""
    known = {**{n: render(s, "duckdb") for n, s in VIEWS.items()}, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} AS ({known[n]})" for n in ordered)
    recursive = "WITH RECURSIVE "
    if sql.lstrip().startswith(recursive):
        return f"{recursive}{parts},\n{sql.lstrip().removeprefix(recursive)}"
    return f"WITH {parts}\n{sql}"


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its expected-result SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(raw_tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql.replace("$NOW", f"TIMESTAMP '{NOW}'"), views)
        return fn

    return register


def stream_query(name: str, sql: str | None = None, same_as: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(spark, live, stored) -> DataFrame``: ``live`` tables are streams, ``stored`` ones are not.

    ``same_as`` names the batch query whose result is expected.
    """

    def register(fn: Callable[[SparkSession, Tables, Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, raw_tables(spark, sf_dir, live=True), raw_tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if same_as is not None:
            ORACLES[name] = ORACLES[same_as]
        elif sql is not None:
            ORACLES[name] = with_views(sql.replace("$NOW", f"TIMESTAMP '{NOW}'"), views)
        return fn

    return register
