"""Query name -> (Spark callable, DuckDB SQL or None), filled in by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(views: str, sql: str | None = None) -> Callable:
    """Register a function of the named views (each a DataFrame) under its own name, with its oracle."""

    def put(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[run.__name__] = lambda spark, sf_dir: run(*(view(spark, sf_dir, n) for n in views.split()))
        if sql:
            ORACLES[run.__name__] = with_views(sql)
        return run

    return put
