"""The registry of queries: name, function of (spark, directory), SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Views:
    """The views of one directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self._dir, name)


def query(sql: str | None = None) -> Callable:
    """Registers a function of :class:`Views` under its name, with the SQL of the same result."""

    def register(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register
