"""All registered queries of the library with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hazeline.views import Data, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function from Data to a DataFrame, with DuckDB SQL that may name the views."""

    def register(make: Callable[[Data], DataFrame]) -> Callable:
        @wraps(make)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Data(spark, sf_dir))

        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = with_views(sql)
        return make

    return register


def _load() -> None:
    from hazeline import plans

    plans.load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
