"""Registered queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.plans.bindings import in_query

FLAGSHIP = "q1_unit_totals"
MODULES = ("count_queries", "class_queries", "table_queries", "more_queries", "axis_queries", "report_queries", "resampling_queries", "cluster_queries")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query, and its SQL where there is one; a name is given once."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = in_query(f)
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"dispersa.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
