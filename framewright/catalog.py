"""The registry of the trace queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.plans import folds as _folds  # noqa: F401  (registers its queries)
from framewright.plans import inventory as _inventory  # noqa: F401
from framewright.plans import inventory_folds as _inventory_folds  # noqa: F401
from framewright.plans import more_queries as _more  # noqa: F401
from framewright.plans import queries as _queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples grouped into sessions, a consensus value for each, and the statistics of their lengths."""
    return _queries.QUERIES["o6_13_sessions"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
