"""All registered queries of the job-posting library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobgrain.sources.views import oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the oracle's body over the same views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = oracle(sql)
        return f

    return add


def _load() -> None:
    from jobgrain.plans import audit_plans, backfill_plans, drift_plans, function_plans, geo_plans, intent_plans, merge_plans, netnew_plans, planning_plans, quality_plans, search_plans, source_plans, streaming_plans, term_plans, text_plans, usage_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
