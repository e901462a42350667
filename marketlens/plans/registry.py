"""Named query catalogue: each entry pairs a Spark query ``(spark, sf_dir)
-> DataFrame`` with the SQL text of an independent oracle (or None when the
operator is a model / heuristic checked by its own invariants)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    survey_ids: tuple[str, ...]


_QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, sql, tuple(ids.split()))
        return fn
    return deco


def all_registered() -> dict[str, Query]:
    """The queries registered so far (for modules that build on others)."""
    return dict(_QUERIES)


def all_queries() -> dict[str, Query]:
    # import for registration side effects
    from marketlens.plans import (customer_queries, drilldown_queries, io_queries, kpi_queries,  # noqa: F401
                                  misc_queries, ml_queries, profile_queries,
                                  retrieval_queries, sentiment_queries)
    return dict(_QUERIES)
