"""Join helpers that keep broadcasts behind a proven size bound."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join ``fact`` to a dimension expected to be small.

    The strategy is left to the planner's file-size estimate
    (``autoBroadcastJoinThreshold``) and to AQE at run time; a large side joins
    by shuffle with skew splitting.
    """
    return fact.join(dim, on, how)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (medians, totals) to every row.

    A global aggregate has exactly one row, so broadcasting it is bounded.
    """
    return df.crossJoin(F.broadcast(one_row))
