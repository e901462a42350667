"""Exact money sums and stable rounding shared by Spark queries.

Money is summed as DECIMAL (exact, order-independent) and rounded last, so a
result does not depend on how rows were partitioned; it is returned as DOUBLE.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def money_sum(c, digits: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast(MONEY)), digits).cast("double")


def rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits).cast("double")


def pct(numer: Column, denom: Column, digits: int = 2) -> Column:
    """``round(100 * numer / denom, digits)``; zero denominator -> null."""
    return F.round(F.try_divide(numer * F.lit(100.0), denom.cast("double")), digits)


def mean_flag(cond: Column) -> Column:
    """pandas ``(col == x).mean()``: null counts as False."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def money_avg(c, digits: int = 4) -> Column:
    """Mean of a money-like column, exact: decimal sum / count, rounded
    half-up in decimal, returned as double.  Doubles averaged in different
    orders (or rounded via different binary/decimal conversions) disagree on
    ties; exact decimals do not."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast(MONEY)) / F.count(c), digits).cast("double")


def money_avg_sql(c: str, digits: int = 4) -> str:
    """The same exact half-up mean in portable integer SQL (for oracles)."""
    den = f"(count({c}) * {10 ** (6 - digits)})"
    s6 = f"CAST(sum(CAST({c} AS DECIMAL(18,6))) * 1000000 AS HUGEINT)"
    q = f"(sign({s6}) * ((2 * abs({s6}) + {den}) // (2 * {den})))"
    return f"(CAST({q} AS DOUBLE) / {10 ** digits}.0)"
