"""Data profiling.

Per-column statistics are computed in one pass by unpivoting columns into
``(column, value)`` rows and grouping by ``column`` (partial aggregation),
rather than one job per column.
"""
from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.money import rounded
from marketlens.functions.quantiles import quantiles

# Numeric and categorical columns of the enriched fact that are profiled.
NUMERIC = ("price", "freight_value", "payment_value", "payment_installments", "review_score",
           "delivery_days", "estimated_delivery_days", "delivery_delay", "carrier_pickup_days",
           "transit_days", "freight_pct", "total_item_value", "comment_length", "product_size")
CATEGORICAL = ("order_status", "customer_state", "customer_city", "payment_type",
               "product_category_name_english", "sentiment", "delivery_status", "Customer_Type")

QUARTILES = (0.25, 0.5, 0.75)
# Sketch sizes (logarithm of the registers, items a level) and what is asked of them: more than four standard errors.
DISTINCT_BITS = 14
DISTINCT_ERROR = 0.04
RANK_ITEMS = 800
RANK_ERROR = 0.015

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def columns_by_kind(df: DataFrame) -> tuple[list[str], list[str]]:      # P17
    """(numeric, categorical) column names by schema type."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC_TYPES)]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return num, cat


def long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select([F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot([], list(cols), "column_name", "value")


def missing_report(df: DataFrame) -> DataFrame:                         # N6
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = counts.unpivot(["_rows"], cols, "column_name", "missing_count")
    return (long.where(F.col("missing_count") > 0)
                .select("column_name", "missing_count",
                        F.round(F.col("missing_count") * 100.0 / F.col("_rows"), 2).alias("missing_pct")))


def numeric_summary(df: DataFrame, cols: Sequence[str] = NUMERIC) -> DataFrame:   # N7
    long = long_numeric(df, cols).where(F.col("value").isNotNull())
    basic = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), rounded(F.avg("value"), 4).alias("mean"),
        rounded(F.stddev_samp("value"), 4).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"])
    q = q.select("column_name", *[rounded(F.col(c), 4).alias(c) for c in ("q25", "q50", "q75")])
    return basic.join(q, "column_name")


def categorical_summary(df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:   # N7, N4
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]) \
             .unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull())
    freq = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq"))
    top = freq.groupBy("column_name").agg(
        F.sum("freq").alias("count"), F.count(F.lit(1)).alias("unique"),
        # most frequent value, ties -> smallest value (deterministic mode)
        F.min(F.struct((-F.col("freq")).alias("nf"), F.col("value").alias("v"))).alias("m"))
    return top.select("column_name", "count", "unique", F.col("m.v").alias("top"), (-F.col("m.nf")).alias("freq"))


def mode_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:          # N4
    modes = categorical_summary(df, cols).select("column_name", "top")
    row = modes.groupBy().pivot("column_name", list(cols)).agg(F.first("top"))
    out = df.crossJoin(F.broadcast(row.select([F.col(c).alias(f"_mode_{c}") for c in cols])))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}"))).drop(f"_mode_{c}")
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:   # N8
    cols = list(cols or df.columns)
    each = [df.where(F.col(c).isNotNull()).select(c).distinct()
              .agg(F.count(F.lit(1)).alias("distinct_values"))
              .select(F.lit(c).alias("column_name"), "distinct_values") for c in cols]
    return functools.reduce(DataFrame.unionByName, each)


def duplicate_rows(df: DataFrame) -> DataFrame:                          # N9
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return total.crossJoin(distinct).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def target_correlations(df: DataFrame, target: str = "review_score",
                        cols: Sequence[str] = NUMERIC, n: int = 10) -> DataFrame:     # N10
    cols = list(cols)
    complete = df.select(*cols).na.drop()
    feats = [c for c in cols if c != target]
    wide = complete.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in feats])
    long = wide.unpivot([], feats, "feature", "corr").where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return (long.select("feature", rounded(F.abs("corr"), 4).alias("abs_corr"))
                .orderBy(F.desc("abs_corr"), "feature").limit(n))


def freight_correlations(df: DataFrame, weight_col: str = "product_size") -> DataFrame:   # N11
    per_product = df.groupBy("product_id").agg(F.first(weight_col).alias("w"), F.avg("freight_value").alias("f"))
    a = per_product.agg(rounded(F.corr(F.col("w").cast("double"), "f"), 4).alias("corr_weight_avg_freight"))
    b = df.agg(rounded(F.corr("price", "freight_value"), 4).alias("corr_price_freight"))
    return a.crossJoin(b)


def five_number(df: DataFrame, value: str, by: str) -> DataFrame:       # N12
    q = quantiles(df, value, {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}, [by])
    return q.select(by, *[rounded(F.col(c), 4).alias(c) for c in ("min", "q25", "median", "q75", "max")])


def sketches(df: DataFrame, part: Column, keys: Sequence[str], numbers: Sequence[str]) -> DataFrame:   # N7, N8
    """One row a ``part`` (say a month) of mergeable sketches: distinct values of
    each of ``keys``, ranks of each of ``numbers``; nulls take no part.  Kept
    beside the data, they answer for any set of parts without its rows."""
    return df.groupBy(part.alias("part")).agg(
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(DISTINCT_BITS)).alias(f"distinct_{c}") for c in keys],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(RANK_ITEMS)).alias(f"ranks_{c}") for c in numbers])


def sketched_distinct(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``column_name, approximate`` from merged sketches; 0 without rows."""
    one = kept.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")), F.lit(0)).alias(c) for c in keys])
    return one.unpivot([], list(keys), "column_name", "approximate")


def sketched_quantiles(kept: DataFrame, numbers: Sequence[str], at: Sequence[float] = QUARTILES) -> DataFrame:
    """``column_name, rows, probability, approximate`` from merged sketches;
    columns without a value have no row."""
    long = kept.unpivot([], [f"ranks_{c}" for c in numbers], "column_name", "ranks")
    merged = long.groupBy(F.substring("column_name", len("ranks_") + 1, 1 << 20).alias("column_name")) \
        .agg(F.kll_merge_agg_double("ranks", F.lit(RANK_ITEMS)).alias("ranks"))
    merged = merged.withColumn("rows", F.kll_sketch_get_n_double("ranks")).where(F.col("rows") > 0)
    asked = F.array(*[F.lit(float(p)) for p in at])
    each = merged.select("column_name", "rows", F.explode(F.arrays_zip(
        asked.alias("probability"), F.kll_sketch_get_quantile_double("ranks", asked).alias("approximate"))).alias("q"))
    return each.select("column_name", "rows", "q.probability", "q.approximate")
