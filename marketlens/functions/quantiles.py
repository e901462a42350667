"""Exact quantiles with linear interpolation (``quantile_cont`` / pandas
``quantile`` semantics), computed without holding a group in one task.

Two passes over the values, of which only the last moves any: the rows of each
group by magnitude (``_bin``: ``BINS`` parts to a power of two, which need no
knowledge of the values), and the values of the parts that hold a wanted rank.
Those are pre-aggregated to
``(group…, value) -> frequency``, ranked with running frequency sums by
``functions.ranking.ranked`` (range-partitioned, so a hot group spans many
tasks), and the two order statistics around ``(n-1)·p`` are picked and
interpolated as ``lo + (hi-lo)·frac``.  However the values lie, the result is
exact; a part that holds most of them only moves more.  ``df`` is evaluated
twice: pass a written table.
``approx_accuracy`` switches to
``percentile_approx`` (one pass, bounded memory, approximate).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.ranking import ranked
from marketlens.sources.store import materialize

BINS = 128


def quantiles(df: DataFrame, col: str, probs: Mapping[str, float],
              keys: Sequence[str] = (), approx_accuracy: int | None = None) -> DataFrame:
    """One row per group (or one row overall) with a column per quantile."""
    keys = list(keys)
    base = df.where(F.col(col).isNotNull())
    for k in keys:      # null keys form no group (pandas groupby semantics)
        base = base.where(F.col(k).isNotNull())
    if approx_accuracy:
        aggs = [F.percentile_approx(col, p, approx_accuracy).cast("double").alias(name)
                for name, p in probs.items()]
        return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)

    r = _around_ranks(base, col, probs, keys)
    n, upto = F.col("_all"), F.col("_upto")
    after = upto - F.col("_freq")
    v = F.col(col).cast("double")
    aggs, finals = [], []
    for name, p in probs.items():
        pos = (n - 1) * F.lit(float(p))
        lo_rank, hi_rank = _ranks(n, p)
        aggs += [F.max(F.when((after < lo_rank) & (lo_rank <= upto), v)).alias(f"_lo_{name}"),
                 F.max(F.when((after < hi_rank) & (hi_rank <= upto), v)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_d_{name}")]
        lo, hi, d = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_d_{name}")
        finals.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * d).alias(name))
    out = r.groupBy(*keys).agg(*aggs) if keys else r.agg(*aggs)
    return out.select(*keys, *finals)


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    pos = (n - 1) * F.lit(float(p))
    return F.floor(pos) + 1, F.ceil(pos) + 1


def _bin(x: Column) -> Column:
    """Number of the part that holds ``x``: grows with ``x``, NaN last."""
    # powers of two of a double: -1074 to 1023, and 1024 for infinity
    size = F.floor((F.least(F.log2(F.abs(x)), F.lit(1024.0)) + 1075) * BINS)
    return F.when(x == 0, 0).when(F.isnan(x), 2100 * BINS).when(x < 0, -size).otherwise(size).cast("int")


def _around_ranks(base: DataFrame, col: str, probs: Mapping[str, float], keys: list[str]) -> DataFrame:
    """The different values near the wanted ranks: ``_freq`` rows each, ``_upto``
    rows of the group up to and with them, ``_all`` rows of the group."""
    spark, x = base.sparkSession, F.col(col).cast("double")
    binned = base.select(*keys, col, _bin(x).alias("_bin"))
    counts = materialize(spark, binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_in")), "quantile-bins")
    group = Window.partitionBy(*keys)      # at most BINS rows a group and power of two
    bins = counts.withColumn("_all", F.sum("_in").over(group)).withColumn("_below", F.coalesce(
        F.sum("_in").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = F.lit(False)
    for p in probs.values():
        for rank in _ranks(F.col("_all"), p):
            wanted |= (F.col("_below") < rank) & (rank <= F.col("_below") + F.col("_in"))
    bins = materialize(spark, bins.where(wanted).select(*keys, "_bin", "_below", "_all"), "quantile-wanted")
    near = [*keys, "_bin", "_below", "_all"]
    freq = binned.join(bins, [*keys, "_bin"]).groupBy(*near, col).agg(F.count(F.lit(1)).alias("_freq"))
    return ranked(freq, [F.col(col).asc()], near, running_sums=["_freq"]) \
        .withColumn("_upto", F.col("_below") + F.col("_cum__freq"))


def median_of(df: DataFrame, col: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, col, {name: 0.5}, keys)
