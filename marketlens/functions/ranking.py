"""Global (or per-key) row numbers and running sums without funnelling a
whole ordering — or one hot key — through a single task.

``Window.orderBy(...)`` with no partition key, or ``partitionBy(key)`` on a
key that holds a third of the rows, runs in one task.  ``ranked`` instead:

1. range-partitions on (keys…, order…), so a hot key spans many contiguous
   partitions;
2. numbers rows inside each (partition, key) slice with a window whose group
   is at most one partition;
3. aggregates a tiny (partition, key) → count/sum table, turns it into
   per-slice offsets with a window over at most #partitions rows per key;
4. adds the offset back (join on (partition, key)).

The partitioned, locally numbered rows are written once to the shared
``spark.checkpoint.dir`` folder and read back, so the totals and the rows
agree on partition ids even if an executor is lost.

The result has ``_rn`` (1-based row number within key), ``_n`` (rows in the
key) and, for each requested column, ``_cum_<col>`` (running sum including
the current row) and ``_all_<col>`` (sum over the key).  The order must be total (add a unique tie-breaker).
Keys must be non-null (rows with a null key form no group; callers filter).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.store import materialize


def ranked(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
           running_sums: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    keys = list(keys)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = (df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
                .withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    cols = {"_lrn": F.row_number().over(local)}
    for c in running_sums:
        cols[f"_lcum_{c}"] = F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Materialise once: both the slice totals and the rows must see the same
    # partition ids, which two independent range exchanges do not guarantee.
    parted = materialize(spark, parted.withColumns(cols), "ranked")

    slices = parted.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.sum(c).alias(f"_tot_{c}") for c in running_sums])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = slices.select(
        "_pid", *keys,
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias("_n"),
        *[F.sum(f"_tot_{c}").over(before).alias(f"_off_{c}") for c in running_sums],
        *[F.sum(f"_tot_{c}").over(whole).alias(f"_all_{c}") for c in running_sums])

    out = parted.join(offsets, ["_pid", *keys]) if keys else parted.join(F.broadcast(offsets), "_pid")
    out = out.withColumn("_rn", F.col("_off") + F.col("_lrn"))
    for c in running_sums:
        out = out.withColumn(f"_cum_{c}", F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.col(f"_lcum_{c}"))
    drop = ["_pid", "_lrn", "_off"] + [f"_lcum_{c}" for c in running_sums] + [f"_off_{c}" for c in running_sums]
    return out.drop(*drop)


def ntile_of(rn: Column, n: Column, buckets: int) -> Column:
    """SQL ``ntile(buckets)`` from a 1-based row number and group size: the
    first ``n % buckets`` tiles get one extra row."""
    r = rn - 1
    size = F.floor(n / buckets)
    rem = n % buckets
    big = rem * (size + 1)
    return F.when(r < big, F.floor(r / (size + 1)) + 1) \
            .otherwise(rem + F.floor((r - big) / F.greatest(size, F.lit(1))) + 1).cast("int")


def next_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  cols: Sequence[str]) -> DataFrame:
    """``lead(col) over (partition by keys order by order)`` for each of
    ``cols`` (as ``next_<col>``), as a rank + equi self-join on
    (keys, row number) so one hot key is not processed by a single task."""
    r = ranked(df, order, keys).drop("_n")
    nxt = r.select(*keys, (F.col("_rn") - 1).alias("_rn"),
                   *[F.col(c).alias(f"next_{c}") for c in cols])
    return r.join(nxt, [*keys, "_rn"], "left").drop("_rn")
