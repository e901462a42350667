"""Customer analytics: RFM, segments, repeat purchase (G31–G34, W6, W10,
J7, P16).

Per-customer work is a hash aggregate (a hot customer is combined map-side).
Ordered per-customer logic (quintiles, next purchase) goes through
``functions.ranking`` so neither a global ordering nor one customer's orders
is processed by a single task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import floor_days
from marketlens.functions.joins import attach_scalars
from marketlens.functions.money import rounded
from marketlens.functions.quantiles import median_of
from marketlens.functions.ranking import next_in_order, ntile_of, ranked
from marketlens.sources.store import materialize

CUST = "customer_unique_id"

# Segment thresholds on R+F+M (each scored 1–5).
SEGMENTS = (("Champions", 12), ("Loyal", 9), ("At Risk", 6))
OTHER_SEGMENT = "Lost"
REPEAT_WINDOW_DAYS = 90
COMFORTABLE_MARGIN_DAYS = 2


def rfm_base(fact: DataFrame) -> DataFrame:                       # G31 (per customer)
    snapshot = fact.agg((F.max("order_purchase_timestamp") + F.expr("INTERVAL 1 DAY")).alias("_snap"))
    per = (fact.where(F.col(CUST).isNotNull()).groupBy(CUST)
               .agg(F.max("order_purchase_timestamp").alias("_last"),
                    F.count_distinct("order_id").alias("frequency"),
                    F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("monetary")))
    per = attach_scalars(per, snapshot)
    return per.select(CUST, floor_days(F.col("_last"), F.col("_snap")).alias("recency"),
                      "frequency", "monetary",
                      (F.col("monetary").cast("double") / F.col("frequency")).alias("aov"))


def rfm_scores(base: DataFrame) -> DataFrame:                     # W6
    """Quintile scores: recent, frequent and high-spending customers score 5.
    Ties are broken by customer id so the split is total."""
    r = ranked(base, [F.desc("recency"), F.asc(CUST)]).withColumn("r_score", ntile_of(F.col("_rn"), F.col("_n"), 5)).drop("_rn", "_n")
    r = ranked(r, [F.asc("frequency"), F.asc(CUST)]).withColumn("f_score", ntile_of(F.col("_rn"), F.col("_n"), 5)).drop("_rn", "_n")
    r = ranked(r, [F.asc("monetary"), F.asc(CUST)]).withColumn("m_score", ntile_of(F.col("_rn"), F.col("_n"), 5)).drop("_rn", "_n")
    score = F.col("r_score") + F.col("f_score") + F.col("m_score")
    seg = F.lit(OTHER_SEGMENT)
    for name, floor in reversed(SEGMENTS):
        seg = F.when(score >= floor, name).otherwise(seg)
    return r.withColumn("rfm_score", score).withColumn("segment", seg)


def rfm_summary(base: DataFrame) -> DataFrame:                    # G31 (stats)
    base = materialize(base.sparkSession, base, "rfm-base")     # read by three aggregates
    stats = base.agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(F.avg("recency"), 2).alias("mean_recency"),
        rounded(F.stddev_samp("recency"), 2).alias("std_recency"),
        rounded(F.avg("frequency"), 4).alias("mean_frequency"),
        F.max("frequency").alias("max_frequency"),
        rounded(F.avg(F.col("monetary").cast("double")), 2).alias("mean_monetary"),
        F.round(F.max("monetary"), 2).cast("double").alias("max_monetary"),
        rounded(F.avg("aov"), 2).alias("mean_aov"),
        F.round(F.avg((F.col("frequency") > 1).cast("double")) * 100, 2).alias("repeat_customer_pct"))
    med_f = median_of(base, "frequency", "median_frequency")
    med_m = median_of(base.withColumn("monetary", F.col("monetary").cast("double")), "monetary", "median_monetary")
    return (stats.crossJoin(med_f).crossJoin(med_m)
                 .withColumn("median_monetary", rounded(F.col("median_monetary"), 2)))


def segment_summary(scored: DataFrame) -> DataFrame:              # G32
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(F.avg(F.col("monetary").cast("double")), 2).alias("avg_monetary"),
        F.round(F.sum("monetary"), 2).cast("double").alias("total_monetary"),
        F.round(F.avg((F.col("frequency") > 1).cast("double")) * 100, 2).alias("repeat_rate_pct"))


def late_vs_on_time_score(fact: DataFrame) -> DataFrame:          # G33
    return (fact.where(F.col("delivery_status").isin("Late", "On Time"))
                .groupBy("delivery_status")
                .agg(rounded(F.avg("review_score"), 4).alias("avg_review_score"),
                     F.count(F.lit(1)).alias("rows")))


def customer_orders(fact: DataFrame) -> DataFrame:
    """One row per (customer, order) with its purchase time."""
    return (fact.where(F.col(CUST).isNotNull())
                .groupBy(CUST, "order_id").agg(F.min("order_purchase_timestamp").alias("purchased_at")))


def next_purchase(fact: DataFrame) -> DataFrame:                  # W10, J7
    """Each order with the customer's next order and the gap in days;
    ``repeat_90d`` = next order within 90 days (a time-bounded self-join
    expressed as a lead, no range join)."""
    orders = customer_orders(fact)
    nxt = next_in_order(orders, [CUST], [F.asc("purchased_at"), F.asc("order_id")],
                        ["order_id", "purchased_at"])
    gap = floor_days(F.col("purchased_at"), F.col("next_purchased_at"))
    return nxt.select(CUST, "order_id", "purchased_at", F.col("next_order_id"),
                      gap.alias("days_to_next_order"),
                      F.coalesce(gap <= REPEAT_WINDOW_DAYS, F.lit(False)).cast("int").alias("repeat_90d"))


def shipping_margin(fact: DataFrame) -> DataFrame:                # P16
    m = floor_days(F.col("order_delivered_carrier_date"), F.col("shipping_limit_date"))
    return fact.withColumn("seller_shipping_margin", m)


def repeat_by_margin(fact: DataFrame) -> DataFrame:               # G34
    margin = F.col("seller_shipping_margin")
    bucket = (F.when(margin > COMFORTABLE_MARGIN_DAYS, "comfortable (>2 days)")
               .when(margin < 0, "late dispatch").otherwise("tight (0-2 days)"))
    rows = shipping_margin(fact).where(margin.isNotNull()).select("order_id", bucket.alias("margin_bucket"))
    rep = next_purchase(fact).select("order_id", "repeat_90d")
    return (rows.join(rep, "order_id").groupBy("margin_bucket")
                .agg(F.count(F.lit(1)).alias("rows"),
                     F.round(F.avg("repeat_90d") * 100, 2).alias("repeat_90d_pct")))
