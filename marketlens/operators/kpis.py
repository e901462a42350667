"""Headline KPIs and dashboard aggregates.

Every function takes the enriched fact and returns a small DataFrame.  All
are single hash aggregates with partial (map-side) aggregation; top-k uses
``orderBy(...).limit(k)`` which plans as TakeOrderedAndProject (no global
sort).  Ties are broken by the group key so results are deterministic.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.money import mean_flag, money_sum, pct, rounded
from marketlens.functions.ranking import ranked

CAT = "product_category_name_english"
def _delivered():
    return F.col("order_status") == "delivered"


def headline(fact: DataFrame) -> DataFrame:                       # G1 (+ Q4, Q6 variants)
    revenue = F.sum(F.col("payment_value").cast("decimal(18,6)"))
    orders = F.count_distinct("order_id")
    per_customer = (fact.where(F.col("customer_unique_id").isNotNull())
                        .groupBy("customer_unique_id")
                        .agg(F.max("is_returning_customer").alias("ret")))
    cust = per_customer.agg(pct(F.sum("ret"), F.count(F.lit(1))).alias("returning_customer_share_pct"))
    dedup = (fact.groupBy("order_id", "payment_sequential")
                 .agg(F.max(F.col("payment_value").cast("decimal(18,6)")).alias("pv"))
                 .agg(F.round(F.sum("pv"), 2).cast("double").alias("revenue_deduped")))
    canceled_orders = (fact.groupBy("order_id")
                           .agg(F.max((F.col("order_status") == "canceled").cast("int")).alias("c"))
                           .agg(pct(F.sum("c"), F.count(F.lit(1))).alias("cancellation_rate_orders_pct")))
    main = fact.agg(
        F.round(revenue, 2).cast("double").alias("total_revenue"),
        orders.alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("total_customers"),
        F.count_distinct("seller_id").alias("total_sellers"),
        F.round(revenue / orders, 2).cast("double").alias("avg_order_value"),
        rounded(mean_flag(_delivered()) * 100, 2).alias("delivery_success_rate_pct"),
        rounded(mean_flag(F.col("order_status") == "canceled") * 100, 2).alias("cancellation_rate_pct"),
        rounded(F.avg("review_score"), 2).alias("avg_review_score"),
        rounded(F.avg("is_returning_customer") * 100, 2).alias("returning_customer_rate_pct"),
    )
    return main.crossJoin(cust).crossJoin(dedup).crossJoin(canceled_orders)


def delivery_headline(fact: DataFrame) -> DataFrame:              # G2
    d = fact.where(_delivered())
    return d.agg(rounded(mean_flag(F.col("delivery_status") == "Late") * 100, 2).alias("late_delivery_rate_pct"),
                 rounded(F.avg("delivery_days"), 2).alias("avg_delivery_days"))


def top_states(fact: DataFrame, n: int = 10) -> DataFrame:        # G3 (+ Q5 distinct customers)
    return (fact.where(F.col("customer_state").isNotNull()).groupBy("customer_state")
                .agg(F.count(F.lit(1)).alias("customers"),
                     F.count_distinct("customer_unique_id").alias("distinct_customers"))
                .orderBy(F.desc("customers"), "customer_state").limit(n))


def top_categories_by_revenue(fact: DataFrame, n: int = 10) -> DataFrame:   # G4
    return (fact.where(F.col(CAT).isNotNull()).groupBy(CAT)
                .agg(money_sum("payment_value").alias("revenue"))
                .orderBy(F.desc("revenue"), CAT).limit(n))


def payment_share(fact: DataFrame) -> DataFrame:                  # G5, W8
    counts = fact.where(F.col("payment_type").isNotNull()).groupBy("payment_type") \
                 .agg(F.count(F.lit(1)).alias("n"))
    # share of total over an already-aggregated (tiny) table
    return counts.select("payment_type",
                         pct(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share_pct"))


def monthly_delivered_revenue(fact: DataFrame) -> DataFrame:      # G6
    return (fact.where(_delivered()).groupBy(F.col("year_month").alias("month"))
                .agg(money_sum("payment_value").alias("revenue")))


def data_range(fact: DataFrame) -> DataFrame:                     # G7
    ts = F.col("order_purchase_timestamp")
    return fact.agg(F.to_date(F.min(ts)).cast("string").alias("first_date"),
                    F.to_date(F.max(ts)).cast("string").alias("last_date"))


def revenue_by_state(fact: DataFrame) -> DataFrame:               # G24
    return (fact.where(F.col("customer_state").isNotNull()).groupBy("customer_state")
                .agg(money_sum("payment_value").alias("revenue"),
                     money_sum("freight_value").alias("total_freight"),
                     F.count_distinct("order_id").alias("orders")))


def orders_per_month(fact: DataFrame) -> DataFrame:               # G24
    return fact.groupBy("year_month").agg(F.count_distinct("order_id").alias("orders"),
                                          money_sum("freight_value").alias("total_freight"))


def payment_type_profile(fact: DataFrame) -> DataFrame:           # G25
    per_type = (fact.where(F.col("payment_type").isNotNull()).groupBy("payment_type")
                    .agg(F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("rev"),
                         rounded(F.avg("payment_value"), 2).alias("avg_payment_value"),
                         F.count_distinct("order_id").alias("orders"),
                         F.count_distinct(F.when(F.col("is_installment") == 1, F.col("order_id")))
                          .alias("installment_orders")))
    total = Window.partitionBy()
    return per_type.select(
        "payment_type", "avg_payment_value", "orders",
        F.round(F.col("rev") * 100 / F.sum("rev").over(total), 2).cast("double").alias("revenue_share_pct"),
        pct(F.col("installment_orders"), F.col("orders")).alias("installment_order_pct"))


def top_cities(fact: DataFrame, n: int = 10) -> DataFrame:        # G26
    return (fact.where(F.col("customer_city").isNotNull()).groupBy("customer_city")
                .agg(F.count_distinct("customer_unique_id").alias("customers"))
                .orderBy(F.desc("customers"), "customer_city").limit(n))


def cancellations_by_category(fact: DataFrame, n: int = 10) -> DataFrame:   # G27
    return (fact.where(F.col("order_status") == "canceled").groupBy(CAT)
                .agg(F.count_distinct("order_id").alias("canceled_orders"))
                .orderBy(F.desc("canceled_orders"), CAT).limit(n))


def items_per_order(fact: DataFrame) -> DataFrame:                # G28
    per_order = fact.groupBy("order_id").agg(F.count_distinct("order_item_id").alias("items"))
    dist = per_order.groupBy("items").agg(F.count(F.lit(1)).alias("orders"))
    return dist.select("items", "orders",
                       pct(F.col("orders"), F.sum("orders").over(Window.partitionBy())).alias("pct_orders"))


def pareto_products(fact: DataFrame, top_share: float = 0.2) -> DataFrame:  # G29, W9
    """Revenue share of the top ``top_share`` of products, via a distributed
    global rank (no single-partition window over all products)."""
    per_product = (fact.where(F.col("product_id").isNotNull()).groupBy("product_id")
                       .agg(F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("rev")))
    r = ranked(per_product, [F.desc("rev"), F.asc("product_id")])
    return r.agg(
        F.count(F.lit(1)).alias("products"),
        F.round(F.sum(F.when(F.col("_rn") <= F.floor(F.col("_n") * top_share), F.col("rev"))) * 100
                / F.sum("rev"), 2).cast("double").alias("top_revenue_share_pct"))


def revenue_curve(fact: DataFrame) -> DataFrame:                  # W9
    """Each product's place by revenue and the cumulative share of revenue up
    to it, by distributed ranking with running sums."""
    per_product = (fact.where(F.col("product_id").isNotNull()).groupBy("product_id")
                       .agg(F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("rev")))
    r = ranked(per_product, [F.desc("rev"), F.asc("product_id")], running_sums=["rev"])
    return r.select("product_id", F.col("_rn").alias("place"), F.round("rev", 2).cast("double").alias("revenue"),
                    F.round(F.try_divide(F.col("_cum_rev").cast("double") * 100, F.col("_all_rev").cast("double")), 4)
                     .alias("cumulative_pct"))


def order_peaks(fact: DataFrame) -> DataFrame:                    # G30
    return fact.groupBy("dayofweek", "hour").agg(F.count_distinct("order_id").alias("orders"))


def concentration(fact: DataFrame) -> DataFrame:                  # G37
    cats = (fact.groupBy(CAT).agg(F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("rev")))
    states = (fact.groupBy("customer_state").agg(F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("rev")))
    rc = cats.select("rev", F.row_number().over(Window.orderBy(F.desc("rev"), CAT)).alias("r"))
    rs = states.select("rev", F.row_number().over(Window.orderBy(F.desc("rev"), "customer_state")).alias("r"))
    c = rc.agg(F.round(F.sum(F.when(F.col("r") <= 10, F.col("rev"))) * 100 / F.sum("rev"), 2)
               .cast("double").alias("top10_category_share_pct"))
    s = rs.agg(F.round(F.sum(F.when(F.col("r") <= 3, F.col("rev"))) * 100 / F.sum("rev"), 2)
               .cast("double").alias("top3_state_share_pct"))
    return c.crossJoin(s)
