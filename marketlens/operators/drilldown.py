"""Category × state drill-down.

``summary`` is the materialisable rollup the dashboard reads; ``selection``
re-aggregates it the way the dashboard does (item/review weighted), and
``exact_cube`` recomputes every selection from the fact in one ``cube``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.money import money_sum, rounded

CAT = "product_category_name_english"
def _labelled():
    return F.col("sentiment").isin("Positive", "Negative", "Neutral")
ALL = "ALL"


def slice_filter(df: DataFrame, category: str | None = None, state: str | None = None,
                 cat_col: str = "category", state_col: str = "state") -> DataFrame:   # F3
    if category not in (None, ALL):
        df = df.where(F.col(cat_col) == category)
    if state not in (None, ALL):
        df = df.where(F.col(state_col) == state)
    return df


def _cell_metrics():
    delivered = F.col("order_delivered_customer_date").isNotNull()
    n = F.count(F.lit(1))
    n_lab = F.sum(_labelled().cast("int"))

    def share(label):
        return F.when(n_lab > 0, F.round(F.sum((F.col("sentiment") == label).cast("int")) * 100.0 / n_lab, 1))

    return [
        money_sum("payment_value").alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
        n.alias("total_items"),
        rounded(F.avg("price"), 2).alias("avg_price"),
        rounded(F.avg("freight_value"), 2).alias("avg_freight"),
        rounded(F.avg("freight_pct"), 1).alias("freight_pct"),
        F.round(F.sum(delivered.cast("int")) * 100.0 / n, 1).alias("delivery_success_rate"),
        F.round(F.sum((F.col("delivery_status") == "Late").cast("int")) * 100.0 / n, 1).alias("late_delivery_rate"),
        F.coalesce(rounded(F.avg(F.when(delivered, F.col("delivery_days"))), 1), F.lit(0.0)).alias("avg_delivery_days"),
        F.coalesce(share("Positive"), F.lit(75.0)).alias("positive_sentiment_pct"),
        F.coalesce(share("Negative"), F.lit(15.0)).alias("negative_sentiment_pct"),
        F.coalesce(share("Neutral"), F.lit(10.0)).alias("neutral_sentiment_pct"),
        n_lab.cast("long").alias("total_reviews"),
        rounded(F.avg("is_returning_customer") * 100, 1).alias("returning_customer_pct"),
    ]


def summary(fact: DataFrame) -> DataFrame:                                       # G8
    return (fact.where(F.col(CAT).isNotNull() & F.col("customer_state").isNotNull())
                .groupBy(F.col(CAT).alias("category"), F.col("customer_state").alias("state"))
                .agg(*_cell_metrics()))


def monthly(fact: DataFrame) -> DataFrame:                                       # G9
    return (fact.where(F.col(CAT).isNotNull() & F.col("customer_state").isNotNull()
                       & F.col("year_month").isNotNull())
                .groupBy(F.col(CAT).alias("category"), F.col("customer_state").alias("state"), "year_month")
                .agg(money_sum("payment_value").alias("revenue"),
                     F.count_distinct("order_id").alias("orders"),
                     rounded(F.avg("review_score"), 4).alias("avg_sentiment")))


def _weighted(c: str, w: str):
    return F.try_divide(F.sum(F.col(c) * F.col(w)), F.sum(w).cast("double"))


def _selection_metrics():
    items = F.sum("total_items")
    reviews = F.sum("total_reviews")
    avg_price = F.coalesce(_weighted("avg_price", "total_items"), F.lit(0.0))
    avg_freight = F.coalesce(_weighted("avg_freight", "total_items"), F.lit(0.0))
    pos = F.when(reviews > 0, _weighted("positive_sentiment_pct", "total_reviews")).otherwise(75.0)
    neg = F.when(reviews > 0, _weighted("negative_sentiment_pct", "total_reviews")).otherwise(15.0)
    return [
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        items.alias("total_items"),
        F.round(avg_price, 2).alias("avg_price"),
        F.round(avg_freight, 2).alias("avg_freight"),
        F.round(F.when(avg_price > 0, avg_freight / avg_price * 100).otherwise(0.0), 2).alias("freight_pct"),
        F.round(F.coalesce(_weighted("delivery_success_rate", "total_items"), F.lit(0.0)), 2).alias("delivery_success_rate"),
        F.round(F.coalesce(_weighted("late_delivery_rate", "total_items"), F.lit(0.0)), 2).alias("late_delivery_rate"),
        F.round(F.coalesce(_weighted("avg_delivery_days", "total_items"), F.lit(0.0)), 2).alias("avg_delivery_days"),
        F.round(pos, 2).alias("positive_sentiment_pct"),
        F.round(neg, 2).alias("negative_sentiment_pct"),
        F.round(F.greatest(F.lit(0.0), 100.0 - pos - neg), 2).alias("neutral_sentiment_pct"),
        reviews.alias("total_reviews"),
    ]


def selection(summary_df: DataFrame, category: str | None = None, state: str | None = None) -> DataFrame:  # G10
    """Dashboard snapshot for one selection (``None``/'ALL' = no filter)."""
    return slice_filter(summary_df, category, state).agg(*_selection_metrics())


def all_selections(summary_df: DataFrame) -> DataFrame:                          # G10 for every selection
    """Every dashboard selection at once: the four cells of cube(category, state)."""
    return (summary_df.cube("category", "state")
            .agg(*_selection_metrics(), F.grouping_id().alias("_g"))
            .withColumn("category", F.when(F.col("_g").bitwiseAND(2) > 0, ALL).otherwise(F.col("category")))
            .withColumn("state", F.when(F.col("_g").bitwiseAND(1) > 0, ALL).otherwise(F.col("state")))
            .drop("_g"))


def state_breakdown(summary_df: DataFrame, n: int = 10) -> DataFrame:            # G11 (category chosen)
    """Top-n states by revenue for every category (unweighted pct means)."""
    per = (summary_df.groupBy("category", "state")
                     .agg(F.round(F.sum("total_revenue"), 2).alias("revenue"),
                          F.sum("total_orders").alias("orders"),
                          F.round(F.avg("positive_sentiment_pct"), 2).alias("pos_sentiment"),
                          F.round(F.avg("late_delivery_rate"), 2).alias("late_pct")))
    w = Window.partitionBy("category").orderBy(F.desc("revenue"), "state")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def category_breakdown(summary_df: DataFrame, n: int = 10) -> DataFrame:         # G11 (state chosen)
    per = (summary_df.groupBy("state", "category")
                     .agg(F.round(F.sum("total_revenue"), 2).alias("revenue"),
                          F.sum("total_orders").alias("orders"),
                          F.round(F.avg("positive_sentiment_pct"), 2).alias("pos_sentiment")))
    w = Window.partitionBy("state").orderBy(F.desc("revenue"), "category")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def monthly_trend(monthly_df: DataFrame, category: str | None = None, state: str | None = None) -> DataFrame:  # G12
    return (slice_filter(monthly_df, category, state).groupBy("year_month")
            .agg(F.round(F.sum("revenue"), 2).alias("revenue")))


def all_monthly_trends(monthly_df: DataFrame) -> DataFrame:                     # G12 for every selection
    return (monthly_df.cube("category", "state", "year_month")
            .agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.grouping_id().alias("_g"))
            .where(F.col("_g").bitwiseAND(1) == 0)
            .withColumn("category", F.when(F.col("_g").bitwiseAND(4) > 0, ALL).otherwise(F.col("category")))
            .withColumn("state", F.when(F.col("_g").bitwiseAND(2) > 0, ALL).otherwise(F.col("state")))
            .drop("_g"))


def exact_cube(fact: DataFrame) -> DataFrame:                                    # G38
    """Every (category|ALL, state|ALL) cell recomputed from order lines, so
    distinct orders are not double counted across cells (unlike G10)."""
    return (fact.where(F.col(CAT).isNotNull() & F.col("customer_state").isNotNull())
                .cube(F.col(CAT).alias("category"), F.col("customer_state").alias("state"))
                .agg(*_cell_metrics(), F.grouping_id().alias("_g"))
                .withColumn("category", F.when(F.col("_g").bitwiseAND(2) > 0, ALL).otherwise(F.col("category")))
                .withColumn("state", F.when(F.col("_g").bitwiseAND(1) > 0, ALL).otherwise(F.col("state")))
                .drop("_g"))


def sample_reviews(fact: DataFrame, texts: DataFrame, per_side: int = 2) -> DataFrame:   # W4
    """First ``per_side`` positive and negative commented reviews per
    (category, state), in order-line order.  The rank limit is
    also applied before the shuffle, so a hot cell sends at most ``per_side``
    rows from each task; only the kept rows (≤ 2·per_side per cell) are
    collected."""
    order = [F.col("order_id").asc(), F.col("order_item_id").asc(),
             F.col("product_id").asc(), F.col("seller_id").asc()]
    commented = fact.where(F.col("has_comment") == 1).select(
        F.col(CAT).alias("category"), F.col("customer_state").alias("state"),
        "sentiment", "order_id", "order_item_id", "product_id", "seller_id", "review_key")
    cells = commented.select("category", "state").distinct()
    sided = commented.where(F.col("sentiment").isin("Positive", "Negative"))
    first = Window.partitionBy("category", "state", "sentiment").orderBy(*order)
    top = sided.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= per_side)
    top = top.join(texts.select("review_key", "review_text"), "review_key")  # AQE broadcasts the small side
    item = F.struct("_rn", "review_text")
    lists = top.groupBy("category", "state").agg(
        F.array_sort(F.collect_list(F.when(F.col("sentiment") == "Positive", item))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("sentiment") == "Negative", item))).alias("n"))
    out = cells.join(lists, ["category", "state"], "left")
    return out.select(
        F.concat_ws("___", "category", "state").alias("key"),
        F.coalesce(F.transform("p", lambda s: s["review_text"]), F.array().cast("array<string>")).alias("positive"),
        F.coalesce(F.transform("n", lambda s: s["review_text"]), F.array().cast("array<string>")).alias("negative"))
