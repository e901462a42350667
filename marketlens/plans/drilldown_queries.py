"""Drill-down queries (G8–G12, G38, W4) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import drilldown as dd
from marketlens.operators.enrich import review_text_dim
from marketlens.operators.fact import enriched
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import query


def _cell_sql(group_sql: str) -> str:
    return f"""
  CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS total_revenue,
  count(DISTINCT order_id) AS total_orders,
  count(*) AS total_items,
  round(avg(price), 2) AS avg_price,
  round(avg(freight_value), 2) AS avg_freight,
  round(avg(freight_pct), 1) AS freight_pct,
  round(sum(CASE WHEN order_delivered_customer_date IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS delivery_success_rate,
  round(sum(CASE WHEN delivery_status = 'Late' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS late_delivery_rate,
  coalesce(round(avg(CASE WHEN order_delivered_customer_date IS NOT NULL THEN delivery_days END), 1), 0.0) AS avg_delivery_days,
  coalesce(round(sum(CASE WHEN sentiment = 'Positive' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END), 0), 1), 75.0) AS positive_sentiment_pct,
  coalesce(round(sum(CASE WHEN sentiment = 'Negative' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END), 0), 1), 15.0) AS negative_sentiment_pct,
  coalesce(round(sum(CASE WHEN sentiment = 'Neutral' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END), 0), 1), 10.0) AS neutral_sentiment_pct,
  CAST(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END) AS BIGINT) AS total_reviews,
  round(avg(is_returning_customer) * 100, 1) AS returning_customer_pct
FROM fact WHERE product_category_name_english IS NOT NULL AND customer_state IS NOT NULL
GROUP BY {group_sql}"""


SUMMARY_CTE = f"""summary AS (
SELECT product_category_name_english AS category, customer_state AS state, {_cell_sql('1, 2')})"""

MONTHLY_CTE = """monthly AS (
SELECT product_category_name_english AS category, customer_state AS state, year_month,
       CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders, round(avg(review_score), 4) AS avg_sentiment
FROM fact WHERE product_category_name_english IS NOT NULL AND customer_state IS NOT NULL AND year_month IS NOT NULL
GROUP BY 1, 2, 3)"""

SELECTION_SQL = """
  round(sum(total_revenue), 2) AS total_revenue,
  CAST(sum(total_orders) AS BIGINT) AS total_orders,
  CAST(sum(total_items) AS BIGINT) AS total_items,
  round(coalesce(sum(avg_price * total_items) / sum(total_items), 0.0), 2) AS avg_price,
  round(coalesce(sum(avg_freight * total_items) / sum(total_items), 0.0), 2) AS avg_freight,
  round(CASE WHEN coalesce(sum(avg_price * total_items) / sum(total_items), 0.0) > 0
             THEN coalesce(sum(avg_freight * total_items) / sum(total_items), 0.0)
                  / coalesce(sum(avg_price * total_items) / sum(total_items), 0.0) * 100 ELSE 0.0 END, 2) AS freight_pct,
  round(coalesce(sum(delivery_success_rate * total_items) / sum(total_items), 0.0), 2) AS delivery_success_rate,
  round(coalesce(sum(late_delivery_rate * total_items) / sum(total_items), 0.0), 2) AS late_delivery_rate,
  round(coalesce(sum(avg_delivery_days * total_items) / sum(total_items), 0.0), 2) AS avg_delivery_days,
  round(CASE WHEN sum(total_reviews) > 0 THEN sum(positive_sentiment_pct * total_reviews) / sum(total_reviews) ELSE 75.0 END, 2) AS positive_sentiment_pct,
  round(CASE WHEN sum(total_reviews) > 0 THEN sum(negative_sentiment_pct * total_reviews) / sum(total_reviews) ELSE 15.0 END, 2) AS negative_sentiment_pct,
  round(greatest(0.0, 100.0
      - CASE WHEN sum(total_reviews) > 0 THEN sum(positive_sentiment_pct * total_reviews) / sum(total_reviews) ELSE 75.0 END
      - CASE WHEN sum(total_reviews) > 0 THEN sum(negative_sentiment_pct * total_reviews) / sum(total_reviews) ELSE 15.0 END), 2) AS neutral_sentiment_pct,
  CAST(sum(total_reviews) AS BIGINT) AS total_reviews"""


@query("drill_summary", "G8", over_fact("SELECT * FROM summary", SUMMARY_CTE))
def drill_summary(spark, sf_dir):
    return dd.summary(enriched(spark, sf_dir))


@query("drill_monthly", "G9", over_fact("SELECT * FROM monthly", MONTHLY_CTE))
def drill_monthly(spark, sf_dir):
    return dd.monthly(enriched(spark, sf_dir))


@query("drill_selections", "G10 F3 J8", over_fact(f"""
SELECT CASE WHEN grouping(category, state) & 2 > 0 THEN 'ALL' ELSE category END AS category,
       CASE WHEN grouping(category, state) & 1 > 0 THEN 'ALL' ELSE state END AS state,
       {SELECTION_SQL}
FROM summary GROUP BY CUBE (category, state)""", SUMMARY_CTE))
def drill_selections(spark, sf_dir):
    return dd.all_selections(dd.summary(enriched(spark, sf_dir)))


_FIRST_CELL = """pick AS (SELECT category AS pc, state AS ps FROM summary ORDER BY total_revenue DESC, category, state LIMIT 1)"""


@query("drill_one_selection", "F3 G10", over_fact("""
SELECT category, state, total_revenue, total_orders, total_items, avg_price, total_reviews
FROM summary, pick WHERE category = pc OR state = ps""", SUMMARY_CTE + "," + _FIRST_CELL))
def drill_one_selection(spark, sf_dir):
    """The cells of one category and of one state, as a user of the drill-down
    picks them: those of the cell with the most revenue."""
    s = dd.summary(enriched(spark, sf_dir))
    pick = s.orderBy(F.desc("total_revenue"), "category", "state").first()
    cols = ["category", "state", "total_revenue", "total_orders", "total_items", "avg_price", "total_reviews"]
    if pick is None:
        return s.select(*cols)
    by_category = dd.slice_filter(s, category=pick["category"])
    by_state = dd.slice_filter(s, state=pick["state"]).where(F.col("category") != pick["category"])
    return by_category.unionByName(by_state).select(*cols)


@query("drill_state_breakdown", "G11", over_fact("""
SELECT * FROM (SELECT category, state, round(sum(total_revenue), 2) AS revenue, CAST(sum(total_orders) AS BIGINT) AS orders,
       round(avg(positive_sentiment_pct), 2) AS pos_sentiment, round(avg(late_delivery_rate), 2) AS late_pct,
       row_number() OVER (PARTITION BY category ORDER BY round(sum(total_revenue), 2) DESC, state) AS rank
FROM summary GROUP BY category, state) WHERE rank <= 10""", SUMMARY_CTE))
def drill_state_breakdown(spark, sf_dir):
    return dd.state_breakdown(dd.summary(enriched(spark, sf_dir)))


@query("drill_category_breakdown", "G11", over_fact("""
SELECT * FROM (SELECT state, category, round(sum(total_revenue), 2) AS revenue, CAST(sum(total_orders) AS BIGINT) AS orders,
       round(avg(positive_sentiment_pct), 2) AS pos_sentiment,
       row_number() OVER (PARTITION BY state ORDER BY round(sum(total_revenue), 2) DESC, category) AS rank
FROM summary GROUP BY state, category) WHERE rank <= 10""", SUMMARY_CTE))
def drill_category_breakdown(spark, sf_dir):
    return dd.category_breakdown(dd.summary(enriched(spark, sf_dir)))


@query("drill_monthly_trends", "G12", over_fact("""
SELECT CASE WHEN grouping(category, state, year_month) & 4 > 0 THEN 'ALL' ELSE category END AS category,
       CASE WHEN grouping(category, state, year_month) & 2 > 0 THEN 'ALL' ELSE state END AS state,
       year_month, round(sum(revenue), 2) AS revenue
FROM monthly GROUP BY CUBE (category, state, year_month)
HAVING grouping(category, state, year_month) & 1 = 0""", MONTHLY_CTE))
def drill_monthly_trends(spark, sf_dir):
    return dd.all_monthly_trends(dd.monthly(enriched(spark, sf_dir)))


@query("drill_exact_cube", "G38", over_fact(f"""
SELECT CASE WHEN grouping(product_category_name_english, customer_state) & 2 > 0 THEN 'ALL' ELSE product_category_name_english END AS category,
       CASE WHEN grouping(product_category_name_english, customer_state) & 1 > 0 THEN 'ALL' ELSE customer_state END AS state,
       {_cell_sql('CUBE (product_category_name_english, customer_state)')}"""))
def drill_exact_cube(spark, sf_dir):
    return dd.exact_cube(enriched(spark, sf_dir))


@query("drill_sample_reviews", "W4 F7", over_fact("""
SELECT c.category || '___' || c.state AS key,
       coalesce(p.pos, []::VARCHAR[]) AS positive, coalesce(p.neg, []::VARCHAR[]) AS negative
FROM (SELECT DISTINCT category, state FROM commented) c
LEFT JOIN (SELECT category, state,
                  list(review_text ORDER BY rn) FILTER (WHERE sentiment = 'Positive') AS pos,
                  list(review_text ORDER BY rn) FILTER (WHERE sentiment = 'Negative') AS neg
           FROM top WHERE rn <= 2 GROUP BY category, state) p USING (category, state)""", """
commented AS (SELECT product_category_name_english AS category, customer_state AS state, sentiment,
                     order_id, order_item_id, product_id, seller_id, review_text FROM fact WHERE has_comment = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY category, state, sentiment
                                     ORDER BY order_id, order_item_id, product_id, seller_id) AS rn
        FROM commented WHERE sentiment IN ('Positive', 'Negative'))"""))
def drill_sample_reviews(spark, sf_dir):
    return dd.sample_reviews(enriched(spark, sf_dir), review_text_dim(spark, sf_dir))
