"""KPI queries (G1–G7, G24–G30, G37) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import kpis
from marketlens.operators.fact import enriched
from marketlens.operators.products import installment_value
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import query

MONEY = "CAST(round(sum(CAST({c} AS DECIMAL(18,6))), 2) AS DOUBLE)"


def msum(c: str) -> str:
    return MONEY.format(c=c)


@query("kpi_headline", "G1 Q4 Q6", over_fact(f"""
SELECT {msum('payment_value')} AS total_revenue,
       count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_unique_id) AS total_customers,
       count(DISTINCT seller_id) AS total_sellers,
       CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))) / count(DISTINCT order_id), 2) AS DOUBLE) AS avg_order_value,
       round(avg(CASE WHEN order_status = 'delivered' THEN 1.0 ELSE 0.0 END) * 100, 2) AS delivery_success_rate_pct,
       round(avg(CASE WHEN order_status = 'canceled' THEN 1.0 ELSE 0.0 END) * 100, 2) AS cancellation_rate_pct,
       round(avg(review_score), 2) AS avg_review_score,
       round(avg(is_returning_customer) * 100, 2) AS returning_customer_rate_pct,
       (SELECT round(sum(r) * 100.0 / count(*), 2) FROM (SELECT max(is_returning_customer) r FROM fact
          WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id)) AS returning_customer_share_pct,
       (SELECT CAST(round(sum(pv), 2) AS DOUBLE) FROM (SELECT max(CAST(payment_value AS DECIMAL(18,6))) pv
          FROM fact GROUP BY order_id, payment_sequential)) AS revenue_deduped,
       (SELECT round(sum(c) * 100.0 / count(*), 2) FROM (SELECT max(CASE WHEN order_status = 'canceled' THEN 1 ELSE 0 END) c
          FROM fact GROUP BY order_id)) AS cancellation_rate_orders_pct
FROM fact"""))
def kpi_headline(spark, sf_dir):
    return kpis.headline(enriched(spark, sf_dir))


@query("kpi_delivery", "G2", over_fact("""
SELECT round(avg(CASE WHEN delivery_status = 'Late' THEN 1.0 ELSE 0.0 END) * 100, 2) AS late_delivery_rate_pct,
       round(avg(delivery_days), 2) AS avg_delivery_days
FROM fact WHERE order_status = 'delivered'"""))
def kpi_delivery(spark, sf_dir):
    return kpis.delivery_headline(enriched(spark, sf_dir))


@query("kpi_top_states", "G3 T1 Q5", over_fact("""
SELECT customer_state, count(*) AS customers, count(DISTINCT customer_unique_id) AS distinct_customers
FROM fact WHERE customer_state IS NOT NULL GROUP BY customer_state
ORDER BY customers DESC, customer_state LIMIT 10"""))
def kpi_top_states(spark, sf_dir):
    return kpis.top_states(enriched(spark, sf_dir))


@query("kpi_top_categories", "G4 T1", over_fact(f"""
SELECT product_category_name_english, {msum('payment_value')} AS revenue
FROM fact WHERE product_category_name_english IS NOT NULL GROUP BY 1
ORDER BY revenue DESC, product_category_name_english LIMIT 10"""))
def kpi_top_categories(spark, sf_dir):
    return kpis.top_categories_by_revenue(enriched(spark, sf_dir))


@query("kpi_payment_share", "G5 W8", over_fact("""
SELECT payment_type, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct
FROM fact WHERE payment_type IS NOT NULL GROUP BY payment_type"""))
def kpi_payment_share(spark, sf_dir):
    return kpis.payment_share(enriched(spark, sf_dir))


@query("kpi_monthly_revenue", "G6 F1 J1 J2 P1 P2 P3 P5 P6 P7 P8 P9 P22 N1 N2 N3 N5", over_fact(f"""
SELECT year_month AS month, {msum('payment_value')} AS revenue
FROM fact WHERE order_status = 'delivered' GROUP BY year_month"""))
def kpi_monthly_revenue(spark, sf_dir):
    return kpis.monthly_delivered_revenue(enriched(spark, sf_dir))


@query("kpi_data_range", "G7", over_fact("""
SELECT CAST(CAST(min(order_purchase_timestamp) AS DATE) AS VARCHAR) AS first_date,
       CAST(CAST(max(order_purchase_timestamp) AS DATE) AS VARCHAR) AS last_date FROM fact"""))
def kpi_data_range(spark, sf_dir):
    return kpis.data_range(enriched(spark, sf_dir))


@query("kpi_state_revenue", "G24", over_fact(f"""
SELECT customer_state, {msum('payment_value')} AS revenue, {msum('freight_value')} AS total_freight,
       count(DISTINCT order_id) AS orders
FROM fact WHERE customer_state IS NOT NULL GROUP BY customer_state"""))
def kpi_state_revenue(spark, sf_dir):
    return kpis.revenue_by_state(enriched(spark, sf_dir))


@query("kpi_orders_per_month", "G24", over_fact(f"""
SELECT year_month, count(DISTINCT order_id) AS orders, {msum('freight_value')} AS total_freight
FROM fact GROUP BY year_month"""))
def kpi_orders_per_month(spark, sf_dir):
    return kpis.orders_per_month(enriched(spark, sf_dir))


@query("kpi_payment_profile", "G25", over_fact("""
SELECT payment_type, avg_payment_value, orders,
       CAST(round(rev * 100 / sum(rev) OVER (), 2) AS DOUBLE) AS revenue_share_pct,
       round(installment_orders * 100.0 / orders, 2) AS installment_order_pct
FROM (SELECT payment_type, sum(CAST(payment_value AS DECIMAL(18,6))) AS rev,
             round(avg(payment_value), 2) AS avg_payment_value,
             count(DISTINCT order_id) AS orders,
             count(DISTINCT CASE WHEN is_installment = 1 THEN order_id END) AS installment_orders
      FROM fact WHERE payment_type IS NOT NULL GROUP BY payment_type)"""))
def kpi_payment_profile(spark, sf_dir):
    return kpis.payment_type_profile(enriched(spark, sf_dir))


@query("kpi_top_cities", "G26", over_fact("""
SELECT customer_city, count(DISTINCT customer_unique_id) AS customers
FROM fact WHERE customer_city IS NOT NULL GROUP BY customer_city
ORDER BY customers DESC, customer_city LIMIT 10"""))
def kpi_top_cities(spark, sf_dir):
    return kpis.top_cities(enriched(spark, sf_dir))


@query("kpi_cancellations_by_category", "G27", over_fact("""
SELECT product_category_name_english, count(DISTINCT order_id) AS canceled_orders
FROM fact WHERE order_status = 'canceled' GROUP BY 1
ORDER BY canceled_orders DESC, product_category_name_english LIMIT 10"""))
def kpi_cancellations_by_category(spark, sf_dir):
    return kpis.cancellations_by_category(enriched(spark, sf_dir))


@query("kpi_items_per_order", "G28", over_fact("""
SELECT items, count(*) AS orders, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct_orders
FROM (SELECT order_id, count(DISTINCT order_item_id) AS items FROM fact GROUP BY order_id)
GROUP BY items"""))
def kpi_items_per_order(spark, sf_dir):
    return kpis.items_per_order(enriched(spark, sf_dir))


@query("kpi_pareto_products", "G29 W9", over_fact("""
SELECT count(*) AS products,
       CAST(round(sum(CASE WHEN rn <= floor(n * 0.2) THEN rev END) * 100 / sum(rev), 2) AS DOUBLE) AS top_revenue_share_pct
FROM (SELECT rev, row_number() OVER (ORDER BY rev DESC, product_id) AS rn, count(*) OVER () AS n
      FROM (SELECT product_id, sum(CAST(payment_value AS DECIMAL(18,6))) AS rev FROM fact
            WHERE product_id IS NOT NULL GROUP BY product_id))"""))
def kpi_pareto_products(spark, sf_dir):
    return kpis.pareto_products(enriched(spark, sf_dir))


@query("kpi_revenue_curve", "W9", over_fact("""
SELECT product_id, row_number() OVER (ORDER BY rev DESC, product_id) AS place, CAST(round(rev, 2) AS DOUBLE) AS revenue,
       round(CAST(sum(rev) OVER (ORDER BY rev DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100
             / CAST(sum(rev) OVER () AS DOUBLE), 4) AS cumulative_pct
FROM (SELECT product_id, sum(CAST(payment_value AS DECIMAL(18,6))) AS rev FROM fact
      WHERE product_id IS NOT NULL GROUP BY product_id)"""))
def kpi_revenue_curve(spark, sf_dir):
    return kpis.revenue_curve(enriched(spark, sf_dir))


_FACT_ROW = ("order_id", "order_item_id", "product_id", "seller_id", "year", "month", "quarter", "week", "dayofyear",
             "dayofweek", "hour", "is_weekend", "delivery_days", "estimated_delivery_days", "delivery_delay",
             "carrier_pickup_days", "transit_days", "delivery_status", "Customer_Type", "is_returning_customer",
             "payment_methods_per_order", "is_multi_payment", "is_installment", "has_comment", "comment_length",
             "sentiment", "product_category_name_english")
_FACT_MONEY = ("price", "freight_value", "payment_value", "total_item_value", "freight_pct")


@query("fact_rows", "P1 P2 P3 P5 P6 P7 P8 P9 N1 N2 N3 N5 J2", over_fact(
    f"SELECT {', '.join(_FACT_ROW)}, {', '.join(f'round({c}, 8) AS {c}' for c in _FACT_MONEY)} FROM fact"))
def fact_rows(spark, sf_dir):
    """Every derived column of every order line."""
    return enriched(spark, sf_dir).select(*_FACT_ROW, *[F.round(c, 8).alias(c) for c in _FACT_MONEY])


@query("fact_installment_value", "P15", over_fact("""
SELECT payment_type, count(installment_value) AS lines, round(max(installment_value), 4) AS largest,
       round(min(installment_value), 4) AS smallest
FROM (SELECT payment_type, payment_value / nullif(payment_installments, 0) AS installment_value FROM fact)
GROUP BY payment_type"""))
def fact_installment_value(spark, sf_dir):
    rows = installment_value(enriched(spark, sf_dir))
    return rows.groupBy("payment_type").agg(
        F.count("installment_value").alias("lines"), F.round(F.max("installment_value"), 4).alias("largest"),
        F.round(F.min("installment_value"), 4).alias("smallest"))


@query("kpi_order_peaks", "G30", over_fact("""
SELECT dayofweek, hour, count(DISTINCT order_id) AS orders FROM fact GROUP BY dayofweek, hour"""))
def kpi_order_peaks(spark, sf_dir):
    return kpis.order_peaks(enriched(spark, sf_dir))


@query("kpi_concentration", "G37", over_fact("""
SELECT c.top10_category_share_pct, s.top3_state_share_pct FROM
 (SELECT CAST(round(sum(CASE WHEN r <= 10 THEN rev END) * 100 / sum(rev), 2) AS DOUBLE) AS top10_category_share_pct
  FROM (SELECT rev, row_number() OVER (ORDER BY rev DESC, k) r FROM
        (SELECT product_category_name_english k, sum(CAST(payment_value AS DECIMAL(18,6))) rev FROM fact GROUP BY 1))) c,
 (SELECT CAST(round(sum(CASE WHEN r <= 3 THEN rev END) * 100 / sum(rev), 2) AS DOUBLE) AS top3_state_share_pct
  FROM (SELECT rev, row_number() OVER (ORDER BY rev DESC, k) r FROM
        (SELECT customer_state k, sum(CAST(payment_value AS DECIMAL(18,6))) rev FROM fact GROUP BY 1))) s"""))
def kpi_concentration(spark, sf_dir):
    return kpis.concentration(enriched(spark, sf_dir))
