"""Customer queries (G31–G34, W6, W10, J7, P16) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions.money import rounded
from marketlens.operators import customers as cu
from marketlens.operators.fact import enriched
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import query

RFM_CTES = """
snap AS (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS s FROM fact),
rfm AS (SELECT customer_unique_id,
               CAST(floor((epoch_us(any_value(s)) - epoch_us(max(order_purchase_timestamp))) / 86400000000) AS INTEGER) AS recency,
               count(DISTINCT order_id) AS frequency,
               sum(CAST(payment_value AS DECIMAL(18,6))) AS monetary,
               CAST(sum(CAST(payment_value AS DECIMAL(18,6))) AS DOUBLE) / count(DISTINCT order_id) AS aov
        FROM fact, snap WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id),
scored AS (SELECT *, r_score + f_score + m_score AS rfm_score,
                  CASE WHEN r_score + f_score + m_score >= 12 THEN 'Champions'
                       WHEN r_score + f_score + m_score >= 9 THEN 'Loyal'
                       WHEN r_score + f_score + m_score >= 6 THEN 'At Risk' ELSE 'Lost' END AS segment
           FROM (SELECT *, ntile(5) OVER (ORDER BY recency DESC, customer_unique_id) AS r_score,
                           ntile(5) OVER (ORDER BY frequency, customer_unique_id) AS f_score,
                           ntile(5) OVER (ORDER BY monetary, customer_unique_id) AS m_score FROM rfm))"""

NEXT_CTE = """
co AS (SELECT customer_unique_id, order_id, min(order_purchase_timestamp) AS purchased_at FROM fact
       WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id, order_id),
nxt AS (SELECT customer_unique_id, order_id,
               lead(order_id) OVER w AS next_order_id,
               CAST(floor((epoch_us(lead(purchased_at) OVER w) - epoch_us(purchased_at)) / 86400000000) AS INTEGER) AS days_to_next_order
        FROM co WINDOW w AS (PARTITION BY customer_unique_id ORDER BY purchased_at, order_id))"""


@query("cust_rfm_scores", "W6 G31", over_fact("""
SELECT customer_unique_id, recency, frequency, CAST(round(monetary, 2) AS DOUBLE) AS monetary,
       round(aov, 2) AS aov, r_score, f_score, m_score, rfm_score, segment FROM scored""", RFM_CTES))
def cust_rfm_scores(spark, sf_dir):
    s = cu.rfm_scores(cu.rfm_base(enriched(spark, sf_dir)))
    return s.select("customer_unique_id", "recency", "frequency",
                    F.round("monetary", 2).cast("double").alias("monetary"),
                    rounded(F.col("aov"), 2).alias("aov"),
                    "r_score", "f_score", "m_score", "rfm_score", "segment")


@query("cust_rfm_summary", "G31 J8", over_fact("""
SELECT count(*) AS customers, round(avg(recency), 2) AS mean_recency, round(stddev_samp(recency), 2) AS std_recency,
       round(avg(frequency), 4) AS mean_frequency, max(frequency) AS max_frequency,
       round(avg(CAST(monetary AS DOUBLE)), 2) AS mean_monetary, CAST(round(max(monetary), 2) AS DOUBLE) AS max_monetary,
       round(avg(aov), 2) AS mean_aov,
       round(avg(CASE WHEN frequency > 1 THEN 1.0 ELSE 0.0 END) * 100, 2) AS repeat_customer_pct,
       quantile_cont(frequency, 0.5) AS median_frequency,
       round(quantile_cont(CAST(monetary AS DOUBLE), 0.5), 2) AS median_monetary
FROM rfm""", RFM_CTES))
def cust_rfm_summary(spark, sf_dir):
    return cu.rfm_summary(cu.rfm_base(enriched(spark, sf_dir)))


@query("cust_segments", "G32", over_fact("""
SELECT segment, count(*) AS customers, round(avg(CAST(monetary AS DOUBLE)), 2) AS avg_monetary,
       CAST(round(sum(monetary), 2) AS DOUBLE) AS total_monetary,
       round(avg(CASE WHEN frequency > 1 THEN 1.0 ELSE 0.0 END) * 100, 2) AS repeat_rate_pct
FROM scored GROUP BY segment""", RFM_CTES))
def cust_segments(spark, sf_dir):
    return cu.segment_summary(cu.rfm_scores(cu.rfm_base(enriched(spark, sf_dir))))


@query("cust_late_vs_on_time", "G33", over_fact("""
SELECT delivery_status, round(avg(review_score), 4) AS avg_review_score, count(*) AS rows
FROM fact WHERE delivery_status IN ('Late', 'On Time') GROUP BY delivery_status"""))
def cust_late_vs_on_time(spark, sf_dir):
    return cu.late_vs_on_time_score(enriched(spark, sf_dir))


@query("cust_next_purchase", "W10 J7", over_fact("""
SELECT customer_unique_id, order_id, next_order_id, days_to_next_order,
       CASE WHEN days_to_next_order <= 90 THEN 1 ELSE 0 END AS repeat_90d FROM nxt""", NEXT_CTE))
def cust_next_purchase(spark, sf_dir):
    return cu.next_purchase(enriched(spark, sf_dir)).drop("purchased_at")


@query("cust_repeat_by_margin", "G34 P16", over_fact("""
SELECT margin_bucket, count(*) AS rows,
       round(avg(CASE WHEN days_to_next_order <= 90 THEN 1 ELSE 0 END) * 100, 2) AS repeat_90d_pct
FROM (SELECT f.order_id,
             CASE WHEN m > 2 THEN 'comfortable (>2 days)' WHEN m < 0 THEN 'late dispatch' ELSE 'tight (0-2 days)' END AS margin_bucket
      FROM (SELECT order_id, CAST(floor((epoch_us(shipping_limit_date) - epoch_us(order_delivered_carrier_date)) / 86400000000) AS INTEGER) AS m
            FROM fact) f WHERE m IS NOT NULL) r
JOIN nxt USING (order_id)
GROUP BY margin_bucket""", NEXT_CTE))
def cust_repeat_by_margin(spark, sf_dir):
    return cu.repeat_by_margin(enriched(spark, sf_dir))
