"""SQL oracle text: the same enriched fact written independently as DuckDB
SQL, so each Spark query can be checked against a second engine.

``MASTER_SQL`` is the fixture mapping; ``FACT_CTES`` applies the cleaning
steps in the same order as ``operators.enrich``.
"""
from __future__ import annotations

MASTER_SQL = """
SELECT
  o_orderkey AS order_id,
  c_custkey AS customer_unique_id,
  n_name AS customer_state,
  r_name AS customer_city,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS order_purchase_timestamp,
  o_orderdate + (o_orderkey % 24 + l_partkey % 48) * INTERVAL '1' HOUR AS order_approved_at,
  CASE WHEN l_linestatus = 'F' THEN o_orderdate + (48 + (l_partkey + l_suppkey) % 120) * INTERVAL '1' HOUR END AS order_delivered_carrier_date,
  CASE WHEN l_linestatus = 'F' THEN o_orderdate + (96 + (l_orderkey * 7 + l_partkey * 3 + l_suppkey) % 720) * INTERVAL '1' HOUR END AS order_delivered_customer_date,
  o_orderdate + 600 * INTERVAL '1' HOUR AS order_estimated_delivery_date,
  o_orderdate + 144 * INTERVAL '1' HOUR AS shipping_limit_date,
  l_linenumber AS order_item_id,
  l_partkey AS product_id,
  l_suppkey AS seller_id,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_extendedprice * l_tax END AS freight_value,
  CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_type END AS product_category_name_english,
  p_size AS product_size,
  l_linenumber AS payment_sequential,
  o_orderpriority AS payment_type,
  CAST(l_quantity AS INT) % 10 + 1 AS payment_installments,
  CASE WHEN (l_orderkey + l_partkey) % 211 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS payment_value,
  l_orderkey AS review_id,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE CAST(1 + (l_orderkey * 13) % 5 AS INT) END AS review_score,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE d.text END AS review_comment_message
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey
LEFT JOIN documents d ON d.doc_id = l_orderkey % (SELECT count(*) FROM documents)
"""


def _days(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS INTEGER)"


P = "order_purchase_timestamp"

FACT_CTES = f"""
master AS ({MASTER_SQL}),
f1 AS (
  SELECT *,
    year({P}) AS year, month({P}) AS month, quarter({P}) AS quarter,
    isodow({P}) - 1 AS dayofweek, dayofyear({P}) AS dayofyear, hour({P}) AS hour,
    weekofyear({P}) AS week,
    CASE WHEN isodow({P}) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    strftime({P}, '%Y-%m') AS year_month,
    {_days(P, 'order_delivered_customer_date')} AS delivery_days,
    {_days(P, 'order_estimated_delivery_date')} AS estimated_delivery_days,
    {_days('order_estimated_delivery_date', 'order_delivered_customer_date')} AS delivery_delay,
    {_days('order_approved_at', 'order_delivered_carrier_date')} AS carrier_pickup_days,
    {_days('order_delivered_carrier_date', 'order_delivered_customer_date')} AS transit_days,
    regexp_replace(' ' || CASE WHEN review_comment_message IS NULL OR review_comment_message = 'No Review'
                               THEN '' ELSE review_comment_message END,
                   '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS review_text
  FROM master
),
f2 AS (
  SELECT f1.*,
    CASE WHEN order_delivered_customer_date IS NULL THEN 'Not Delivered Yet'
         WHEN delivery_delay > 0 THEN 'Late' ELSE 'On Time' END AS delivery_status,
    CASE WHEN co.n > 1 THEN 'Returning' ELSE 'New' END AS Customer_Type,
    CASE WHEN co.n > 1 THEN 1 ELSE 0 END AS is_returning_customer,
    max(payment_sequential) OVER (PARTITION BY order_id) AS payment_methods_per_order,
    CASE WHEN payment_installments > 1 THEN 1 ELSE 0 END AS is_installment,
    CASE WHEN review_text <> '' THEN 1 ELSE 0 END AS has_comment,
    length(review_text) AS comment_length,
    CASE WHEN review_score IS NULL THEN 'Unknown' WHEN review_score <= 2 THEN 'Negative'
         WHEN review_score = 3 THEN 'Neutral' ELSE 'Positive' END AS sentiment
  FROM f1 LEFT JOIN (
    SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM f1
    WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id) co USING (customer_unique_id)
),
f3 AS (
  SELECT * REPLACE (
    coalesce(payment_value, (SELECT quantile_cont(payment_value, 0.5) FROM f2)) AS payment_value,
    coalesce(product_category_name_english, 'Unknown') AS product_category_name_english),
    CASE WHEN payment_methods_per_order > 1 THEN 1 ELSE 0 END AS is_multi_payment
  FROM f2
),
f4 AS (
  SELECT f3.* REPLACE (coalesce(f3.freight_value, g.m) AS freight_value)
  FROM f3 LEFT JOIN (SELECT customer_state, quantile_cont(freight_value, 0.5) AS m
                     FROM f3 GROUP BY customer_state) g USING (customer_state)
),
f5 AS (
  SELECT * REPLACE (coalesce(freight_value, (SELECT quantile_cont(freight_value, 0.5) FROM f4)) AS freight_value)
  FROM f4
),
f6 AS (
  SELECT f5.* REPLACE (coalesce(f5.price, g.m) AS price)
  FROM f5 LEFT JOIN (SELECT product_category_name_english, quantile_cont(price, 0.5) AS m
                     FROM f5 GROUP BY product_category_name_english) g USING (product_category_name_english)
),
f7 AS (
  SELECT * REPLACE (
    coalesce(price, (SELECT quantile_cont(price, 0.5) FROM f6)) AS price,
    coalesce(payment_installments, (SELECT quantile_cont(payment_installments, 0.5) FROM f6)) AS payment_installments)
  FROM f6
),
f8 AS (
  SELECT *, price + freight_value AS total_item_value,
         coalesce(freight_value / nullif(price, 0) * 100, 0) AS fp_raw
  FROM f7
),
fact AS (
  SELECT f8.* EXCLUDE (fp_raw),
         least(greatest(fp_raw, q.q1 - 1.5 * (q.q3 - q.q1)), q.q3 + 1.5 * (q.q3 - q.q1)) AS freight_pct
  FROM f8, (SELECT quantile_cont(fp_raw, 0.25) AS q1, quantile_cont(fp_raw, 0.75) AS q3 FROM f8) q
)
"""


def over_fact(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the enriched-fact CTE chain (and extra CTEs)."""
    extra = f",\n{extra_ctes}" if extra_ctes.strip() else ""
    return f"WITH {FACT_CTES}{extra}\n{body}"
