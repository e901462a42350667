"""Queries registered by this module."""

from pyspark.sql import functions as F  # noqa: E402

from marketlens.operators import recommend as rc  # noqa: E402
from marketlens.operators.fact import enriched  # noqa: E402
from marketlens.plans.oracle import over_fact  # noqa: E402
from marketlens.plans.registry import query  # noqa: E402
from marketlens.plans.sentiment_queries import REVIEW_CTES  # noqa: E402
from marketlens.sources.store import materialize  # noqa: E402
from marketlens.functions.money import money_avg_sql  # noqa: E402
from marketlens.sources.tables import load_table  # noqa: E402

_CATALOG_SQL = f"""
per AS (SELECT product_id, min(product_category_name_english) AS product_category_name_english,
               {money_avg_sql('price')} AS price, round(avg(review_score), 4) AS review_score,
               CAST(min(product_size) AS DOUBLE) AS product_weight_g
        FROM fact WHERE product_id IS NOT NULL GROUP BY product_id),
st AS (SELECT avg(price) mp, stddev_pop(price) sp, avg(review_score) mr, stddev_pop(review_score) sr,
              avg(product_weight_g) mw, stddev_pop(product_weight_g) sw FROM per)"""


_CATALOG_ROWS = """
SELECT product_id, product_category_name_english, price, review_score, product_weight_g,
       round(coalesce((price - mp) / nullif(sp, 0), 0.0), 4) AS price_scaled,
       round(coalesce((review_score - mr) / nullif(sr, 0), 0.0), 4) AS rating_scaled,
       round(coalesce((product_weight_g - mw) / nullif(sw, 0), 0.0), 4) AS weight_scaled
FROM per, st"""


@query("rec_catalog", "M24", over_fact(_CATALOG_ROWS, _CATALOG_SQL))
def rec_catalog(spark, sf_dir):
    return rc.catalog(enriched(spark, sf_dir))


@query("rec_catalog_lookup", "J4", over_fact(
    _CATALOG_ROWS + " WHERE product_id IN (SELECT p_partkey FROM part UNION ALL SELECT -p_partkey FROM part)", _CATALOG_SQL))
def rec_catalog_lookup(spark, sf_dir):
    """Catalogue rows of every part and of as many unknown ids."""
    wanted = load_table(spark, sf_dir, "part").select(
        F.explode(F.array(F.col("p_partkey"), -F.col("p_partkey"))).alias("product_id"))
    return rc.lookup(rc.catalog(enriched(spark, sf_dir)), wanted)


def _catalog_feats(spark, sf_dir):
    cat = materialize(spark, rc.catalog(enriched(spark, sf_dir)), "catalog")
    return cat, materialize(spark, rc.content_features(cat), "content-features")


_SIMILAR_CTE = _CATALOG_SQL + f""",
cat AS ({_CATALOG_ROWS}),
named AS (SELECT category, list_filter(string_split_regex(lower(coalesce(category, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS tokens, n
          FROM (SELECT product_category_name_english AS category, count(*) AS n FROM cat GROUP BY 1)),
words AS (SELECT category, n, token, count(*) AS tf FROM (SELECT category, n, unnest(tokens) AS token FROM named) GROUP BY 1, 2, 3),
idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM cat)) / (1.0 + sum(n))) + 1.0 AS idf FROM words GROUP BY token),
weights AS (SELECT category, token, tf * idf AS w FROM words JOIN idf USING (token)),
unit AS (SELECT category, token, w / sqrt(sum(w * w) OVER (PARTITION BY category)) AS w FROM weights),
dots AS (SELECT a.category AS a, b.category AS b, sum(a.w * b.w) AS dot FROM unit a JOIN unit b USING (token) GROUP BY 1, 2),
vec AS (SELECT c.*, sqrt(coalesce(d.dot, 0.0) + price_scaled * price_scaled + rating_scaled * rating_scaled
                         + weight_scaled * weight_scaled) AS norm
        FROM cat c LEFT JOIN dots d ON d.a IS NOT DISTINCT FROM c.product_category_name_english
                                   AND d.b IS NOT DISTINCT FROM c.product_category_name_english),
scores AS (SELECT p.product_id, q.product_id AS rec_product_id, q.product_category_name_english, q.price, q.review_score,
                  coalesce((coalesce(d.dot, 0.0) + p.price_scaled * q.price_scaled + p.rating_scaled * q.rating_scaled
                            + p.weight_scaled * q.weight_scaled) / nullif(p.norm * q.norm, 0), 0.0) AS score
           FROM vec p JOIN vec q ON p.product_id <> q.product_id
           LEFT JOIN dots d ON d.a IS NOT DISTINCT FROM p.product_category_name_english
                           AND d.b IS NOT DISTINCT FROM q.product_category_name_english)"""


@query("rec_similar_content", "M25 M27 J6", over_fact("""
SELECT product_id, rec_product_id, CAST(rank AS INTEGER) AS rank, round(score, 4) + 0.0 AS similarity_score,
       product_category_name_english, price, review_score
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(score, 6) DESC, rec_product_id) AS rank FROM scores)
WHERE rank <= 5""", _SIMILAR_CTE))
def rec_similar_content(spark, sf_dir):
    cat, feats = _catalog_feats(spark, sf_dir)
    return rc.similar_products(cat, rc.content_vectors(feats), "content", 5, "content")


@query("rec_similar_svd", "M26 M27 J6")
def rec_similar_svd(spark, sf_dir):
    cat, feats = _catalog_feats(spark, sf_dir)
    lat = materialize(spark, rc.svd_latent(feats), "latent")
    return rc.similar_products(cat, lat, "latent", 5, "svd")

from marketlens.operators import insights as ins  # noqa: E402
from marketlens.operators import kpis  # noqa: E402
from marketlens.operators import sentiment as se  # noqa: E402
from marketlens.operators.retrieval import questions  # noqa: E402


def _route_sql() -> str:
    q = "lower(regexp_replace(question, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'))"
    whens = "\n".join(
        "  WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in ins.INTENT_RULES)
    return f"CASE\n{whens}\n  ELSE '{ins.FALLBACK_INTENT}' END"


_QUESTIONS_SQL = "qs AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user')"


@query("ins_question_routing", "R6", f"WITH {_QUESTIONS_SQL} SELECT qid, question, {_route_sql()} AS intent FROM qs")
def ins_question_routing(spark, sf_dir):
    return ins.route(questions(spark, sf_dir))


@query("ins_intent_counts", "R6", f"""WITH {_QUESTIONS_SQL}
SELECT intent, count(*) AS questions FROM (SELECT {_route_sql()} AS intent FROM qs) GROUP BY intent""")
def ins_intent_counts(spark, sf_dir):
    return ins.intent_counts(ins.route(questions(spark, sf_dir)))


_SINGLE = ("total_revenue", "total_orders", "avg_order_value", "delivery_success_rate_pct", "cancellation_rate_pct",
           "returning_customer_rate_pct", "total_customers", "total_sellers")


@query("ins_routed_answers", "R6 G1 G2 G3 G4 G5 G7 G13", over_fact(f"""
SELECT qid, question, r.intent, k.metric, label, value
FROM routed r LEFT JOIN (quotes JOIN k USING (metric)) k ON r.intent = k.intent""", f"""{REVIEW_CTES},
{_QUESTIONS_SQL},
routed AS (SELECT qid, question, {_route_sql()} AS intent FROM qs),
quotes(intent, metric) AS (VALUES
  ('revenue', 'total_revenue'), ('revenue', 'total_orders'), ('revenue', 'avg_order_value'), ('revenue', 'data_range'),
  ('logistics', 'delivery_success_rate_pct'), ('logistics', 'late_delivery_rate_pct'),
  ('logistics', 'avg_delivery_days'), ('logistics', 'cancellation_rate_pct'),
  ('sentiment', 'reviews'), ('sentiment', 'positive_pct'), ('sentiment', 'negative_pct'), ('sentiment', 'neutral_pct'),
  ('categories', 'top_category_revenue'), ('geography', 'top_state_customers'), ('payments', 'payment_share_pct'),
  ('retention', 'returning_customer_rate_pct'), ('retention', 'total_customers'), ('sellers', 'total_sellers'),
  ('snapshot', 'total_revenue'), ('snapshot', 'total_orders'), ('snapshot', 'positive_pct'),
  ('snapshot', 'late_delivery_rate_pct'), ('snapshot', 'returning_customer_rate_pct')),
one AS (SELECT CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS total_revenue,
       CAST(count(DISTINCT order_id) AS DOUBLE) AS total_orders,
       CAST(count(DISTINCT customer_unique_id) AS DOUBLE) AS total_customers,
       CAST(count(DISTINCT seller_id) AS DOUBLE) AS total_sellers,
       CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))) / count(DISTINCT order_id), 2) AS DOUBLE) AS avg_order_value,
       round(avg(CASE WHEN order_status = 'delivered' THEN 1.0 ELSE 0.0 END) * 100, 2) AS delivery_success_rate_pct,
       round(avg(CASE WHEN order_status = 'canceled' THEN 1.0 ELSE 0.0 END) * 100, 2) AS cancellation_rate_pct,
       round(avg(is_returning_customer) * 100, 2) AS returning_customer_rate_pct FROM fact),
late AS (SELECT round(avg(CASE WHEN delivery_status = 'Late' THEN 1.0 ELSE 0.0 END) * 100, 2) AS late_delivery_rate_pct,
       round(avg(delivery_days), 2) AS avg_delivery_days FROM fact WHERE order_status = 'delivered'),
k AS (
  SELECT metric, CAST(NULL AS VARCHAR) AS label, value FROM one UNPIVOT (value FOR metric IN ({', '.join(_SINGLE)}))
  UNION ALL SELECT metric, NULL, value FROM late UNPIVOT (value FOR metric IN (late_delivery_rate_pct, avg_delivery_days))
  UNION ALL SELECT lower(sentiment) || '_pct', NULL, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)
            FROM lab GROUP BY sentiment
  UNION ALL SELECT 'reviews', NULL, count(*) FROM lab
  UNION ALL SELECT 'data_range', CAST(CAST(min(order_purchase_timestamp) AS DATE) AS VARCHAR) || ' to '
            || CAST(CAST(max(order_purchase_timestamp) AS DATE) AS VARCHAR), NULL FROM fact
  UNION ALL (SELECT 'top_category_revenue', product_category_name_english,
                    CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS v
             FROM fact WHERE product_category_name_english IS NOT NULL GROUP BY 2 ORDER BY v DESC, 2 LIMIT 5)
  UNION ALL (SELECT 'top_state_customers', customer_state, count(*) AS v
             FROM fact WHERE customer_state IS NOT NULL GROUP BY 2 ORDER BY v DESC, 2 LIMIT 5)
  UNION ALL SELECT 'payment_share_pct', payment_type, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)
            FROM fact WHERE payment_type IS NOT NULL GROUP BY 2)"""))
def ins_routed_answers(spark, sf_dir):
    """All questions with the figures their intent quotes (those of forecast
    questions: ``ins_forecast_answers``)."""
    fact = enriched(spark, sf_dir)
    kp = ins.kpi_long(kpis.headline(fact), kpis.delivery_headline(fact),
                      se.distribution(se.labelled(se.reviews(fact))))
    lists = ins.kpi_lists(kpis.top_categories_by_revenue(fact, ins.QUOTED), kpis.top_states(fact, ins.QUOTED),
                          kpis.payment_share(fact), kpis.data_range(fact))
    quoted = materialize(spark, kp.unionByName(lists), "quoted-kpis")
    return ins.answers(ins.route(questions(spark, sf_dir)), quoted).select("qid", "question", "intent", "metric", "label",
                                                                           "value")


_R7_METRICS = ("total_revenue", "total_orders", "avg_order_value", "positive_pct", "negative_pct",
               "late_delivery_rate_pct", "delivery_success_rate_pct", "cancellation_rate_pct",
               "returning_customer_rate_pct", "avg_delivery_days", "total_customers", "total_sellers")
_FOCUS = {"total_revenue": "General overview", "total_orders": "General overview",
          "avg_order_value": "General overview", "returning_customer_rate_pct": "Growth",
          "positive_pct": "Customer Sentiment", "negative_pct": "Customer Sentiment",
          "late_delivery_rate_pct": "Logistics & Delivery", "delivery_success_rate_pct": "Logistics & Delivery",
          "cancellation_rate_pct": "Logistics & Delivery", "avg_delivery_days": "Logistics & Delivery",
          "total_customers": "General overview", "total_sellers": "General overview"}


@query("ins_insight_metrics", "R7 G38", over_fact(f"""
SELECT CASE metric {' '.join(f"WHEN '{m}' THEN '{f}'" for m, f in _FOCUS.items())} END AS focus,
       category, state, metric, value,
       CASE WHEN metric = 'late_delivery_rate_pct' AND value >= 4.0 THEN 'above_benchmark' ELSE '' END AS flag
FROM cells UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_R7_METRICS)}))""", """
cells AS (
  SELECT CASE WHEN grouping(product_category_name_english, customer_state) & 2 > 0 THEN 'ALL' ELSE product_category_name_english END AS category,
         CASE WHEN grouping(product_category_name_english, customer_state) & 1 > 0 THEN 'ALL' ELSE customer_state END AS state,
         CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS total_revenue,
         CAST(count(DISTINCT order_id) AS DOUBLE) AS total_orders,
         CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))) / count(DISTINCT order_id), 2) AS DOUBLE) AS avg_order_value,
         round(sum(CASE WHEN sentiment = 'Positive' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END), 0), 2) AS positive_pct,
         round(sum(CASE WHEN sentiment = 'Negative' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN sentiment IN ('Positive','Negative','Neutral') THEN 1 ELSE 0 END), 0), 2) AS negative_pct,
         round(sum(CASE WHEN order_status = 'delivered' AND delivery_status = 'Late' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN order_status = 'delivered' THEN 1 ELSE 0 END), 0), 2) AS late_delivery_rate_pct,
         round(avg(CASE WHEN order_status = 'delivered' THEN 1.0 ELSE 0.0 END) * 100, 2) AS delivery_success_rate_pct,
         round(avg(CASE WHEN order_status = 'canceled' THEN 1.0 ELSE 0.0 END) * 100, 2) AS cancellation_rate_pct,
         round(avg(is_returning_customer) * 100, 2) AS returning_customer_rate_pct,
         round(avg(CASE WHEN order_status = 'delivered' THEN delivery_days END), 2) AS avg_delivery_days,
         CAST(count(DISTINCT customer_unique_id) AS DOUBLE) AS total_customers,
         CAST(count(DISTINCT seller_id) AS DOUBLE) AS total_sellers
  FROM fact GROUP BY CUBE (product_category_name_english, customer_state))"""))
def ins_insight_metrics(spark, sf_dir):
    return ins.insight_metrics(enriched(spark, sf_dir))


@query("ins_insight_rankings", "R7 G3 G4 G5", over_fact("""
SELECT 'Product Recommendation' AS focus, 'ALL' AS category, state, 'top_category_revenue' AS metric, place, category AS label,
       value FROM cats WHERE place <= 5
UNION ALL SELECT 'Logistics & Delivery', category, 'ALL', 'top_state_customers', place, state, value FROM states WHERE place <= 5
UNION ALL SELECT 'Growth', category, state, 'payment_share_pct', place, payment_type, value FROM pay""", """
cat_sum AS (
  SELECT CASE WHEN grouping(customer_state) = 1 THEN 'ALL' ELSE customer_state END AS state,
         product_category_name_english AS category,
         CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS value
  FROM fact WHERE product_category_name_english IS NOT NULL
  GROUP BY GROUPING SETS ((customer_state, product_category_name_english), (product_category_name_english))),
cats AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY value DESC, category) AS place FROM cat_sum),
state_sum AS (
  SELECT CASE WHEN grouping(product_category_name_english) = 1 THEN 'ALL' ELSE product_category_name_english END AS category,
         customer_state AS state, CAST(count(*) AS DOUBLE) AS value
  FROM fact WHERE customer_state IS NOT NULL
  GROUP BY GROUPING SETS ((customer_state, product_category_name_english), (customer_state))),
states AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY value DESC, state) AS place FROM state_sum),
pay_sum AS (
  SELECT CASE WHEN grouping(product_category_name_english) = 1 THEN 'ALL' ELSE product_category_name_english END AS category,
         CASE WHEN grouping(customer_state) = 1 THEN 'ALL' ELSE customer_state END AS state, payment_type, count(*) AS n
  FROM fact WHERE payment_type IS NOT NULL
  GROUP BY GROUPING SETS ((product_category_name_english, customer_state, payment_type),
                          (product_category_name_english, payment_type), (customer_state, payment_type), (payment_type))),
pay AS (SELECT category, state, payment_type, round(n * 100.0 / sum(n) OVER (PARTITION BY category, state), 2) AS value,
               row_number() OVER (PARTITION BY category, state ORDER BY n DESC, payment_type) AS place FROM pay_sum)"""))
def ins_insight_rankings(spark, sf_dir):
    return ins.insight_rankings(materialize(spark, ins.ranking_cells(enriched(spark, sf_dir)), "insight-cells"))


@query("ins_five_level_labels", "P20", over_fact("""
SELECT CASE review_score WHEN 1 THEN 'Very Negative' WHEN 2 THEN 'Negative' WHEN 3 THEN 'Neutral'
                         WHEN 4 THEN 'Positive' WHEN 5 THEN 'Very Positive' ELSE 'Unknown' END AS label,
       count(*) AS rows FROM fact GROUP BY 1"""))
def ins_five_level_labels(spark, sf_dir):
    return enriched(spark, sf_dir).groupBy(ins.five_level(F.col("review_score")).alias("label")) \
        .agg(F.count(F.lit(1)).alias("rows"))

from marketlens.operators import products as pd_  # noqa: E402
from marketlens.sources import files  # noqa: E402


@query("prod_geometry", "P14", """
SELECT p_partkey AS product_id, CAST(p_size * p_size * p_size AS BIGINT) AS volume_cm3,
       round(p_size * 100 / 1000.0, 3) AS weight_kg,
       CASE WHEN p_size * p_size * p_size <= 1000 THEN 'Small' WHEN p_size * p_size * p_size <= 10000 THEN 'Medium'
            WHEN p_size * p_size * p_size <= 50000 THEN 'Large' ELSE 'Extra Large' END AS size_category
FROM part""")
def prod_geometry(spark, sf_dir):
    dims = pd_.part_dimensions(load_table(spark, sf_dir, "part"))
    g = pd_.geometry(dims, "product_length_cm", "product_height_cm", "product_width_cm", "product_weight_g")
    return g.select("product_id", "volume_cm3", "weight_kg", "size_category")


@query("prod_order_composition", "P15", over_fact("""
SELECT order_id, count(DISTINCT order_item_id) AS items_per_order,
       CASE WHEN count(DISTINCT order_item_id) > 1 THEN 1 ELSE 0 END AS is_multi_item,
       CASE WHEN count(DISTINCT seller_id) > 1 THEN 1 ELSE 0 END AS is_multi_seller
FROM fact GROUP BY order_id"""))
def prod_order_composition(spark, sf_dir):
    return pd_.order_composition(enriched(spark, sf_dir))


_TITLE = ("array_to_string(list_transform(string_split(lower({x}), ' '), "
          "lambda w: upper(w[1:1]) || w[2:]), ' ')")


@query("prod_display_labels", "P18", over_fact(f"""
SELECT product_id,
       {_TITLE.format(x="regexp_replace(replace(coalesce(product_category_name_english, 'General Items'), '_', ' '), '(?i)unknown', 'General Items', 'g')")} AS display_category,
       printf('$%.2f', {money_avg_sql('price', 2)}) AS price_label,
       'ID: ' || substring(CAST(product_id AS VARCHAR), 1, 8) || '...' AS id_label
FROM fact WHERE product_id IS NOT NULL GROUP BY product_id, product_category_name_english"""))
def prod_display_labels(spark, sf_dir):
    from marketlens.functions.money import money_avg
    f = enriched(spark, sf_dir).where(F.col("product_id").isNotNull())
    per = f.groupBy("product_id", "product_category_name_english").agg(money_avg("price", 2).alias("p"))
    return per.select("product_id", pd_.display_name(F.col("product_category_name_english")).alias("display_category"),
                      pd_.price_label(F.col("p")).alias("price_label"), pd_.id_label(F.col("product_id")).alias("id_label"))


@query("prod_category_domain", "T3", over_fact("""
SELECT product_category_name_english, row_number() OVER (ORDER BY product_category_name_english) AS position
FROM (SELECT DISTINCT product_category_name_english FROM fact WHERE product_category_name_english IS NOT NULL)"""))
def prod_category_domain(spark, sf_dir):
    return pd_.domain(enriched(spark, sf_dir), "product_category_name_english")


@query("kpi_document", "S6 G1 G3 G4 G5 G6 G7")
def kpi_document(spark, sf_dir):
    fact = enriched(spark, sf_dir)
    return files.kpi_document(kpis.headline(fact), kpis.delivery_headline(fact), kpis.top_states(fact),
                              kpis.top_categories_by_revenue(fact), kpis.payment_share(fact),
                              kpis.monthly_delivered_revenue(fact), kpis.data_range(fact))
