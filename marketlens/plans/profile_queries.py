"""Profiling queries (N6–N12) and their oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import profile as pr
from marketlens.operators.fact import enriched
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import query
from marketlens.sources.master import master, review_messages
from marketlens.sources.store import materialize

RAW_COLS = ("order_id", "customer_unique_id", "customer_state", "customer_city", "order_status",
            "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
            "order_delivered_customer_date", "order_estimated_delivery_date", "shipping_limit_date",
            "order_item_id", "product_id", "seller_id", "price", "freight_value",
            "product_category_name_english", "product_size", "payment_sequential", "payment_type",
            "payment_installments", "payment_value", "review_id", "review_score", "review_comment_message")


def raw_master(spark, sf_dir):
    """Master with a review-message *presence* column: the key where there is a
    text, null where the text is null (the text itself is not needed here)."""
    present = review_messages(spark, sf_dir).select("review_key", F.when(
        F.col("review_comment_message").isNotNull(), F.col("review_key").cast("string")).alias("_msg"))
    present = materialize(spark, present, "text-presence")     # the planner sizes it from its files, without the texts
    m = master(spark, sf_dir).join(present, "review_key", "left")
    return m.withColumnRenamed("_msg", "review_comment_message").drop("review_key")


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@query("prof_missing", "N6", over_fact(f"""
SELECT * FROM ({_union([f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
                        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM master"
                        for c in RAW_COLS])}) WHERE missing_count > 0"""))
def prof_missing(spark, sf_dir):
    return pr.missing_report(raw_master(spark, sf_dir).select(*RAW_COLS))


_LONG = _union([f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM fact WHERE {c} IS NOT NULL"
                for c in pr.NUMERIC])


@query("prof_numeric_summary", "N7", over_fact(f"""
SELECT column_name, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
       round(quantile_cont(value, 0.75), 4) AS q75
FROM ({_LONG}) GROUP BY column_name"""))
def prof_numeric_summary(spark, sf_dir):
    return pr.numeric_summary(enriched(spark, sf_dir))


_LONG_CAT = _union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM fact WHERE {c} IS NOT NULL"
                    for c in pr.CATEGORICAL])


@query("prof_categorical_summary", "N7 N4", over_fact(f"""
SELECT column_name, CAST(sum(freq) AS BIGINT) AS count, count(*) AS unique,
       arg_min(value, struct_pack(nf := -freq, v := value)) AS top, max(freq) AS freq
FROM (SELECT column_name, value, count(*) AS freq FROM ({_LONG_CAT}) GROUP BY column_name, value)
GROUP BY column_name"""))
def prof_categorical_summary(spark, sf_dir):
    return pr.categorical_summary(enriched(spark, sf_dir))


@query("prof_distinct_counts", "N8", over_fact(f"""
SELECT column_name, count(DISTINCT value) AS distinct_values FROM ({_union([
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM master WHERE {c} IS NOT NULL"
    for c in RAW_COLS])}) GROUP BY column_name"""))
def prof_distinct_counts(spark, sf_dir):
    """Each column from its own narrow scan of the written master; the message
    column from the distinct texts of the keys in use."""
    cols = [c for c in RAW_COLS if c != "review_comment_message"]
    m = materialize(spark, master(spark, sf_dir).select(*cols, "review_key"), "profile-master")
    used = m.select("review_key").where(F.col("review_key").isNotNull()).distinct()
    texts = review_messages(spark, sf_dir).join(used, "review_key", "left_semi").select("review_comment_message")
    return pr.distinct_counts(m, cols).unionByName(pr.distinct_counts(texts))


@query("prof_duplicate_rows", "N9", over_fact("""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM master)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM master)) AS duplicate_rows FROM master"""))
def prof_duplicate_rows(spark, sf_dir):
    return pr.duplicate_rows(master(spark, sf_dir))


_FEATS = [c for c in pr.NUMERIC if c != "review_score"]


@query("prof_target_correlation", "N10", over_fact(f"""
SELECT feature, abs_corr FROM ({_union([
    f"SELECT '{c}' AS feature, round(abs(corr(CAST({c} AS DOUBLE), CAST(review_score AS DOUBLE))), 4) AS abs_corr FROM cc"
    for c in _FEATS])}) WHERE abs_corr IS NOT NULL AND NOT isnan(abs_corr)
ORDER BY abs_corr DESC, feature LIMIT 10""",
    "cc AS (SELECT * FROM fact WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in pr.NUMERIC) + ")"))
def prof_target_correlation(spark, sf_dir):
    return pr.target_correlations(enriched(spark, sf_dir))


@query("prof_freight_correlation", "N11", over_fact("""
SELECT (SELECT round(corr(CAST(w AS DOUBLE), f), 4) FROM (SELECT product_id, first(product_size) AS w, avg(freight_value) AS f
        FROM fact GROUP BY product_id)) AS corr_weight_avg_freight,
       round(corr(price, freight_value), 4) AS corr_price_freight FROM fact"""))
def prof_freight_correlation(spark, sf_dir):
    return pr.freight_correlations(enriched(spark, sf_dir))


def _five_sql(value: str, by: str) -> str:
    qs = ", ".join(f"round(quantile_cont(CAST({value} AS DOUBLE), {p}), 4) AS {n}"
                   for n, p in (("min", 0.0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("max", 1.0)))
    return f"SELECT {by}, {qs} FROM fact WHERE {value} IS NOT NULL AND {by} IS NOT NULL GROUP BY {by}"


@query("prof_delivery_days_by_score", "N12", over_fact(_five_sql("delivery_days", "review_score")))
def prof_delivery_days_by_score(spark, sf_dir):
    return pr.five_number(enriched(spark, sf_dir), "delivery_days", "review_score")


@query("prof_comment_length_by_sentiment", "N12", over_fact(_five_sql("comment_length", "sentiment")))
def prof_comment_length_by_sentiment(spark, sf_dir):
    return pr.five_number(enriched(spark, sf_dir), "comment_length", "sentiment")


_KEYS = ("order_id", "customer_unique_id", "product_id", "seller_id", "customer_city", "review_id")
_NUMBERS = ("price", "freight_value", "payment_value", "product_size", "delivery_days")


def _monthly_sketches(spark, sf_dir):
    month = F.date_trunc("month", F.col("order_purchase_timestamp"))
    return materialize(spark, pr.sketches(enriched(spark, sf_dir), month, _KEYS, _NUMBERS), "sketches")


@query("prof_distinct_sketches", "N8", over_fact(_union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, TRUE AS within_bound FROM fact" for c in _KEYS])))
def prof_distinct_sketches(spark, sf_dir):
    """Distinct values from written monthly sketches, merged, beside the exact
    count: is the estimate within ``DISTINCT_ERROR`` of it?"""
    near = pr.sketched_distinct(_monthly_sketches(spark, sf_dir), _KEYS)
    exact = pr.distinct_counts(enriched(spark, sf_dir), _KEYS).withColumnRenamed("distinct_values", "exact")
    bound = F.abs(F.col("approximate") - F.col("exact")) <= F.col("exact") * pr.DISTINCT_ERROR
    return exact.join(near, "column_name").select("column_name", "exact", bound.alias("within_bound"))


@query("prof_quantile_sketches", "N7 N12", over_fact(_union([
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, count({c}) AS rows, TRUE AS within_bound FROM fact"
    for c in _NUMBERS for p in pr.QUARTILES])))
def prof_quantile_sketches(spark, sf_dir):
    """Quartiles from written monthly sketches, merged: do the ranks of each
    estimate, counted over all rows, hold its probability within ``RANK_ERROR``?"""
    near = pr.sketched_quantiles(_monthly_sketches(spark, sf_dir), _NUMBERS)
    values = pr.long_numeric(enriched(spark, sf_dir), _NUMBERS).where(F.col("value").isNotNull())
    # a handful of estimates beside all rows; counted before the shuffle
    ranks = values.join(F.broadcast(near), "column_name").groupBy("column_name", "probability", "rows").agg(
        F.avg((F.col("value") < F.col("approximate")).cast("double")).alias("below"),
        F.avg((F.col("value") <= F.col("approximate")).cast("double")).alias("upto"))
    p = F.col("probability")
    bound = (F.col("below") - pr.RANK_ERROR <= p) & (p <= F.col("upto") + pr.RANK_ERROR)
    return ranks.select("column_name", "probability", "rows", bound.alias("within_bound"))
