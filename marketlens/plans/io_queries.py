"""File sources and sinks as round trips through the shared folder (S1-S4,
S6-S9), and column kinds (P17).  Inputs are written from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators import drilldown as dd
from marketlens.operators import profile
from marketlens.operators import retrieval as rt
from marketlens.operators.enrich import review_text_dim
from marketlens.operators.fact import enriched
from marketlens.plans import drilldown_queries as dq
from marketlens.plans import kpi_queries  # noqa: F401  (its queries are built on below)
from marketlens.plans import misc_queries as mq
from marketlens.plans.memo import memo
from marketlens.plans.ml_queries import _sentiment_model
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import all_registered, query
from marketlens.session import scratch_path
from marketlens.sources import files
from marketlens.sources.master import master
from marketlens.sources.store import materialize
from marketlens.sources.tables import load_table

# What the written CSV has wrong: a price that is no number, a date that is none.
BAD_PRICE_LINE, BAD_DATE_LINE = 7, 6


def _raw_csv(spark, sf_dir):
    """The order-line master as a CSV file, read back as typed rows."""
    def build():
        line = F.col("order_item_id")
        rows = master(spark, sf_dir)
        rows = rows.withColumns({
            "price": F.when(line == BAD_PRICE_LINE, "unknown").otherwise(F.col("price").cast("string")),
            "order_approved_at": F.when(line == BAD_DATE_LINE, "not a date").otherwise(F.col("order_approved_at").cast("string"))})
        path = scratch_path(spark, "master-csv")
        files.write_master_csv(rows, path)
        return files.read_raw_master_csv(spark, path)
    return memo(spark, sf_dir, "master-csv", build)


@query("src_csv_rows", "S1 S2", over_fact(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id, CAST(product_id AS VARCHAR) AS product_id, order_status,
       order_purchase_timestamp, CASE WHEN order_item_id <> {BAD_DATE_LINE} THEN order_approved_at END AS order_approved_at,
       order_delivered_customer_date, price, payment_value
FROM master WHERE order_item_id <> {BAD_PRICE_LINE}"""))
def src_csv_rows(spark, sf_dir):
    """Good rows of the CSV: typed, dates parsed leniently."""
    raw = _raw_csv(spark, sf_dir)
    rows = files.parse_dates(raw.where(F.col(files.CORRUPT).isNull()))
    return rows.select("order_id", "order_item_id", "product_id", "order_status", "order_purchase_timestamp",
                       "order_approved_at", "order_delivered_customer_date", "price", "payment_value")


@query("src_csv_rejects", "S1", over_fact(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id, CAST(NULL AS DOUBLE) AS price, TRUE AS line_kept
FROM master WHERE order_item_id = {BAD_PRICE_LINE}"""))
def src_csv_rejects(spark, sf_dir):
    """Rows that do not fit the schema; their line is kept."""
    raw = _raw_csv(spark, sf_dir).where(F.col(files.CORRUPT).isNotNull())
    return raw.select("order_id", "order_item_id", "price", F.col(files.CORRUPT).contains("unknown").alias("line_kept"))


@query("src_date_failures", "S2", over_fact(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS filled, "
    + (f"count(CASE WHEN order_item_id = {BAD_DATE_LINE} THEN 1 END)" if c == "order_approved_at" else "CAST(0 AS BIGINT)")
    + f" AS failed FROM (SELECT {c if c in ('order_purchase_timestamp', 'order_approved_at', 'order_delivered_carrier_date', 'order_delivered_customer_date', 'order_estimated_delivery_date', 'shipping_limit_date') else 'CAST(NULL AS TIMESTAMP) AS ' + c}, order_item_id FROM master)"
    for c in files.DATE_COLUMNS)))
def src_date_failures(spark, sf_dir):
    """Filled and unparsable values of each date column."""
    return files.date_failures(_raw_csv(spark, sf_dir))


_DOCUMENT_MAPS = (("top_states_by_customers", "kpi_top_states", "customer_state", "customers"),
                  ("top_categories_by_revenue", "kpi_top_categories", "product_category_name_english", "revenue"),
                  ("payment_method_share_pct", "kpi_payment_share", "payment_type", "share_pct"),
                  ("revenue_by_month", "kpi_monthly_revenue", "month", "revenue"))
_SCALARS = ("kpi_headline", "kpi_delivery")


def _document_sql() -> str:
    known = all_registered()
    parts = [f"SELECT '{field}' AS field, CAST({k} AS VARCHAR) AS key, CAST({v} AS DOUBLE) AS value FROM ({known[q].sql})"
             for field, q, k, v in _DOCUMENT_MAPS]
    parts += [f"SELECT field, CAST(NULL AS VARCHAR) AS key, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({known[q].sql})) "
              "ON COLUMNS(*) INTO NAME field VALUE value)" for q in _SCALARS]
    return "\nUNION ALL\n".join(parts)


@query("sink_kpi_json", "S6 S3", _document_sql())
def sink_kpi_json(spark, sf_dir):
    """The KPI document written as one JSON file and read back with an explicit
    schema of scalars and maps; one row per scalar and map entry."""
    path = scratch_path(spark, "kpi-json")
    document = mq.kpi_document(spark, sf_dir).drop("data_range")
    files.write_json(document, path, single_file=True)
    maps = [m[0] for m in _DOCUMENT_MAPS]
    schema = T.StructType([T.StructField(c, T.MapType(T.StringType(), T.DoubleType()) if c in maps else T.DoubleType())
                           for c in document.columns])
    back = files.read_artifact(spark, path, "json", schema, multi_line=False)
    scalars = [F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("key"), F.col(c).alias("value"))
               for c in document.columns if c not in maps]

    def entry_of(field):
        return lambda e: F.struct(F.lit(field).alias("field"), e["key"].alias("key"), e["value"].alias("value"))
    entries = [F.transform(F.map_entries(c), entry_of(c)) for c in maps]
    return back.select(F.explode(F.concat(F.array(*scalars), *entries)).alias("e")).select("e.*").where("value is not null")


def _csv_round_trip(spark, df, name, partition_by=()):
    path = scratch_path(spark, name)
    files.write_table(df, path, "csv", partition_by)
    return files.read_artifact(spark, path, "csv", df.schema).select(*df.columns)


@query("sink_summary_csv", "S7 S3", over_fact("SELECT * FROM summary", dq.SUMMARY_CTE))
def sink_summary_csv(spark, sf_dir):
    """The drill-down summary written as CSV by state and read back."""
    return _csv_round_trip(spark, dd.summary(enriched(spark, sf_dir)), "summary-csv", ("state",))


@query("sink_monthly_csv", "S7 S3", over_fact("SELECT * FROM monthly", dq.MONTHLY_CTE))
def sink_monthly_csv(spark, sf_dir):
    """The monthly drill-down table written as CSV and read back."""
    return _csv_round_trip(spark, dd.monthly(enriched(spark, sf_dir)), "monthly-csv")


@query("sink_review_samples_json", "S8 S3", all_registered()["drill_sample_reviews"].sql)
def sink_review_samples_json(spark, sf_dir):
    """The sample reviews of each slice written as nested JSON and read back."""
    samples = dd.sample_reviews(enriched(spark, sf_dir), review_text_dim(spark, sf_dir))
    path = scratch_path(spark, "samples-json")
    files.write_json(samples, path)
    return files.read_artifact(spark, path, "json", samples.schema, multi_line=False).select(*samples.columns)


@query("src_text_dir", "S4 S5 R1", """
SELECT CAST(item_id AS VARCHAR) || '.txt' AS source, CAST(k AS INTEGER) AS chunk_no, length(text) AS chars,
       md5(substring(text, CAST(k * 480 + 1 AS INTEGER), 500)) AS chunk_md5
FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE CAST(ceil((length(text) - 20) / 480) AS BIGINT) END)) AS k
      FROM benchmark WHERE length(text) > 0)""")
def src_text_dir(spark, sf_dir):
    """A folder of text files, one for each passage, read whole by file and cut
    into chunks.  The folder of a passage names its source."""
    path = scratch_path(spark, "texts")
    load_table(spark, sf_dir, "benchmark").where(F.length("text") > 0) \
        .select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("source_name"), "text") \
        .write.partitionBy("source_name").text(path)
    texts = files.read_text_dir(spark, path, folder_names=True)
    chunks = rt.chunk_fixed(texts.withColumn("doc_key", F.xxhash64("source")))
    whole = texts.select("source", F.length("text").alias("chars"))
    return chunks.select("source", "chunk_no", F.md5("text").alias("chunk_md5")).join(whole, "source")


@query("sent_reloaded_scores", "S9")
def sent_reloaded_scores(spark, sf_dir):
    """Scores of the held-out reviews by the sentiment model and by the same
    model written to the shared folder and loaded again."""
    split, terms, model = _sentiment_model(spark, sf_dir)
    path = scratch_path(spark, "sentiment-model")
    model.save(path)
    test = split.where(F.col("split") == "test")
    own, back = (m.score(test, terms).select("review_id", "predicted_sentiment", "probabilities") for m in (model, type(model).load(path)))
    back = back.withColumnsRenamed({"predicted_sentiment": "reloaded_sentiment", "probabilities": "_p"})
    off = F.array_max(F.zip_with("probabilities", "_p", lambda a, b: F.abs(a - b)))
    return own.join(back, "review_id").select("review_id", "predicted_sentiment", "reloaded_sentiment", off.alias("largest_difference"))


_PROFILED = ("customer", "lineitem", "orders", "part")


@query("prof_columns_by_kind", "P17", " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, column_name, CASE WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS kind
FROM (DESCRIBE SELECT * FROM {t}) WHERE column_type NOT LIKE 'TIMESTAMP%' AND column_type <> 'DATE'""" for t in _PROFILED))
def prof_columns_by_kind(spark, sf_dir):
    """Numeric and categorical columns of the given tables by their types."""
    rows = []
    for t in _PROFILED:
        numeric, categorical = profile.columns_by_kind(load_table(spark, sf_dir, t))
        rows += [(t, c, "numeric") for c in numeric] + [(t, c, "categorical") for c in categorical]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string")
