"""File sources and sinks.

All readers take explicit schemas (no inference pass over large files);
all writers are Spark writers (distributed, partitioned where useful).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.dates import lenient_timestamp

# Timestamp columns of the order-line master.
DATE_COLUMNS = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
                "order_delivered_customer_date", "order_estimated_delivery_date", "shipping_limit_date",
                "review_creation_date", "review_answer_timestamp")

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
# The 37-column master schema, dates read as text then parsed leniently.
MASTER_COLUMNS = (
    ("order_id", _S), ("customer_id", _S), ("order_status", _S), ("order_purchase_timestamp", _S),
    ("order_approved_at", _S), ("order_delivered_carrier_date", _S), ("order_delivered_customer_date", _S),
    ("order_estimated_delivery_date", _S), ("customer_unique_id", _S), ("customer_zip_code_prefix", _I),
    ("customer_city", _S), ("customer_state", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
    ("shipping_limit_date", _S), ("price", _D), ("freight_value", _D), ("product_category_name", _S),
    ("product_name_lenght", _I), ("product_description_lenght", _I), ("product_photos_qty", _I),
    ("product_weight_g", _I), ("product_length_cm", _I), ("product_height_cm", _I), ("product_width_cm", _I),
    ("product_category_name_english", _S), ("payment_sequential", _I), ("payment_type", _S),
    ("payment_installments", _I), ("payment_value", _D), ("review_id", _S), ("review_score", _I),
    ("review_comment_title", _S), ("review_comment_message", _S), ("review_creation_date", _S),
    ("review_answer_timestamp", _S))
MASTER_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in MASTER_COLUMNS])


def parse_dates(df: DataFrame, cols=DATE_COLUMNS) -> DataFrame:          # S2
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: lenient_timestamp(F.col(c)) for c in present})


CORRUPT = "_corrupt_record"


def read_raw_master_csv(spark: SparkSession, path: str) -> DataFrame:
    """The typed CSV rows with dates still as text; ``_corrupt_record`` holds
    the line of a row that does not fit the schema (all columns are parsed,
    whatever is selected later)."""
    schema = T.StructType([*MASTER_SCHEMA.fields, T.StructField(CORRUPT, _S, True)])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
                 .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                 .option("columnPruning", False).csv(path))


def read_master_csv(spark: SparkSession, path: str) -> DataFrame:      # S1
    raw = read_raw_master_csv(spark, path)
    return parse_dates(raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT))


def date_failures(raw: DataFrame, cols=DATE_COLUMNS) -> DataFrame:      # S2
    """Per date column how many texts there are and how many are no date."""
    counts = raw.agg(*[F.count(c).alias(f"{c}|filled") for c in cols],
                     *[F.count(F.when(F.col(c).isNotNull() & lenient_timestamp(F.col(c)).isNull(), 1)).alias(f"{c}|failed") for c in cols])
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}|filled").alias("filled"), F.col(f"{c}|failed").alias("failed")) for c in cols]
    return counts.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def write_master_csv(rows: DataFrame, path: str) -> None:
    """Rows (any of the master's columns, the rest empty) as a headed CSV.
    Files are compressed: with quoted line ends they cannot be split anyhow."""
    have = set(rows.columns)
    cols = [(F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias(n) for n, _ in MASTER_COLUMNS]
    rows.select(*cols).write.option("header", True).option("escape", '"').option("compression", "lz4").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_artifact(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None,
                  date_cols=(), multi_line: bool = True) -> DataFrame | None:      # S3
    """JSON / CSV / parquet artefact with optional date parsing; a missing
    path returns None (the caller degrades gracefully).  ``multi_line``: a JSON
    file is one document, else one a line."""
    if not _exists(spark, path):
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", True).csv(path)
    elif fmt == "json":
        df = r.option("multiLine", multi_line).json(path)
    else:
        df = r.parquet(path)
    return parse_dates(df, date_cols) if date_cols else df


def read_text_dir(spark: SparkSession, path: str, glob: str = "*.txt", folder_names: bool = False) -> DataFrame:   # S4, S5
    """One row per file: (source name, whole text).  The source is the file's
    name or, with ``folder_names``, that of the ``name=value`` folder it lies
    in.  A single newline at the end of a file is not part of its text."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True, pathGlobFilter=glob)
    name = r"=([^/=]+)/[^/]+$" if folder_names else r"([^/]+)$"
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("source"),
                     F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:      # S6, S8
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:   # S7
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def save_model(model, path: str) -> None:                               # S9
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def kpi_document(headline: DataFrame, delivery: DataFrame, top_states: DataFrame, top_categories: DataFrame,
                 payment_share: DataFrame, monthly: DataFrame, data_range: DataFrame) -> DataFrame:   # S6
    """The KPI document as one row: scalars plus map columns."""
    def as_map(df, k, v):
        return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(k).cast("string"), F.col(v).cast("double")))))
    maps = (as_map(top_states, "customer_state", "customers").toDF("top_states_by_customers")
            .crossJoin(as_map(top_categories, "product_category_name_english", "revenue").toDF("top_categories_by_revenue"))
            .crossJoin(as_map(payment_share, "payment_type", "share_pct").toDF("payment_method_share_pct"))
            .crossJoin(as_map(monthly, "month", "revenue").toDF("revenue_by_month")))
    rng = data_range.select(F.array("first_date", "last_date").alias("data_range"))
    return headline.crossJoin(delivery).crossJoin(rng).crossJoin(maps)
