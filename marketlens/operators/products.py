"""Product and order scalar features."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size buckets on volume (cm³) and display substitutions.
SIZE_BUCKETS = ((1_000, "Small"), (10_000, "Medium"), (50_000, "Large"))
LARGEST_BUCKET = "Extra Large"
UNKNOWN_DISPLAY = "General Items"


def geometry(df: DataFrame, length: str, height: str, width: str, weight_g: str) -> DataFrame:   # P14
    vol = F.col(length) * F.col(height) * F.col(width)
    cat = F.lit(LARGEST_BUCKET)
    for bound, name in reversed(SIZE_BUCKETS):
        cat = F.when(vol <= bound, name).otherwise(cat)
    return df.withColumns({"volume_cm3": vol.cast("long"),
                           "weight_kg": F.round(F.col(weight_g) / 1000.0, 3),
                           "size_category": F.when(vol.isNull(), None).otherwise(cat)})


def part_dimensions(part: DataFrame) -> DataFrame:
    """Fixture mapping of product dimensions from the part table: a cube of
    side ``p_size`` cm weighing ``p_size × 100`` g (the order-line source
    has explicit dimension columns; the test tables do not)."""
    return part.select(F.col("p_partkey").alias("product_id"),
                       F.col("p_size").alias("product_length_cm"), F.col("p_size").alias("product_height_cm"),
                       F.col("p_size").alias("product_width_cm"), (F.col("p_size") * 100).alias("product_weight_g"))


def order_composition(fact: DataFrame) -> DataFrame:                  # P15
    return fact.groupBy("order_id").agg(
        F.count_distinct("order_item_id").alias("items_per_order"),
        (F.count_distinct("order_item_id") > 1).cast("int").alias("is_multi_item"),
        (F.count_distinct("seller_id") > 1).cast("int").alias("is_multi_seller"))


def installment_value(fact: DataFrame) -> DataFrame:                  # P15
    return fact.withColumn("installment_value",
                           F.try_divide(F.col("payment_value"), F.col("payment_installments")))


def display_name(c: Column) -> Column:                                 # P18
    """'_' -> ' ', 'unknown' (any case) -> 'General Items', title case."""
    s = F.regexp_replace(F.coalesce(c, F.lit(UNKNOWN_DISPLAY)), "_", " ")
    s = F.regexp_replace(s, "(?i)unknown", UNKNOWN_DISPLAY)
    return F.initcap(s)


def price_label(c: Column) -> Column:                                   # P18
    return F.format_string("$%.2f", c)


def id_label(c: Column, n: int = 8) -> Column:                          # P18
    return F.concat(F.lit("ID: "), F.substring(c.cast("string"), 1, n), F.lit("..."))


def domain(df: DataFrame, col: str) -> DataFrame:                       # T3
    """Distinct non-null values in sorted order, with their position."""
    vals = df.where(F.col(col).isNotNull()).select(col).distinct()
    return vals.withColumn("position", F.row_number().over(Window.orderBy(col)))
