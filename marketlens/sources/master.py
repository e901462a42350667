"""The order-line master (one row per order × item × payment × review).

The modelled workload starts from a pre-joined master table.  Here it is
built from the entity tables with equi-joins (inner for the mandatory sides,
left for review text) following the fixture mapping:

  lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part  [⟕ review text]

Plan shape at scale: customers join the orders, products the lines, and both
sides then join by order key (shuffle joins, AQE splits skewed keys);
nation/region are bounded and broadcast by the planner.  All other columns
follow row by row (``master_columns``), so only source columns are shuffled.  Review *text* is not copied onto fact rows:
the fact carries an integer ``review_key`` and text-derived metrics come from
the text table, joined by key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.dates import add_hours
from marketlens.functions.joins import attach_scalars, join_small
from marketlens.sources.tables import load_table

# Fixed values of the fixture mapping (they define which rows are null and
# how dates are derived); they must equal the oracle view exactly.
# review text = documents[l_orderkey % (number of documents)]
NO_TEXT_EVERY = 3               # l_orderkey % 3 = 0 -> no review text
NULL_PRICE_EVERY = 97           # l_partkey % 97 = 0 -> price missing
NULL_FREIGHT_EVERY = 89         # l_orderkey % 89 = 0 -> freight missing
NULL_PAYMENT_EVERY = 211        # (l_orderkey + l_partkey) % 211 = 0 -> payment missing
NULL_SCORE_EVERY = 41           # l_orderkey % 41 = 0 -> review score missing
NULL_CATEGORY_BRAND = "Brand#1"
NULL_LOCAL_CATEGORY_EVERY = 43  # p_partkey % 43 = 0 -> category of the seller's language missing
NULL_DESCRIPTION_EVERY = 61     # p_partkey % 61 = 0 -> description length missing
LONG_DESCRIPTION_EVERY = 53     # p_partkey % 53 = 0 -> description of LONG_DESCRIPTION characters
LONG_DESCRIPTION = 4000
ZIP_PREFIXES = 100_000


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = load_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return join_small(nation, region, nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "n_name", "r_name")


def line_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sides of the master: lines, orders with their customer's geography,
    products, and the one-row number of texts."""
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    orders = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")

    cust_geo = join_small(customer, geography(spark, sf_dir),
                          F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.join(cust_geo.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    texts = load_table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_texts"))
    return li, orders, part, texts


def join_lines(li: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Lines, products, orders; the order comes last, so that the result lies
    by order key and a window over an order needs no shuffle of its own."""
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def review_key_of(order_key, n_texts) -> F.Column:
    return F.when(order_key % NO_TEXT_EVERY != 0, F.try_mod(order_key, n_texts))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master order-line table with the reference's column names."""
    li, orders, part, texts = line_sources(spark, sf_dir)
    df = attach_scalars(join_lines(li, orders, part), texts)
    return master_columns(df.withColumn("review_key", review_key_of(F.col("l_orderkey"), F.col("n_texts"))))


def master_columns(df: DataFrame, *more: str) -> DataFrame:
    """The master's columns (and ``more``) from the joined source columns, row by row."""
    od = F.col("o_orderdate")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    shipped = F.col("l_linestatus") == "F"
    price = F.col("l_extendedprice")
    status = F.col("o_orderstatus")
    return df.select(
        ok.alias("order_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
        F.col("r_name").alias("customer_city"),
        F.when(status == "F", "delivered").when(status == "O", "shipped")
         .otherwise("canceled").alias("order_status"),
        add_hours(od, (ok % 24).cast("int")).alias("order_purchase_timestamp"),
        add_hours(od, (ok % 24 + pk % 48).cast("int")).alias("order_approved_at"),
        F.when(shipped, add_hours(od, (48 + (pk + sk) % 120).cast("int")))
         .alias("order_delivered_carrier_date"),
        F.when(shipped, add_hours(od, (96 + (ok * 7 + pk * 3 + sk) % 720).cast("int")))
         .alias("order_delivered_customer_date"),
        add_hours(od, F.lit(600)).alias("order_estimated_delivery_date"),
        add_hours(od, F.lit(144)).alias("shipping_limit_date"),
        F.col("l_linenumber").alias("order_item_id"),
        pk.alias("product_id"),
        sk.alias("seller_id"),
        F.when(pk % NULL_PRICE_EVERY != 0, price).alias("price"),
        F.when(ok % NULL_FREIGHT_EVERY != 0, price * F.col("l_tax")).alias("freight_value"),
        F.when(F.col("p_brand") != NULL_CATEGORY_BRAND, F.col("p_type"))
         .alias("product_category_name_english"),
        F.col("p_size").alias("product_size"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("o_orderpriority").alias("payment_type"),
        (F.col("l_quantity").cast("int") % 10 + 1).alias("payment_installments"),
        F.when((ok + pk) % NULL_PAYMENT_EVERY != 0, price * (1 - F.col("l_discount")))
         .alias("payment_value"),
        ok.alias("review_id"),
        F.when(ok % NULL_SCORE_EVERY != 0, (1 + (ok * 13) % 5).cast("int")).alias("review_score"),
        "review_key", *more,
    )


def review_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_key -> review_comment_message`` over the whole text table."""
    return load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_key"), F.col("text").alias("review_comment_message"))


def listing_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in of the catalogue columns that the order lines lack: one row a
    product, sizes as in ``products.part_dimensions`` (a cube of side
    ``p_size`` that weighs ``p_size`` x 100 g)."""
    pk, size = F.col("p_partkey"), F.col("p_size")
    return load_table(spark, sf_dir, "part").select(
        pk.alias("product_id"),
        F.when(pk % NULL_LOCAL_CATEGORY_EVERY != 0, F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.when(pk % LONG_DESCRIPTION_EVERY == 0, LONG_DESCRIPTION).when(pk % NULL_DESCRIPTION_EVERY != 0, 200 + pk % 700)
         .cast("int").alias("product_description_lenght"),
        (1 + pk % 5).cast("int").alias("product_photos_qty"),
        (size * 100).alias("product_weight_g"), size.alias("product_length_cm"), size.alias("product_height_cm"),
        size.alias("product_width_cm"))


def with_listing(fact: DataFrame, listings: DataFrame) -> DataFrame:
    """Order lines with the columns of their product and the zip prefix of
    their customer."""
    return fact.join(listings, "product_id", "left") \
               .withColumn("customer_zip_code_prefix", (F.col("customer_unique_id") % ZIP_PREFIXES).cast("int"))
