"""Question routing and insight metrics as table jobs.

R6 classifies a *table* of questions with ordered, first-match substring
rules (an earlier rule wins, and a keyword matches inside longer words, as
in the modelled assistant) and attaches the KPI values each intent quotes.
R7 produces, for the platform and every (category, state) cell, the figures
the rule-based report quotes, long-format with a threshold flag.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.money import pct, rounded
from marketlens.functions.text import strip

# Routing rules in evaluation order (intent, keywords).
INTENT_RULES = (
    ("revenue", ("revenue", "sales", "money", "total", "gmv", "income", "turnover", "earned")),
    ("logistics", ("late", "deliver", "logistic", "shipping", "delay", "carrier", "transit", "ontime")),
    ("sentiment", ("sentiment", "review", "happy", "unhappy", "satisfaction", "feedback", "rating", "score", "feel")),
    ("forecast", ("forecast", "predict", "future", "next", "trend", "projection", "model")),
    ("categories", ("recommend", "opportunity", "growth", "best seller", "top category", "categor", "product")),
    ("geography", ("state", "region", "geographic", "location", "city", "where", "sp", "rj", "mg")),
    ("payments", ("payment", "credit", "boleto", "voucher", "method", "card")),
    ("retention", ("return", "loyal", "repeat", "retention", "customer")),
    ("sellers", ("seller", "vendor", "merchant", "partner")),
    ("help", ("help", "what can", "capabilities", "hello", "hi")),
)
FALLBACK_INTENT = "snapshot"

# KPI names quoted per intent.
INTENT_METRICS = {
    "revenue": ("total_revenue", "total_orders", "avg_order_value", "data_range"),
    "logistics": ("delivery_success_rate_pct", "late_delivery_rate_pct", "avg_delivery_days", "cancellation_rate_pct"),
    "sentiment": ("positive_pct", "negative_pct", "neutral_pct", "reviews"),
    "forecast": ("forecast_wape_pct", "forecast_r2"),
    "categories": ("top_category_revenue",),
    "geography": ("top_state_customers",),
    "payments": ("payment_share_pct",),
    "retention": ("returning_customer_rate_pct", "total_customers"),
    "sellers": ("total_sellers",),
    "snapshot": ("total_revenue", "total_orders", "positive_pct", "late_delivery_rate_pct",
                 "returning_customer_rate_pct"),
}

# Star -> five-level label, and the keyword fallback of the
# sentiment scorer with its fixed class probabilities (Negative, Neutral, Positive).
FIVE_LEVEL = {1: "Very Negative", 2: "Negative", 3: "Neutral", 4: "Positive", 5: "Very Positive"}
POSITIVE_WORDS = ("bom", "otimo", "ótimo", "excelente", "rapido", "rápido", "recomendo", "perfeito", "adorei",
                  "gostei", "parabens", "chegou antes")
NEGATIVE_WORDS = ("ruim", "pessimo", "péssimo", "demorou", "atrasou", "defeito", "quebrado", "nao recebi",
                  "não recebi", "errado", "danificado")
FALLBACK_PROBS = {"Positive": (0.05, 0.10, 0.85), "Negative": (0.85, 0.10, 0.05), "Mixed": (0.15, 0.20, 0.65)}
LATE_BENCHMARK_PCT = 4.0


def five_level(score) -> F.Column:                                     # P20
    expr = F.lit("Unknown")
    for k in sorted(FIVE_LEVEL, reverse=True):
        expr = F.when(score == k, FIVE_LEVEL[k]).otherwise(expr)
    return expr


def keyword_kind(text) -> F.Column:                                    # P21
    """Positive, Negative or Mixed (both or none) by substring hits."""
    t = F.coalesce(text, F.lit(""))
    pos = F.exists(F.array(*[F.lit(w) for w in POSITIVE_WORDS]), lambda w: t.contains(w))
    neg = F.exists(F.array(*[F.lit(w) for w in NEGATIVE_WORDS]), lambda w: t.contains(w))
    return F.when(pos & ~neg, "Positive").when(neg & ~pos, "Negative").otherwise("Mixed")


def keyword_sentiment(kind) -> tuple[F.Column, F.Column]:              # P21
    """(label, probabilities[Neg, Neu, Pos]) of a kind, which is read several
    times: pass a column, not the search of a text."""
    label = F.when(kind == "Negative", "Negative").otherwise("Positive")
    probs = F.when(kind == "Positive", F.array(*[F.lit(p) for p in FALLBACK_PROBS["Positive"]])) \
             .when(kind == "Negative", F.array(*[F.lit(p) for p in FALLBACK_PROBS["Negative"]])) \
             .otherwise(F.array(*[F.lit(p) for p in FALLBACK_PROBS["Mixed"]]))
    return label, probs


def route(questions: DataFrame, text_col: str = "question") -> DataFrame:   # R6
    q = F.lower(strip(F.col(text_col)))
    intent = F.lit(FALLBACK_INTENT)
    for name, words in reversed(INTENT_RULES):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        intent = F.when(hit, name).otherwise(intent)
    return questions.withColumn("intent", intent)


def intent_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("intent").agg(F.count(F.lit(1)).alias("questions"))


QUOTED = 5          # categories and states an answer quotes


def kpi_long(headline: DataFrame, delivery: DataFrame, sentiment_dist: DataFrame) -> DataFrame:
    """One (metric, label, value) row per single KPI the answers quote."""
    h = headline.crossJoin(delivery)
    shares = sentiment_dist.groupBy().pivot("sentiment", ["Positive", "Negative", "Neutral"]).agg(F.first("share_pct"))
    shares = shares.select(F.col("Positive").alias("positive_pct"), F.col("Negative").alias("negative_pct"),
                           F.col("Neutral").alias("neutral_pct"))
    n = sentiment_dist.agg(F.max("total_reviews").cast("double").alias("reviews"))
    wide = h.crossJoin(shares).crossJoin(n)
    metrics = sorted({m for ms in INTENT_METRICS.values() for m in ms} & set(wide.columns))
    long = wide.select([F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.select("metric", F.lit(None).cast("string").alias("label"), "value")


def listed(table: DataFrame, metric: str, label: str | F.Column, value: str | None) -> DataFrame:
    """A small KPI table as (metric, label, value) rows."""
    label = F.col(label) if isinstance(label, str) else label
    return table.select(F.lit(metric).alias("metric"), label.alias("label"),
                        (F.col(value) if value else F.lit(None)).cast("double").alias("value"))


def kpi_lists(top_categories: DataFrame, top_states: DataFrame, payment_share: DataFrame, dates: DataFrame) -> DataFrame:
    """The KPIs the answers quote as lists: one row per category, state and
    payment type, and the dates the figures span."""
    return listed(top_categories, "top_category_revenue", "product_category_name_english", "revenue") \
        .unionByName(listed(top_states, "top_state_customers", "customer_state", "customers")) \
        .unionByName(listed(payment_share, "payment_share_pct", "payment_type", "share_pct")) \
        .unionByName(listed(dates, "data_range", F.concat_ws(" to ", "first_date", "last_date"), None))


def answers(routed: DataFrame, kpis: DataFrame) -> DataFrame:
    """Each routed question with the KPI rows its intent quotes; questions
    whose intent quotes none (help), or none of ``kpis``, keep one row."""
    pairs = [(i, m) for i, ms in INTENT_METRICS.items() for m in ms]
    spark = routed.sparkSession
    im = spark.createDataFrame(pairs, "intent string, metric string")      # fixed rule table
    quoted = F.broadcast(im.join(kpis, "metric"))                           # some 40 rows
    return routed.join(quoted, "intent", "left")


CAT = "product_category_name_english"


#: Column -> number of its different values in a cell.
CELL_COUNTS = {"order_id": "total_orders", "customer_unique_id": "total_customers", "seller_id": "total_sellers"}


def _cell_sums(fact: DataFrame) -> DataFrame:
    """Sums of every cell of the cube of category and state, from the sums of
    each (category, state); ``_g`` tells ALL from null."""
    delivered = F.col("order_status") == "delivered"
    lab = F.col("sentiment").isin("Positive", "Negative", "Neutral")
    sums = {"revenue": F.sum(F.col("payment_value").cast("decimal(18,6)")), "rows": F.count(F.lit(1)),
            "labelled": F.sum(lab.cast("int")),
            "positive": F.sum((F.col("sentiment") == "Positive").cast("int")),
            "negative": F.sum((F.col("sentiment") == "Negative").cast("int")),
            "late": F.sum((delivered & (F.col("delivery_status") == "Late")).cast("int")),
            "delivered": F.sum(delivered.cast("int")),
            "delivered_rows": F.count(F.when(delivered, 1)), "canceled_rows": F.count(F.when(F.col("order_status") == "canceled", 1)),
            "returning": F.sum("is_returning_customer"), "typed": F.count("is_returning_customer"),
            "days": F.sum(F.when(delivered, F.col("delivery_days"))), "timed": F.count(F.when(delivered, F.col("delivery_days")))}
    pairs = fact.groupBy(F.col(CAT).alias("category"), F.col("customer_state").alias("state")) \
                .agg(*[v.alias(k) for k, v in sums.items()])
    cells = pairs.cube("category", "state").agg(*[F.sum(k).alias(k) for k in sums], F.grouping_id().alias("_g"))
    return cells.withColumn("revenue", F.col("revenue").cast("decimal(28,6)"))


def _cell_counts(fact: DataFrame, col: str, name: str) -> DataFrame:
    """Different values of ``col`` in every cell of the cube.  A value's
    (category, state) pairs are made distinct, so a window over one value has
    at most as many rows as there are cells; its first row, and its first row
    of each category and of each state, count for the coarser cells."""
    own = fact.where(F.col(col).isNotNull()) \
              .select(F.col(col).alias("_v"), F.col(CAT).alias("category"), F.col("customer_state").alias("state")).distinct()

    def first(by: list[str], order: list[str]):
        return (F.row_number().over(Window.partitionBy("_v", *by).orderBy(*order)) == 1).cast("long")
    marked = own.withColumns({"_g1": first(["category"], ["state"]), "_g3": first([], ["category", "state"])}) \
                .withColumn("_g2", first(["state"], ["category"]))
    pairs = marked.groupBy("category", "state").agg(F.count(F.lit(1)).alias("_g0"), *[F.sum(c).alias(c) for c in ("_g1", "_g2", "_g3")])
    cells = pairs.cube("category", "state").agg(*[F.sum(f"_g{g}").alias(f"_g{g}") for g in range(4)], F.grouping_id().alias("_g"))
    return cells.select("category", "state", "_g", F.element_at(F.array("_g0", "_g1", "_g2", "_g3"), (F.col("_g") + 1).cast("int")).alias(name))


def insight_metrics(fact: DataFrame) -> DataFrame:                      # R7
    """Platform and every (category|ALL, state|ALL) cell, long format:
    (focus, category, state, metric, value, flag)."""
    every = _cell_sums(fact)
    for col, name in CELL_COUNTS.items():
        every = every.unionByName(_cell_counts(fact, col, name), allowMissingColumns=True)
    keys = ["category", "state", "_g"]
    # one row a cell from each part
    cells = every.groupBy(*keys).agg(*[F.max(c).alias(c) for c in every.columns if c not in keys])
    orders = F.coalesce("total_orders", F.lit(0))
    share = lambda n, d: F.round(F.try_divide(F.col(n) * 100.0, F.col(d)), 2)
    mean = lambda n, d: F.try_divide(F.col(n), F.col(d))
    cells = cells.select(
        F.when(F.col("_g").bitwiseAND(2) > 0, "ALL").otherwise(F.col("category")).alias("category"),
        F.when(F.col("_g").bitwiseAND(1) > 0, "ALL").otherwise(F.col("state")).alias("state"),
        F.round("revenue", 2).cast("double").alias("total_revenue"), orders.cast("double").alias("total_orders"),
        F.round(F.col("revenue") / orders, 2).cast("double").alias("avg_order_value"),
        share("positive", "labelled").alias("positive_pct"), share("negative", "labelled").alias("negative_pct"),
        share("late", "delivered").alias("late_delivery_rate_pct"),
        F.round(mean("delivered_rows", "rows") * 100, 2).alias("delivery_success_rate_pct"),
        F.round(mean("canceled_rows", "rows") * 100, 2).alias("cancellation_rate_pct"),
        rounded(mean("returning", "typed") * 100, 2).alias("returning_customer_rate_pct"),
        rounded(mean("days", "timed"), 2).alias("avg_delivery_days"),
        *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("total_customers", "total_sellers")])
    focus = {"total_revenue": "General overview", "total_orders": "General overview",
             "avg_order_value": "General overview", "total_customers": "General overview",
             "total_sellers": "General overview", "returning_customer_rate_pct": "Growth",
             "positive_pct": "Customer Sentiment", "negative_pct": "Customer Sentiment",
             "late_delivery_rate_pct": "Logistics & Delivery", "delivery_success_rate_pct": "Logistics & Delivery",
             "cancellation_rate_pct": "Logistics & Delivery", "avg_delivery_days": "Logistics & Delivery"}
    long = cells.unpivot(["category", "state"], list(focus), "metric", "value")
    fmap = F.create_map(*[x for kv in focus.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    flag = F.when((F.col("metric") == "late_delivery_rate_pct") & (F.col("value") >= LATE_BENCHMARK_PCT),
                  "above_benchmark").otherwise("")
    return long.select(fmap[F.col("metric")].alias("focus"), "category", "state", "metric", "value", flag.alias("flag"))


def ranking_cells(fact: DataFrame) -> DataFrame:
    """The one pass over the fact that ``insight_rankings`` needs: revenue and
    rows by category, state and payment type."""
    return fact.groupBy(F.col(CAT).alias("category"), F.col("customer_state").alias("state"), "payment_type").agg(
        F.sum(F.col("payment_value").cast("decimal(18,6)")).alias("revenue"), F.count(F.lit(1)).alias("rows"))


def insight_rankings(cells: DataFrame, n: int = QUOTED) -> DataFrame:    # R7
    """The lists the report quotes, per slice (a category or ALL, a state or
    ALL): the ``n`` best categories by revenue of each state, the ``n`` states
    with most customer rows of each category, payment shares of every slice."""
    def over(col: str) -> F.Column:
        return F.explode(F.array(col, F.lit("ALL")))

    def best(by: str, label: str, value: F.Column) -> DataFrame:
        totals = cells.where(F.col(label).isNotNull()).withColumn("slice", over(by)) \
                      .groupBy("slice", label).agg(value.alias("value"))
        w = Window.partitionBy("slice").orderBy(F.desc("value"), label)
        return totals.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

    cats = best("state", "category", F.round(F.sum("revenue"), 2).cast("double")).select(
        F.lit("Product Recommendation").alias("focus"), F.lit("ALL").alias("category"), F.col("slice").alias("state"),
        F.lit("top_category_revenue").alias("metric"), "place", F.col("category").alias("label"), "value")
    states = best("category", "state", F.sum("rows").cast("double")).select(
        F.lit("Logistics & Delivery").alias("focus"), F.col("slice").alias("category"), F.lit("ALL").alias("state"),
        F.lit("top_state_customers").alias("metric"), "place", F.col("state").alias("label"), "value")
    paid = cells.where(F.col("payment_type").isNotNull()).withColumn("category", over("category")) \
                .withColumn("state", over("state")).groupBy("category", "state", "payment_type") \
                .agg(F.sum("rows").alias("rows"))
    w = Window.partitionBy("category", "state")
    pay = paid.select(F.lit("Growth").alias("focus"), "category", "state", F.lit("payment_share_pct").alias("metric"),
                      F.row_number().over(w.orderBy(F.desc("rows"), "payment_type")).alias("place"),
                      F.col("payment_type").alias("label"), pct(F.col("rows"), F.sum("rows").over(w)).alias("value"))
    return cats.unionByName(states).unionByName(pay)
