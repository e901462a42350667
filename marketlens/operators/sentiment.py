"""Review sentiment aggregates and review-text statistics (G13–G22, G35,
G36, N13, W5, F2, F4, F5, J3, T4).

Text work is done once per distinct review text and weighted by how many
order lines reference it (``text_multiplicity``), instead of re-tokenising
the same text on every fanned-out fact row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.money import pct, rounded
from marketlens.operators.kpis import top_categories_by_revenue
from marketlens.sources.store import materialize

CAT = "product_category_name_english"
LABELS = ("Negative", "Neutral", "Positive")


def reviews(fact: DataFrame) -> DataFrame:                       # W5, F4
    """One row per review id: its first order line in (item, product,
    seller) order.  ``min(struct)`` is a partially aggregated hash aggregate,
    so an order with many lines is reduced map-side."""
    first = F.min(F.struct("order_item_id", "product_id", "seller_id", "review_score", "sentiment",
                           "delivery_status", F.col(CAT).alias("category"),
                           F.col("customer_state").alias("state"), "review_key")).alias("r")
    return fact.where(F.col("review_id").isNotNull()).groupBy("review_id").agg(first).select("review_id", "r.*")


def labelled(revs: DataFrame) -> DataFrame:                      # F2
    return revs.where(F.col("sentiment") != "Unknown")


def distribution(lab: DataFrame) -> DataFrame:                   # G13
    counts = lab.groupBy("sentiment").agg(F.count(F.lit(1)).alias("reviews"),
                                          F.sum("review_score").alias("_s"))
    all_ = Window.partitionBy()
    return counts.select("sentiment", "reviews",
                         pct(F.col("reviews"), F.sum("reviews").over(all_)).alias("share_pct"),
                         F.sum("reviews").over(all_).alias("total_reviews"),
                         F.round(F.sum("_s").over(all_) / F.sum("reviews").over(all_), 2).alias("avg_review_score"))


def crosstab(lab: DataFrame, row: str, labels: Sequence[str] = LABELS) -> DataFrame:   # G14, T4
    """Row-normalised % of each sentiment per ``row`` value (missing -> 0)."""
    piv = lab.groupBy(row).pivot("sentiment", list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))
    total = sum((F.col(lbl) for lbl in labels), F.lit(0))
    return piv.select(row, *[pct(F.col(lbl), total).alias(lbl) for lbl in labels])


def by_top_categories(lab: DataFrame, categories: DataFrame) -> DataFrame:   # G15, F5
    """Crosstab restricted to a category list (left-semi join keeps the
    list's membership semantics without collecting it)."""
    keep = lab.join(categories.select(F.col(CAT).alias("category")), "category", "left_semi")
    return crosstab(keep, "category")


def by_top_states(lab: DataFrame, n: int = 10) -> DataFrame:     # G16, J3
    top = (lab.groupBy("state").agg(F.count(F.lit(1)).alias("_c"))
              .orderBy(F.desc("_c"), "state").limit(n).select("state"))
    return crosstab(lab.join(top, "state", "left_semi"), "state")


def score_distribution(fact: DataFrame) -> DataFrame:            # G17
    c = fact.where(F.col("review_score").isNotNull()).groupBy("review_score").agg(F.count(F.lit(1)).alias("rows"))
    return c.select("review_score", "rows", pct(F.col("rows"), F.sum("rows").over(Window.partitionBy())).alias("pct"))


def delivery_days_by_score(fact: DataFrame) -> DataFrame:        # G18
    return (fact.where(F.col("review_score").isNotNull()).groupBy("review_score")
                .agg(rounded(F.avg("delivery_days"), 4).alias("avg_delivery_days")))


def comment_behaviour(fact: DataFrame) -> DataFrame:             # G19
    return fact.groupBy("sentiment").agg(rounded(F.avg("has_comment"), 2).alias("has_comment"),
                                         rounded(F.avg("comment_length"), 2).alias("comment_length"))


def state_polarity(fact: DataFrame) -> DataFrame:                # G20
    pn = fact.where(F.col("sentiment").isin("Positive", "Negative"))
    ct = crosstab(pn.withColumnRenamed("customer_state", "state"), "state", ("Positive", "Negative"))
    return ct.withColumn("rank", F.row_number().over(Window.orderBy("Positive", "state")))


def category_volume(fact: DataFrame, n: int = 10) -> DataFrame:  # G21
    return (fact.where(F.col(CAT).isNotNull() & (F.col(CAT) != "Unknown")).groupBy(CAT)
                .agg(F.count(F.lit(1)).alias("reviews")).orderBy(F.desc("reviews"), CAT).limit(n))


def order_status_counts(fact: DataFrame) -> DataFrame:           # G22
    c = fact.groupBy("order_status").agg(F.count(F.lit(1)).alias("rows"))
    return c.select("order_status", "rows", pct(F.col("rows"), F.sum("rows").over(Window.partitionBy())).alias("pct"))


def text_multiplicity(fact: DataFrame) -> DataFrame:
    """review_key -> number of order lines carrying that text (null key =
    lines without text)."""
    return fact.groupBy("review_key").agg(F.count(F.lit(1)).alias("lines"))


def cleaned_texts(messages: DataFrame, stopwords=T.PT_STOPWORDS) -> DataFrame:
    return messages.select("review_key", T.clean_tokens(F.col("review_comment_message"), stopwords).alias("tokens"))


def word_frequency(fact: DataFrame, messages: DataFrame, n: int | None = None,
                   stopwords=T.PT_STOPWORDS) -> DataFrame:        # G35
    """All words with their counts, or the ``n`` most frequent."""
    toks = cleaned_texts(messages, stopwords)
    w = text_multiplicity(fact).join(toks, "review_key")
    counts = w.select(F.explode("tokens").alias("word"), "lines").groupBy("word").agg(F.sum("lines").alias("count"))
    return counts if n is None else counts.orderBy(F.desc("count"), "word").limit(n)


def top_bigrams(fact: DataFrame, messages: DataFrame, n: int = 20,
                stopwords=T.PT_STOPWORDS) -> DataFrame:           # G36
    toks = cleaned_texts(messages, stopwords)
    w = text_multiplicity(fact).join(toks, "review_key")
    return (w.select(F.explode(T.bigrams(F.col("tokens"))).alias("bigram"), "lines").groupBy("bigram")
             .agg(F.sum("lines").alias("count")).orderBy(F.desc("count"), "bigram").limit(n))


def word_count_histogram(fact: DataFrame, messages: DataFrame, bins: int = 30,
                         stopwords=T.PT_STOPWORDS) -> DataFrame:  # N13
    """Equal-width histogram of cleaned word counts over order lines
    (lines without text count 0 words)."""
    wc = cleaned_texts(messages, stopwords).select("review_key", F.size("tokens").alias("words"))
    lines = text_multiplicity(fact).join(wc, "review_key", "left") \
        .withColumn("words", F.coalesce("words", F.lit(0)))
    # one row per distinct text key, read three times below: write it once
    lines = materialize(fact.sparkSession, lines, "text-lines")
    rng = lines.agg(F.min("words").alias("lo"), F.max("words").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("words") - F.col("lo")) * float(bins) / width), F.lit(bins - 1))).cast("int")
    counts = lines.crossJoin(F.broadcast(rng)).groupBy(b.alias("bin")).agg(F.sum("lines").alias("count"))
    spine = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return (spine.join(counts, "bin", "left")
                 .select("bin",
                         F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 4).alias("lower"),
                         F.round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins, 4).alias("upper"),
                         F.coalesce("count", F.lit(0)).alias("count")))


def default_top_categories(fact: DataFrame, n: int = 10) -> DataFrame:
    """Membership list for G15: the top-n categories by revenue."""
    return top_categories_by_revenue(fact, n).select(CAT)
