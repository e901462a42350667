"""Sentiment and review-text queries (G13–G22, G35, G36, N13) and oracles."""
from __future__ import annotations

from marketlens.functions.text import PT_STOPWORDS
from marketlens.operators import sentiment as se
from marketlens.operators.fact import enriched
from marketlens.plans.oracle import over_fact
from marketlens.plans.registry import query
from marketlens.sources.master import review_messages

REVIEW_CTES = """
revs AS (SELECT * FROM (SELECT review_id, review_score, sentiment, delivery_status,
                               product_category_name_english AS category, customer_state AS state,
                               row_number() OVER (PARTITION BY review_id ORDER BY order_item_id, product_id, seller_id) AS rn
                        FROM fact WHERE review_id IS NOT NULL) WHERE rn = 1),
lab AS (SELECT * FROM revs WHERE sentiment <> 'Unknown')"""

_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in PT_STOPWORDS) + "]"
TOKENS_SQL = ("list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
              "lower(coalesce({c}, '')), '<.*?>', '', 'g'), 'http\\S+', '', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'), "
              "'[0-9]+', '', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 1 AND NOT list_contains(" + _STOP_SQL + ", w))")


def tokens_sql(c: str) -> str:
    return TOKENS_SQL.format(c=c)


def crosstab_sql(src: str, row: str, labels=("Negative", "Neutral", "Positive")) -> str:
    total = " + ".join(f"c_{lbl}" for lbl in labels)
    counts = ", ".join(f"count(*) FILTER (WHERE sentiment = '{lbl}') AS c_{lbl}" for lbl in labels)
    shares = ", ".join(f"round(c_{lbl} * 100.0 / ({total}), 2) AS {lbl}" for lbl in labels)
    return f"SELECT {row}, {shares} FROM (SELECT {row}, {counts} FROM {src} GROUP BY {row})"


def _lab(spark, sf_dir):
    return se.labelled(se.reviews(enriched(spark, sf_dir)))


@query("sent_distribution", "G13 W5 F2 F4", over_fact("""
SELECT sentiment, count(*) AS reviews, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct,
       CAST(sum(count(*)) OVER () AS BIGINT) AS total_reviews,
       round(sum(sum(review_score)) OVER () / sum(count(*)) OVER (), 2) AS avg_review_score
FROM lab GROUP BY sentiment""", REVIEW_CTES))
def sent_distribution(spark, sf_dir):
    return se.distribution(_lab(spark, sf_dir))


@query("sent_by_delivery", "G14 T4", over_fact(crosstab_sql("lab", "delivery_status"), REVIEW_CTES))
def sent_by_delivery(spark, sf_dir):
    return se.crosstab(_lab(spark, sf_dir), "delivery_status")


@query("sent_by_top_category", "G15 F5", over_fact(crosstab_sql(
    "(SELECT * FROM lab WHERE category IN (SELECT product_category_name_english FROM topcats))", "category"),
    REVIEW_CTES + """,
topcats AS (SELECT product_category_name_english FROM fact WHERE product_category_name_english IS NOT NULL
            GROUP BY 1 ORDER BY round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) DESC, 1 LIMIT 10)"""))
def sent_by_top_category(spark, sf_dir):
    fact = enriched(spark, sf_dir)
    return se.by_top_categories(se.labelled(se.reviews(fact)), se.default_top_categories(fact))


@query("sent_by_top_state", "G16 J3", over_fact(crosstab_sql(
    "(SELECT * FROM lab WHERE state IN (SELECT state FROM lab GROUP BY state ORDER BY count(*) DESC, state LIMIT 10))",
    "state"), REVIEW_CTES))
def sent_by_top_state(spark, sf_dir):
    return se.by_top_states(_lab(spark, sf_dir))


@query("sent_score_distribution", "G17", over_fact("""
SELECT review_score, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM fact WHERE review_score IS NOT NULL GROUP BY review_score"""))
def sent_score_distribution(spark, sf_dir):
    return se.score_distribution(enriched(spark, sf_dir))


@query("sent_delivery_days_by_score", "G18", over_fact("""
SELECT review_score, round(avg(delivery_days), 4) AS avg_delivery_days
FROM fact WHERE review_score IS NOT NULL GROUP BY review_score"""))
def sent_delivery_days_by_score(spark, sf_dir):
    return se.delivery_days_by_score(enriched(spark, sf_dir))


@query("sent_comment_behaviour", "G19 P7", over_fact("""
SELECT sentiment, round(avg(has_comment), 2) AS has_comment, round(avg(comment_length), 2) AS comment_length
FROM fact GROUP BY sentiment"""))
def sent_comment_behaviour(spark, sf_dir):
    return se.comment_behaviour(enriched(spark, sf_dir))


@query("sent_state_polarity", "G20", over_fact(
    "SELECT *, row_number() OVER (ORDER BY Positive, state) AS rank FROM ("
    + crosstab_sql("(SELECT customer_state AS state, sentiment FROM fact WHERE sentiment IN ('Positive', 'Negative'))",
                   "state", ("Positive", "Negative")) + ")"))
def sent_state_polarity(spark, sf_dir):
    return se.state_polarity(enriched(spark, sf_dir))


@query("sent_category_volume", "G21", over_fact("""
SELECT product_category_name_english, count(*) AS reviews FROM fact
WHERE product_category_name_english IS NOT NULL AND product_category_name_english <> 'Unknown'
GROUP BY 1 ORDER BY reviews DESC, 1 LIMIT 10"""))
def sent_category_volume(spark, sf_dir):
    return se.category_volume(enriched(spark, sf_dir))


@query("sent_order_status", "G22", over_fact("""
SELECT order_status, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM fact GROUP BY order_status"""))
def sent_order_status(spark, sf_dir):
    return se.order_status_counts(enriched(spark, sf_dir))


@query("text_word_frequency", "G35 P19", over_fact(f"""
SELECT word, count(*) AS count FROM (SELECT unnest({tokens_sql('review_comment_message')}) AS word FROM fact)
GROUP BY word"""))
def text_word_frequency(spark, sf_dir):
    return se.word_frequency(enriched(spark, sf_dir), review_messages(spark, sf_dir))


@query("text_top_bigrams", "G36 P19", over_fact(f"""
SELECT bigram, count(*) AS count FROM (
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram
  FROM (SELECT {tokens_sql('review_comment_message')} AS t FROM fact))
GROUP BY bigram ORDER BY count DESC, bigram LIMIT 20"""))
def text_top_bigrams(spark, sf_dir):
    return se.top_bigrams(enriched(spark, sf_dir), review_messages(spark, sf_dir))


@query("text_length_histogram", "N13", over_fact(f"""
SELECT s.bin, round(r.lo + s.bin * (r.hi - r.lo) / 30, 4) AS lower,
       round(r.lo + (s.bin + 1) * (r.hi - r.lo) / 30, 4) AS upper, coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 30)) s
CROSS JOIN (SELECT min(words) AS lo, max(words) AS hi FROM w) r
LEFT JOIN (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor(CAST(words - lo AS DOUBLE) * 30.0::DOUBLE / CAST(hi - lo AS DOUBLE)), 29) AS INTEGER) END AS bin,
                  count(*) AS count
           FROM w, (SELECT min(words) AS lo, max(words) AS hi FROM w) GROUP BY 1) c ON c.bin = s.bin""",
    f"w AS (SELECT CAST(len({tokens_sql('review_comment_message')}) AS INTEGER) AS words FROM fact)"))
def text_length_histogram(spark, sf_dir):
    return se.word_count_histogram(enriched(spark, sf_dir), review_messages(spark, sf_dir))
