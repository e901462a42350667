"""Forecasting queries (G23, W1–W3, W7, M16–M23, U1) and their oracles.
Model-based entries have no SQL oracle (rows-only check)."""
from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from marketlens.functions.money import money_avg_sql
from marketlens.operators import drilldown as dd
from marketlens.operators import forecast as fc
from marketlens.operators.fact import enriched
from marketlens.plans.drilldown_queries import SUMMARY_CTE
from marketlens.plans.oracle import over_fact
from marketlens.plans.memo import memo
from marketlens.plans.registry import query
from marketlens.sources.store import materialize

_PI = "pi()"


def _fourier_sql(d: str) -> str:
    dow, wk, mo, doy = f"(isodow({d}) - 1)", f"weekofyear({d})", f"month({d})", f"dayofyear({d})"
    parts = []
    for name, x, per in (("dayofweek", dow, 7.0), ("week", wk, 52.0), ("month", mo, 12.0), ("dayofyear", doy, 365.0)):
        parts.append(f"round(sin(2 * {_PI} * {x} / {per}), 6) + 0.0 AS sin_{name}")
        parts.append(f"round(cos(2 * {_PI} * {x} / {per}), 6) + 0.0 AS cos_{name}")
    parts += [f"year({d}) AS year", f"quarter({d}) AS quarter", f"{mo} AS month",
              f"CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END AS is_weekend",
              f"CASE WHEN {mo} = 11 AND day({d}) >= 22 THEN 1 ELSE 0 END AS is_black_friday",
              f"CASE WHEN {mo} = 12 AND day({d}) <= 24 THEN 1 ELSE 0 END AS is_holiday_season"]
    return ",\n  ".join(parts)


_MIX = ",\n  ".join(
    [f"round(avg(CASE WHEN coalesce(cr, 0) = {k} THEN 1.0 ELSE 0.0 END), 4) AS cat_{k}" for k in range(1, 11)]
    + ["round(avg(CASE WHEN cr IS NULL THEN 1.0 ELSE 0.0 END), 4) AS cat_other"]
    + [f"round(avg(CASE WHEN sr = {k} THEN 1.0 ELSE 0.0 END), 4) AS state_{k}" for k in range(1, 4)]
    + ["round(avg(CASE WHEN sr IS NULL THEN 1.0 ELSE 0.0 END), 4) AS state_other"])

PANEL_CTE = f"""
topc AS (SELECT product_category_name_english AS c, row_number() OVER (ORDER BY m DESC, product_category_name_english) AS cr
         FROM (SELECT product_category_name_english, round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS m FROM fact
               WHERE product_category_name_english IS NOT NULL GROUP BY 1) QUALIFY cr <= 10),
tops AS (SELECT customer_state AS s, row_number() OVER (ORDER BY m DESC, customer_state) AS sr
         FROM (SELECT customer_state, count(*) AS m FROM fact WHERE customer_state IS NOT NULL GROUP BY 1) QUALIFY sr <= 3),
daily AS (
  SELECT CAST(order_purchase_timestamp AS DATE) AS date,
    CAST(round(sum(CAST(payment_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS daily_gmv,
    CAST(round(sum(CAST(total_item_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS daily_item_revenue,
    CAST(round(sum(CAST(freight_value AS DECIMAL(18,6))), 2) AS DOUBLE) AS shipping_revenue,
    count(order_item_id) AS order_volume,
    {money_avg_sql('price')} AS avg_price,
    {money_avg_sql('freight_pct')} AS avg_freight_pct,
    round(avg(payment_installments), 4) AS avg_installments, round(avg(is_installment), 4) AS is_installment_rate,
    round(avg(is_returning_customer), 4) AS is_returning_customer,
    {_MIX}
  FROM fact LEFT JOIN topc ON product_category_name_english = topc.c LEFT JOIN tops ON customer_state = tops.s
  WHERE order_status = 'delivered' GROUP BY 1),
panel AS (SELECT *, {_fourier_sql('date')} FROM daily)"""

_ROLLS = ",\n  ".join(
    [f"lag(daily_gmv, {k}) OVER w AS lag_{k}" for k in fc.LAGS]
    + [f"CASE WHEN count(daily_gmv) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN "
       f"round({fn}(daily_gmv) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 4) END AS roll_{nm}_{k}"
       for k in fc.ROLLS for fn, nm in (("avg", "mean"), ("stddev_samp", "std"))])
SUP_CTE = PANEL_CTE + f""",
sup AS (SELECT * FROM (SELECT *, {_ROLLS} FROM panel WINDOW w AS (ORDER BY date))
        WHERE {' AND '.join([f'lag_{k} IS NOT NULL' for k in fc.LAGS] + [f'roll_{nm}_{k} IS NOT NULL' for k in fc.ROLLS for nm in ('mean', 'std')])}),
split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date DESC) <= 30 THEN 'test' ELSE 'train' END AS split FROM sup)"""


def _panel(spark, sf_dir):
    """The platform's daily panel, one row per day: written once, so that the
    fact is not summed again for every query and model that reads it."""
    return memo(spark, sf_dir, "daily-panel",
                lambda: materialize(spark, fc.daily_panel(enriched(spark, sf_dir)), "fc-panel"))


@query("fc_daily_panel", "G23 P10 P11 P12 F1", over_fact("SELECT * FROM panel", PANEL_CTE))
def fc_daily_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query("fc_supervised", "W1 W2 W3 T2", over_fact("SELECT * EXCLUDE (split) FROM split", SUP_CTE))
def fc_supervised(spark, sf_dir):
    return fc.supervised(_panel(spark, sf_dir))


@query("fc_holdout_split", "M16", over_fact("SELECT date, split FROM split", SUP_CTE))
def fc_holdout_split(spark, sf_dir):
    return fc.holdout_split(fc.supervised(_panel(spark, sf_dir))).select("date", "split")


@query("fc_naive_metrics", "M22", over_fact("""
SELECT round(sum(abs(daily_gmv - lag_1)) / sum(abs(daily_gmv)) * 100, 2) AS WAPE_pct,
       round(avg(2 * abs(daily_gmv - lag_1) / (abs(daily_gmv) + abs(lag_1) + 1e-8)) * 100, 2) AS SMAPE_pct,
       round(avg(abs(daily_gmv - lag_1)), 2) AS MAE,
       round(sqrt(avg((daily_gmv - lag_1) * (daily_gmv - lag_1))), 2) AS RMSE,
       round(1 - sum((daily_gmv - lag_1) * (daily_gmv - lag_1)) / (count(daily_gmv) * var_pop(daily_gmv)), 4) AS R2
FROM split WHERE split = 'test'""", SUP_CTE))
def fc_naive_metrics(spark, sf_dir):
    return fc.metrics(fc.naive_forecast(fc.holdout_split(fc.supervised(_panel(spark, sf_dir)))))


@query("fc_history_tail", "W7", over_fact("""
SELECT date, daily_gmv FROM panel ORDER BY date DESC LIMIT 113""", PANEL_CTE))
def fc_history_tail(spark, sf_dir):
    return fc.history_tail(_panel(spark, sf_dir)).select("date", "daily_gmv")


SHARES_CTE = SUMMARY_CTE + """,
shares AS (SELECT CASE WHEN grouping(category, state) & 2 > 0 THEN 'ALL' ELSE category END AS category,
                  CASE WHEN grouping(category, state) & 1 > 0 THEN 'ALL' ELSE state END AS state,
                  sum(total_revenue) / (SELECT sum(total_revenue) FROM summary) AS share
           FROM summary GROUP BY CUBE (category, state))"""


@query("fc_slice_shares", "M21 J8", over_fact(
    "SELECT category, state, round(share * 100, 4) AS share_pct FROM shares", SHARES_CTE))
def fc_slice_shares(spark, sf_dir):
    sh = fc.slice_shares(dd.summary(enriched(spark, sf_dir)))
    return sh.select("category", "state", F.round(F.col("share") * 100, 4).alias("share_pct"))


@query("fc_slice_history", "M21 U1 F3", over_fact("""
SELECT category, state, date, 'Actual (History)' AS type, round(daily_gmv * share, 2) AS value
FROM (SELECT date, daily_gmv FROM panel ORDER BY date DESC LIMIT 113), shares""", PANEL_CTE + "," + SHARES_CTE))
def fc_slice_history(spark, sf_dir):
    """Daily history of every (category, state) slice."""
    shares = fc.slice_shares(dd.summary(enriched(spark, sf_dir)))
    return fc.slice_series(shares, fc.history_tail(_panel(spark, sf_dir)))


def _models(spark, sf_dir):
    # the supervised matrix is small (one row per day): write it once so
    # every boosting iteration reads it instead of recomputing the panel
    def build():
        split = materialize(spark, fc.holdout_split(fc.supervised(_panel(spark, sf_dir))).coalesce(1), "fc-split")
        fitted = fc.fit_all(fc.model_candidates(), {"train": split.where(F.col("split") == "train"), "all": split})
        evaluation = materialize(spark, fc.evaluate_models(split, fitted["train"]), "fc-eval")
        return split, (evaluation, fitted["all"])
    return memo(spark, sf_dir, "forecast-models", build)


@query("fc_model_evaluation", "M17 M18 M19 M22 M13")
def fc_model_evaluation(spark, sf_dir):
    _, (evaluation, _) = _models(spark, sf_dir)
    return evaluation


@query("ins_forecast_answers", "R6 M23")
def ins_forecast_answers(spark, sf_dir):
    """Questions about the forecast with the best model's hold-out figures."""
    _, (evaluation, _) = _models(spark, sf_dir)
    best = evaluation.join(fc.best_model_name(evaluation), "model")
    quoted = listed(best, "forecast_wape_pct", "model", "WAPE_pct").unionByName(listed(best, "forecast_r2", "model", "R2"))
    return answers(route(questions(spark, sf_dir)).where(F.col("intent") == "forecast"), quoted) \
        .select("qid", "question", "intent", "metric", "label", "value")


def _forecasts(spark, sf_dir):
    """Every candidate refit on the full supervised matrix and rolled forward
    90 days, written once."""
    _, (evaluation, fitted) = _models(spark, sf_dir)

    def build():
        return materialize(spark, fc.model_forecasts(_panel(spark, sf_dir), fitted, evaluation), "fc-forecasts")
    return memo(spark, sf_dir, "forecast-90d", build)


def _future(spark, sf_dir):
    """The forecast of the best model by hold-out WAPE."""
    return _forecasts(spark, sf_dir).where("is_best").drop("is_best", "WAPE_pct")


@query("fc_model_forecasts", "M18 M20 M23")
def fc_model_forecasts(spark, sf_dir):
    """One row per date and model; the best by hold-out WAPE is marked."""
    return _forecasts(spark, sf_dir)


@query("fc_future_90d", "M20 M23 U2")
def fc_future_90d(spark, sf_dir):
    return _future(spark, sf_dir)


_PANEL_KEYS = ("product_category_name_english", "customer_state")


@query("fc_panel_forecast", "M20 M21")
def fc_panel_forecast(spark, sf_dir):
    """Forecast of every (category, state) series by one pooled model, before
    and after reconciliation to the platform's forecast."""
    panel = fc.dense_panel(enriched(spark, sf_dir), _PANEL_KEYS, _panel(spark, sf_dir))
    return fc.panel_forecast(panel, _future(spark, sf_dir), _PANEL_KEYS)


@query("fc_slice_projection", "M21")
def fc_slice_projection(spark, sf_dir):
    """Projected total and daily mean of every (category, state) slice."""
    return fc.slice_projection(fc.slice_shares(dd.summary(enriched(spark, sf_dir))), _future(spark, sf_dir))


@query("fc_slice_outlook", "U1 M21 F3")
def fc_slice_outlook(spark, sf_dir):
    """History and forecast of every (category, state) slice, tagged by type."""
    return fc.slice_series(fc.slice_shares(dd.summary(enriched(spark, sf_dir))), fc.history_tail(_panel(spark, sf_dir)),
                           _future(spark, sf_dir))

from marketlens.sources import master as ms  # noqa: E402
from marketlens.sources.master import listing_attributes, with_listing  # noqa: E402
from marketlens.operators import classify as cl  # noqa: E402
from marketlens.operators import satisfaction as sat  # noqa: E402
from marketlens.operators import sentiment as se  # noqa: E402
from marketlens.operators import sentiment_ml as sml  # noqa: E402
from marketlens.operators.enrich import review_text_dim, spread_texts  # noqa: E402
from marketlens.operators.insights import answers, keyword_kind, keyword_sentiment, listed, route  # noqa: E402
from marketlens.operators.retrieval import questions  # noqa: E402
from marketlens.functions.text import clean_text  # noqa: E402


def _sentiment_model(spark, sf_dir):
    def build():
        fact = enriched(spark, sf_dir)
        terms = materialize(spark, sml.review_tokens(spread_texts(review_text_dim(spark, sf_dir))), "sent-tokens")
        corpus = sml.review_corpus(se.reviews(fact), terms)
        split = materialize(spark, cl.stratified_split(corpus, "sentiment", ["review_id"]), "sent-split")
        return split, terms, sml.SentimentModel().fit(split.where(F.col("split") == "train"), terms)
    return memo(spark, sf_dir, "sentiment-model", build)


@query("sent_model_report", "M1 M2 M3 M4")
def sent_model_report(spark, sf_dir):
    split, terms, model = _sentiment_model(spark, sf_dir)
    pred = model.score(split.where(F.col("split") == "test"), terms)
    return cl.report(pred, "sentiment", "predicted_sentiment")


@query("sent_batch_scoring", "M5")
def sent_batch_scoring(spark, sf_dir):
    split, terms, model = _sentiment_model(spark, sf_dir)
    return model.score(split, terms).select("review_id", "sentiment", "predicted_sentiment",
                                            "probabilities", "confidence")


def _keyword_ctes() -> str:
    from marketlens.operators.insights import FALLBACK_PROBS, NEGATIVE_WORDS, POSITIVE_WORDS
    from marketlens.plans.sentiment_queries import REVIEW_CTES, tokens_sql
    t = f"array_to_string({tokens_sql('review_text')}, ' ')"
    pos = " OR ".join(f"contains(ct, '{w}')" for w in POSITIVE_WORDS)
    neg = " OR ".join(f"contains(ct, '{w}')" for w in NEGATIVE_WORDS)
    probs = ", ".join(f"CASE kind WHEN 'Positive' THEN {FALLBACK_PROBS['Positive'][i]} WHEN 'Negative' THEN {FALLBACK_PROBS['Negative'][i]} "
                      f"ELSE {FALLBACK_PROBS['Mixed'][i]} END::DOUBLE AS {name}"
                      for i, name in enumerate(("p_negative", "p_neutral", "p_positive")))
    return REVIEW_CTES + f""",
revt AS (SELECT r.review_id, r.sentiment, min(f.review_text) AS review_text FROM lab r
         JOIN fact f ON f.review_id = r.review_id GROUP BY 1, 2),
kinds AS (SELECT sentiment, CASE WHEN ({pos}) AND NOT ({neg}) THEN 'Positive' WHEN ({neg}) AND NOT ({pos}) THEN 'Negative' ELSE 'Mixed' END AS kind
          FROM (SELECT sentiment, {t} AS ct FROM revt)),
pr AS (SELECT sentiment, CASE kind WHEN 'Negative' THEN 'Negative' ELSE 'Positive' END AS pred, {probs} FROM kinds),
classes AS (SELECT sentiment AS cls FROM pr UNION SELECT pred FROM pr),
per AS (SELECT c.cls, coalesce(t.tp * 1.0 / nullif(p.predicted, 0), 0.0) AS prec,
               coalesce(t.tp * 1.0 / nullif(s.support, 0), 0.0) AS rec, coalesce(s.support, 0) AS support
        FROM classes c
        LEFT JOIN (SELECT sentiment AS cls, count(*) AS support FROM pr GROUP BY 1) s ON s.cls = c.cls
        LEFT JOIN (SELECT pred AS cls, count(*) AS predicted FROM pr GROUP BY 1) p ON p.cls = c.cls
        LEFT JOIN (SELECT sentiment AS cls, count(*) AS tp FROM pr WHERE sentiment = pred GROUP BY 1) t ON t.cls = c.cls),
scored AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f FROM per)"""


_KEYWORD_REPORT = """
SELECT cls AS class, round(prec, 4) AS precision, round(rec, 4) AS recall, round(f, 4) AS f1, support FROM scored
UNION ALL
SELECT 'macro avg', round(avg(prec), 4), round(avg(rec), 4), round(avg(f), 4), sum(support)::BIGINT FROM scored
UNION ALL
SELECT 'weighted avg', round(sum(prec * support) / sum(support), 4), round(sum(rec * support) / sum(support), 4),
       round(sum(f * support) / sum(support), 4), sum(support)::BIGINT FROM scored
UNION ALL
SELECT 'accuracy', round(avg(CASE WHEN sentiment = pred THEN 1.0 ELSE 0.0 END), 4),
       round(avg(CASE WHEN sentiment = pred THEN 1.0 ELSE 0.0 END), 4),
       round(avg(CASE WHEN sentiment = pred THEN 1.0 ELSE 0.0 END), 4), count(*) FROM pr"""


def _keyword_scored(spark, sf_dir):
    """Every labelled review with the keyword scorer's label and its fixed
    probabilities.  Each distinct text is cleaned once, into a written column,
    and searched once for the keywords; a review carries only the kind found."""
    def build():
        fact = enriched(spark, sf_dir)
        clean = materialize(spark, spread_texts(review_text_dim(spark, sf_dir)).select(
            "review_key", clean_text(F.col("review_text")).alias("clean")), "clean-texts")
        kinds = materialize(spark, clean.select("review_key", keyword_kind(F.col("clean")).alias("kind")), "keyword-kinds")
        revs = se.labelled(se.reviews(fact)).join(kinds, "review_key", "left") \
                 .select("sentiment", F.coalesce("kind", keyword_kind(F.lit(""))).alias("kind"))
        label, probs = keyword_sentiment(F.col("kind"))
        names = ("p_negative", "p_neutral", "p_positive")
        return materialize(spark, revs.select("sentiment", label.alias("pred"), *[probs[i].alias(n) for i, n in enumerate(names)]),
                           "keyword-scores")
    return memo(spark, sf_dir, "keyword-scores", build)


@query("sent_keyword_report", "P21 M4 P19", over_fact(_KEYWORD_REPORT, _keyword_ctes()))
def sent_keyword_report(spark, sf_dir):
    """Keyword fallback scorer evaluated against the star-derived labels: every
    class, both averages and the accuracy."""
    return cl.report(_keyword_scored(spark, sf_dir), "sentiment", "pred")


@query("sent_keyword_confusion", "M4 P21", over_fact(
    "SELECT sentiment AS actual, pred AS predicted, count(*) AS n FROM pr GROUP BY 1, 2", _keyword_ctes()))
def sent_keyword_confusion(spark, sf_dir):
    """Confusion matrix of the keyword scorer."""
    return cl.confusion(_keyword_scored(spark, sf_dir), "sentiment", "pred")


@query("sent_keyword_probabilities", "P21", over_fact(
    "SELECT pred, p_negative, p_neutral, p_positive, count(*) AS reviews FROM pr GROUP BY ALL", _keyword_ctes()))
def sent_keyword_probabilities(spark, sf_dir):
    """Reviews by the label and the fixed probabilities the scorer gives."""
    return _keyword_scored(spark, sf_dir).groupBy("pred", "p_negative", "p_neutral", "p_positive").agg(F.count(F.lit(1)).alias("reviews"))


def _listed(spark, sf_dir):
    """The order lines with the catalogue columns of their products."""
    return with_listing(enriched(spark, sf_dir), listing_attributes(spark, sf_dir))


def _satisfaction_data(spark, sf_dir):
    filled = _filled(spark, sf_dir)

    def build():
        train, test, _ = sat.prepare(filled)
        train = materialize(spark, train, "sat-train")
        test = materialize(spark, test, "sat-test")
        return materialize(spark, sat.smote(train), "sat-smote"), test
    return memo(spark, sf_dir, "satisfaction-data", build)


def _satisfaction(spark, sf_dir, *names):
    """Balanced rows, test rows and the named models (all, if none is named);
    each is fitted once a session, when a query first needs it."""
    balanced, test = _satisfaction_data(spark, sf_dir)
    known = sat.classifiers()
    fitted = {n: memo(spark, sf_dir, f"satisfaction-{n}", lambda n=n: sat.train_all(balanced, {n: known[n]})[n])
              for n in names or known}
    return balanced, test, fitted


@query("sat_smote_balance", "M8 M3")
def sat_smote_balance(spark, sf_dir):
    bal, _ = _satisfaction_data(spark, sf_dir)
    return bal.groupBy("review_score").agg(F.count(F.lit(1)).alias("rows"))


@query("sat_tree_search", "M10 M12")
def sat_tree_search(spark, sf_dir):
    """Search of the single tree: accuracy of 15 drawn points on 3 folds of the balanced rows."""
    balanced, _ = _satisfaction_data(spark, sf_dir)
    return memo(spark, sf_dir, "tree-search", lambda: sat.random_search(
        spark, "DecisionTree", DecisionTreeClassifier(seed=sat.SEED), sat.TREE_GRID, balanced))[0]


@query("sat_model_comparison", "M9 M10 M11 M13")
def sat_model_comparison(spark, sf_dir):
    _, test, fitted = _satisfaction(spark, sf_dir)
    return sat.comparison(fitted, test)


@query("sat_class_report", "M4")
def sat_class_report(spark, sf_dir):
    _, test, fitted = _satisfaction(spark, sf_dir, "RandomForest")
    return cl.report(sat.predict(fitted["RandomForest"], test), "review_score", "predicted_score")


@query("sat_importances", "M14")
def sat_importances(spark, sf_dir):
    return sat.importances(_satisfaction(spark, sf_dir, "RandomForest")[2]["RandomForest"])


@query("sat_sample_scores", "M15 M28")
def sat_sample_scores(spark, sf_dir):
    """A reproducible sample scored by every model; sampled before scoring."""
    _, test, fitted = _satisfaction(spark, sf_dir)
    few = test.orderBy(F.xxhash64("row_id", F.lit(sat.SEED)), "row_id").limit(10)
    return sat.seeded_sample(sat.side_by_side(fitted, few))


_LISTED_CTE = f"""
listed AS (SELECT f.*, CAST(customer_unique_id % {ms.ZIP_PREFIXES} AS INTEGER) AS customer_zip_code_prefix,
                  CASE WHEN p_partkey % {ms.NULL_LOCAL_CATEGORY_EVERY} <> 0 THEN p_brand END AS product_category_name,
                  length(p_name) AS product_name_lenght,
                  CASE WHEN p_partkey % {ms.LONG_DESCRIPTION_EVERY} = 0 THEN {ms.LONG_DESCRIPTION}
                       WHEN p_partkey % {ms.NULL_DESCRIPTION_EVERY} <> 0 THEN 200 + p_partkey % 700 END AS product_description_lenght,
                  1 + p_partkey % 5 AS product_photos_qty, p_size * 100 AS product_weight_g, p_size AS product_length_cm,
                  p_size AS product_height_cm, p_size AS product_width_cm,
                  floor((epoch_us(order_estimated_delivery_date) - epoch_us(order_delivered_customer_date)) / 86400000000.0) AS delivery_vs_estimated,
                  (epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp)) / 3600000000.0 AS approval_hours
           FROM fact f LEFT JOIN part ON p_partkey = product_id),
reviewed AS (SELECT * FROM listed WHERE review_score IS NOT NULL),
mf AS (SELECT review_score, """ + ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in sat.NUMERIC) + """,
              """ + ", ".join(f"coalesce({c}, (SELECT {c} FROM reviewed WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}"
                              for c in sat.CATEGORICAL) + """
       FROM reviewed)"""
_FILLED_CTE = _LISTED_CTE
for _i, _c in enumerate(sat.OUTLIER_COLS):      # each column's bounds come from the rows that the earlier ones left
    _from = "mf" if _i == 0 else f"o{_i - 1}"
    _FILLED_CTE += f""",
o{_i} AS MATERIALIZED (SELECT t.* FROM {_from} t, (SELECT quantile_cont({_c}, 0.25) AS q1, quantile_cont({_c}, 0.75) AS q3 FROM {_from})
         WHERE {_c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
_FILLED_SUMS = ("approval_hours", "delivery_days", "delivery_vs_estimated", "product_description_lenght", "product_name_lenght")
_FILLED_SQL = over_fact(f"""
SELECT a.*, b.kept_rows
FROM (SELECT review_score, count(*) AS rows, {", ".join(f"round(sum({c}), 2) AS {c}" for c in _FILLED_SUMS)} FROM mf GROUP BY 1) a
LEFT JOIN (SELECT review_score, count(*) AS kept_rows FROM o{len(sat.OUTLIER_COLS) - 1} GROUP BY 1) b USING (review_score)""", _FILLED_CTE)


def _filled(spark, sf_dir):
    def build():
        frame = materialize(spark, sat.model_frame(_listed(spark, sf_dir)), "sat-frame")    # medians and modes pass over it
        return materialize(spark, sat.fill(frame), "sat-filled")
    return memo(spark, sf_dir, "satisfaction-filled", build)


@query("sat_filled_rows", "N1 P4 F6", _FILLED_SQL)
def sat_filled_rows(spark, sf_dir):
    """By score: rows of the filled model frame, sums of filled features, and
    the rows that the outlier removal over its nine columns leaves."""
    frame = _filled(spark, sf_dir)
    left = sat.remove_outliers(frame).groupBy("review_score").agg(F.count(F.lit(1)).alias("kept_rows"))
    return frame.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("rows"), *[F.round(F.sum(c), 2).alias(c) for c in _FILLED_SUMS]) \
        .join(left, "review_score", "left")


@query("sat_mode_filled", "N4", over_fact(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS rows FROM mf GROUP BY 2" for c in sat.CATEGORICAL), _LISTED_CTE))
def sat_mode_filled(spark, sf_dir):
    """Values of the categorical features after the mode fill, with their rows."""
    frame = _filled(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in sat.CATEGORICAL])
    return frame.select(F.explode(each).alias("e")).groupBy("e.column_name", "e.value").agg(F.count(F.lit(1)).alias("rows"))


def _codes_sql() -> str:
    """Every value of each categorical column over all order lines; codes are
    places among the values of the reviewed lines, 0 for any other value."""
    return over_fact(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, value, coalesce(code, 0) AS code, rows
FROM (SELECT {c} AS value, count(*) AS rows FROM listed GROUP BY 1)
LEFT JOIN (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT {c} AS v FROM reviewed WHERE {c} IS NOT NULL)) ON v = value"""
                                        for c in sat.CATEGORICAL), _LISTED_CTE)


@query("sat_category_codes", "M6 J5", _codes_sql())
def sat_category_codes(spark, sf_dir):
    """Codes learned from the reviewed order lines, looked up for all lines."""
    _, idx = sat.encode(_filled(spark, sf_dir))
    coded = sat.encode_with(idx, _listed(spark, sf_dir).select(*sat.CATEGORICAL))
    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col(f"{c}_code").cast("int").alias("code"))
            for c in sat.CATEGORICAL]
    return coded.select(F.explode(F.array(*each)).alias("e")).groupBy("e.column_name", "e.value", "e.code") \
                .agg(F.count(F.lit(1)).alias("rows"))


@query("sat_scaled_means", "M7 M15", over_fact("SELECT CAST(review_score AS INTEGER) AS review_score, " + ", ".join(
    f"round(coalesce(avg(({c} - m_{c}) / nullif(s_{c}, 0)), 0), 4) + 0.0 AS {c}" for c in sat.NUMERIC) + """
FROM mf, (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in sat.NUMERIC) + """ FROM mf)
GROUP BY review_score""", _LISTED_CTE))
def sat_scaled_means(spark, sf_dir):
    """Mean of every standardised numeric feature by score, all reviewed lines."""
    scaled, _ = sat.scale(sat.encode(_filled(spark, sf_dir))[0])
    return scaled.groupBy("review_score").agg(*[(F.round(F.avg(c), 4) + 0.0).alias(c) for c in sat.NUMERIC])


_UNKNOWN = {"delivery_delay": 0.0, "review_score": 3.0}


@query("sat_unknown_indicators", "P13", over_fact("SELECT customer_state, count(*) AS rows, " + ", ".join(
    f"count(*) - count({c}) AS {c}_unknown, round(avg(coalesce(CAST({c} AS DOUBLE), {d})), 4) + 0.0 AS {c}"
    for c, d in _UNKNOWN.items()) + " FROM fact GROUP BY 1"))
def sat_unknown_indicators(spark, sf_dir):
    """Unknown delays and scores as flags with neutral values, by state."""
    df = sat.unknown_indicators(enriched(spark, sf_dir).select("customer_state", *_UNKNOWN), _UNKNOWN)
    return df.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"{c}_unknown").alias(f"{c}_unknown") for c in _UNKNOWN],
        *[(F.round(F.avg(c), 4) + 0.0).alias(c) for c in _UNKNOWN])
