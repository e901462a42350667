"""Daily GMV forecasting.

The panel is keyed by ``series`` (one platform-wide series by default, or
e.g. category × state), so windows partition by series and the recursive
forecast rolls all series of a task together.  A daily series has
one row per day: windows over it are bounded by the calendar, not by the
order volume.
"""
from __future__ import annotations

import copy
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler, StandardScaler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.money import money_avg, rounded
from marketlens.functions.trees import linear_of, trees_of
from marketlens.sources.store import materialize

CAT = "product_category_name_english"
# Fixed values of the modelled feature set.
LAGS = (1, 2, 3, 7, 14, 21, 30)
ROLLS = (7, 14, 30)
FEATURE_COLS = ("lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "lag_21", "lag_30",
                "roll_mean_7", "roll_std_7", "roll_mean_14", "roll_mean_30",
                "is_weekend", "sin_dayofweek", "cos_dayofweek", "sin_week", "cos_week",
                "sin_month", "cos_month", "sin_dayofyear", "cos_dayofyear",
                "is_black_friday", "is_holiday_season", "quarter", "year",
                "avg_freight_pct", "avg_installments", "avg_price")
LINEAR_COLS = ("sin_dayofweek", "cos_dayofweek", "sin_week", "cos_week",
               "sin_month", "cos_month", "sin_dayofyear", "cos_dayofyear",
               "is_weekend", "is_black_friday", "is_holiday_season", "quarter", "year",
               "avg_freight_pct", "avg_installments", "avg_price")
TOP_CATEGORIES = 10
TOP_STATES = 3
HOLDOUT_DAYS = 30
HORIZON_DAYS = 90
HISTORY_TAIL_DAYS = 113
EXOGENOUS_TAIL_DAYS = 30
HYBRID_TREE_WEIGHT, HYBRID_LINEAR_WEIGHT, HYBRID_FLOOR = 0.6, 0.4, 500.0
RIDGE_ALPHA = 10.0


def fourier(date: Column) -> dict[str, Column]:                   # P10, P12
    dow = F.weekday(date)
    wk, mo, doy = F.weekofyear(date), F.month(date), F.dayofyear(date)
    two_pi = 2 * math.pi
    return {
        "sin_dayofweek": F.sin(two_pi * dow / 7.0), "cos_dayofweek": F.cos(two_pi * dow / 7.0),
        "sin_week": F.sin(two_pi * wk / 52.0), "cos_week": F.cos(two_pi * wk / 52.0),
        "sin_month": F.sin(two_pi * mo / 12.0), "cos_month": F.cos(two_pi * mo / 12.0),
        "sin_dayofyear": F.sin(two_pi * doy / 365.0), "cos_dayofyear": F.cos(two_pi * doy / 365.0),
        "year": F.year(date), "quarter": F.quarter(date), "month": mo,
        "is_weekend": dow.isin(5, 6).cast("int"),
        "is_black_friday": ((mo == 11) & (F.dayofmonth(date) >= 22)).cast("int"),
        "is_holiday_season": ((mo == 12) & (F.dayofmonth(date) <= 24)).cast("int"),
    }


def top_ranked(fact: DataFrame, key: str, n: int, by_revenue: bool) -> DataFrame:   # P11
    """Top-n values of ``key`` with their rank (revenue or row count)."""
    metric = (F.round(F.sum(F.col("payment_value").cast("decimal(18,6)")), 2) if by_revenue
              else F.count(F.lit(1)))
    agg = fact.where(F.col(key).isNotNull()).groupBy(key).agg(metric.alias("_m"))
    return (agg.orderBy(F.desc("_m"), key).limit(n)
               .withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_m"), key)))
               .select(key, "_rank"))


def daily_panel(fact: DataFrame, series: Sequence[str] = ()) -> DataFrame:          # G23, F1, P11
    series = list(series)
    delivered = fact.where(F.col("order_status") == "delivered")
    cats = top_ranked(fact, CAT, TOP_CATEGORIES, True).withColumnRenamed("_rank", "_cat_rank")
    states = top_ranked(fact, "customer_state", TOP_STATES, False).withColumnRenamed("_rank", "_state_rank")
    # both lists have at most TOP_* rows: broadcast is bounded
    rows = (delivered.join(F.broadcast(cats), CAT, "left")
                     .join(F.broadcast(states), "customer_state", "left")
                     .withColumn("date", F.to_date("order_purchase_timestamp")))
    mix = ([rounded(F.avg((F.coalesce(F.col("_cat_rank"), F.lit(0)) == k).cast("double")), 4).alias(f"cat_{k}")
            for k in range(1, TOP_CATEGORIES + 1)]
           + [rounded(F.avg(F.col("_cat_rank").isNull().cast("double")), 4).alias("cat_other")]
           + [rounded(F.avg((F.coalesce(F.col("_state_rank"), F.lit(0)) == k).cast("double")), 4).alias(f"state_{k}")
              for k in range(1, TOP_STATES + 1)]
           + [rounded(F.avg(F.col("_state_rank").isNull().cast("double")), 4).alias("state_other")])
    daily = rows.groupBy(*series, "date").agg(
        F.round(F.sum(F.col("payment_value").cast("decimal(18,6)")), 2).cast("double").alias("daily_gmv"),
        F.round(F.sum(F.col("total_item_value").cast("decimal(18,6)")), 2).cast("double").alias("daily_item_revenue"),
        F.round(F.sum(F.col("freight_value").cast("decimal(18,6)")), 2).cast("double").alias("shipping_revenue"),
        F.count("order_item_id").alias("order_volume"),
        money_avg("price", 4).alias("avg_price"),
        money_avg("freight_pct", 4).alias("avg_freight_pct"),
        rounded(F.avg("payment_installments"), 4).alias("avg_installments"),
        rounded(F.avg("is_installment"), 4).alias("is_installment_rate"),
        rounded(F.avg("is_returning_customer"), 4).alias("is_returning_customer"),
        *mix)
    cal = fourier(F.col("date"))
    return daily.withColumns({k: (rounded(v, 6) if k.startswith(("sin", "cos")) else v) for k, v in cal.items()})


def supervised(panel: DataFrame, series: Sequence[str] = (), target: str = "daily_gmv",
               drop_warmup: bool = True) -> DataFrame:                              # W1, W2, W3, T2
    """Row lags of the target and trailing (shifted) rolling mean/std, null
    until the frame is full (pandas ``rolling(w)`` semantics)."""
    w = Window.partitionBy(*series).orderBy("date")
    cols = {f"lag_{k}": F.lag(target, k).over(w) for k in LAGS}
    for k in ROLLS:
        frame = w.rowsBetween(-k, -1)
        full = F.count(target).over(frame) == k
        cols[f"roll_mean_{k}"] = F.when(full, rounded(F.avg(target).over(frame), 4))
        cols[f"roll_std_{k}"] = F.when(full, rounded(F.stddev_samp(target).over(frame), 4))
    out = panel.withColumns(cols)
    return out.na.drop(subset=list(cols)) if drop_warmup else out


def holdout_split(sup: DataFrame, series: Sequence[str] = (), test_days: int = HOLDOUT_DAYS) -> DataFrame:   # M16
    w = Window.partitionBy(*series).orderBy(F.desc("date"))
    return sup.withColumn("split", F.when(F.row_number().over(w) <= test_days, "test").otherwise("train"))


def metrics(pred: DataFrame, label: str = "daily_gmv", prediction: str = "prediction",
            by: Sequence[str] = ()) -> DataFrame:                                   # M22
    y, p = F.col(label), F.col(prediction)
    err = F.abs(y - p)
    return pred.groupBy(*by).agg(
        F.round(F.sum(err) / F.sum(F.abs(y)) * 100, 2).alias("WAPE_pct"),
        F.round(F.avg(2 * err / (F.abs(y) + F.abs(p) + F.lit(1e-8))) * 100, 2).alias("SMAPE_pct"),
        F.round(F.avg(err), 2).alias("MAE"),
        F.round(F.sqrt(F.avg(err * err)), 2).alias("RMSE"),
        F.round(1 - F.sum((y - p) * (y - p)) / (F.count(y) * F.var_pop(y)), 4).alias("R2"))


def naive_forecast(split: DataFrame) -> DataFrame:
    """Lag-1 baseline predictions on the hold-out rows."""
    return split.where(F.col("split") == "test").withColumn("prediction", F.col("lag_1"))


# ---- models (Spark ML) ---------------------------------------------------

def _assembler(cols, out="features"):
    return VectorAssembler(inputCols=list(cols), outputCol=out)


def random_forest(seed: int = 42) -> Pipeline:                                      # M17
    return Pipeline(stages=[_assembler(FEATURE_COLS), RandomForestRegressor(
        labelCol="daily_gmv", numTrees=200, maxDepth=15, minInstancesPerNode=2, seed=seed,
        featureSubsetStrategy="all",
        maxMemoryInMB=2048)])


def boosted(max_iter: int = 500, seed: int = 42) -> Pipeline:                       # M18
    return Pipeline(stages=[_assembler(FEATURE_COLS), GBTRegressor(
        labelCol="daily_gmv", maxIter=max_iter, stepSize=0.05, seed=seed)])


class Hybrid:                                                                        # M19
    """0.6 · boosted trees (depth 6, 150 × 0.05) + 0.4 · ridge on scaled
    calendar/exogenous columns, floored at 500."""

    def __init__(self, seed: int = 42):
        self.seed = seed

    def fit(self, df: DataFrame) -> "Hybrid":
        n = df.count()
        self.tree = Pipeline(stages=[_assembler(FEATURE_COLS, "tf"), GBTRegressor(
            featuresCol="tf", labelCol="daily_gmv", predictionCol="p_tree", maxIter=150, maxDepth=6,
            stepSize=0.05, seed=self.seed)]).fit(df)
        self.linear = Pipeline(stages=[
            _assembler(LINEAR_COLS, "lf_raw"),
            StandardScaler(inputCol="lf_raw", outputCol="lf", withMean=True, withStd=True),
            LinearRegression(featuresCol="lf", labelCol="daily_gmv", predictionCol="p_lin",
                             regParam=RIDGE_ALPHA / max(n, 1), elasticNetParam=0.0, standardization=False)]).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.linear.transform(self.tree.transform(df))
        pred = F.greatest(F.lit(HYBRID_FLOOR),
                          HYBRID_TREE_WEIGHT * F.col("p_tree") + HYBRID_LINEAR_WEIGHT * F.col("p_lin"))
        return out.withColumn("prediction", pred).drop("tf", "lf_raw", "lf", "p_tree", "p_lin")


def model_candidates(seed: int = 42) -> dict:
    return {"RandomForest": random_forest(seed), "Boosted": boosted(seed=seed), "Hybrid": Hybrid(seed)}


def fit_all(candidates: dict, frames: dict[str, DataFrame]) -> dict[str, dict]:
    """Every candidate fitted on every frame (name -> candidate -> model).  A
    daily frame is small and boosting is a long chain of short jobs, so the
    fits run side by side, each from a thread of its own."""
    with ThreadPoolExecutor(max_workers=max(1, len(candidates) * len(frames))) as pool:
        jobs = {(f, name): pool.submit(copy.deepcopy(c).fit if isinstance(c, Hybrid) else c.fit, df)
                for f, df in frames.items() for name, c in candidates.items()}
        return {f: {name: jobs[f, name].result() for name in candidates} for f in frames}


def evaluate_models(split: DataFrame, fitted: dict) -> DataFrame:                    # M13, M22
    """Hold-out metrics of the fitted models and of the lag-1 baseline."""
    test = split.where(F.col("split") == "test")
    out = metrics(naive_forecast(split)).withColumn("model", F.lit("NaiveLag1"))
    for name, model in fitted.items():
        out = out.unionByName(metrics(model.transform(test)).withColumn("model", F.lit(name)))
    return out


def model_forecasts(panel: DataFrame, fitted: dict, evaluation: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:   # M23
    """One row per (date, model): every model (refit on all supervised rows)
    rolled forward by itself, with its hold-out WAPE; ``is_best`` marks the
    model of least WAPE (ties to the first name)."""
    scores = evaluation.select("model", "WAPE_pct")
    best = best_model_name(evaluation).select(F.col("model").alias("_best"))
    out = None
    for name, model in fitted.items():
        rows = recursive_forecast(panel, model, horizon=horizon).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(scores), "model").crossJoin(F.broadcast(best)) \
              .withColumn("is_best", F.col("model") == F.col("_best")).drop("_best")


def best_model_name(evaluation: DataFrame) -> DataFrame:                             # M23
    return evaluation.where(F.col("model") != "NaiveLag1").orderBy("WAPE_pct", "model").limit(1).select("model")


@dataclass
class Predictor:
    """A fitted candidate as a function of feature columns (name -> values of
    all rows) that needs no Spark session: weighted parts and a floor."""
    parts: list[tuple]          # model, its columns, weight
    floor: float = -math.inf

    def __call__(self, x: dict) -> np.ndarray:
        return np.maximum(self.floor, sum(w * m.predict(np.column_stack([x[c] for c in cols])) for m, cols, w in self.parts))


def predictor(spark, model) -> Predictor:
    if isinstance(model, Hybrid):
        tree, line = trees_of(spark, model.tree.stages[-1], False), linear_of(model.linear.stages[1], model.linear.stages[2])
        return Predictor([(tree, FEATURE_COLS, HYBRID_TREE_WEIGHT), (line, LINEAR_COLS, HYBRID_LINEAR_WEIGHT)], HYBRID_FLOOR)
    last = model.stages[-1]
    return Predictor([(trees_of(spark, last, isinstance(last, RandomForestRegressionModel)), FEATURE_COLS, 1.0)])


def recursive_forecast(panel: DataFrame, model, series: Sequence[str] = (), horizon: int = HORIZON_DAYS) -> DataFrame:   # M20, U2
    """Roll every series forward day by day.  The state is one row per series
    with its last 30 values and the calendar of the coming days; a task rolls
    all its series together, each step feeding the predictions back into lags
    and rolling statistics.  The model travels as plain arrays
    (``functions.trees``), so the recursion is one pass over the state table,
    whatever the number of series.  Series of fewer than 30 days have no full
    lags and get no forecast."""
    spark, series = panel.sparkSession, list(series)
    hist_n = max(max(LAGS), max(ROLLS))
    w = Window.partitionBy(*series).orderBy(F.desc("date"))
    tail = panel.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hist_n)
    exogenous = ("avg_freight_pct", "avg_installments", "avg_price")
    state = tail.groupBy(*series).agg(
        F.max("date").alias("last_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "daily_gmv"))), lambda s: s["daily_gmv"]).alias("hist"),
        *[F.avg(F.when(F.col("_r") <= EXOGENOUS_TAIL_DAYS, F.col(c))).alias(c) for c in exogenous])
    state = state.where(F.size("hist") == hist_n)
    days = list(fourier(F.lit("2000-01-01").cast("date")))

    def calendar(i):
        parts = fourier(F.date_add(F.col("last_date"), i))
        return F.array(*[parts[c].cast("double") for c in days])
    state = state.withColumn("calendar", F.transform(F.sequence(F.lit(1), F.lit(horizon)), calendar))
    sent = spark.sparkContext.broadcast(predictor(spark, model))

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = sent.value
        for b in batches:
            if not len(b):
                continue
            hist = np.stack(b["hist"].to_numpy()).astype(float)
            cal = np.stack([np.stack(c) for c in b["calendar"]])            # series x days x parts
            fixed = {c: b[c].to_numpy(float) for c in exogenous}
            for i in range(horizon):
                x = dict(fixed) | {c: cal[:, i, j] for j, c in enumerate(days)}
                x |= {f"lag_{k}": hist[:, -k] for k in LAGS}
                for k in ROLLS:
                    x[f"roll_mean_{k}"] = hist[:, -k:].mean(axis=1)
                    x[f"roll_std_{k}"] = hist[:, -k:].std(axis=1, ddof=1)
                y = predict(x)
                hist = np.concatenate((hist[:, 1:], y[:, None]), axis=1)
                out = b[[*series, "last_date"]].copy()
                out["step"], out["daily_gmv_forecast"] = np.int32(i + 1), y
                yield out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (state.schema[c] for c in series))
    rolled = state.mapInPandas(roll, f"{kinds}last_date date, step int, daily_gmv_forecast double")
    out = rolled.select(*series, F.date_add("last_date", F.col("step")).alias("date"), "daily_gmv_forecast")
    cal = fourier(F.col("date"))
    return out.withColumns({"is_black_friday": cal["is_black_friday"], "is_holiday_season": cal["is_holiday_season"]})


POOLED_TREES = 100


def dense_panel(fact: DataFrame, series: Sequence[str], platform: DataFrame | None = None) -> DataFrame:   # M20, M21
    """Daily GMV of every series over the platform's whole calendar (days
    without sales are 0) with the platform's exogenous means and calendar
    parts, and ``scale``, the series' mean day.  ``platform`` is the daily
    panel, if it is written already.  The days with sales are written, so the
    lines are summed once and not again for the series, the rows and the mean."""
    series = list(series)
    sold = fact.where((F.col("order_status") == "delivered") & F.col("order_purchase_timestamp").isNotNull())
    for c in series:
        sold = sold.where(F.col(c).isNotNull())
    day = F.to_date("order_purchase_timestamp")
    own = sold.groupBy(*series, day.alias("date")).agg(
        F.round(F.sum(F.col("payment_value").cast("decimal(18,6)")), 2).cast("double").alias("daily_gmv"))
    own = materialize(fact.sparkSession, own, "fc-series-days")
    platform = (daily_panel(fact) if platform is None else platform).select("date", "avg_freight_pct", "avg_installments", "avg_price")
    spine = own.select(*series).distinct().crossJoin(F.broadcast(platform))           # one row per calendar day
    rows = spine.join(own, [*series, "date"], "left").withColumn("daily_gmv", F.coalesce("daily_gmv", F.lit(0.0)))
    mean = rows.groupBy(*series).agg(F.avg("daily_gmv").alias("scale"))
    return rows.join(mean, series).withColumns(fourier(F.col("date")))


def panel_forecast(panel: DataFrame, platform: DataFrame, series: Sequence[str], horizon: int = HORIZON_DAYS,
                   seed: int = 42) -> DataFrame:                                      # M20, M21
    """Forecast of every series by one model pooled over all of them: series
    are divided by their mean day, one forest learns from all supervised rows,
    all series roll forward together and are scaled back.  ``value`` is
    reconciled top-down: each day the series are scaled so that they add up to
    the platform's forecast (equal parts if all are 0); ``own`` is before."""
    spark, series = panel.sparkSession, list(series)
    scaled = panel.where(F.col("scale") > 0).withColumn("daily_gmv", F.col("daily_gmv") / F.col("scale"))
    scaled = materialize(spark, scaled, "fc-pooled")
    train = materialize(spark, supervised(scaled, series), "fc-pooled-train")
    model = Pipeline(stages=[_assembler(FEATURE_COLS), RandomForestRegressor(
        labelCol="daily_gmv", numTrees=POOLED_TREES, maxDepth=8, minInstancesPerNode=5, seed=seed)]).fit(train)
    rolled = recursive_forecast(scaled, model, series, horizon).join(scaled.select(*series, "scale").distinct(), series)
    own = materialize(spark, rolled.select(*series, "date", (F.col("daily_gmv_forecast") * F.col("scale")).alias("own")), "fc-pooled-own")
    total = own.groupBy("date").agg(F.sum("own").alias("_sum"), F.count(F.lit(1)).alias("_n")) \
               .join(platform.select("date", F.col("daily_gmv_forecast").alias("_platform")), "date")
    part = F.when(F.col("_sum") > 0, F.col("own") / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return own.join(F.broadcast(total), "date").select(*series, "date", F.round("own", 2).alias("own"),
                                                       F.round(F.col("_platform") * part, 2).alias("value"))


def history_tail(panel: DataFrame, n: int = HISTORY_TAIL_DAYS, series: Sequence[str] = ()) -> DataFrame:   # W7
    w = Window.partitionBy(*series).orderBy(F.desc("date"))
    return panel.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def slice_shares(summary_df: DataFrame) -> DataFrame:
    """Revenue share of every (category|ALL, state|ALL) slice."""
    from marketlens.operators.drilldown import ALL
    cells = (summary_df.cube("category", "state")
             .agg(F.sum("total_revenue").alias("rev"), F.grouping_id().alias("_g"))
             .withColumn("category", F.when(F.col("_g").bitwiseAND(2) > 0, ALL).otherwise(F.col("category")))
             .withColumn("state", F.when(F.col("_g").bitwiseAND(1) > 0, ALL).otherwise(F.col("state"))))
    total = summary_df.agg(F.sum("total_revenue").alias("_tot"))
    return cells.crossJoin(F.broadcast(total)).select(
        "category", "state",
        F.when(F.col("_tot") > 0, F.col("rev") / F.col("_tot")).otherwise(1.0).alias("share"))


def slice_series(shares: DataFrame, history: DataFrame, future: DataFrame | None = None,
                 category: str | None = None, state: str | None = None) -> DataFrame:   # M21, U1, F3
    """History (and forecast) of every slice, or of the slices of one category
    and / or state: the platform's days, tagged by type, times the slice's
    share.  The days (history tail and horizon) are bounded and broadcast."""
    sel = shares
    if category is not None:
        sel = sel.where(F.col("category") == category)
    if state is not None:
        sel = sel.where(F.col("state") == state)
    series = history.select("date", F.col("daily_gmv").alias("base"), F.lit("Actual (History)").alias("type"))
    if future is not None:
        series = series.unionByName(future.select(
            "date", F.col("daily_gmv_forecast").alias("base"), F.lit("Forecast").alias("type")))
    return sel.crossJoin(F.broadcast(series)).select(
        "category", "state", "date", "type", rounded(F.col("base") * F.col("share"), 2).alias("value"))


def slice_projection(shares: DataFrame, future: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:   # M21
    """Projected total and daily mean over the first ``days`` forecast days
    for every slice: a one-row horizon aggregate attached to the shares."""
    from marketlens.functions.joins import attach_scalars
    w = Window.orderBy("date")
    horizon = (future.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= days)
                     .agg(F.sum("daily_gmv_forecast").alias("_tot"), F.avg("daily_gmv_forecast").alias("_avg")))
    return attach_scalars(shares, horizon).select(
        "category", "state", rounded(F.col("share") * 100, 4).alias("share_pct"),
        rounded(F.col("_tot") * F.col("share"), 2).alias("projected_total"),
        rounded(F.col("_avg") * F.col("share"), 2).alias("projected_daily_avg"))
