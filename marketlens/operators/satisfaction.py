"""1–5 star satisfaction classifier.

Order (split before oversampling and scaling, fixing the modelled
notebook's leak): feature frame → median / mode fills → label encoding →
sequential IQR outlier removal → stratified split → scaling fitted on train
→ SMOTE on train → RF / DT / one-vs-rest GBT → reports, importances,
side-by-side scoring, seeded sample.
"""
from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.dates import floor_days, fractional_hours
from marketlens.functions.joins import attach_scalars
from marketlens.functions.neighbours import neighbours
from marketlens.functions.quantiles import quantiles
from marketlens.functions.ranking import ranked
from marketlens.operators.classify import SEED, stratified_split
from marketlens.operators.profile import mode_fill
from marketlens.sources.store import materialize

# The 23 model features in the modelled order (spelling as in the
# source's columns), and the nine columns of the outlier removal in its order.
FEATURES = ("order_status", "customer_zip_code_prefix", "customer_city", "customer_state", "order_item_id", "price",
            "freight_value", "product_category_name", "product_name_lenght", "product_description_lenght",
            "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
            "payment_sequential", "payment_type", "payment_installments", "payment_value",
            "product_category_name_english", "delivery_days", "delivery_vs_estimated", "approval_hours")
CATEGORICAL = ("order_status", "customer_city", "customer_state", "product_category_name", "payment_type",
               "product_category_name_english")
NUMERIC = tuple(c for c in FEATURES if c not in CATEGORICAL)
OUTLIER_COLS = ("price", "freight_value", "product_weight_g", "product_length_cm", "product_height_cm",
                "product_width_cm", "payment_value", "product_name_lenght", "product_description_lenght")
TARGET = "review_score"
# The searched points of the single tree (Spark's trees have no least size of a split node).
TREE_GRID = {"maxDepth": (5, 10, 15, 20), "minInstancesPerNode": (1, 2, 4), "impurity": ("gini", "entropy")}


def model_frame(fact: DataFrame) -> DataFrame:                          # P4, P17, F4
    """Reviewed order lines (with the columns of ``with_listing``) as the
    modelled features, the score and a row id."""
    ts = F.col("order_purchase_timestamp")
    df = fact.withColumns({
        "delivery_vs_estimated": floor_days(F.col("order_delivered_customer_date"),
                                            F.col("order_estimated_delivery_date")),
        "approval_hours": fractional_hours(ts, F.col("order_approved_at")),
    })
    keys = ("order_id", "order_item_id", "product_id", "seller_id")
    return (df.where(F.col(TARGET).isNotNull())
              .select(*[F.col(k).alias(f"_k_{k}") for k in keys], *FEATURES, F.col(TARGET).cast("int").alias(TARGET))
              .withColumn("row_id", F.xxhash64(*[F.col(f"_k_{k}") for k in keys], *[F.col(c) for c in FEATURES]))
              .drop(*[f"_k_{k}" for k in keys]))


def unknown_indicators(df: DataFrame, cols: dict[str, float]) -> DataFrame:   # P13
    """``<col>_unknown`` flag plus a neutral numeric default."""
    for c, default in cols.items():
        df = df.withColumn(f"{c}_unknown", F.col(c).isNull().cast("int")) \
               .withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(float(default))))
    return df


def fill(df: DataFrame) -> DataFrame:                                   # N1, N4
    q = quantiles(df.select([F.col(c).cast("double").alias(c) for c in NUMERIC])
                    .unpivot([], list(NUMERIC), "column_name", "value"), "value", {"m": 0.5}, ["column_name"])
    meds = q.groupBy().pivot("column_name", list(NUMERIC)).agg(F.first("m"))
    out = attach_scalars(df, meds.select([F.col(c).alias(f"_med_{c}") for c in NUMERIC]))
    for c in NUMERIC:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"))).drop(f"_med_{c}")
    return mode_fill(out, list(CATEGORICAL))


def encode(df: DataFrame) -> tuple[DataFrame, object]:                   # M6, J5
    """Codes in lexicographic order; unseen values at scoring map to 0."""
    idx = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_code" for c in CATEGORICAL],
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return idx.transform(df), idx


def encode_with(idx, df: DataFrame) -> DataFrame:
    out = idx.transform(df)
    n = {c: len(lbls) for c, lbls in zip(CATEGORICAL, idx.labelsArray)}
    for c in CATEGORICAL:   # 'keep' puts unseen at the end; the modelled app uses 0
        out = out.withColumn(f"{c}_code", F.when(F.col(f"{c}_code") >= n[c], 0.0).otherwise(F.col(f"{c}_code")))
    return out


def remove_outliers(df: DataFrame, cols: Sequence[str] = OUTLIER_COLS) -> DataFrame:   # F6
    """Sequential IQR filter: bounds of each column are computed on the rows
    that survived the previous columns (order matters; not fused)."""
    for c in cols:
        # one row, written: later columns read it with every pass
        q = materialize(df.sparkSession, quantiles(df, c, {"_q1": 0.25, "_q3": 0.75}), "outlier-bounds")
        iqr = F.col("_q3") - F.col("_q1")
        df = (attach_scalars(df, q)
              .where((F.col(c) >= F.col("_q1") - 1.5 * iqr) & (F.col(c) <= F.col("_q3") + 1.5 * iqr))
              .drop("_q1", "_q3"))
    return df


def feature_columns() -> list[str]:
    return [f"{c}_code" if c in CATEGORICAL else c for c in FEATURES]


def scale(train: DataFrame, other: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:   # M7
    """Standardise with the population std of the training rows."""
    cols = feature_columns()
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])

    def apply(d):
        d = attach_scalars(d, stats)
        for c in cols:
            d = d.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)))
        return d.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
    return apply(train), (apply(other) if other is not None else None)


def smote(train: DataFrame, label: str = TARGET, seed: int = SEED) -> DataFrame:       # M8
    """Oversample every class to the majority size with k=1 SMOTE: each
    synthetic row is ``x + u·(nn − x)`` for a base row x, its nearest
    same-class neighbour nn (exact, bucketed search) and a hash-seeded u."""
    cols = feature_columns()
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    # equal rows share row_id, so rows are numbered for the neighbour joins
    base = ranked(train.select("row_id", label, vec.alias("x")), [F.asc("row_id")]) \
        .select(F.col("_rn").alias("row_id"), label, "x")
    base = materialize(train.sparkSession, base, "smote-base")
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    target = counts.agg(F.max("_c").alias("_max"))
    nn = neighbours(base.select(F.col(label).alias("grp"), F.col("row_id").alias("id"), F.col("x").alias("vec")), 1, "euclidean")
    nn = materialize(train.sparkSession, nn.select(F.col("qid").alias("row_id"), F.col("cid").alias("nn_id")), "smote-neighbours")
    pairs = base.join(nn, "row_id").join(base.select(F.col("row_id").alias("nn_id"), F.col("x").alias("nx")), "nn_id")
    r = ranked(pairs.withColumn("_h", F.xxhash64("row_id", F.lit(seed))), [F.asc("_h"), F.asc("row_id")], [label])
    r = attach_scalars(r, target)
    need = F.col("_max") - F.col("_n")
    copies = F.floor(need / F.col("_n")) + F.when(F.col("_rn") <= need % F.col("_n"), 1).otherwise(0)
    rep = r.withColumn("_copies", copies.cast("int")).where(F.col("_copies") > 0) \
           .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    u = (F.xxhash64("row_id", "_copy", F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF)) / float(0x80000000))
    new_x = F.zip_with("x", "nx", lambda a, b: a + u * (b - a))
    gen = rep.select(F.xxhash64("row_id", "_copy", F.lit(seed + 1)).alias("row_id"), label, new_x.alias("x"))
    allx = base.unionByName(gen)
    return allx.select("row_id", label, *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=feature_columns(), outputCol="features").transform(df) \
        .withColumn("label", (F.col(TARGET) - 1).cast("double"))


def classifiers(seed: int = SEED) -> dict:                              # M9, M10, M11
    """Fixed points inside the modelled search grids (trees 50–150, depth
    5–20); ``random_search`` explores the grid when wanted."""
    return {
        "RandomForest": RandomForestClassifier(numTrees=100, maxDepth=10, impurity="gini",
                                               featureSubsetStrategy="sqrt", seed=seed),
        "DecisionTree": DecisionTreeClassifier(maxDepth=10, impurity="gini", seed=seed),
        # the classes' small jobs side by side; each is seeded, so the fit does not depend on it
        "GradientBoosting": OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, seed=seed), parallelism=5),
    }


def train_all(train: DataFrame, models: dict | None = None) -> dict:
    data = _assembled(train)
    return {name: est.fit(data) for name, est in (models or classifiers()).items()}


def predict(model, df: DataFrame) -> DataFrame:
    out = model.transform(_assembled(df))
    return out.withColumn("predicted_score", (F.col("prediction") + 1).cast("int"))


def comparison(fitted: dict, test: DataFrame) -> DataFrame:             # M13
    rows = []
    for name, m in fitted.items():
        p = m.transform(_assembled(test))
        rows.append(p.agg(F.lit(name).alias("model"),
                          F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("model", F.round("accuracy", 4).alias("accuracy")).orderBy(F.desc("accuracy"), "model")


def importances(model, n: int = 10) -> DataFrame:                        # M14
    """Top-n feature importances (one value per feature of the model)."""
    from pyspark.sql import SparkSession
    vals = model.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(feature_columns(), vals)), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def side_by_side(fitted: dict, scenarios: DataFrame) -> DataFrame:      # M15
    """Score a table of scenarios with every model, one column per model."""
    out = _assembled(scenarios)
    for name, m in fitted.items():
        out = m.transform(out).withColumn(f"pred_{name}", (F.col("prediction") + 1).cast("int")) \
               .drop("prediction", "rawPrediction", "probability")
    return out.drop("features", "label")


def seeded_sample(scored: DataFrame, n: int = 10, seed: int = SEED) -> DataFrame:   # M28
    """A reproducible n-row sample with per-model correctness flags."""
    preds = [c for c in scored.columns if c.startswith("pred_")]
    s = scored.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(n)
    return s.select("row_id", TARGET, *preds, *[(F.col(p) == F.col(TARGET)).cast("int").alias(f"ok_{p[5:]}")
                                                 for p in preds])


def draws_of(grid: dict[str, Sequence], draws: int, seed: int = SEED) -> list[dict]:
    """``draws`` different points of the grid (all, if it has fewer), seeded."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(draws, len(points)))


def random_search(spark: SparkSession, name: str, estimator, grid: dict[str, Sequence], train: DataFrame, draws: int = 15,
                  folds: int = 3, seed: int = SEED, parallelism: int = 4) -> tuple[DataFrame, dict]:     # M12
    """Seeded draws from a grid, each fitted without one fold and scored on it.

    A row's fold is a hash of its id, so it depends on nothing else.  The
    assembled rows are written once; every fit is a Spark job over them, with
    ``parallelism`` of them at a time.  Returns one row per (draw, fold) and
    the point of the best mean accuracy (ties: the earliest draw).
    """
    data = materialize(spark, _assembled(train).select(
        "features", "label", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(folds)).cast("int").alias("fold")), "search-rows")
    points = draws_of(grid, draws, seed)

    def fit(job):
        draw, fold = job
        point = {estimator.getParam(k): v for k, v in points[draw].items()}
        model = estimator.copy(point).fit(data.where(F.col("fold") != fold))
        scored = model.transform(data.where(F.col("fold") == fold)).agg(
            F.count(F.lit(1)).alias("rows"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")).first()
        return name, draw, fold, json.dumps(points[draw], sort_keys=True), scored["rows"], scored["accuracy"]

    jobs = [(d, f) for d in range(len(points)) for f in range(folds)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(fit, jobs))
    mean = [np.mean([r[5] for r in rows if r[1] == d and r[5] is not None] or [-1.0]) for d in range(len(points))]
    best = points[int(np.argmax(mean))]
    table = spark.createDataFrame([(*r, points[r[1]] == best) for r in rows],
                                  "model string, draw int, fold int, point string, rows long, accuracy double, best boolean")
    return table, best


def prepare(filled: DataFrame):
    """Written, filled feature frame → encoding → outliers → split → scaling."""
    df, idx = encode(filled)
    df = remove_outliers(df)
    df = stratified_split(df, TARGET, ["row_id"])
    train, test = scale(df.where(F.col("split") == "train"), df.where(F.col("split") == "test"))
    return train, test, idx


