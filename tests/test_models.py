"""Model operators on tiny inputs: persistence, random search, boosted
regressor, unknown indicators, unseen-category encoding, SMOTE balance."""
import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import forecast as fc
from marketlens.operators import satisfaction as sat
from marketlens.sources.files import load_pipeline_model, save_model


def _panel(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(i, float(1000 + 100 * np.sin(i / 3) + rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "d int, daily_gmv double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    for c in ("avg_freight_pct", "avg_installments", "avg_price"):
        df = df.withColumn(c, F.lit(1.0))
    return df.withColumns(fc.fourier(F.col("date"))).drop("d")


def test_boosted_regressor_persist_and_reload(spark):
    sup = fc.supervised(_panel(spark))
    model = fc.boosted(max_iter=3).fit(sup)
    path = tempfile.mkdtemp(prefix="ml-model-") + "/m"
    save_model(model, path)
    again = load_pipeline_model(path)
    a = [r.prediction for r in model.transform(sup).collect()]
    b = [r.prediction for r in again.transform(sup).collect()]
    assert a == b


def test_recursive_forecast_shape(spark):
    panel = _panel(spark)
    model = fc.random_forest().fit(fc.supervised(panel))
    out = fc.recursive_forecast(panel, model, horizon=4).collect()
    assert len(out) == 4 and all(r.daily_gmv_forecast is not None for r in out)


class _FewRounds(fc.Hybrid):
    """The hybrid with a shorter boosting stage."""

    def fit(self, df):
        import unittest.mock as m
        from pyspark.ml.regression import GBTRegressor
        with m.patch.object(fc, "GBTRegressor", lambda **k: GBTRegressor(**k | {"maxIter": 4})):
            return super().fit(df)


def test_recursive_forecast_equals_the_models_step_by_step(spark):
    """Two keyed series; every step as a transform of the panel so far."""
    one = _panel(spark, 50).withColumn("key", F.lit("a"))
    panel = one.unionByName(one.withColumn("key", F.lit("b")).withColumn("daily_gmv", F.col("daily_gmv") * 2 + 50)).cache()
    short = one.where("date < '2020-01-20'").withColumn("key", F.lit("short"))
    train = fc.supervised(panel, ["key"]).cache()
    for model in (fc.boosted(max_iter=5).fit(train), _FewRounds().fit(train)):
        got = {(r.key, r.date): r.daily_gmv_forecast
               for r in fc.recursive_forecast(panel.unionByName(short), model, ["key"], horizon=3).collect()}
        assert {k for k, _ in got} == {"a", "b"} and len(got) == 6
        rows = {k: [r.daily_gmv for r in panel.where(F.col("key") == k).orderBy("date").collect()] for k in ("a", "b")}
        last = panel.agg(F.max("date")).first()[0]
        for step in range(1, 4):
            x = []
            for k, h in rows.items():
                f = {f"lag_{n}": float(h[-n]) for n in fc.LAGS}
                for n in fc.ROLLS:
                    f[f"roll_mean_{n}"], f[f"roll_std_{n}"] = float(np.mean(h[-n:])), float(np.std(h[-n:], ddof=1))
                x.append({"key": k, "avg_freight_pct": 1.0, "avg_installments": 1.0, "avg_price": 1.0, **f})
            step_rows = spark.createDataFrame(x).withColumn("date", F.date_add(F.lit(last), step))
            step_rows = step_rows.withColumns(fc.fourier(F.col("date")))
            for r in model.transform(step_rows).collect():
                assert got[r.key, r.date] == pytest.approx(r.prediction, rel=1e-9)
                rows[r.key].append(r.prediction)


def test_panel_forecasts_add_up_to_the_platform(spark):
    one = _panel(spark, 45).withColumn("key", F.lit("a")).withColumn("scale", F.lit(1000.0))
    panel = one.unionByName(one.withColumn("key", F.lit("b")).withColumn("daily_gmv", F.col("daily_gmv") * 3).withColumn("scale", F.lit(3000.0)))
    platform = spark.createDataFrame([(45 + i, 5000.0 + i) for i in range(3)], "d int, daily_gmv_forecast double") \
        .withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    out = fc.panel_forecast(panel, platform, ["key"], horizon=3)
    sums = [r.v for r in out.groupBy("date").agg(F.sum("value").alias("v")).orderBy("date").collect()]
    assert sums == pytest.approx([5000.0, 5001.0, 5002.0], abs=0.02)
    ratio = out.groupBy("date").pivot("key").agg(F.first("value")).collect()
    assert all(r.b == pytest.approx(3 * r.a, rel=0.2) for r in ratio)


def test_series_days_are_summed_once_from_the_lines(spark):
    """Lines of two series on three platform days: the lines are read once,
    days without sales are 0."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    lines = [("a", 1, 10.0, "delivered"), ("a", 1, 5.0, "delivered"), ("a", 3, 6.0, "delivered"), ("b", 2, 9.0, "delivered"),
             ("b", 2, 7.0, "canceled"), (None, 2, 7.0, "delivered"), ("c", None, 7.0, "delivered")]
    fact = spark.createDataFrame(lines, "key string, d int, payment_value double, order_status string") \
        .selectExpr("key", "date_add(date'2020-01-01', d) AS order_purchase_timestamp", "payment_value", "order_status") \
        .mapInPandas(counted, "key string, order_purchase_timestamp date, payment_value double, order_status string")
    platform = spark.range(1, 4).selectExpr("date_add(date'2020-01-01', int(id)) AS date", "double(id) AS avg_freight_pct",
                                            "1D AS avg_installments", "1D AS avg_price")
    out = fc.dense_panel(fact, ["key"], platform).orderBy("key", "date").collect()
    assert [(r.key, r.date.day - 1, r.daily_gmv, r.scale, r.avg_freight_pct) for r in out] == [
        ("a", 1, 15.0, 7.0, 1.0), ("a", 2, 0.0, 7.0, 2.0), ("a", 3, 6.0, 7.0, 3.0),
        ("b", 1, 0.0, 3.0, 1.0), ("b", 2, 9.0, 3.0, 2.0), ("b", 3, 0.0, 3.0, 3.0)]
    assert read.value == len(lines)


def test_the_daily_panel_is_written_once_for_all_queries(spark, monkeypatch):
    from marketlens.plans import ml_queries
    built = []
    monkeypatch.setattr(ml_queries, "enriched", lambda *_: spark.range(3))
    monkeypatch.setattr(fc, "daily_panel", lambda fact: built.append(1) or fact)
    assert [ml_queries._panel(spark, "one-panel").count() for _ in range(2)] == [3, 3] and len(built) == 1


def test_keywords_are_searched_once_and_scored_by_kind(spark):
    from marketlens.operators.insights import FALLBACK_PROBS, keyword_kind, keyword_sentiment
    df = spark.createDataFrame([(0, "muito bom"), (1, "produto ruim"), (2, "bom ruim"), (3, "x"), (4, None)], "i int, t string")
    kinds = df.select("i", keyword_kind(F.col("t")).alias("kind"))
    label, probs = keyword_sentiment(F.col("kind"))
    got = {r.i: (r.kind, r.label, tuple(r.probs)) for r in kinds.select("i", "kind", label.alias("label"), probs.alias("probs")).collect()}
    want = {0: "Positive", 1: "Negative", 2: "Mixed", 3: "Mixed", 4: "Mixed"}
    assert got == {i: (k, "Negative" if k == "Negative" else "Positive", FALLBACK_PROBS[k]) for i, k in want.items()}


def test_unknown_indicators_and_unseen_codes(spark):
    df = spark.createDataFrame([("1.5", "a"), (None, "b"), ("x", "a")], "delay string, c string")
    out = sat.unknown_indicators(df, {"delay": 0.0}).collect()
    assert [(r.delay, r.delay_unknown) for r in out] == [(1.5, 0), (0.0, 1), (0.0, 0)]


def test_smote_balances_classes(spark):
    rng = np.random.default_rng(4)
    cols = sat.feature_columns()
    rows = []
    for i in range(60):
        cls = 5 if i < 40 else (1 if i < 52 else 3)
        rows.append((i, cls, *rng.normal(size=len(cols)).tolist()))
    df = spark.createDataFrame(rows, ["row_id", "review_score", *cols])
    bal = {r.review_score: r.n for r in sat.smote(df).groupBy("review_score").agg(F.count("*").alias("n")).collect()}
    assert bal == {5: 40, 1: 40, 3: 40}


def test_random_search_scores_each_draw_on_the_fold_it_did_not_see(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    rng = np.random.default_rng(5)
    cols = sat.feature_columns()
    x = rng.normal(size=(240, len(cols)))
    rows = [(i, int(1 + (v[0] > 0) + (v[1] > 0)), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["row_id", "review_score", *cols])
    grid = {"maxDepth": (1, 3, 5), "impurity": ("gini", "entropy")}
    points = sat.draws_of(grid, 4)
    assert points == sat.draws_of(grid, 4) and len({tuple(p.items()) for p in points}) == 4
    assert len(sat.draws_of(grid, 99)) == 6
    table, best = sat.random_search(spark, "tree", DecisionTreeClassifier(seed=1), grid, df, draws=4, folds=3)
    got = {(r.draw, r.fold): r for r in table.collect()}
    assert len(got) == 12 and sum(r.rows for r in got.values()) == 4 * 240
    fold = F.pmod(F.xxhash64("row_id", F.lit(sat.SEED)), F.lit(3))
    data = sat._assembled(df).withColumn("fold", fold)
    for draw, part in ((0, 0), (3, 2)):
        model = DecisionTreeClassifier(seed=1, **points[draw]).fit(data.where(F.col("fold") != part))
        held = model.transform(data.where(F.col("fold") == part))
        want = held.where("label = prediction").count() / held.count()
        assert got[draw, part].accuracy == pytest.approx(want) and json.loads(got[draw, part].point) == points[draw]
    means = [np.mean([got[d, f].accuracy for f in range(3)]) for d in range(4)]
    assert best == points[int(np.argmax(means))]
    assert {r.draw for r in got.values() if r.best} == {int(np.argmax(means))}


def test_power_iteration_spans_the_leading_singular_vectors(spark):
    from pyspark.ml.linalg import Vectors
    from marketlens.operators import recommend as rc
    rng = np.random.default_rng(5)
    x = (rng.random((80, 12)) < 0.3) * rng.normal(size=(80, 12)) * np.linspace(6, 1, 12)
    rows = [(i, Vectors.dense(v) if i % 3 else Vectors.sparse(12, {int(j): float(v[j]) for j in np.flatnonzero(v)}))
            for i, v in enumerate(x)]
    feats = spark.createDataFrame(rows, ["product_id", "features"])
    basis = rc.svd_basis(feats, k=4, extra=4, rounds=60)
    right = np.linalg.svd(x, full_matrices=False)[2][:4].T
    assert np.abs(basis.T @ right) == pytest.approx(np.eye(4), abs=1e-4)
    latent = {r.product_id: r.latent for r in rc.svd_latent(feats, 4).collect()}
    assert np.abs(np.array([latent[i] for i in range(80)])) == pytest.approx(np.abs(x @ right), abs=1e-2)


def test_sentiment_model_learns_and_scores_each_text_once(spark):
    """Copies of a review weigh as rows: vocabulary, frequencies and loss are
    those of Spark's own estimators over all rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from marketlens.functions.textml import drop_tfidf_temps, fit_tfidf
    from marketlens.operators import sentiment_ml as sml
    from marketlens.operators.classify import class_weights
    from marketlens.sources.store import materialize
    texts = spark.createDataFrame([(0, "otimo produto bom"), (1, "produto ruim quebrado"), (2, "entrega bom rapida"), (3, ""), (4, None)],
                                  "review_key long, review_text string")
    terms = materialize(spark, sml.review_terms(texts), "test-terms")
    assert terms.count() == 3
    revs = spark.createDataFrame([(i, ("Positive", "Negative", "Positive")[i % 3] if i != 4 else "Negative", i % 3) for i in range(30)]
                                 + [(90, "Positive", 3), (91, "Unknown", 0), (92, "Negative", None)],
                                 "review_id long, sentiment string, review_key long")
    corpus = materialize(spark, sml.review_corpus(revs, terms), "test-corpus")
    assert corpus.columns == ["review_id", "sentiment", "text_no"] and corpus.count() == 30
    model = sml.SentimentModel().fit(corpus, terms)
    got = {r.review_id: r.probabilities for r in model.score(corpus, terms).collect()}
    every = corpus.join(terms, "text_no")
    tfidf = fit_tfidf(every, "terms", "features", sml.VOCAB)
    assert set(model.tfidf.stages[0].vocabulary) == set(tfidf.stages[0].vocabulary)
    data = drop_tfidf_temps(tfidf.transform(model.indexer.transform(every)), "features").join(class_weights(corpus, "sentiment"), "sentiment")
    plain = LogisticRegression(family="multinomial", weightCol="weight", maxIter=1000, tol=1e-4, regParam=1 / 30, elasticNetParam=0.0,
                               standardization=False).fit(data)
    for r in plain.transform(data).select("review_id", vector_to_array("probability").alias("p")).collect():
        assert got[r.review_id] == pytest.approx(r.p, abs=1e-3)


def test_a_query_fits_only_the_models_it_names(spark, monkeypatch):
    from marketlens.plans import ml_queries
    fits = []
    monkeypatch.setattr(ml_queries, "_satisfaction_data", lambda *_: ("balanced", "test"))
    monkeypatch.setattr(sat, "train_all", lambda train, models: fits.extend(models) or dict.fromkeys(models, "fitted"))
    assert set(ml_queries._satisfaction(spark, "named-models", "RandomForest")[2]) == {"RandomForest"} and fits == ["RandomForest"]
    assert set(ml_queries._satisfaction(spark, "named-models")[2]) == set(sat.classifiers())
    assert sorted(fits) == sorted(sat.classifiers())           # the forest is not fitted again


def test_smote_searches_all_classes_at_once(spark, monkeypatch):
    """One search whatever the number of classes; neighbours are of the row's class."""
    calls, found = [], sat.neighbours
    monkeypatch.setattr(sat, "neighbours", lambda rows, *a: calls.append(rows.count()) or found(rows, *a))
    cols = sat.feature_columns()
    rows = [(i, 1 + i % 4, *[float(i % 4 * 100 + (i * (j + 3)) % 7) for j in range(len(cols))]) for i in range(40)] + [(99, 2, *[103.0] * len(cols))]
    out = sat.smote(spark.createDataFrame(rows, ["row_id", "review_score", *cols]))
    assert calls == [41]
    assert {r.review_score: (r.n, r.low // 100, r.high // 100) for r in out.groupBy("review_score").agg(
        F.count("*").alias("n"), F.min(cols[0]).alias("low"), F.max(cols[0]).alias("high")).collect()} == {c: (11, c - 1, c - 1) for c in (1, 2, 3, 4)}


def test_sentiment_model_joins_its_texts_once(spark):
    """The texts are read once for the fit, as tokens; the model is that of written terms."""
    from marketlens.operators import sentiment_ml as sml
    from marketlens.sources.store import materialize
    texts = spark.createDataFrame([(0, "otimo produto bom bom"), (1, "produto ruim quebrado"), (2, "entrega bom rapida")], "review_key long, review_text string")
    tokens = materialize(spark, sml.review_tokens(texts), "test-tokens")
    assert tokens.columns == ["text_no", "review_key", "tokens"]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    corpus = sml.review_corpus(spark.createDataFrame([(i, ("Positive", "Negative", "Positive")[i % 3], i % 3) for i in range(30)],
                                                     "review_id long, sentiment string, review_key long"), tokens)
    corpus = materialize(spark, corpus, "test-corpus")
    model = sml.SentimentModel().fit(corpus, tokens.mapInPandas(counted, tokens.schema))
    assert read.value == 3
    plain = sml.SentimentModel().fit(corpus, sml.with_terms(tokens))
    assert model.tfidf.stages[0].vocabulary == plain.tfidf.stages[0].vocabulary and "bom bom" in model.tfidf.stages[0].vocabulary
    assert model.lr.coefficientMatrix.toArray() == pytest.approx(plain.lr.coefficientMatrix.toArray(), abs=1e-9)
    a, b = ({r.review_id: r.probabilities for r in m.score(corpus, t).collect()} for m, t in ((model, tokens), (plain, sml.with_terms(tokens))))
    assert len(a) == 30 and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)
