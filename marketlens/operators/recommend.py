"""Product recommendation (M24–M27, J4): catalog, content features,
truncated-SVD latent vectors, top-n similar products for every product.

The neighbour search is the exact pruned search of ``functions.neighbours``
(no cross join); similarity = 1 − cosine distance for content vectors and
1 / (1 + euclidean distance) for latent vectors.  Self is excluded by id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.joins import attach_scalars
from marketlens.functions.neighbours import neighbours
from marketlens.functions.money import money_avg, rounded
from marketlens.functions.textml import drop_tfidf_temps, fit_tfidf

CAT = "product_category_name_english"
SVD_RANK = 10


def catalog(fact: DataFrame, weight_col: str = "product_size") -> DataFrame:      # M24
    """One row per product with z-scored (population std) numerics."""
    per = (fact.where(F.col("product_id").isNotNull()).groupBy("product_id")
               .agg(F.min(CAT).alias(CAT), money_avg("price", 4).alias("price"),
                    rounded(F.avg("review_score"), 4).alias("review_score"),
                    F.min(weight_col).cast("double").alias("product_weight_g")))
    stats = per.agg(*[f(c).alias(f"_{n}_{c}") for c in ("price", "review_score", "product_weight_g")
                      for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = attach_scalars(per, stats)
    for c, name in (("price", "price_scaled"), ("review_score", "rating_scaled"),
                    ("product_weight_g", "weight_scaled")):
        z = F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        out = out.withColumn(name, rounded(F.coalesce(z, F.lit(0.0)), 4))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def content_features(cat: DataFrame) -> DataFrame:                                 # M25
    """TF-IDF (smoothed idf + 1, L2) of the category text + the three scaled
    numerics, as one feature vector per product; every category word is a term."""
    toks = cat.withColumn("_tok", F.split(F.lower(F.coalesce(F.col(CAT), F.lit(""))), "[^a-z0-9]+")) \
              .withColumn("_tok", F.filter("_tok", lambda t: F.length(t) >= 2))
    vocab = toks.select(F.explode("_tok").alias("t")).distinct().count()
    tfidf = fit_tfidf(toks, "_tok", "_tfidf", max(1, vocab))
    out = drop_tfidf_temps(tfidf.transform(toks), "_tfidf")
    asm = VectorAssembler(inputCols=["_tfidf", "price_scaled", "rating_scaled", "weight_scaled"],
                          outputCol="features")
    return asm.transform(out).drop("_tok", "_tfidf")


def _sparse(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column and value of every stored entry of ML vectors in
    their struct form (type, size, indices, values)."""
    own = [np.arange(len(r["values"])) if r["type"] == 1 else np.array(r["indices"], np.int64) for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in own])
    values = [r["values"] for r in rows]
    flat = np.concatenate([np.array(v, float) for v in values]) if rows else np.zeros(0)
    return at, np.concatenate(own) if rows else np.zeros(0, np.int64), flat


def _times(rows: list, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense basis."""
    at, col, value = _sparse(rows)
    out = np.zeros((len(rows), basis.shape[1]))
    np.add.at(out, at, basis[col] * value[:, None])
    return out


def svd_basis(feats: DataFrame, k: int = SVD_RANK, extra: int = 6, rounds: int = 12, tolerance: float = 1e-10) -> np.ndarray:
    """Leading right singular vectors of the (uncentred) sparse feature rows by
    block power iteration: each round the basis is broadcast, every task adds
    up its part of ``X' X B`` sparsely, the parts are summed by key as vectors
    per column (tree of partial sums) and the driver, which holds columns x
    (k + extra) numbers, makes them orthonormal.  Signs: the largest entry of
    each vector is positive."""
    spark = feats.sparkSession
    wide = feats.select(F.unwrap_udt("features").alias("x"))
    d = int(feats.select(F.unwrap_udt("features").alias("x")).select(
        F.coalesce(F.col("x.size"), F.size("x.values")).alias("d")).agg(F.max("d")).first()[0] or 0)
    width = min(d, k + extra)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(d, width)))[0]
    values = np.zeros(width)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(basis)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(sent.value)
            for b in batches:
                rows = b.column("x").to_pylist()
                at, col, value = _sparse(rows)
                y = np.zeros((len(rows), total.shape[1]))
                np.add.at(y, at, sent.value[col] * value[:, None])
                np.add.at(total, col, y[at] * value[:, None])
            used = np.flatnonzero(np.abs(total).sum(axis=1))
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), *[pa.array(total[used, j]) for j in range(total.shape[1])]],
                    ["col", *[f"y{j}" for j in range(total.shape[1])]])

        schema = "col int, " + ", ".join(f"y{j} double" for j in range(width))
        got = wide.mapInArrow(part, schema).groupBy("col").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).toArrow()
        image = np.zeros((d, width))
        image[got.column("col").to_numpy()] = np.stack([got.column(f"y{j}").to_numpy() for j in range(width)], axis=1)
        # rotate to the eigenvectors of the small matrix, so that the order is by singular value
        own, turn = np.linalg.eigh(basis.T @ image)
        order = np.argsort(-own, kind="stable")
        change = np.abs(own[order] - values)[:k].max(initial=0.0)
        values = own[order]
        basis = np.linalg.qr(image @ turn[:, order])[0]
        if change <= tolerance * max(values[0], 1e-300):
            break
    basis = basis[:, :min(k, d)]
    return basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])


def svd_latent(feats: DataFrame, k: int = SVD_RANK) -> DataFrame:                   # M26
    """Latent vectors ``X V`` (``U S``) of every product; ``V`` (columns x k)
    is broadcast and applied to batches of sparse rows."""
    sent = feats.sparkSession.sparkContext.broadcast(svd_basis(feats, k))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            latent = _times(b.column("x").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("product_id"), pa.array(list(latent), pa.list_(pa.float64()))],
                                             ["product_id", "latent"])
    kind = feats.schema["product_id"].dataType.simpleString()
    return feats.select("product_id", F.unwrap_udt("features").alias("x")) \
                .mapInArrow(project, f"product_id {kind}, latent array<double>")


def similar_products(cat: DataFrame, vectors: DataFrame, vec_col: str, n: int = 5,
                     strategy: str = "content") -> DataFrame:                        # M27, J4
    metric = "cosine" if strategy == "content" else "euclidean"
    v = vectors.select(F.col("product_id").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    hits = neighbours(v.select(F.lit(0).alias("grp"), "id", "vec"), n, metric)
    sim = F.col("score") if metric == "cosine" else 1.0 / (1.0 - F.col("score"))
    recs = hits.select(F.col("qid").alias("product_id"), F.col("cid").alias("rec_product_id"), "rank",
                       rounded(sim, 4).alias("similarity_score"))
    info = cat.select(F.col("product_id").alias("rec_product_id"), CAT, "price", "review_score")
    return recs.join(info, "rec_product_id")


def lookup(rows: DataFrame, wanted: DataFrame) -> DataFrame:                         # J4
    """Rows of the wanted products (``product_id``); an unknown id gives none."""
    return rows.join(wanted.select("product_id"), "product_id", "left_semi")


def content_vectors(feats: DataFrame) -> DataFrame:
    return feats.select("product_id", vector_to_array("features").alias("content"))

