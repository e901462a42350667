"""Fitted Spark ML regressors as plain arrays, for tasks that apply a model
many times to a few rows (a recursive forecast): a DataFrame ``transform`` a
step would cost a job each.

The nodes come from the model's own saved form (``data``: one row a node),
read back with Spark's reader; their number is the model's, not the data's.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marketlens.session import scratch_path


@dataclass
class Trees:
    """Ensembles as node arrays; a leaf is its own child."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 1024):
            part = x[at:at + 1024]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            row = np.arange(len(part))[:, None]
            while True:
                low = part[row, self.feature[node]] <= self.threshold[node]
                down = np.where(low, self.left[node], self.right[node])
                if (down == node).all():
                    break
                node = down
            out[at:at + 1024] = self.value[node] @ self.weights
        return out


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.coefficients + self.intercept


def trees_of(spark: SparkSession, model, averaged: bool) -> Trees:
    """Arrays of a fitted forest (``averaged``) or boosted ensemble whose
    splits are all numeric."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")) \
                .orderBy("treeID", "id").select("treeID", "id", "prediction", "leftChild", "rightChild", "featureIndex", "cut").toPandas()
    tree, own = rows["treeID"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    base = first[np.searchsorted(tree[first], tree)]
    place = np.arange(len(rows))
    leaf = rows["leftChild"].to_numpy(np.int64) < 0
    assert (place - base == own).all()              # ids of a tree are its rows' numbers
    child = lambda c: np.where(leaf, place, base + rows[c].to_numpy(np.int64))
    weights = np.full(len(first), 1.0 / len(first)) if averaged else np.array(model.treeWeights, float)
    return Trees(np.where(leaf, 0, rows["featureIndex"].fillna(0).to_numpy(np.int64)), rows["cut"].fillna(0.0).to_numpy(float),
                 child("leftChild"), child("rightChild"), rows["prediction"].to_numpy(float), first, weights)


def linear_of(scaler, model) -> Linear:
    """A fitted standard scaler followed by a linear regression."""
    std = np.array(scaler.std.toArray(), float)
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    return Linear(np.array(scaler.mean.toArray(), float), scale, np.array(model.coefficients.toArray(), float), float(model.intercept))
