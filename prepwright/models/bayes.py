"""Bayesian ridge regression from sufficient statistics.

The covariance of features and target is aggregated by Spark in one distributed pass;
only that (d+1) x (d+1) matrix reaches the driver, where the evidence is maximised.
Predictions and their deviations are computed on the executors.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Gamma priors, iteration limit and tolerance of the published defaults.
PRIOR = 1e-6
MAX_ITERATIONS = 300
TOLERANCE = 1e-3


def sufficient_statistics(df: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred cross-product matrix) of the features with the label appended."""
    joint = VectorAssembler(inputCols=[features, "label"], outputCol="_xy").transform(df.select(features, "label"))
    row = joint.select(Summarizer.metrics("count", "mean", "std").summary(F.col("_xy")).alias("s")).first()["s"]
    mean, sd = row["mean"].toArray(), row["std"].toArray()
    corr = np.nan_to_num(Correlation.corr(joint, "_xy").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    return row["count"], mean, corr * np.outer(sd, sd) * (row["count"] - 1)


def maximise_evidence(n: int, xtx: np.ndarray, xty: np.ndarray, yty: float):
    """(weights, noise precision, weight covariance) of the centred problem."""
    e, v = np.linalg.eigh(xtx)
    e = np.clip(e, 0.0, None)
    rotated = v.T @ xty
    alpha, lam = 1.0 / max(yty / n, np.finfo(float).eps), 1.0
    before = None
    for _ in range(MAX_ITERATIONS):
        w = v @ (rotated / (e + lam / alpha))
        rss = max(yty - 2 * w @ xty + w @ xtx @ w, 0.0)
        gamma = np.sum(alpha * e / (lam + alpha * e))
        lam = (gamma + 2 * PRIOR) / (w @ w + 2 * PRIOR)
        alpha = (n - gamma + 2 * PRIOR) / (rss + 2 * PRIOR)
        if before is not None and np.sum(np.abs(before - w)) < TOLERANCE:
            break
        before = w
    w = v @ (rotated / (e + lam / alpha))
    return w, alpha, (v / (alpha * e + lam)) @ v.T


@dataclass
class BayesianRidgeModel:
    weights: np.ndarray
    intercept: float
    noise: float
    covariance: np.ndarray
    centre: np.ndarray
    features_col: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, ``uncertainty`` and the 95 % bounds."""
        w, b, noise, cov, centre = self.weights, self.intercept, self.noise, self.covariance, self.centre

        def predict(x: pd.Series) -> pd.DataFrame:
            m = np.stack(x.to_numpy()) if len(x) else np.empty((0, len(w)))
            d = m - centre
            return pd.DataFrame({"mean": m @ w + b, "sd": np.sqrt(1.0 / noise + np.einsum("ij,jk,ik->i", d, cov, d))})

        schema = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType())])
        udf = F.pandas_udf(predict, schema)
        out = df.withColumn("_p", udf(vector_to_array(self.features_col)))
        return out.withColumns({
            "prediction": F.col("_p.mean"), "uncertainty": F.col("_p.sd"),
            "lower_95": F.col("_p.mean") - 1.96 * F.col("_p.sd"),
            "upper_95": F.col("_p.mean") + 1.96 * F.col("_p.sd")}).drop("_p")


class BayesianRidge:
    """Estimator with the ``fit``/``transform`` shape of Spark ML, on a vector column and ``label``."""

    def __init__(self, features_col: str = "features"):
        self.features_col = features_col

    def fit(self, df: DataFrame) -> BayesianRidgeModel:
        n, mean, cross = sufficient_statistics(df, self.features_col)
        xtx, xty, yty = cross[:-1, :-1], cross[:-1, -1], cross[-1, -1]
        w, noise, cov = maximise_evidence(n, xtx, xty, yty)
        return BayesianRidgeModel(w, float(mean[-1] - mean[:-1] @ w), float(noise), cov, mean[:-1], self.features_col)


def prediction_interval(train: DataFrame, test: DataFrame) -> DataFrame:
    """(key, prediction, uncertainty, lower_95, upper_95) for the test rows."""
    return BayesianRidge().fit(train).transform(test).select(
        "key", "prediction", "uncertainty", "lower_95", "upper_95")
