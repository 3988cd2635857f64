"""Reference points: what a feature is set to when it is taken away."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.detectors.base import mean_vector
from relevia.functions import vectors as V
from relevia.operators.neighbors import nn_reference

SUMMARY_CENTRES = 20
SUMMARY_FROM_ROWS = 100


def zeros_reference(df: DataFrame, features: str = "features", out: str = "reference") -> DataFrame:
    return df.withColumn(out, F.transform(features, lambda x: F.lit(0.0)))


def mean_reference(df: DataFrame, train: DataFrame, features: str = "features", out: str = "reference") -> DataFrame:
    return df.withColumn(out, V.vector(mean_vector(train, features)))


def nearest_reference(
    df: DataFrame, train: DataFrame, features: str = "features", row_id: str = "row_id", out: str = "reference"
) -> DataFrame:
    nearest = nn_reference(df, train, row_id, features).select(row_id, F.col("reference").alias(out))
    return df.join(nearest, row_id)


def kmeans_reference(train: DataFrame, features: str = "features", k: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Global reference set: (centres, weights), weights being the clusters' row shares."""
    data = train.select(array_to_vector(features).alias("vector"))
    model = KMeans(featuresCol="vector", k=k, seed=seed).fit(data)
    sizes = np.asarray(model.summary.clusterSizes, dtype=np.float64)
    return np.array(model.clusterCenters()), sizes / sizes.sum()


def background_summary(
    train: DataFrame,
    features: str = "features",
    seed: int = 0,
    most_rows: int = SUMMARY_FROM_ROWS,
    centres: int = SUMMARY_CENTRES,
) -> tuple[np.ndarray, np.ndarray]:
    """Training rows as reference set; more than ``most_rows`` become weighted centres (0: always centres)."""
    rows = train.select(features).take(most_rows + 1)
    if len(rows) > most_rows:
        return kmeans_reference(train, features, centres, seed)
    return np.array([r[0] for r in rows]), np.full(len(rows), 1.0 / len(rows))


def add_reference(
    df: DataFrame, background: str, train: DataFrame | None = None, network=None, features: str = "features",
    row_id: str = "row_id",
) -> DataFrame:
    """One reference point per row by name: zeros, mean, NN, single_optimum."""
    if background == "zeros":
        return zeros_reference(df, features)
    if background == "mean":
        return mean_reference(df, train, features)
    if background == "NN":
        return nearest_reference(df, train, features, row_id)
    if background == "single_optimum":
        from relevia.explain.optimize import optimum_reference

        return optimum_reference(df, network, features)
    raise ValueError(f"unknown background {background!r}")
