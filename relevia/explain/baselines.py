"""Simple attributions: reconstruction error and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.functions.arrow import with_vector
from relevia.functions.hashing import noise


def reconstruction_error(df: DataFrame, detector, features: str = "features", out: str = "phi") -> DataFrame:
    """Squared difference of reconstruction and input per column."""
    return with_vector(df, [features], out, lambda x: (detector.reconstruct_batch(x) - x) ** 2)


def uniform_noise(df: DataFrame, seed: int = 0, features: str = "features", row_id: str = "row_id", out: str = "phi") -> DataFrame:
    """A number in [-1, 1) per cell that depends on seed, row and column only."""
    return df.withColumn(out, noise(seed, F.col(row_id), F.size(features)))


def noise_times_input(df: DataFrame, seed: int = 0, features: str = "features", row_id: str = "row_id", out: str = "phi") -> DataFrame:
    return df.withColumn(out, V.multiply(noise(seed, F.col(row_id), F.size(features)), F.col(features)))
