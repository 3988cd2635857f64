"""Principal component detector: distances of a row to the component vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.detectors.base import Detector
from relevia.functions import vectors as V
from relevia.functions.arrow import lists, matrix, sum_vectors

MAX_WIDTH = 4_096


def moments(df: DataFrame, features: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, mean and covariance (divided by n - 1) from one pass of partial sums."""
    first = df.select(features).first()
    if first is None:
        raise ValueError("no training rows")
    width = len(first[0])
    if width > MAX_WIDTH:
        raise ValueError(f"a covariance of {width} columns is too large")
    # a row of the data as origin keeps the sums of products small
    origin = np.asarray(first[0], dtype=np.float64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)) - origin
                n += len(x)
                total += x.sum(axis=0)
                products += x.T @ x
        yield pa.RecordBatch.from_arrays([lists(np.concatenate([[n], total, products.ravel()])[None, :])], names=["s"])

    parts = df.select(features).mapInArrow(add, "s array<double>")
    flat = sum_vectors(parts, "s", 1 + width + width * width)
    n, total = flat[0], flat[1 : 1 + width]
    products = flat[1 + width :].reshape(width, width)
    shift = total / n
    covariance = (products - n * np.outer(shift, shift)) / max(n - 1.0, 1.0)
    return n, origin + shift, covariance


def _decomposed(mean: np.ndarray, covariance: np.ndarray, standardization: bool) -> tuple[np.ndarray, ...]:
    """(origin, scale, shares of variance, components) in falling order of variance."""
    scale = np.ones(len(mean))
    if standardization:
        scale = np.sqrt(np.diag(covariance))
        scale[scale == 0.0] = 1.0
        covariance = covariance / np.outer(scale, scale)
    else:
        mean = np.zeros(len(mean))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values, components = np.maximum(values[order], 0.0), vectors[:, order].T
    # eigenvectors have no sign of their own: make the largest entry positive
    largest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(mean)), largest])
    return mean, scale, values / max(values.sum(), 1e-300), components * signs[:, None]


class PcaDetector(Detector):
    """score = -(sum over components of the distance to the component / its weight)."""

    kind = "pca"

    def __init__(self, components: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.components = components
        self.weights = weights
        self.mean = mean
        self.scale = scale

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        features: str = "features",
        n_components: float | None = None,
        whiten: bool = False,
        weighted: bool = True,
        standardization: bool = False,
    ) -> "PcaDetector":
        """``n_components``: a count, or the share of variance to keep when below 1.

        ``whiten`` rescales projections only; this score uses none, so it changes nothing.
        """
        options = {"n_components": n_components, "whiten": whiten, "weighted": weighted, "standardization": standardization}
        return cls.fit_many(df, [options], features)[0]

    @classmethod
    def fit_many(cls, df: DataFrame, grid: Sequence[Mapping], features: str = "features") -> list["PcaDetector"]:
        """One detector per choice of options, from one pass over the rows and one decomposition per scaling."""
        _, mean, covariance = moments(df, features)
        known = {}
        for standardization in {bool(options.get("standardization", False)) for options in grid}:
            known[standardization] = _decomposed(mean, covariance, standardization)
        out = []
        for options in grid:
            mean, scale, ratio, components = known[bool(options.get("standardization", False))]
            n_components, keep = options.get("n_components"), len(ratio)
            if n_components is not None:
                if 0 < n_components < 1:
                    keep = int(np.searchsorted(np.cumsum(ratio), n_components) + 1)
                else:
                    keep = int(n_components)
            keep = max(1, min(keep, len(ratio)))
            weights = ratio[:keep] if options.get("weighted", True) else np.ones(keep)
            out.append(cls(components[:keep], np.maximum(weights, 1e-12), mean, scale))
        return out

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        squares = (x**2).sum(axis=1)[:, None] + (self.components**2).sum(axis=1) - 2.0 * x @ self.components.T
        return -(np.sqrt(np.maximum(squares, 0.0)) / self.weights).sum(axis=1)

    def expression(self, features: Column) -> Column:
        """The score as a JVM expression, for narrow rows."""
        standard = F.zip_with(V.subtract(features, V.vector(self.mean)), V.vector(self.scale), lambda a, b: a / b)
        terms = [V.euclidean(standard, V.vector(c)) / F.lit(float(w)) for c, w in zip(self.components, self.weights)]
        return -V.total(F.array(*terms))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"components": self.components, "weights": self.weights, "mean": self.mean, "scale": self.scale}

    @classmethod
    def restore(cls, params, arrays):
        return cls(arrays["components"], arrays["weights"], arrays["mean"], arrays["scale"])
