"""One-class SVM with an RBF kernel, approximated by random Fourier features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.detectors.base import Detector
from relevia.functions.arrow import lists, matrix, sum_vectors

BINS = 64


def _next_range(counts: np.ndarray, cover: float, low: float, high: float) -> tuple[float, float]:
    """Put the bins where the covered rows and about as many more lie; widen when they hit an end."""
    step = (high - low) / BINS
    filled = np.flatnonzero(counts)
    reached = int(np.searchsorted(np.cumsum(counts), min(2.0 * cover, counts.sum())))
    new_low = low - (high - low) if filled[0] == 0 else low + (filled[0] - 1) * step
    new_high = high + (high - low) if reached >= BINS - 1 else low + (reached + 2) * step
    return new_low, new_high


class OneClassSVM(Detector):
    """score = <w, phi(x)> - rho; negative scores lie outside the support boundary."""

    kind = "ocsvm"

    def __init__(self, directions: np.ndarray, phases: np.ndarray, w: np.ndarray, rho: float = 0.0):
        self.directions = directions
        self.phases = phases
        self.w = w
        self.rho = rho

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions.T + self.phases)

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        return self._map(x) @ self.w - self.rho

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        features: str = "features",
        nu: float = 0.05,
        gamma: float = 1.0,
        components: int = 256,
        iterations: int = 30,
        seed: int = 0,
    ) -> "OneClassSVM":
        """Frank-Wolfe on the dual: every step moves w towards the mean of the share ``nu``
        of rows with the lowest scores.

        One pass per step: tasks add up mapped rows by score bin, and the driver takes the
        lowest bins (the last one in part) until ``nu`` of the rows are covered.
        """
        data = df.select(features).persist()
        try:
            first = data.first()
            if first is None:
                raise ValueError("no training rows")
            width = len(first[0])
            rng = np.random.default_rng(seed)
            directions = rng.normal(scale=np.sqrt(2.0 * gamma), size=(components, width))
            phases = rng.uniform(0.0, 2.0 * np.pi, components)
            model = cls(directions, phases, np.zeros(components))
            low, high = -1.0, 1.0
            for step in range(iterations):
                counts, sums = model._bin_sums(data, features, low, high)
                if step == 0:
                    # all scores are 0 for w = 0: start from the mean of all rows
                    model = cls(directions, phases, sums.sum(axis=0) / counts.sum())
                    high = float(np.sqrt(2.0) * np.linalg.norm(model.w))
                    low = -high
                    continue
                cover = min(counts.sum(), max(1.0, nu * counts.sum()))
                before = np.concatenate([[0.0], np.cumsum(counts)[:-1]])
                part = np.clip((cover - before) / np.maximum(counts, 1.0), 0.0, 1.0)
                target = (part[:, None] * sums).sum(axis=0) / cover
                pace = 2.0 / (step + 2.0)
                model = cls(directions, phases, (1.0 - pace) * model.w + pace * target)
                low, high = _next_range(counts, cover, low, high)
            boundary = model.transform(data, features).agg(F.percentile_approx("score", nu, F.lit(100_000))).first()[0]
            return cls(directions, phases, model.w, float(boundary))
        finally:
            data.unpersist()

    def _bin_sums(self, data: DataFrame, features: str, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Row count and sum of the mapped rows per score bin; the outer bins are open."""
        size = len(self.phases)
        model = self

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(BINS), np.zeros((BINS, size))
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                mapped = model._map(matrix(batch.column(0)))
                place = np.floor((mapped @ model.w - low) / (high - low) * BINS).clip(0, BINS - 1).astype(np.int64)
                counts += np.bincount(place, minlength=BINS)
                np.add.at(sums, place, mapped)
            yield pa.RecordBatch.from_arrays([lists(np.concatenate([counts, sums.ravel()])[None, :])], names=["s"])

        parts = data.select(features).mapInArrow(add, "s array<double>")
        flat = sum_vectors(parts, "s", BINS * (size + 1))
        return flat[:BINS], flat[BINS:].reshape(BINS, size)

    def params(self) -> dict:
        return {"rho": self.rho}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"directions": self.directions, "phases": self.phases, "w": self.w}

    @classmethod
    def restore(cls, params, arrays):
        return cls(arrays["directions"], arrays["phases"], arrays["w"], params["rho"])
