"""What every fitted detector offers: scores per batch, and parts for the model table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.functions.arrow import matrix, with_vector


class Detector:
    """A fitted detector. Lower scores are more anomalous."""

    kind = ""

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of a matrix."""
        raise NotImplementedError

    def transform(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """Add the score, computed per Arrow batch on the executors."""
        return with_vector(df, [features], out, self.score_batch, scalar=True)

    def params(self) -> dict:
        return {}

    def arrays(self) -> dict[str, np.ndarray]:
        return {}

    @classmethod
    def restore(cls, params: dict, arrays: dict[str, np.ndarray]) -> "Detector":
        raise NotImplementedError


def score_many(
    df: DataFrame, detectors: Sequence[Detector], keep: Sequence[str] = (), features: str = "features", run: str = "run"
) -> DataFrame:
    """``run, *keep, score``: the scores of many detectors from one pass over the rows; run is a detector's number.

    Each batch is scored by all detectors before the next one is read. A null vector has a null score.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{run}` int", *[f"`{c}` {kinds[c]}" for c in keep], "score double"])
    shipped = df.sparkSession.sparkContext.broadcast(list(detectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keep)))
            lost = np.asarray(batch.column(len(keep)).is_null())
            for number, detector in enumerate(shipped.value):
                found = pa.array(np.asarray(detector.score_batch(x), dtype=np.float64), mask=lost)
                numbers = pa.array(np.full(batch.num_rows, number), pa.int32())
                yield pa.RecordBatch.from_arrays([numbers, *batch.columns[:-1], found], names=[run, *keep, "score"])

    return df.select(*keep, features).mapInArrow(score, schema)


class CentroidDetector(Detector):
    """Reconstructs every row as one fixed point; the error is the distance to it.

    The scorer is a plain expression, so it runs without leaving the JVM.
    """

    kind = "centroid"

    def __init__(self, centre: np.ndarray):
        self.centre = np.asarray(centre, dtype=np.float64)

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features") -> "CentroidDetector":
        return cls(mean_vector(df, features))

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        return -np.sqrt(((x - self.centre) ** 2).sum(axis=1))

    def expression(self, features: Column) -> Column:
        return -V.euclidean(features, V.vector(self.centre))

    def reconstruct_batch(self, x: np.ndarray) -> np.ndarray:
        return np.tile(self.centre, (len(x), 1))

    def transform(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        return df.withColumn(out, self.expression(F.col(features)))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"centre": self.centre}

    @classmethod
    def restore(cls, params, arrays):
        return cls(arrays["centre"])


def mean_vector(df: DataFrame, features: str = "features") -> list[float]:
    """Mean of each vector position, as one aggregation over whole vectors."""
    mean = df.select(Summarizer.mean(array_to_vector(features)).alias("mean")).first()["mean"]
    return [float(v) for v in mean]
