"""Fitted detectors as a Parquet table of named number blocks; no pickles."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Autoencoder
from relevia.detectors.base import CentroidDetector, Detector
from relevia.detectors.iforest import IsolationForest
from relevia.detectors.ocsvm import OneClassSVM
from relevia.detectors.pca import PcaDetector

KINDS = {c.kind: c for c in (Autoencoder, CentroidDetector, IsolationForest, OneClassSVM, PcaDetector)}
VALUES_PER_ROW = 65_536
SCHEMA = (
    "kind string, train_id string, model_id string, metric double, params string, "
    "name string, shape array<long>, part int, `values` array<double>"
)


def save_model(spark: SparkSession, model: Detector, path: str, train_id: str, metric: float | None = None) -> str:
    """Append a fitted detector; ``metric`` ranks models of the same kind and training table."""
    model_id = uuid.uuid4().hex
    rows = []
    for name, values in (model.arrays() or {"": np.zeros(0)}).items():
        flat = np.asarray(values, dtype=np.float64).ravel()
        for part, start in enumerate(range(0, max(flat.size, 1), VALUES_PER_ROW)):
            rows.append((
                model.kind, train_id, model_id, metric, json.dumps(model.params()), name,
                [int(s) for s in np.shape(values)], part, flat[start : start + VALUES_PER_ROW].tolist(),
            ))
    spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("kind", "train_id").parquet(path)
    return model_id


def load_model(spark: SparkSession, path: str, kind: str, train_id: str) -> Detector:
    """The saved detector of this kind and training table with the best metric."""
    found = spark.read.schema(SCHEMA).parquet(path).where((F.col("kind") == kind) & (F.col("train_id") == train_id))
    best = found.orderBy(F.col("metric").desc_nulls_last(), "model_id").select("model_id").first()
    if best is None:
        raise ValueError(f"no {kind} model for {train_id!r}")
    rows = found.where(F.col("model_id") == best["model_id"]).orderBy("name", "part").collect()
    blocks: dict[str, list] = {}
    for row in rows:
        blocks.setdefault(row["name"], []).append(row)
    arrays = {
        name: np.concatenate([np.asarray(r["values"], dtype=np.float64) for r in parts]).reshape(parts[0]["shape"])
        for name, parts in blocks.items()
        if name
    }
    return KINDS[kind].restore(json.loads(rows[0]["params"]), arrays)
