"""Encoding and scoring are row-wise, so a fitted pair also scores a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(rows: DataFrame, encoder, detector, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Scores of streaming rows with an encoder and a detector fitted on a table."""
    encoded = encoder.transform(rows).select(*keep, "features")
    return detector.transform(encoded).drop("features")
