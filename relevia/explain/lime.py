"""Local surrogate attributions: a weighted ridge regression around each row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.functions.arrow import lists, matrix, spread_rows

# Samples per row, kernel width factor, ridge penalty, seed.
SAMPLES = 5_000
KERNEL_WIDTH = 0.75
RIDGE_ALPHA = 1.0
SEED = 42
MAX_VALUES = 200_000
BLOCK_CELLS = 2_000_000


def value_frequencies(train: DataFrame, features: str = "features") -> list[tuple[np.ndarray, np.ndarray]]:
    """Per column its training values and their shares; their total number is checked."""
    counted = (
        train.select(F.posexplode(features).alias("position", "value"))
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    rows = counted.take(MAX_VALUES + 1)
    if len(rows) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} distinct values: encode the columns in buckets first")
    by_position: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["position"], r["value"])):
        by_position.setdefault(row["position"], []).append((row["value"], row["rows"]))
    out = []
    for position in sorted(by_position):
        values = np.array([v for v, _ in by_position[position]])
        shares = np.array([n for _, n in by_position[position]], dtype=np.float64)
        out.append((values, shares / shares.sum()))
    return out


def surrogates(
    score_batch, x: np.ndarray, ids: np.ndarray, frequencies, seed: int, samples: int
) -> np.ndarray:
    """Coefficients of a block of rows: which columns, kept as they are, raise the anomaly score.

    Each row has its own draws, by seed and id; the block is scored at once.
    """
    rows, width = x.shape
    draws = np.stack([np.random.default_rng([seed, int(i) & (2**63 - 1)]).random((samples, width)) for i in ids])
    drawn = np.empty_like(draws)
    for j, (values, shares) in enumerate(frequencies):
        at = np.searchsorted(np.cumsum(shares), draws[:, :, j].ravel(), side="right")
        drawn[:, :, j] = values[np.minimum(at, len(values) - 1)].reshape(rows, samples)
    drawn[:, 0] = x
    same = (drawn == x[:, None, :]).astype(np.float64)
    target = -score_batch(drawn.reshape(-1, width)).reshape(rows, samples)
    distance = (1.0 - same).sum(axis=2)
    weight = np.sqrt(np.exp(-distance / (KERNEL_WIDTH * math.sqrt(width)) ** 2))
    whole = weight.sum(axis=1)
    centred = same - (np.einsum("rs,rsw->rw", weight, same) / whole[:, None])[:, None, :]
    level = (weight * target).sum(axis=1) / whole
    weighted = centred * weight[:, :, None]
    left = weighted.transpose(0, 2, 1) @ centred + RIDGE_ALPHA * np.eye(width)
    right = np.einsum("rsw,rs->rw", weighted, target - level[:, None])
    return np.linalg.solve(left, right[:, :, None])[:, :, 0]


def lime(
    df: DataFrame,
    detector,
    train: DataFrame,
    samples: int = SAMPLES,
    seed: int = SEED,
    features: str = "features",
    row_id: str = "row_id",
) -> DataFrame:
    """Add ``phi``. Samples are drawn where the row lies, by seed and row id, so nothing is
    shuffled and the result does not depend on the data layout."""
    shipped = df.sparkSession.sparkContext.broadcast(value_frequencies(train, features))
    kept = [f for f in df.schema.fields if f.name != "phi"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    place = {name: i for i, name in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(place[features]))
            ids = np.asarray(batch.column(place[row_id]))
            step = max(1, BLOCK_CELLS // (samples * x.shape[1]))
            phi = np.vstack([
                surrogates(detector.score_batch, x[at : at + step], ids[at : at + step], shipped.value, seed, samples)
                for at in range(0, len(x), step)
            ])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(place[f.name]) for f in kept], lists(phi)], names=[*[f.name for f in kept], "phi"]
            )

    return spread_rows(df).mapInArrow(run, f"{schema}, phi array<double>")
