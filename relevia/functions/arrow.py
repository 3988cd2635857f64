"""Arrow list columns as NumPy matrices and back, for vectorised per-batch work."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as (rows, width); a null row becomes NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count == 0:
        return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))
    valid = np.asarray(column.is_valid())
    values = np.asarray(column.drop_null().flatten(), dtype=np.float64).reshape(int(valid.sum()), -1)
    out = np.full((rows, values.shape[1]), np.nan)
    out[valid] = values
    return out


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as ``list<double>``."""
    values = np.ascontiguousarray(values, dtype=np.float64)
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def with_vector(
    df: DataFrame, inputs: list[str], out: str, compute: Callable[..., np.ndarray], scalar: bool = False
) -> DataFrame:
    """Add a column computed per Arrow batch from matrix-valued input columns.

    ``compute`` gets one matrix per input and returns a matrix, or a vector when ``scalar``.
    """
    kind = "double" if scalar else "array<double>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    kept = [f.name for f in df.schema.fields if f.name != out]
    position = {name: i for i, name in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = compute(*[matrix(batch.column(position[i])) for i in inputs])
            column = pa.array(np.asarray(result, dtype=np.float64)) if scalar else lists(result)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(position[k]) for k in kept], column], names=[*kept, out]
            )

    return df.mapInArrow(run, f"{schema}, `{out}` {kind}")


VECTOR_BLOCK = 65_536


def sum_vectors(parts: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum an array column over a table of per-task partial results.

    Vectors are cut into blocks. Tasks add up a block's parts in two levels, about the square
    root of the shuffle width first, so that one vector in all reaches the driver.
    """
    shuffle_width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan_in = max(1, math.ceil(math.sqrt(shuffle_width)))
    schema = "block int, lane int, part array<double>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = np.random.default_rng().integers(fan_in)
        for batch in batches:
            for row in matrix(batch.column(0)) if batch.num_rows else ():
                for block, start in enumerate(range(0, width, VECTOR_BLOCK)):
                    part = row[None, start : start + VECTOR_BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([lane], pa.int32()), lists(part)], names=["block", "lane", "part"]
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, key in enumerate(keys):
                part = matrix(batch.column(2).slice(i, 1))[0]
                sums[key] = sums[key] + part if key in sums else part
        for (block, lane), part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([lane], pa.int32()), lists(part[None, :])], names=["block", "lane", "part"]
            )

    blocks = math.ceil(width / VECTOR_BLOCK)
    lanes = parts.select(column).mapInArrow(cut, schema).repartition(fan_in * blocks, "block", "lane").mapInArrow(add, schema)
    merged = lanes.withColumn("lane", F.lit(0)).repartition(blocks, "block").mapInArrow(add, schema)
    acc = np.zeros(width)
    for row in merged.collect():
        start = row["block"] * VECTOR_BLOCK
        acc[start : start + len(row["part"])] += np.asarray(row["part"])
    return acc


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal rows out over all shuffle partitions before work that is heavy per row.

    Rows to explain are few and small, so by size alone they would end up in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
