"""Repeatable uniform numbers that depend on keys only, never on the data layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1): the first 32 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def noise(seed: int, row_id: Column, width: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """``array<double>`` of uniform draws, one per position."""
    span = high - low
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda j: F.lit(low) + F.lit(span) * uniform(F.lit(seed), row_id, j),
    )
