"""Calendar features of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First hour of daytime parts 1..4 (part 0 starts at midnight).
DAYTIME_STARTS = (3, 11, 15, 18)


def is_weekday(ts: Column) -> Column:
    """1 from Monday to Friday, else 0."""
    return F.dayofweek(ts).between(2, 6).cast("int")


def daytime(ts: Column) -> Column:
    """Daytime part 0..4 by hour."""
    hour = F.hour(ts)
    return sum((hour >= start).cast("int") for start in DAYTIME_STARTS)
