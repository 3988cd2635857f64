"""Column expressions on ``array<double>`` vectors; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(l2_norm(v), lambda norm: F.when(norm == 0.0, v).otherwise(F.transform(v, lambda x: x / norm)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def absolute(v: Column) -> Column:
    return F.transform(v, lambda x: F.abs(x))


def positive_part(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return l2_norm(subtract(a, b))


def highlight(v: Column, share: float = 0.25) -> Column:
    """Flags of the entries above ``share`` of the row's largest entry."""
    return let(F.array_max(v) * F.lit(share), lambda limit: F.transform(v, lambda x: x > limit))


def weighted_sums(v: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Constant matrix times vector: one dot product per row of ``rows``."""
    return F.array(*[dot(v, vector(row)) for row in rows])


def group_sums(v: Column, groups: Sequence[Sequence[int]]) -> Column:
    """Sum the entries at each group's 0-based positions, one output entry per group."""
    return F.array(
        *[
            F.aggregate(
                F.array(*[F.lit(i + 1) for i in group]),
                F.lit(0.0),
                lambda acc, i: acc + F.element_at(v, i),
            )
            for group in groups
        ]
    )


def ordered_positions(v: Column, key: Callable[[Column], Column]) -> Column:
    """1-based positions by ``key`` descending; ties by position descending."""
    tagged = F.transform(v, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
    return F.transform(F.reverse(F.array_sort(tagged)), lambda s: s["i"] + 1)


def top_positions(v: Column, k: int, by_magnitude: bool = True) -> Column:
    """1-based positions of the ``k`` largest entries, largest first."""
    key = (lambda x: F.abs(x)) if by_magnitude else (lambda x: x)
    return F.slice(ordered_positions(v, key), 1, k)
