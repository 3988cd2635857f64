"""Encoders: fit small parameters on training rows, transform any rows by expressions.

A fitted encoder turns source columns into one ``array<double>`` and names its
entries in a catalog of (position, encoded name, source column, kind).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.operators.ranking import RankSelector
from relevia.session import materialize

MISSING = "nan"
UNSEEN_CODE = -1000000
MAX_ENCODED_WIDTH = 20_000
MAX_LITERAL_CATEGORIES = 1_000


@dataclass
class EncodedColumn:
    position: int
    name: str
    source: str
    kind: str


def text_value(column: str) -> Column:
    """Category text of a column; null is the category ``nan``."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


def number_value(column: str) -> Column:
    """Number of a column; null is 0, and 0 means missing."""
    return F.coalesce(F.col(f"`{column}`").cast("double"), F.lit(0.0))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values of each column."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), text_value(c).alias("value")) for c in columns])
    )
    return df.select(cells.alias("s")).select("s.*").distinct()


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the distinct values of each column, coded in sorted order, as a written table.

    Values are cut into ranges and numbered inside them; a range's first code is the sum of the
    ranges before it. So no task orders all values of a column, and codes stay as they were fitted.
    """
    ranges = distinct_values(df, columns).repartitionByRange("column", "value")
    ranges = materialize(ranges.withColumn("_range", F.spark_partition_id()), "dictionary-ranges")
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select("column", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("column", "_range").orderBy("value")) - 1
    coded = ranges.withColumn("_inside", inside).join(sizes, ["column", "_range"])
    return materialize(coded.select("column", "value", (F.col("_first") + F.col("_inside")).alias("code")), "dictionary")


def _literal_categories(distinct: DataFrame, limit: int) -> dict[str, list[str]] | None:
    """Sorted values per column, or None if there are more than ``limit`` in all."""
    rows = distinct.take(limit + 1)
    if len(rows) > limit:
        return None
    found: dict[str, list[str]] = {}
    # code points order texts as their UTF-8 bytes do
    for row in sorted(rows, key=lambda r: (r["column"], r["value"])):
        found.setdefault(row["column"], []).append(row["value"])
    return found


class OneHotEncoder:
    """One entry per seen category; an unseen value leaves its column all off."""

    kind = "cat"

    def __init__(self, columns: Sequence[str], off_value: float = 0.0):
        self.columns = list(columns)
        self.off_value = float(off_value)
        self.categories: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> "OneHotEncoder":
        found = _literal_categories(distinct_values(df, self.columns), MAX_ENCODED_WIDTH)
        if found is None:
            raise ValueError(f"more than {MAX_ENCODED_WIDTH} categories: use SparseEncoder or OrdinalEncoder")
        self.categories = {c: found.get(c, []) for c in self.columns}
        return self

    def _on(self, column: str, on: Column, off: Column) -> Column:
        value = text_value(column)
        choices = F.array(*[F.lit(v) for v in self.categories[column]]).cast("array<string>")
        return F.transform(choices, lambda v: F.when(v == value, on).otherwise(off))

    def expression(self) -> Column:
        return F.concat(*[self._on(c, F.lit(1.0), F.lit(self.off_value)) for c in self.columns])

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, self.expression())

    def catalog(self) -> list[tuple[str, str]]:
        return [(f"{c}_{v}", c) for c in self.columns for v in self.categories[c]]

    def inverse(self, df: DataFrame, encoded: str = "features") -> DataFrame:
        """Category text per source column; null when the column is all off."""
        start, out = 1, {}
        for c in self.columns:
            values = self.categories[c]
            at = F.array_position(F.slice(encoded, start, len(values)), F.lit(1.0)).cast("int")
            out[c] = F.when(at > 0, F.element_at(F.array(*[F.lit(v) for v in values]), at))
            start += len(values)
        return df.withColumns(out)


class OrdinalEncoder:
    """Index in the sorted category list, a fixed code for unseen values.

    A short dictionary is a lookup inside the expression, a long one is a join.
    """

    kind = "cat"

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.dictionary: DataFrame | None = None
        self.categories: dict[str, list[str]] | None = None

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        self.categories = _literal_categories(distinct_values(df, self.columns), MAX_LITERAL_CATEGORIES)
        if self.categories is None:
            self.dictionary = fit_dictionary(df, self.columns)
        return self

    def expression(self) -> Column:
        if self.categories is None:
            raise ValueError("the dictionary is too long for an expression: use transform")
        codes = []
        for c in self.columns:
            choices = F.array(*[F.lit(v) for v in self.categories.get(c, [])]).cast("array<string>")
            at = F.array_position(choices, text_value(c))
            codes.append(F.when(at > 0, at - 1).otherwise(F.lit(UNSEEN_CODE)).cast("double"))
        return F.array(*codes)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        if self.categories is not None:
            return df.withColumn(out, self.expression())
        joined = df
        for i, c in enumerate(self.columns):
            codes = self.dictionary.where(F.col("column") == c).select(
                F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")
            )
            joined = joined.join(codes, text_value(c) == F.col(f"_value{i}"), "left").drop(f"_value{i}")
        codes = [F.coalesce(F.col(f"_code{i}"), F.lit(UNSEEN_CODE)).cast("double") for i in range(len(self.columns))]
        return joined.withColumn(out, F.array(*codes)).drop(*[f"_code{i}" for i in range(len(self.columns))])

    def catalog(self) -> list[tuple[str, str]]:
        return [(c, c) for c in self.columns]

    def inverse(self, df: DataFrame, encoded: str = "features") -> DataFrame:
        """Category text per source column; null for the unseen code."""
        if self.categories is not None:
            out = {}
            for i, c in enumerate(self.columns):
                choices = F.array(*[F.lit(v) for v in self.categories.get(c, [])]).cast("array<string>")
                code = F.element_at(F.col(encoded), i + 1).cast("int")
                out[c] = F.when(code >= 0, F.try_element_at(choices, code + 1))
            return df.withColumns(out)
        for i, c in enumerate(self.columns):
            values = self.dictionary.where(F.col("column") == c).select(
                F.col("code").cast("double").alias(f"_code{i}"), F.col("value").alias(f"_value{i}")
            )
            df = (
                df.join(values, F.element_at(F.col(encoded), i + 1) == F.col(f"_code{i}"), "left")
                .withColumn(c, F.col(f"_value{i}"))
                .drop(f"_code{i}", f"_value{i}")
            )
        return df


def log10_scale(x: Column) -> Column:
    """sign(x) * (log10|x| + 1) from 1 up, sign(x) * |x| below."""
    size = F.abs(x)
    return F.signum(x) * F.when(size >= 1.0, F.log10(size) + 1.0).otherwise(size)


def _missing_flag(column: str) -> Column:
    return (number_value(column) == 0.0).cast("double")


class LogScaler:
    """Signed log10 scale; needs no fit."""

    kind = "num"

    def __init__(self, columns: Sequence[str], nan_bucket: bool = False, numeric_last: bool = False):
        self.columns = list(columns)
        self.nan_bucket = nan_bucket
        self.numeric_last = numeric_last

    def fit(self, df: DataFrame) -> "LogScaler":
        return self

    def _entries(self) -> list[tuple[str, str, Column]]:
        values = [(f"{c}_", c, log10_scale(number_value(c))) for c in self.columns]
        flags = [(f"{c}_0", c, _missing_flag(c)) for c in self.columns]
        if self.numeric_last:
            return flags + values
        if not self.nan_bucket:
            return values
        return [entry for pair in zip(values, flags) for entry in pair]

    def expression(self) -> Column:
        return F.array(*[e for _, _, e in self._entries()])

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, self.expression())

    def catalog(self) -> list[tuple[str, str]]:
        return [(name, source) for name, source, _ in self._entries()]


class _LinearScaler:
    """(x - shift) / span per column, a span of zero counts as 1."""

    kind = "num"

    def __init__(self, columns: Sequence[str], nan_bucket: bool = False, digits: int | None = None):
        self.columns = list(columns)
        self.nan_bucket = nan_bucket
        self.digits = digits
        self.shift: list[float] = []
        self.span: list[float] = []

    def _statistics(self, value: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def fit(self, df: DataFrame):
        aggregates = []
        for i, c in enumerate(self.columns):
            shift, span = self._statistics(number_value(c))
            if self.digits is not None:
                shift, span = F.round(shift, self.digits), F.round(span, self.digits)
            aggregates += [shift.alias(f"shift{i}"), span.alias(f"span{i}")]
        row = df.agg(*aggregates).first()
        self.shift = [row[f"shift{i}"] or 0.0 for i in range(len(self.columns))]
        self.span = [row[f"span{i}"] or 1.0 for i in range(len(self.columns))]
        return self

    def expression(self) -> Column:
        values = [
            (number_value(c) - F.lit(shift)) / F.lit(span)
            for c, shift, span in zip(self.columns, self.shift, self.span)
        ]
        flags = [_missing_flag(c) for c in self.columns] if self.nan_bucket else []
        return F.array(*values, *flags)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, self.expression())

    def catalog(self) -> list[tuple[str, str]]:
        flags = [(f"{c}_0", c) for c in self.columns] if self.nan_bucket else []
        return [(c, c) for c in self.columns] + flags


class ZScoreScaler(_LinearScaler):
    def _statistics(self, value: Column) -> tuple[Column, Column]:
        return F.avg(value), F.stddev_pop(value)


class MinMaxScaler(_LinearScaler):
    def _statistics(self, value: Column) -> tuple[Column, Column]:
        return F.min(value), F.max(value) - F.min(value)


# A bucketed value is moved up by this much before it meets the edges.
EDGE_ATOL = 1e-8
EDGE_RTOL = 1e-5
MIN_BUCKET_WIDTH = 1e-8


class BucketEncoder:
    """Buckets over the non-zero values of each column, and one more for zero.

    Strategies: ``quantile_outlier`` (1 % outlier buckets around equal-count inlier
    buckets), ``uniform``, ``quantile``, ``kmeans``. Edges are exact.
    """

    kind = "num"

    def __init__(
        self,
        columns: Sequence[str],
        n_buckets: int = 5,
        strategy: str = "quantile_outlier",
        encode: str = "onehot",
        max_iterations: int = 300,
        digits: int | None = None,
    ):
        if strategy not in ("quantile_outlier", "uniform", "quantile", "kmeans"):
            raise ValueError(f"unknown strategy {strategy!r}")
        if encode not in ("onehot", "ordinal"):
            raise ValueError(f"unknown encode {encode!r}")
        self.columns = list(columns)
        self.n_buckets = n_buckets
        self.strategy = strategy
        self.encode = encode
        self.max_iterations = max_iterations
        self.digits = digits
        self.edges: dict[str, list[float]] = {}

    def fit(self, df: DataFrame) -> "BucketEncoder":
        source = df.select(*[f"`{c}`" for c in self.columns])
        if self.strategy == "uniform":
            return self._set_edges(*self._range(source), None)
        if self.strategy == "kmeans":
            low, high = self._range(source)
            edges = self._kmeans(source, low, high, [c for c in self.columns if self._varies(low[c], high[c])])
        else:
            selector = RankSelector(source, self.columns, skip_zero=True)
            low, high = selector.minimum, selector.maximum
            varying = [c for c in self.columns if self._varies(low[c], high[c])]
            quantiles = self._quantile if self.strategy == "quantile" else self._quantile_outlier
            edges = quantiles(selector, varying)
        if self.strategy != "quantile_outlier":
            edges = {c: self._drop_narrow(e) for c, e in edges.items()}
        return self._set_edges(low, high, edges)

    def _set_edges(self, low: dict, high: dict, edges: dict[str, list[float]] | None) -> "BucketEncoder":
        if edges is None:
            edges = {c: self._spaced(low[c], high[c]) for c in self.columns if self._varies(low[c], high[c])}
        for c in self.columns:
            if c not in edges:
                edges[c] = [] if low[c] is None else [-float("inf"), float("inf")]
            if self.digits is not None:
                edges[c] = [round(e, self.digits) if abs(e) != float("inf") else e for e in edges[c]]
        self.edges = {c: edges[c] for c in self.columns}
        return self

    @staticmethod
    def _varies(low: float | None, high: float | None) -> bool:
        return low is not None and low != high

    def _range(self, df: DataFrame) -> tuple[dict, dict]:
        aggregates = []
        for i, c in enumerate(self.columns):
            v = F.when(F.col(f"`{c}`") != 0, F.col(f"`{c}`").cast("double"))
            aggregates += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        row = df.agg(*aggregates).first()
        return (
            {c: row[f"lo{i}"] for i, c in enumerate(self.columns)},
            {c: row[f"hi{i}"] for i, c in enumerate(self.columns)},
        )

    def _spaced(self, low: float, high: float) -> list[float]:
        step = (high - low) / self.n_buckets
        return [low + i * step for i in range(self.n_buckets)] + [high]

    @staticmethod
    def _drop_narrow(edges: list[float]) -> list[float]:
        return edges[:1] + [b for a, b in zip(edges, edges[1:]) if b - a > MIN_BUCKET_WIDTH]

    def _quantile(self, selector: RankSelector, columns: list[str]) -> dict[str, list[float]]:
        steps = [i / self.n_buckets for i in range(self.n_buckets + 1)]
        return selector.percentiles(
            {c: steps for c in columns}, {c: 0 for c in columns}, {c: selector.count[c] for c in columns}
        )

    def _quantile_outlier(self, selector: RankSelector, columns: list[str]) -> dict[str, list[float]]:
        places = {
            c: (int(selector.count[c] * 0.01), int(selector.count[c] * 0.99)) for c in columns
        }
        points = self.n_buckets - 1
        steps = [i / (points - 1) if points > 1 else 0.0 for i in range(points)]
        # the ranks of the inlier quantiles hang on ties at the limits: one pass brackets both
        ranks = {}
        for c, (lo, hi) in places.items():
            earliest, latest = (lo + 1, selector.neighbours(c, hi)[0] - 1), (selector.neighbours(c, lo)[1], hi - 1)
            inner = [[int(max(0, ends[0] * (1 - p) + ends[1] * p)) for p in steps] for ends in (earliest, latest)]
            ranks[c] = [(lo, lo), (hi, hi), *((min(a, b), max(a, b) + 1) for a, b in zip(*inner))]
        selector.expect(ranks)
        limits = selector.select({c: list(p) for c, p in places.items()})
        first, size = {}, {}
        for c, (lo, hi) in places.items():
            first[c] = limits[c, lo].through
            size[c] = limits[c, hi].below - first[c]
        inner = selector.percentiles({c: steps for c in columns}, first, size)
        edges = {}
        for c, (lo, _) in places.items():
            # no value strictly between the limits: the inlier buckets are empty at the lower limit
            middle = inner.get(c, [limits[c, lo].value] * points)
            edges[c] = [selector.minimum[c], *middle, selector.maximum[c]]
        return edges

    def _kmeans(self, df: DataFrame, low: dict, high: dict, columns: list[str]) -> dict[str, list[float]]:
        """Lloyd steps on the counted distinct values of all columns at once."""
        if not columns:
            return {}
        ends = {c: self._spaced(low[c], high[c]) for c in columns}
        centres = {c: [(a + b) / 2 for a, b in zip(e, e[1:])] for c, e in ends.items()}
        cells = [
            F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)
        ]
        histogram = (
            df.select(F.explode(F.array(*cells)).alias("s"))
            .select("s.*")
            .where("v IS NOT NULL AND v <> 0")
            .groupBy("c", "v")
            .agg(F.count(F.lit(1)).alias("n"))
            .persist()
        )
        try:
            spread = {r["c"]: r["var"] for r in histogram.groupBy("c").agg(_weighted_variance()).collect()}
            active = set(range(len(columns)))
            for _ in range(self.max_iterations):
                borders = {
                    i: [(a + b) / 2 for a, b in zip(centres[columns[i]], centres[columns[i]][1:])]
                    for i in active
                }
                inside = F.lit(None).cast("int")
                for i, cut in borders.items():
                    place = F.size(F.filter(V.vector(cut), lambda e: e <= F.col("v")))
                    inside = F.when(F.col("c") == i, place).otherwise(inside)
                means = (
                    histogram.where(F.col("c").isin(sorted(active)))
                    .groupBy("c", inside.alias("k"))
                    .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
                    .collect()
                )
                moved = dict.fromkeys(active, 0.0)
                for row in means:
                    column = columns[row["c"]]
                    moved[row["c"]] += (centres[column][row["k"]] - row["mean"]) ** 2
                    centres[column][row["k"]] = row["mean"]
                active = {i for i in active if moved[i] > 1e-4 * spread[i]}
                if not active:
                    break
        finally:
            histogram.unpersist()
        return {
            c: [
                low[c],
                *[(a + b) / 2 for a, b in zip(sorted(centres[c]), sorted(centres[c])[1:])],
                high[c],
            ]
            for c in columns
        }

    def bucket(self, column: str) -> Column:
        """Bucket number: 0..n-1 for values, n for zero."""
        value = number_value(column)
        shifted = value + (F.lit(EDGE_ATOL) + F.lit(EDGE_RTOL) * F.abs(value))
        edges = V.vector(self.edges[column][1:])
        place = V.let(shifted, lambda x: F.size(F.filter(edges, lambda e: x >= e)))
        return F.when(value == 0.0, F.lit(self.n_buckets)).otherwise(
            F.least(place, F.lit(self.n_buckets - 1))
        )

    def expression(self) -> Column:
        if self.encode == "ordinal":
            return F.array(*[self.bucket(c).cast("double") for c in self.columns])
        numbers = F.sequence(F.lit(0), F.lit(self.n_buckets))
        return F.concat(*[self._onehot(numbers, self.bucket(c)) for c in self.columns])

    @staticmethod
    def _onehot(numbers: Column, bucket: Column) -> Column:
        return V.let(bucket, lambda place: F.transform(numbers, lambda b: (b == place).cast("double")))

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        return df.withColumn(out, self.expression())

    def catalog(self) -> list[tuple[str, str]]:
        if self.encode == "ordinal":
            return [(c, c) for c in self.columns]
        names = []
        for c in self.columns:
            edges = self.edges[c]
            for b in range(self.n_buckets):
                low = "-inf" if b == 0 or b >= len(edges) else f"{edges[b]:.0f}"
                high = "inf" if b == self.n_buckets - 1 or b + 1 >= len(edges) else f"{edges[b + 1]:.0f}"
                names.append((f"{c}_{low}_{high}", c))
            names.append((f"{c}_0", c))
        return names


def _weighted_variance() -> Column:
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    return (F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n") - mean * mean).alias("var")


class TabularEncoder:
    """Categorical entries first, numeric entries after; either side may be absent."""

    def __init__(self, categorical=None, numeric=None):
        self.parts = [p for p in (categorical, numeric) if p is not None]

    def fit(self, df: DataFrame) -> "TabularEncoder":
        for part in self.parts:
            part.fit(df)
        return self

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        names = [f"_part{i}" for i in range(len(self.parts))]
        for name, part in zip(names, self.parts):
            df = part.transform(df, name)
        return df.withColumn(out, F.concat(*names)).drop(*names)

    def catalog(self) -> list[EncodedColumn]:
        entries = [(name, source, p.kind) for p in self.parts for name, source in p.catalog()]
        return [EncodedColumn(i, name, source, kind) for i, (name, source, kind) in enumerate(entries)]


def make_encoder(
    categorical_columns: Sequence[str],
    numeric_columns: Sequence[str],
    categorical: str = "onehot",
    numeric: str = "buckets",
    **options,
) -> TabularEncoder:
    """Encoder pair by name: onehot, onehot_no_zero, ordinal, None / log10, zscore, minmax, buckets, None."""
    categorical_choices = {
        "onehot": lambda: OneHotEncoder(categorical_columns),
        "onehot_no_zero": lambda: OneHotEncoder(categorical_columns, off_value=-1.0),
        "ordinal": lambda: OrdinalEncoder(categorical_columns),
        "None": lambda: None,
    }
    numeric_choices = {
        "log10": lambda: LogScaler(numeric_columns, **options),
        "zscore": lambda: ZScoreScaler(numeric_columns, **options),
        "minmax": lambda: MinMaxScaler(numeric_columns, **options),
        "buckets": lambda: BucketEncoder(numeric_columns, **options),
        "None": lambda: None,
    }
    if categorical not in categorical_choices:
        raise ValueError(f"categorical must be one of {sorted(categorical_choices)}, not {categorical!r}")
    if numeric not in numeric_choices:
        raise ValueError(f"numeric must be one of {sorted(numeric_choices)}, not {numeric!r}")
    return TabularEncoder(categorical_choices[categorical](), numeric_choices[numeric]())
