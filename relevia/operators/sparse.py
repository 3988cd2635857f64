"""Encoded rows of any width: a row is the list of its entries that are not zero.

``features`` is ``array<struct<at: long, value: double>>``, positions ascending. Positions are those of the
dense encoder: the categories of each column in sorted order, then the numeric entries. The dictionary is
a table, so neither a plan nor the driver holds a category of a wide column.

Parameters by position (means, component vectors) are a ``PositionTable``. A table of at most
``SHIPPED_BYTES`` goes to every task; a larger one is joined with the entries, where positions that many
rows have are split off into a short table of their own, so that a frequent category is no hot key.

Nulls are the category ``nan``, unseen categories have no entry, null features have null results. ``row_id``
must be unique and not null, as it brings the entries of a row together again after a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.functions.arrow import lists, matrix, sum_vectors, with_vector
from relevia.functions.hashing import uniform
from relevia.operators.encode import MAX_LITERAL_CATEGORIES, _literal_categories, fit_dictionary, text_value
from relevia.session import materialize

SHIPPED_BYTES = 64 << 20
#: A position is frequent when more than one row in so many has it; so a row adds at most that many.
FREQUENT = 1_000


class SparseEncoder:
    """One entry per categorical column whose value was seen, and the numeric entries that are not zero."""

    def __init__(self, columns: Sequence[str], numeric=None, literal_limit: int = MAX_LITERAL_CATEGORIES):
        self.columns = list(columns)
        self.numeric = numeric
        self.literal_limit = literal_limit
        self.dictionary: DataFrame | None = None
        self.sizes: dict[str, int] = {}
        self.short: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> "SparseEncoder":
        self.dictionary = fit_dictionary(df, self.columns)
        counted = {r["column"]: r["count"] for r in self.dictionary.groupBy("column").count().collect()}
        self.sizes = {c: counted.get(c, 0) for c in self.columns}
        few = [c for c in self.columns if self.sizes[c] <= self.literal_limit]
        chosen = self.dictionary.where(F.col("column").isin(few)).select("column", "value")
        found = _literal_categories(chosen, sum(self.sizes[c] for c in few)) or {}
        self.short = {c: found.get(c, []) for c in few}
        if self.numeric is not None:
            self.numeric.fit(df)
        return self

    @property
    def starts(self) -> dict[str, int]:
        """First position of each categorical column."""
        out, start = {}, 0
        for c in self.columns:
            out[c] = start
            start += self.sizes[c]
        return out

    @property
    def numeric_start(self) -> int:
        return sum(self.sizes.values())

    @property
    def width(self) -> int:
        return self.numeric_start + (len(self.numeric.catalog()) if self.numeric is not None else 0)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the entries; a short column is looked up in the expression, a wide one is joined."""
        kept, entries, starts = df.drop(out).columns, [], self.starts
        wide = [c for c in self.columns if c not in self.short]
        for i, c in enumerate(wide):
            codes = self.dictionary.where(F.col("column") == c).select(
                F.col("value").alias(f"#value{i}"), F.col("code").alias(f"#code{i}")
            )
            df = df.join(codes, text_value(c) == F.col(f"#value{i}"), "left")
        for c in self.columns:
            if c in self.short:
                place = F.array_position(F.array(*[F.lit(v) for v in self.short[c]]).cast("array<string>"), text_value(c))
                code = F.when(place > 0, place - 1)
            else:
                code = F.col(f"#code{wide.index(c)}")
            entries.append(F.struct((code + starts[c]).alias("at"), F.lit(1.0).alias("value")))
        parts = [F.filter(F.array(*entries), lambda e: e["at"].isNotNull())] if entries else []
        if self.numeric is not None:
            df = self.numeric.transform(df, "#numbers")
            first = self.numeric_start
            numbers = F.transform("#numbers", lambda v, i: F.struct((i + F.lit(first)).cast("long").alias("at"), v.alias("value")))
            parts.append(F.filter(numbers, lambda e: e["value"] != 0.0))
        return df.select(*[F.col(f"`{c}`") for c in kept], F.concat(*parts).alias(out))

    def inverse(self, df: DataFrame, encoded: str = "features") -> DataFrame:
        """Category text per categorical column; null where the column has no entry."""
        starts = self.starts
        for i, c in enumerate(self.columns):
            first, last = starts[c], starts[c] + self.sizes[c]
            mine = F.filter(encoded, lambda e: (e["at"] >= F.lit(first)) & (e["at"] < F.lit(last)))
            code = F.try_element_at(mine, F.lit(1))["at"] - F.lit(first)
            if c in self.short:
                texts = F.array(*[F.lit(v) for v in self.short[c]]).cast("array<string>")
                df = df.withColumn(c, F.try_element_at(texts, (code + 1).cast("int")))
            else:
                values = self.dictionary.where(F.col("column") == c).select(
                    F.col("code").alias(f"#code{i}"), F.col("value").alias(f"#value{i}")
                )
                df = df.join(values, code == F.col(f"#code{i}"), "left").withColumn(c, F.col(f"#value{i}"))
                df = df.drop(f"#code{i}", f"#value{i}")
        return df

    def names(self, spark: SparkSession) -> DataFrame:
        """(enc_pos, enc_name, source_name, kind) of all positions, as a table."""
        starts = self.starts
        first = F.coalesce(*[F.when(F.col("column") == c, F.lit(s)) for c, s in starts.items()], F.lit(0))
        found = self.dictionary.select(
            (F.col("code") + first).cast("long").alias("enc_pos"),
            F.concat_ws("_", "column", "value").alias("enc_name"),
            F.col("column").alias("source_name"),
            F.lit("cat").alias("kind"),
        )
        if self.numeric is None:
            return found
        rows = [(self.numeric_start + i, n, s, self.numeric.kind) for i, (n, s) in enumerate(self.numeric.catalog())]
        return found.unionByName(spark.createDataFrame(rows, "enc_pos long, enc_name string, source_name string, kind string"))

    def source_ranges(self) -> dict[str, list[tuple[int, int]]]:
        """Position ranges [first, last) of each source column."""
        out: dict[str, list[tuple[int, int]]] = {}
        for c, s in self.starts.items():
            out.setdefault(c, []).append((s, s + self.sizes[c]))
        for i, (_, source) in enumerate(self.numeric.catalog() if self.numeric is not None else ()):
            out.setdefault(source, []).append((self.numeric_start + i, self.numeric_start + i + 1))
        return out


def _within(position: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for first, last in ranges:
        inside = inside | ((position >= F.lit(first)) & (position < F.lit(last)))
    return inside


def source_sums(entries: Column, encoder: SparseEncoder) -> Column:
    """``array<double>``: the sum of the entries of each source column, in the order of ``source_ranges``."""
    return F.array(
        *[
            V.total(F.transform(F.filter(entries, lambda e: _within(e["at"], ranges)), lambda e: e["value"]))
            for ranges in encoder.source_ranges().values()
        ]
    )


def position_moments(df: DataFrame, features: str = "features") -> tuple[int, DataFrame]:
    """Row count, and a written table (at, frequent, n, total, squares) of the positions that occur."""
    rows = df.where(F.col(features).isNotNull()).count()
    cells = df.select(F.explode(features).alias("e")).select("e.*")
    sums = cells.groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
    )
    return rows, materialize(sums.withColumn("frequent", F.col("n") * FREQUENT > F.lit(rows)), "position-moments")


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, positions, values, nulls) of an Arrow column of entries."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = column.flatten()
    at = np.asarray(pc.struct_field(flat, "at"), dtype=np.int64)
    value = np.asarray(pc.struct_field(flat, "value"), dtype=np.float64)
    return np.concatenate([[0], np.cumsum(lengths)]), at, value, np.asarray(column.is_null())


class PositionTable:
    """``size`` parameters per position: a table (at, frequent, vector), zero for positions it does not name."""

    def __init__(self, rows: DataFrame, width: int, size: int = 1, shipped_bytes: int = SHIPPED_BYTES):
        self.rows = rows
        self.width = width
        self.size = size
        self.shipped = width * size * 8 <= shipped_bytes
        self._broadcast = None

    def _dense(self):
        """The table as a broadcast (width, size) matrix; only for tables of a checked size."""
        if self._broadcast is None:
            found = self.rows.select("at", "vector").toArrow()
            dense = np.zeros((self.width, self.size))
            if found.num_rows:
                dense[np.asarray(found["at"])] = matrix(found["vector"])
            self._broadcast = self.rows.sparkSession.sparkContext.broadcast(dense)
        return self._broadcast

    def _cells(self, df: DataFrame, features: str, row_id: str) -> DataFrame:
        """(#row, #slot, value, vector) of all entries whose position is in the table."""
        cells = df.select(F.col(row_id).alias("#row"), F.posexplode(features).alias("#slot", "e"))
        cells = cells.select("#row", "#slot", "e.at", "e.value")
        # at most FREQUENT positions per entry of a row are frequent, whatever the number of rows
        frequent = F.broadcast(self.rows.where("frequent").select("at", "vector"))
        rare = self.rows.where("not frequent").select("at", "vector")
        split = cells.join(frequent, "at", "left")
        known = split.where("vector is not null")
        return known.unionByName(split.where("vector is null").drop("vector").join(rare, "at"))

    def look_up(self, df: DataFrame, row_id: str, out: str, features: str = "features") -> DataFrame:
        """Add ``array<double>``: the parameter (of a table of size 1) at each entry of the row."""
        if self.shipped:
            dense = self._dense()

            @F.arrow_udf("array<double>")
            def gather(column: pa.Array) -> pa.Array:
                offsets, at, _, nulls = _slots(column)
                found = pa.array(dense.value[at, 0])
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, mask=pa.array(nulls))

            return df.withColumn(out, gather(features))
        slots = self._cells(df, features, row_id).groupBy("#row").agg(
            F.map_from_entries(F.collect_list(F.struct("#slot", F.element_at("vector", 1)))).alias("#slots")
        )
        found = F.transform(features, lambda e, i: F.coalesce(F.try_element_at("#slots", i), F.lit(0.0)))
        return df.join(slots, F.col(row_id) == F.col("#row"), "left").withColumn(out, found).drop("#row", "#slots")

    def project(self, df: DataFrame, row_id: str, out: str, features: str = "features") -> DataFrame:
        """Add ``array<double>``: the sum of value times vector over the entries of the row."""
        size = self.size
        if self.shipped:
            dense = self._dense()

            @F.arrow_udf("array<double>")
            def add(column: pa.Array) -> pa.Array:
                offsets, at, value, nulls = _slots(column)
                rows = np.repeat(np.arange(len(column)), np.diff(offsets))
                sums = np.column_stack([
                    np.bincount(rows, weights=dense.value[at, j] * value, minlength=len(column)) for j in range(size)
                ])
                found = lists(sums)
                return pa.ListArray.from_arrays(found.offsets, found.values, mask=pa.array(nulls))

            return df.withColumn(out, add(features))
        sums = self._cells(df, features, row_id).groupBy("#row").agg(
            F.array(*[F.sum(F.element_at("vector", j + 1) * F.col("value")) for j in range(size)]).alias("#sums")
        )
        nothing = F.array(*[F.lit(0.0)] * size)
        found = F.when(F.col(features).isNotNull(), F.coalesce("#sums", nothing))
        return df.join(sums, F.col(row_id) == F.col("#row"), "left").withColumn(out, found).drop("#row", "#sums")


def _values(features: str) -> Column:
    return F.transform(features, lambda e: e["value"])


def _squares(features: str) -> Column:
    return V.total(F.transform(features, lambda e: e["value"] * e["value"]))


class SparseCentroid:
    """Distance to the mean of the training rows, and its square by source column."""

    kind = "sparse_centroid"

    def __init__(self, centre: PositionTable, encoder: SparseEncoder, rest: dict[str, float]):
        self.centre = centre
        self.encoder = encoder
        self.rest = rest

    @classmethod
    def fit(cls, df: DataFrame, encoder: SparseEncoder, features: str = "features", **options) -> "SparseCentroid":
        rows, sums = position_moments(df, features)
        if rows == 0:
            raise ValueError("no training rows")
        centre = sums.select("at", "frequent", F.array(F.col("total") / F.lit(float(rows))).alias("vector"))
        square = F.element_at("vector", 1) * F.element_at("vector", 1)
        ranges = encoder.source_ranges()
        rest = centre.agg(*[F.sum(F.when(_within(F.col("at"), r), square)) for r in ranges.values()]).first()
        return cls(PositionTable(centre, encoder.width, 1, **options), encoder, {s: v or 0.0 for s, v in zip(ranges, rest)})

    def source_errors(self, df: DataFrame, row_id: str, out: str = "errors", features: str = "features") -> DataFrame:
        """Add ``array<double>``: the squared distance in each source column, the silent positions included.

        A position without an entry adds the square of the mean there; so the sum of all these squares
        is corrected at the entries only.
        """
        df = self.centre.look_up(df, row_id, "#centre", features)
        corrected = F.zip_with(
            features, "#centre",
            lambda e, c: F.struct(e["at"].alias("at"), (e["value"] * (e["value"] - 2.0 * c)).alias("value")),
        )
        sums = source_sums(corrected, self.encoder)
        whole = F.zip_with(sums, V.vector(list(self.rest.values())), lambda a, b: F.greatest(a + b, F.lit(0.0)))
        return df.withColumn(out, F.when(F.col(features).isNotNull(), whole)).drop("#centre")

    def transform(self, df: DataFrame, row_id: str, out: str = "score", features: str = "features") -> DataFrame:
        """Add the score; lower is more anomalous."""
        df = self.source_errors(df, row_id, "#errors", features)
        return df.withColumn(out, -F.sqrt(V.total(F.col("#errors")))).drop("#errors")


def _gram(df: DataFrame, left: str, right: str, size: int) -> np.ndarray:
    """Sum of left times right transposed over all rows, from partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                products += matrix(batch.column(0)).T @ matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([lists(products.reshape(1, -1))], names=["s"])

    parts = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(add, "s array<double>")
    return sum_vectors(parts, "s", size * size).reshape(size, size)


class SparsePca:
    """Leading principal components of sparse rows by subspace iteration, and the detector's distances to them.

    A step projects the rows onto the subspace, sums their entries times these projections by position,
    and makes the result orthonormal through its Gram matrix. The subspace stays a table; only matrices of
    its size squared reach the driver. The score is that of the dense detector with so many components:
    minus the sum over components of the distance to the component over its share of the variance.
    """

    kind = "sparse_pca"

    def __init__(self, components: PositionTable, weights: np.ndarray):
        self.components = components
        self.weights = weights

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        width: int,
        n_components: int,
        row_id: str,
        features: str = "features",
        oversample: int = 8,
        iterations: int = 6,
        weighted: bool = True,
        seed: int = 0,
        shipped_bytes: int = SHIPPED_BYTES,
    ) -> "SparsePca":
        rows, sums = position_moments(df, features)
        if rows < 2:
            raise ValueError("fewer than two training rows")
        sums = sums.withColumn("mean", F.col("total") / F.lit(float(rows)))
        spread = sums.agg(F.sum(F.col("squares") - F.col("total") * F.col("mean"))).first()[0] / (rows - 1.0)
        size = min(n_components + oversample, width)
        draws = F.array(*[uniform(F.lit(seed), F.col("at"), F.lit(j)) - 0.5 for j in range(size)])
        basis, size = cls._orthonormal(sums.select("at", "frequent", draws.alias("vector")), size)
        for step in range(iterations + 1):
            image = cls._image(df, row_id, features, rows, sums, basis, width, size, shipped_bytes)
            if step < iterations:
                last = step == iterations - 1
                basis, size = cls._orthonormal(image.select("at", "frequent", F.col("image").alias("vector")), size, 1 + last)
        values, turn = np.linalg.eigh(_gram(image, "vector", "image", size))
        order = np.argsort(values)[::-1][:n_components]
        turn = turn[:, order]
        turned = with_vector(image.select("at", "frequent", "vector"), ["vector"], "vector", lambda x: x @ turn)
        ratio = np.maximum(values[order], 0.0) / max(spread, 1e-300)
        table = PositionTable(materialize(turned, "components"), width, len(order), shipped_bytes)
        return cls(table, np.maximum(ratio, 1e-12) if weighted else np.ones(len(order)))

    @staticmethod
    def _orthonormal(table: DataFrame, size: int, times: int = 1) -> tuple[DataFrame, int]:
        """The same subspace with orthonormal columns, and their number; directions that are no more than rounding go.

        A second time mends what a poor first Gram matrix left, which matters for the last subspace only.
        """
        for _ in range(times):
            values, axes = np.linalg.eigh(_gram(table, "vector", "vector", size))
            kept = values > 1e-12 * max(values.max(), 1e-300)
            turn = axes[:, kept] / np.sqrt(values[kept])
            size = turn.shape[1]
            table = with_vector(table, ["vector"], "vector", lambda x, turn=turn: x @ turn)
            table = materialize(table, "subspace")
        return table, size

    @staticmethod
    def _image(df, row_id, features, rows, sums, basis, width, size, shipped_bytes) -> DataFrame:
        """(at, frequent, vector, image): the covariance times the subspace."""
        table = PositionTable(basis, width, size, shipped_bytes)
        projected = table.project(df.select(row_id, features), row_id, "#y", features)
        cells = projected.select(F.explode(features).alias("e"), "#y").select("e.*", "#y")
        added = cells.groupBy("at").agg(*[F.sum(F.col("value") * F.element_at("#y", j + 1)).alias(f"#s{j}") for j in range(size)])
        joined = basis.join(sums.select("at", "mean"), "at")
        centre = joined.agg(*[F.sum(F.col("mean") * F.element_at("vector", j + 1)) for j in range(size)]).first()
        image = F.array(
            *[(F.col(f"#s{j}") - F.col("mean") * F.lit(rows * float(centre[j]))) / F.lit(rows - 1.0) for j in range(size)]
        )
        return materialize(joined.join(added, "at").select("at", "frequent", "vector", image.alias("image")), "subspace")

    def transform(self, df: DataFrame, row_id: str, out: str = "score", features: str = "features") -> DataFrame:
        """Add the score; lower is more anomalous."""
        df = self.components.project(df, row_id, "#along", features)
        # components have length one
        apart = F.zip_with(
            "#along", V.vector(self.weights), lambda a, w: F.sqrt(F.greatest(_squares(features) + 1.0 - 2.0 * a, F.lit(0.0))) / w
        )
        return df.withColumn(out, -V.total(apart)).drop("#along")
