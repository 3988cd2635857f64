"""Exact order statistics and rank metrics over data of any size.

A global sort in one task does not scale, so every operator here works in three
steps: cut the value range into buckets with an approximate quantile sketch, get
each bucket's row count, then order only inside a bucket and add the count of the
buckets before it. The sketch decides how even the buckets are, never the result.
Equal scores are collapsed to one counted row first, so a score shared by a third
of the table is one row, not one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevia.functions.vectors import let
from relevia.session import materialize

MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 16
SKETCH_GROUPS = 64


def _thin(cuts: Sequence[float], rows: int) -> list[float]:
    """Keep as many of the cut points as the row count calls for."""
    wanted = max(MIN_BUCKETS, min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))
    step = max(1, len(cuts) // wanted)
    return sorted({float(c) for c in cuts[step - 1 :: step]})


def _sketch(column: Column) -> Column:
    # one text literal instead of thousands of number literals keeps the plan small
    text = ",".join(str(i / MAX_BUCKETS) for i in range(1, MAX_BUCKETS))
    return F.percentile_approx(column, F.split(F.lit(text), ",").cast("array<double>"), F.lit(MAX_BUCKETS))


def _value_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group and column ``<c>_rows``, ``<c>_low``, ``<c>_high`` and sorted ``<c>_cuts``.

    The sketches of all tasks would be too much for one task to merge, so each of up to
    ``SKETCH_GROUPS`` tasks merges a share and only their cut points are put together.
    """
    share = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    first, second = [], []
    for c in columns:
        first += [F.count(c).alias(f"{c}_rows"), F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), _sketch(F.col(c)).alias(f"{c}_cuts")]
        merged = F.array_sort(F.flatten(F.collect_list(f"{c}_cuts")))
        second += [
            F.sum(f"{c}_rows").alias(f"{c}_rows"), F.min(f"{c}_low").alias(f"{c}_low"),
            F.max(f"{c}_high").alias(f"{c}_high"), merged.alias(f"{c}_cuts"),
        ]
    shares = df.withColumn("_share", share).groupBy(*by, "_share").agg(*first)
    stats = shares.groupBy(*by).agg(*second)
    return stats.withColumns({f"{c}_cuts": _every_nth(F.col(f"{c}_cuts")) for c in columns})


def _every_nth(cuts: Column) -> Column:
    """About ``MAX_BUCKETS`` of the sorted cut points of all shares."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.size(cuts) / MAX_BUCKETS))
    return let(step, lambda n: F.filter(cuts, lambda _, i: F.pmod(i + 1, n) == 0))


def cut_points(df: DataFrame, column: str, by: Sequence[str] = ()) -> list[float]:
    """Bucket boundaries of a numeric column, fine enough inside every ``by`` group.

    ``by`` names a handful of groups (splits, model seeds), not a row key.
    """
    value = F.col(column).cast("double")
    values = df.where(value.isNotNull() & ~F.isnan(value)).select(*by, value.alias("_v"))
    merged: set[float] = set()
    for row in _value_stats(values, ["_v"], by).collect():
        if row["_v_cuts"]:
            merged.update(_thin(row["_v_cuts"], row["_v_rows"]))
    return sorted(merged)


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Add the index of the bucket that holds ``column`` (binary search in the JVM)."""
    inner = [c for c in cuts if abs(c) != float("inf")]
    if not inner:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *inner, float("inf")]
    # adding 0.0 turns -0.0 into 0.0, which the search would put in another bucket
    staged = df.withColumn("_cut_value", F.col(column).cast("double") + F.lit(0.0))
    placed = Bucketizer(splits=splits, inputCol="_cut_value", outputCol=out).transform(staged)
    return placed.withColumn(out, F.col(out).cast("int")).drop("_cut_value")


def global_index(
    df: DataFrame, order_column: str, out: str = "index", by: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position of each row in ``order_column`` order, per ``by`` group.

    The order column is numeric and unique within a group (a row id).
    """
    by = list(by)
    placed = with_bucket(df, order_column, cut_points(df, order_column, by))
    sizes = placed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(order_column)
    return (
        placed.withColumn("_number", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_number") - 1)
        .drop("_bucket", "_offset", "_number")
    )


def score_prefix(
    df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Cumulative counts per distinct score, lowest (most anomalous) score first.

    Columns: ``by``, ``score``, ``p`` and ``n`` (anomalies and rows at the score),
    ``cp`` and ``cn`` (at the score or below), ``tp`` and ``tn`` (in the group).
    """
    by = list(by)
    rows = df.select(
        *by, (F.col(score).cast("double") + F.lit(0.0)).alias("score"), F.col(y).cast("long").alias("y")
    ).where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isNotNull())
    counted = rows.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    # read three times below; written once so that the scores behind it are computed once
    counted = materialize(counted, "score-counts")
    cuts = cut_points(counted, "score", by)
    placed = with_bucket(counted, "score", cuts)
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
        .select(
            *by,
            "_bucket",
            F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("op"),
            F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("on"),
            F.sum("bp").over(whole).alias("tp"),
            F.sum("bn").over(whole).alias("tn"),
        )
    )
    running = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn("cp", F.sum("p").over(running))
        .withColumn("cn", F.sum("n").over(running))
        .join(offsets, [*by, "_bucket"])
        .select(
            *by,
            "score",
            "p",
            "n",
            (F.col("cp") + F.col("op")).alias("cp"),
            (F.col("cn") + F.col("on")).alias("cn"),
            "tp",
            "tn",
        )
    )


def _metric_columns() -> dict[str, Column]:
    """Aggregates over a ``score_prefix`` group; null where a class is missing."""
    p, n, cp, cn = (F.col(c).cast("double") for c in ("p", "n", "cp", "cn"))
    anomalies, rows = F.max("tp").cast("double"), F.max("tn").cast("double")
    normals = rows - anomalies
    normals_above = (F.col("tn") - F.col("tp")).cast("double") - (cn - cp)
    # the p anomalies of one score take consecutive ranks behind the tied normals;
    # ranks are measured from the middle of the list to keep the squares small
    middle = cn - (p - 1) / 2
    centred = middle - F.col("tn") / 2
    mean_centred = F.try_divide(F.sum(p * centred), anomalies)
    mean_square = F.try_divide(F.sum(p * centred * centred + p * (p * p - 1) / 12), anomalies)
    some_normals = F.when(normals > 0, F.lit(1.0))
    return {
        "auc_roc": F.try_divide(F.sum(p * (normals_above + (n - p) / 2)), anomalies * normals),
        "auc_pr": some_normals * F.try_divide(F.sum(p * F.try_divide(cp, cn)), anomalies),
        "rank_mean": F.try_divide(F.sum(p * middle), anomalies),
        "rank_std": F.sqrt(F.greatest(F.lit(0.0), mean_square - mean_centred * mean_centred)),
        "max_fraud": F.max(F.when(F.col("p") > 0, F.col("score"))),
        "min_detect": F.max(F.when(F.col("p") > 0, F.col("cn"))),
    }


def score_report(
    df: DataFrame,
    score: str = "score",
    y: str = "y",
    by: Sequence[str] = (),
    metrics: Sequence[str] = ("auc_roc", "auc_pr", "rank_mean", "rank_std", "max_fraud", "min_detect"),
) -> DataFrame:
    """Detector metrics per ``by`` group in one pass over the score counts.

    Lower scores are more anomalous, ``y`` is 1 for anomalies. Ranks are 1-based in
    (score, y) order, so a normal row goes before an anomaly of the same score.
    """
    columns = _metric_columns()
    return score_prefix(df, score, y, by).groupBy(*by).agg(*[columns[m].alias(m) for m in metrics])


def auc_roc(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Chance that an anomaly scores below a normal row, ties count one half."""
    return score_report(df, score, y, by, ["auc_roc"])


def auc_pr(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Average precision, from the lowest score up."""
    return score_report(df, score, y, by, ["auc_pr"])


def mean_rank(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of the anomalies' ranks."""
    return score_report(df, score, y, by, ["rank_mean", "rank_std"])


def max_rank(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Highest anomaly score, and how many rows score at or below it."""
    return score_report(df, score, y, by, ["max_fraud", "min_detect"])


RANKS_PER_PIECE = 65_536


def rank_ranges(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """The ranks of all anomalies as closed ranges, one per score that has anomalies."""
    return (
        score_prefix(df, score, y, by)
        .where(F.col("p") > 0)
        .select(*by, "score", (F.col("cn") - F.col("p") + 1).alias("first_rank"), F.col("cn").alias("last_rank"))
    )


def fraud_ranks(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """One row per anomaly with its rank; long ranges are split before they unfold."""
    pieces = rank_ranges(df, score, y, by).select(
        *by,
        "score",
        "last_rank",
        F.explode(F.sequence("first_rank", "last_rank", F.lit(RANKS_PER_PIECE))).alias("from_rank"),
    )
    return pieces.repartition(*by, "score", "from_rank").select(
        *by,
        "score",
        F.explode(
            F.sequence("from_rank", F.least(F.col("from_rank") + RANKS_PER_PIECE - 1, F.col("last_rank")))
        ).alias("rank"),
    )


def confusion(
    df: DataFrame, n_anomalies: int, score: str = "score", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """2x2 counts when the rows up to the score at 0-based rank ``n_anomalies`` are flagged."""
    reached = F.col("cn") >= n_anomalies + 1
    at = score_prefix(df, score, y, by).groupBy(*by).agg(
        F.min(F.when(reached, F.col("score"))).alias("threshold"),
        F.min(F.when(reached, F.col("cn"))).alias("flagged"),
        F.min(F.when(reached, F.col("cp"))).alias("tp"),
        F.max("tp").alias("anomalies"),
        F.max("tn").alias("total"),
    )
    return at.select(
        *by,
        "threshold",
        (F.col("total") - F.col("anomalies") - F.col("flagged") + F.col("tp")).alias("tn"),
        (F.col("flagged") - F.col("tp")).alias("fp"),
        (F.col("anomalies") - F.col("tp")).alias("fn"),
        "tp",
    )


@dataclass
class Selected:
    """A value with the number of rows below it and at or below it."""

    value: float
    below: int
    through: int


#: Cut points by which a bracket is wider than its ranks on either side: twice the sketch's own error.
SLACK = 4
#: Parts of one bracket at most, each ordered on its own.
BRACKET_PARTS = 64


class RankSelector:
    """Exact order statistics of numeric columns by 0-based rank, in two passes over the rows.

    The first pass has counts, extremes and a quantile sketch of all columns. The sketch brackets the
    wanted ranks; the second pass keeps the counted values inside brackets and only the number of
    rows between them, so that what is ordered is a few sketch steps around each rank. Nulls, and zeros
    when ``skip_zero``, are left out.

    Ranks that are known beforehand (``expect``) share the second pass. The row counts prove where a
    rank lies, so a bracket that missed its rank, as a sketch of very uneven splits may, costs one
    more pass and never a wrong value.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], skip_zero: bool = False):
        self.columns = list(columns)
        value = {
            c: F.when(F.lit(not skip_zero) | (F.col(f"`{c}`") != 0), F.col(f"`{c}`").cast("double"))
            for c in self.columns
        }
        self._wide = df.select(*[value[c].alias(f"v{i}") for i, c in enumerate(self.columns)])
        names = [f"v{i}" for i in range(len(self.columns))]
        stats = _value_stats(self._wide, names).first()
        self.count = {c: stats[f"{v}_rows"] or 0 for c, v in zip(self.columns, names)}
        self.minimum = {c: stats[f"{v}_low"] for c, v in zip(self.columns, names)}
        self.maximum = {c: stats[f"{v}_high"] for c, v in zip(self.columns, names)}
        # adding 0.0 turns -0.0 into 0.0, which is the same value
        self._sketch = {c: [x + 0.0 for x in stats[f"{v}_cuts"] or []] for c, v in zip(self.columns, names)}
        self.passes = 1
        self._borders: dict[int, list[float]] = {}
        self._kept: dict[int, set[int]] = {}
        self._sizes: dict[int, list[tuple[int, int]]] = {}
        self._values: DataFrame | None = None

    def _steps(self, column: str, low: float, high: float) -> tuple[int, int]:
        """Positions of the sketch's cut points around the ranks from low to high; -1 and its length are the ends."""
        size = len(self._sketch[column])
        scale = (size + 1) / max(1, self.count[column])
        return max(-1, int(low * scale) - 1 - SLACK), min(size, _ceil(high * scale) - 1 + SLACK)

    def neighbours(self, column: str, rank: int) -> tuple[int, int]:
        """About the fewest rows that can lie below the value at a rank, and the most at or below it."""
        sketch, rows = self._sketch[column], self.count[column]
        scale = rows / (len(sketch) + 1)
        first, last = self._steps(column, rank, rank)
        below = bisect_left(sketch, sketch[first]) - SLACK if first >= 0 else 0
        through = bisect_right(sketch, sketch[last]) + 1 + SLACK if last < len(sketch) else len(sketch) + 1
        return max(0, min(rank, int(below * scale))), min(rows, max(rank + 1, _ceil(through * scale)))

    def expect(self, ranks: Mapping[str, Sequence[tuple[float, float]]]) -> None:
        """The second pass, for ranks between each (low, high) of a column."""
        borders, kept = {}, {}
        for column, spans in ranks.items():
            c = self.columns.index(column)
            parts = [self._bracket(column, low, high) for low, high in spans]
            borders[c], kept[c] = {x for inner, _ in parts for x in inner}, [ends for _, ends in parts]
        self._count(borders, kept)

    def _bracket(self, column: str, low: float, high: float) -> tuple[list[float], tuple[float, float]]:
        """Borders of the parts of a bracket, and its ends."""
        sketch = self._sketch[column]
        first, last = self._steps(column, low, high)
        inside = sketch[max(0, first) : last + 1]
        if not inside:
            return [], (-math.inf, math.inf)
        # behind its last value a bracket ends, so that a value of very many rows is a part of its own
        end = math.nextafter(inside[-1], math.inf) + 0.0
        thin = inside[:: max(1, len(inside) // BRACKET_PARTS)]
        ends = (inside[0] if first >= 0 else -math.inf, end if last < len(sketch) else math.inf)
        return [*thin, inside[-1], end], ends

    def _count(self, borders: dict[int, set[float]], kept: dict[int, list[tuple[float, float]]]) -> None:
        """Count the rows of all parts, and of the values in parts between the ends in ``kept``."""
        wide, cells = self._wide, []
        self._borders = {c: sorted(x for x in borders[c] if math.isfinite(x)) for c in kept}
        self._kept = {}
        for c in kept:
            ends = [-math.inf, *self._borders[c], math.inf]
            self._kept[c] = {
                b for b, (x, y) in enumerate(zip(ends, ends[1:])) if any(low <= x and y <= high for low, high in kept[c])
            }
            wide = with_bucket(wide, f"v{c}", self._borders[c], f"b{c}")
            v = F.col(f"v{c}") + F.lit(0.0)
            whole = F.col(f"b{c}").isin(sorted(self._kept[c]))
            cell = F.struct(F.lit(c).alias("c"), F.col(f"b{c}").alias("b"), F.when(whole, v).alias("v"))
            cells.append(F.when(F.col(f"v{c}").isNotNull(), cell))
        if not cells:
            return
        counted = wide.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.*")
        counted = counted.groupBy("c", "b", "v").agg(F.count(F.lit(1)).alias("n"))
        self._values = materialize(counted, "brackets")
        self.passes += 1
        self._sizes = {}
        for row in self._values.groupBy("c", "b").agg(F.sum("n").alias("n")).orderBy("c", "b").collect():
            self._sizes.setdefault(row["c"], []).append((row["b"], row["n"]))

    def _place(self, ranks: Mapping[str, Sequence[int]]) -> tuple[list[tuple[int, int, int, int]], dict[str, list]]:
        """(column, part, rank, rows before the part) of each rank in a kept part, and the ranks in none."""
        wanted, missed = [], {}
        for column, column_ranks in ranks.items():
            c = self.columns.index(column)
            for rank in sorted(set(column_ranks)):
                if not 0 <= rank < self.count[column]:
                    raise ValueError(f"rank {rank} is outside column {column}")
                offset = 0
                for part, size in self._sizes.get(c, []):
                    if rank < offset + size:
                        break
                    offset += size
                else:
                    part = -1
                if part in self._kept.get(c, ()):
                    wanted.append((c, part, rank, offset))
                else:
                    missed.setdefault(column, []).append((c, part, rank))
        return wanted, missed

    def _recount(self, missed: dict[str, list]) -> None:
        """One more pass for missed ranks: their brackets, or the whole part, cut finely, where the bracket missed."""
        borders = {c: set(x) for c, x in self._borders.items()}
        kept = {}
        for c, parts in self._kept.items():
            ends = [-math.inf, *self._borders[c], math.inf]
            kept[c] = [(ends[b], ends[b + 1]) for b in parts]
        for column, places in missed.items():
            c, sketch = self.columns.index(column), self._sketch[column]
            ends = [-math.inf, *self._borders.get(c, ()), math.inf]
            for _, part, rank in places:
                if part < 0:
                    fine, whole = self._bracket(column, rank, rank)
                else:
                    whole = ends[part], ends[part + 1]
                    fine = sketch[bisect_right(sketch, whole[0]) : bisect_left(sketch, whole[1])]
                    fine = [*fine, *(math.nextafter(x, math.inf) + 0.0 for x in fine)]
                borders.setdefault(c, set()).update(fine)
                kept.setdefault(c, []).append(whole)
        self._count(borders, kept)

    def select(self, ranks: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], Selected]:
        """Values at the wanted ranks, keyed by (column, rank)."""
        wanted, missed = self._place(ranks)
        while missed:
            self._recount(missed)
            wanted, missed = self._place(ranks)
        if not wanted:
            return {}
        requests = self._wide.sparkSession.createDataFrame(wanted, "c int, b int, rank long, before long")
        asked = F.lit(False)
        for c, b in sorted({(c, b) for c, b, _, _ in wanted}):
            asked = asked | ((F.col("c") == c) & (F.col("b") == b))
        running = (
            Window.partitionBy("c", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        counted = self._values.where(asked).withColumn("through", F.sum("n").over(running))
        through = F.col("before") + F.col("through")
        found = (
            counted.join(F.broadcast(requests), ["c", "b"])
            .where((F.col("rank") >= through - F.col("n")) & (F.col("rank") < through))
            .select("c", "rank", "v", (through - F.col("n")).alias("below"), through.alias("through"))
        )
        return {
            (self.columns[r["c"]], r["rank"]): Selected(r["v"], r["below"], r["through"])
            for r in found.collect()
        }

    def percentiles(
        self, probabilities: Mapping[str, Sequence[float]], first: Mapping[str, int], size: Mapping[str, int]
    ) -> dict[str, list[float]]:
        """Linearly interpolated percentiles of the ``size`` values from rank ``first`` on."""
        places = {
            c: [first[c] + (size[c] - 1) * p for p in ps] for c, ps in probabilities.items() if size[c] > 0
        }
        values = self.select({c: [r for h in hs for r in {int(h), _ceil(h)}] for c, hs in places.items()})
        return {
            c: [
                values[c, int(h)].value + (values[c, _ceil(h)].value - values[c, int(h)].value) * (h - int(h))
                for h in hs
            ]
            for c, hs in places.items()
        }


def _ceil(h: float) -> int:
    return math.ceil(h)
