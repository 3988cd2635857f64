"""Agreement of attributions with expert marks, and compactness, per row and per run.

Row metrics are expressions on two arrays (attributions and 0/1 marks), so they need
no shuffle; only the summary per run aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.functions import vectors as V


def _marked(phi: Column, gold: Column, mark: int) -> Column:
    return F.filter(phi, lambda v, i: F.get(gold, i) == mark)


def _with_both(phi: Column, gold: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` on the values of the marked and of the unmarked fields."""
    return V.let(_marked(phi, gold, 1), lambda marked: V.let(_marked(phi, gold, 0), lambda rest: body(marked, rest)))


def row_auc_roc(phi: Column, gold: Column) -> Column:
    """Chance that a marked field outranks an unmarked one; null without both kinds."""

    def share(marked: Column, rest: Column) -> Column:
        wins = F.aggregate(
            marked,
            F.lit(0.0),
            lambda acc, v: acc
            + F.size(F.filter(rest, lambda r: r < v))
            + F.size(F.filter(rest, lambda r: r == v)) * 0.5,
        )
        return F.try_divide(wins, (F.size(marked) * F.size(rest)).cast("double"))

    return _with_both(phi, gold, share)


def row_auc_pr(phi: Column, gold: Column) -> Column:
    """Average precision of the marked fields; null without both kinds."""

    def average(marked: Column, rest: Column) -> Column:
        def precision(v: Column) -> Column:
            return V.let(
                F.size(F.filter(marked, lambda m: m >= v)),
                lambda hits: hits / (hits + F.size(F.filter(rest, lambda r: r >= v))),
            )

        precisions = F.aggregate(marked, F.lit(0.0), lambda acc, v: acc + precision(v))
        return F.when(F.size(rest) > 0, F.try_divide(precisions, F.size(marked).cast("double")))

    return _with_both(phi, gold, average)


def row_pearson(phi: Column, gold: Column) -> Column:
    """Correlation of marks and attributions; null when either is constant."""
    size = F.size(phi).cast("double")

    def centred(v: Column) -> Column:
        return V.let(V.total(v) / size, lambda mean: F.transform(v, lambda x: x - mean))

    def correlation(a: Column, b: Column) -> Column:
        return F.try_divide(V.dot(a, b), V.l2_norm(a) * V.l2_norm(b))

    marks = F.transform(gold, lambda x: x.cast("double"))
    return V.let(centred(phi), lambda a: V.let(centred(marks), lambda b: correlation(a, b)))


def row_cosine(phi: Column, gold: Column) -> Column:
    """Cosine of marks and attributions; 0 when either is a zero vector."""
    marks = F.transform(gold, lambda x: x.cast("double"))
    return F.coalesce(F.try_divide(V.dot(phi, marks), V.l2_norm(phi) * V.l2_norm(marks)), F.lit(0.0))


def _weights(phi: Column, absolute: bool) -> Column:
    return V.absolute(phi) if absolute else V.positive_part(phi)


def gini_index(phi: Column, absolute: bool = False) -> Column:
    """Gini index of the positive (or absolute) attributions; 0 for a zero row."""
    size = F.size(phi)

    def index(values: Column) -> Column:
        ranked = F.transform(values, lambda v, i: (size - i - 0.5) * v)
        return F.lit(1.0) - F.try_divide(2.0 * V.total(ranked), size * V.total(values))

    return F.coalesce(V.let(F.array_sort(_weights(phi, absolute)), index), F.lit(0.0))


def distraction_weight(phi: Column, gold: Column, absolute: bool = False) -> Column:
    """Share of the positive (or absolute) attribution on unmarked fields; 0 for a zero row."""
    values = _weights(phi, absolute)
    unmarked = F.zip_with(values, gold, lambda v, g: v * (1 - g))
    return F.coalesce(F.try_divide(V.total(unmarked), V.total(values)), F.lit(0.0))


def with_row_metrics(df: DataFrame, phi: str = "phi", gold: str = "gold") -> DataFrame:
    a, g = F.col(phi), F.col(gold)
    return df.withColumns(
        {
            "roc": row_auc_roc(a, g),
            "pr": row_auc_pr(a, g),
            "pearson": row_pearson(a, g),
            "cosine": row_cosine(a, g),
        }
    )


def _mean_std(columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return out


def _compactness(phi: Column, gold: Column) -> dict[str, Column]:
    return {
        "gini": gini_index(phi),
        "gini_abs": gini_index(phi, absolute=True),
        "dist": distraction_weight(phi, gold),
        "dist_abs": distraction_weight(phi, gold, absolute=True),
    }


def explanation_report(
    df: DataFrame, phi: str = "phi", gold: str = "gold", by: Sequence[str] = (), compactness: bool = False
) -> DataFrame:
    """Mean and population deviation of the row metrics per run, with row counts.

    Rows whose marks are all set or all clear have no ROC and are left out of its mean.
    ``compactness`` adds Gini and distraction in the same pass, for runs that face up.
    """
    measured = with_row_metrics(df, phi, gold)
    names = ["roc", "pr", "pearson", "cosine"]
    if compactness:
        extra = _compactness(F.col(phi), F.col(gold))
        measured, names = measured.withColumns(extra), names + list(extra)
    return (
        measured.groupBy(*by)
        .agg(
            *_mean_std(names),
            F.count(F.lit(1)).alias("rows"),
            F.count("roc").alias("rows_with_roc"),
        )
    )


def mean_row_roc(df: DataFrame, phi: str = "phi", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(row_auc_roc(F.col(phi), F.col(gold))).alias("roc_mean"))


MAX_RUNS = 100_000


def orient(df: DataFrame, phi: str = "phi", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """Flip the sign of every run whose mean ROC is below one half."""
    means = mean_row_roc(df, phi, gold, by)
    rows = means.take(MAX_RUNS + 1)
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs")
    known = F.broadcast(df.sparkSession.createDataFrame(rows, means.schema))
    joined = df.join(known, list(by)) if by else df.withColumn("roc_mean", F.lit(rows[0]["roc_mean"]))
    sign = F.when(F.col("roc_mean") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    return joined.withColumn(phi, V.scale(F.col(phi), sign)).drop("roc_mean")


def size_eval(df: DataFrame, phi: str = "phi", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """Compactness per run: ROC, cosine, Gini and distraction after orientation.

    Both signs are measured in one pass and the one with the better mean ROC is
    reported, so the orientation needs no second scan.
    """
    gold_column = F.col(gold)
    names = ["roc", "cos", "gini", "gini_abs", "dist", "dist_abs"]
    measured = df
    for sign in ("up", "down"):
        values = F.col(phi) if sign == "up" else F.transform(phi, lambda x: -x)
        columns = {
            "roc": row_auc_roc(values, gold_column),
            "cos": row_cosine(values, gold_column),
            **_compactness(values, gold_column),
        }
        measured = measured.withColumns({f"{name}_{sign}": column for name, column in columns.items()})
    summary = measured.groupBy(*by).agg(*_mean_std([f"{n}_{s}" for n in names for s in ("up", "down")]))
    keep = F.col("roc_up_mean") >= 0.5
    chosen = [
        F.when(keep, F.col(f"{n}_up_{stat}")).otherwise(F.col(f"{n}_down_{stat}")).alias(f"{n}_{stat}")
        for n in names
        for stat in ("mean", "std")
    ]
    return summary.select(*by, *chosen)


def model_set_summary(
    df: DataFrame,
    subset: Sequence[int] | None = None,
    phi: str = "phi",
    gold: str = "gold",
    by: Sequence[str] = (),
) -> DataFrame:
    """Over the seeds of a model set: seeds with mean ROC from 0.5 and below, ROC and cosine spread.

    ``type`` is ``large`` for all seeds and ``small`` for the chosen subset.
    """
    per_seed = df.groupBy(*by, "seed").agg(
        F.avg(row_auc_roc(F.col(phi), F.col(gold))).alias("roc"),
        F.avg(row_cosine(F.col(phi), F.col(gold))).alias("cos"),
    )
    member = F.array(
        F.lit("large"),
        F.when(F.col("seed").isin(list(subset)), F.lit("small")) if subset is not None else F.lit(None),
    )
    return (
        per_seed.withColumn("type", F.explode(F.array_compact(member)))
        .groupBy(*by, "type")
        .agg(
            F.count_if(F.col("roc") >= 0.5).alias("gte_half"),
            F.count_if(F.col("roc") < 0.5).alias("lt_half"),
            *_mean_std(["roc", "cos"]),
        )
    )


def checked_rows(explanations: DataFrame, gold: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Explanations of the marked rows; fails when a marked row has none, or not as many entries as marks."""
    marks = gold.groupBy(row_id).agg(F.count(F.lit(1)).alias("_marks"))
    entries = explanations.groupBy(row_id).agg(F.count(F.lit(1)).alias("_entries"))
    found = marks.join(entries, row_id, "left").agg(
        F.count_if(F.col("_entries").isNull()).alias("missing"),
        F.count_if(F.col("_entries") != F.col("_marks")).alias("uneven"),
    ).first()
    if found["missing"]:
        raise ValueError(f"{found['missing']} marked rows have no explanation")
    if found["uneven"]:
        raise ValueError(f"{found['uneven']} marked rows have more or fewer entries than marks")
    return explanations.join(marks.select(row_id), row_id, "left_semi")


def to_vectors(
    long: DataFrame, features: Sequence[str], value: str, keys: Sequence[str], out: str
) -> DataFrame:
    """Gather a long (keys, feature, value) table into one array per key, in feature order."""
    order = F.array(*[F.lit(f) for f in features])
    picked = F.map_from_entries(F.collect_list(F.struct("feature", value)))
    return (
        long.where(F.col("feature").isin(list(features)))
        .groupBy(*keys)
        .agg(picked.alias("_by_name"))
        .select(*keys, F.transform(order, lambda f: F.element_at("_by_name", f)).alias(out))
    )


def to_long(df: DataFrame, features: Sequence[str], vector: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Spread an array into (keys, feature, value) rows."""
    names = F.array(*[F.lit(f) for f in features])
    return df.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), F.col(vector).alias(value))).alias("e")).select(
        *keys, F.col("e.feature").alias("feature"), F.col(f"e.{value}").alias(value)
    )


def join_gold(explanations: DataFrame, gold: DataFrame) -> DataFrame:
    """Align long explanations with long marks by row and feature."""
    return explanations.join(gold, ["row_id", "feature"])
