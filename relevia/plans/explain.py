"""Explanation runs: choose rows, make reference points, attribute, compare with marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.explain import baselines, gradients
from relevia.explain.lime import lime
from relevia.explain.optimize import dynamic_background_shap
from relevia.explain.reference import add_reference, background_summary, kmeans_reference
from relevia.explain.shap import kernel_shap
from relevia.operators.consistency import consistency, density_histogram
from relevia.operators.explmetrics import explanation_report, orient, size_eval
from relevia.operators.groups import to_source_columns
from relevia.session import materialize
from relevia.sources.sinks import append_summary, write_explanation

PAIR_COLUMNS = ["euclid_abs", "euclid", "sign_disagreement", "feature_disagreement"]


def attribute(
    rows: DataFrame,
    detector,
    method: str,
    background: str = "zeros",
    train: DataFrame | None = None,
    seed: int = 0,
    samples: int | None = None,
    **options,
) -> DataFrame:
    """Add ``phi`` (higher is more anomalous) for rows with ``row_id`` and ``features``."""
    network = getattr(detector, "network", None)
    if method == "shap":
        if background == "kmeans":
            return kernel_shap(rows, detector, kmeans_reference(train, seed=seed), samples, seed=seed, **options)
        if background == "train":
            return kernel_shap(rows, detector, background_summary(train, seed=seed), samples, seed=seed, **options)
        if background in ("optimized", "full"):
            return dynamic_background_shap(rows, network, background, samples=samples, seed=seed, **options)
        pointed = add_reference(rows, background, train, network)
        return kernel_shap(pointed, detector, "reference", samples, seed=seed, **options).drop("reference")
    if method == "lime":
        return lime(rows, detector, train, **options)
    if method == "gradient":
        return gradients.saliency(rows, network)
    if method == "grad_input":
        return gradients.gradient_times_input(rows, network)
    if method == "intgrad":
        return gradients.integrated_gradients(add_reference(rows, background, train, network), network).drop("reference")
    if method == "lrp":
        return gradients.lrp(rows, network).drop("convergence_gap")
    if method == "reconstruction":
        return baselines.reconstruction_error(rows, detector)
    if method == "uniform_noise":
        return baselines.uniform_noise(rows, seed)
    if method == "uniform_noise_times_input":
        return baselines.noise_times_input(rows, seed)
    raise ValueError(f"unknown method {method!r}")


def explain_anomalies(
    rows: DataFrame,
    detector,
    method: str,
    background: str = "zeros",
    train: DataFrame | None = None,
    groups: Sequence[Sequence[int]] | None = None,
    out: str | None = None,
    model: str = "AE",
    **options,
) -> tuple[DataFrame, DataFrame | None]:
    """(explanations, report). ``rows`` carry ``gold`` marks when a report is wanted.

    Attributions of encoded columns are summed to source columns when ``groups`` is given.
    With ``out`` the explanations and the report row are appended there.
    """
    explained = attribute(rows, detector, method, background, train, **options)
    if groups is not None:
        explained = explained.withColumn("phi", to_source_columns(F.col("phi"), groups))
    # attribution is expensive: it runs once for report, sink and caller
    explained = materialize(explained, "explained")
    report = None
    if "gold" in rows.columns:
        report = explanation_report(explained).withColumns({"xai": F.lit(method), "variant": F.lit(background)})
    if out is not None:
        write_explanation(explained.select("row_id", "phi"), f"{out}/explanations", model, method, background)
        if report is not None:
            append_summary(report, f"{out}/summary")
    return explained, report


def compactness(explained: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return size_eval(explained, by=by)


def model_set_consistency(explanations: DataFrame, k: float = 5, bins: int = 75) -> tuple[DataFrame, DataFrame]:
    """(pair distances, histograms) of a model set with columns seed, row_id, phi, gold.

    Explanations are turned to face up as a set and brought to length 1 first.
    """
    facing_up = orient(explanations) if "gold" in explanations.columns else explanations
    pairs = consistency(facing_up, k)
    return pairs, density_histogram(pairs, PAIR_COLUMNS, bins)
