"""Gradient attributions of the autoencoder's reconstruction distance, per Arrow batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Network
from relevia.functions import vectors as V
from relevia.functions.arrow import with_vector

# Path steps, share added for positive weights, denominator floor.
PATH_STEPS = 50
GAMMA = 0.25
STABILITY = 1e-9


def saliency(df: DataFrame, network: Network, features: str = "features", out: str = "phi") -> DataFrame:
    """Signed gradient of the error with respect to each input."""
    return with_vector(df, [features], out, lambda x: network.error_and_gradient(x)[1])


def gradient_times_input(df: DataFrame, network: Network, features: str = "features", out: str = "phi") -> DataFrame:
    graded = saliency(df, network, features, "_gradient")
    return graded.withColumn(out, V.multiply(F.col("_gradient"), F.col(features))).drop("_gradient")


def path_gradients(network: Network, x: np.ndarray, reference: np.ndarray, steps: int = PATH_STEPS) -> np.ndarray:
    """Gradients averaged on the straight path from the reference (Gauss-Legendre nodes)."""
    nodes, node_weights = np.polynomial.legendre.leggauss(steps)
    average = np.zeros_like(x)
    for node, weight in zip(nodes, node_weights):
        at = (node + 1.0) / 2.0
        average += weight / 2.0 * network.error_and_gradient(reference + at * (x - reference))[1]
    return average * (x - reference)


def integrated_gradients(
    df: DataFrame,
    network: Network,
    features: str = "features",
    reference: str = "reference",
    steps: int = PATH_STEPS,
    out: str = "phi",
) -> DataFrame:
    return with_vector(df, [features, reference], out, lambda x, r: path_gradients(network, x, r, steps))


def relevance(network: Network, x: np.ndarray, gamma: float = GAMMA) -> np.ndarray:
    """Layer-wise relevance of the error.

    The distance layer hands each output the share of its squared difference. A linear
    layer hands relevance back by contribution, with its positive weights enlarged.
    """
    output, trace = network.forward(x)
    squares = (output - x) ** 2
    error = np.sqrt(squares.sum(axis=1))
    passed = squares / np.maximum(error, STABILITY)[:, None]
    for layer_input, _, norm, parts, _ in reversed(trace):
        weight, bias = parts[0], parts[1]
        if norm is not None:
            # batch norm with running statistics is linear: fold it into the layer
            centred, deviation, _ = norm
            factor = parts[2] / deviation
            mean = (layer_input @ weight.T + bias - centred * deviation)[0]
            weight, bias = weight * factor[:, None], (bias - mean) * factor + parts[3]
        weight = weight + gamma * np.maximum(weight, 0.0)
        made = layer_input @ weight.T + bias
        made = made + np.where(made >= 0, STABILITY, -STABILITY)
        passed = layer_input * ((passed / made) @ weight)
    return passed


def lrp(df: DataFrame, network: Network, features: str = "features", gamma: float = GAMMA, out: str = "phi") -> DataFrame:
    """Add the relevance and ``convergence_gap``, the part of the error it does not explain."""
    attributed = with_vector(df, [features], out, lambda x: relevance(network, x, gamma))
    with_error = with_vector(attributed, [features], "_error", network.error, scalar=True)
    return with_error.withColumn("convergence_gap", F.col("_error") - V.total(F.col(out))).drop("_error")
