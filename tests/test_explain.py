import itertools
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Autoencoder, Network
from relevia.detectors.base import CentroidDetector
from relevia.explain import gradients
from relevia.explain.baselines import noise_times_input, reconstruction_error, uniform_noise
from relevia.explain.lime import lime
from relevia.explain.optimize import (
    Objective, adam_descent, descent_reference, dynamic_background_shap, line_search_descent, optimum_reference,
)
from relevia.explain.reference import add_reference, background_summary, kmeans_reference
from relevia.explain.shap import (
    Coalitions, all_masks, coalition_plan, default_samples, kernel_shap, shap_batch, shap_exact, shapley_coefficients,
)
from relevia.functions import vectors as V


# the scorers below are defined here, where executors cannot import them from
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Product(CentroidDetector):
    """A scorer with interactions, for checks against brute force."""

    def score_batch(self, x):
        return -(x[:, 0] * x[:, 1] + np.abs(x).sum(axis=1) ** 1.5)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    x[3, 2] = 0.0
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").cache(), x


@pytest.fixture(scope="module")
def network(data):
    return Autoencoder.fit(data[0], n_layers=2, n_bottleneck=2, epochs=5, batch_size=16).network


def phis(df):
    return np.array([r["phi"] for r in df.orderBy("row_id").collect()])


def brute_shapley(f, x, references, weights):
    width = len(x)

    def value(kept):
        mixed = references.copy()
        mixed[:, list(kept)] = x[list(kept)]
        return weights @ f(mixed)

    phi = np.zeros(width)
    for j in range(width):
        others = [i for i in range(width) if i != j]
        for size in range(width):
            factor = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for kept in itertools.combinations(others, size):
                phi[j] += factor * (value((*kept, j)) - value(kept))
    return phi


def test_exact_shapley(spark, data):
    df, x = data
    detector = Product(np.zeros(5))
    references = np.random.default_rng(1).normal(size=(3, 5))
    weights = np.array([0.5, 0.3, 0.2])
    found = kernel_shap(df, detector, (references, weights))
    expected = np.array([brute_shapley(lambda m: -detector.score_batch(m), row, references, weights) for row in x])
    assert np.allclose(phis(found), expected)
    total = found.select("row_id", (F.col("expected_value") + V.total(F.col("phi"))).alias("t")).orderBy("row_id")
    assert np.allclose([r["t"] for r in total.collect()], -detector.score_batch(x))
    centre = CentroidDetector(np.full(5, 0.3))
    by_expression = shap_exact(df, centre.expression, 5, references.tolist(), weights)
    assert np.allclose(phis(by_expression), phis(kernel_shap(df, centre, (references, weights))))


def test_unchanged_columns_get_zero(spark, data):
    df, x = data
    found = phis(kernel_shap(add_reference(df, "zeros"), Product(np.zeros(5))))
    assert found[3, 2] == 0.0
    same = df.withColumn("reference", F.col("features"))
    assert not phis(kernel_shap(same, Product(np.zeros(5)))).any()
    one = df.withColumn("reference", F.transform("features", lambda v, i: F.when(i == 1, 0.0).otherwise(v)))
    moved = phis(kernel_shap(one, Product(np.zeros(5))))
    assert not moved[:, [0, 2, 3, 4]].any()


def test_coalition_plan():
    for width in (2, 3, 5, 8):
        masks, weights = coalition_plan(width)
        assert len(masks) == 2**width - 2 == len({m.tobytes() for m in masks})
        assert weights.sum() == pytest.approx(1.0)
        assert np.allclose(shapley_coefficients(width).sum(axis=0)[[0, -1]], [-1.0, 1.0])
    masks, weights = coalition_plan(14, samples=200, seed=3)
    assert len(masks) <= 200 and weights.sum() == pytest.approx(1.0)
    sizes = masks.sum(axis=1)
    assert (sizes == 1).sum() == 14 and (sizes == 13).sum() == 14
    again, _ = coalition_plan(14, samples=200, seed=3)
    assert np.array_equal(masks, again)
    assert default_samples(10) == 1022 and default_samples(40) == 2128


@pytest.mark.parametrize("width", range(12, 21))
@pytest.mark.parametrize("samples", [None, 60, 700])
def test_every_size_has_its_kernel_weight(width, samples):
    masks, weights = coalition_plan(width, samples, seed=1)
    size = masks.sum(axis=1).astype(int)
    kernel = np.array([1 / (s * (width - s)) for s in range(1, width)])
    got = np.bincount(size, weights=weights, minlength=width)[1:width]
    assert got == pytest.approx(kernel / kernel.sum())
    assert len({m.tobytes() for m in masks}) == len(masks) <= max(samples or 10**6, 2 * (width // 2))
    # every mask comes with its complement, so each column is in half of the weight
    assert weights @ masks == pytest.approx(np.full(width, 0.5))


def test_sampled_shapley_against_all_masks():
    rng = np.random.default_rng(7)
    x, width = rng.normal(size=(5, 12)), 12
    coefficients, every = shapley_coefficients(width), all_masks(width)
    score = lambda v: np.tanh(v[..., :6].sum(axis=-1)) + v[..., 6] * v[..., 7] + v[..., 8:].sum(axis=-1)
    exact = np.array([coefficients @ score(every * row) for row in x])
    errors = []
    for seed in range(20):
        found, _ = shap_batch(lambda v: -score(v), x, np.zeros((5, 1, 12)), np.ones(1), Coalitions(800, seed))
        assert found.sum(axis=1) == pytest.approx(exact.sum(axis=1))
        errors.append(found - exact)
    assert np.abs(np.mean(errors, axis=0)).max() < 0.02
    assert np.abs(errors).max() < 0.15


def test_sampled_shapley(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 14))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    pointed = add_reference(df, "zeros")
    exact = phis(kernel_shap(pointed, Product(np.zeros(14))))
    sampled = kernel_shap(pointed, Product(np.zeros(14)), samples=1500, seed=1)
    assert np.abs(phis(sampled) - exact).max() < 0.25 * np.abs(exact).max()
    assert np.allclose(phis(sampled).sum(axis=1), exact.sum(axis=1))
    chosen = phis(kernel_shap(pointed, Product(np.zeros(14)), top_features=4))
    assert ((chosen != 0).sum(axis=1) == 4).all()
    assert np.allclose(chosen.sum(axis=1), exact.sum(axis=1))


def test_lime_finds_what_matters(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")

    class OneColumn(CentroidDetector):
        def score_batch(self, rows):
            return -10.0 * (rows[:, 2] == 2.0)

    found = phis(lime(df, OneColumn(np.zeros(4)), df, samples=400))
    hit = x[:, 2] == 2.0
    assert (found[hit, 2] > 5).all() and np.abs(np.delete(found, 2, axis=1)).max() < 2.0
    assert np.array_equal(found, phis(lime(df.repartition(6), OneColumn(np.zeros(4)), df, samples=400)))


def test_saliency_by_differences(spark, data, network):
    df, x = data
    found = phis(gradients.saliency(df, network))
    for j in range(5):
        step = np.zeros(5)
        step[j] = 1e-6
        assert np.allclose(found[:, j], (network.error(x + step) - network.error(x - step)) / 2e-6, atol=1e-4)
    assert np.allclose(phis(gradients.gradient_times_input(df, network)), found * x)


def test_gradient_with_batch_norm():
    network = Network(4, 2, 2, batch_norm=True, seed=1)
    x = np.random.default_rng(0).normal(size=(30, 4))
    for _ in range(20):
        network.loss_and_gradient(x)
    _, gradient = network.error_and_gradient(x)
    step = np.array([0, 1e-6, 0, 0])
    assert np.allclose(gradient[:, 1], (network.error(x + step) - network.error(x - step)) / 2e-6, atol=1e-4)


def test_integrated_gradients_add_up(spark, data, network):
    df, x = data
    found = phis(gradients.integrated_gradients(add_reference(df, "zeros"), network, steps=200))
    gap = network.error(x) - network.error(np.zeros((1, 5)))
    assert np.abs(found.sum(axis=1) - gap).max() < 0.05


def test_relevance_is_conserved_without_biases(spark, data):
    df, x = data
    network = Network(5, 1, 3, seed=2)
    network.weights = [w if w.ndim == 2 else np.zeros_like(w) for w in network.weights]
    rows = gradients.lrp(df, network).orderBy("row_id").collect()
    out, trace = network.forward(x)
    alive = np.array([all((layer[1][i] != 0).any() for layer in trace) for i in range(len(x))])
    gaps = np.array([r["convergence_gap"] for r in rows])
    assert np.abs(gaps[alive]).max() < 1e-4
    assert all(len(r["phi"]) == 5 for r in rows)


def test_line_search_lowers_the_objective(spark, data, network):
    df, x = data
    rows = np.arange(len(x))
    keep = np.zeros(x.shape, dtype=bool)
    keep[:, 1] = True
    objective = Objective(network, x)
    found = line_search_descent(objective, keep)
    before, after = objective(x, rows)[0], objective(found, rows)[0]
    assert (after <= before).all() and after.mean() < 0.5 * before.mean()
    assert np.array_equal(found[:, 1], x[:, 1])
    frame = optimum_reference(df, network, keep=[1]).orderBy("row_id").collect()
    assert np.allclose([r["reference"] for r in frame], found)


def test_threshold_and_avoided_points(network, data):
    _, x = data
    high = Objective(network, x, threshold=1e9)
    assert np.allclose(line_search_descent(high, np.zeros(x.shape, bool)), x)
    near = x + 1e-3
    pushed = Objective(network, x, threshold=1e9, avoid=near[:1], diversity=10.0, radius=0.5)
    moved = line_search_descent(pushed, np.zeros(x.shape, bool))
    assert np.linalg.norm(moved[0] - near[0]) > 0.4
    value, gradient = Objective(network, x, avoid=near[:2])(x + 0.1, np.arange(len(x)))
    assert np.isfinite(value).all() and np.isfinite(gradient).all()


def test_adam_descent(spark, data, network):
    df, x = data
    objective = Objective(network, x)
    found = adam_descent(objective, np.zeros(x.shape, bool), steps=300, rate=0.02)
    rows = np.arange(len(x))
    assert objective(found, rows)[0].mean() < objective(x, rows)[0].mean()
    frame = descent_reference(df, network, steps=20, keep=[0]).orderBy("row_id").collect()
    assert np.allclose([r["reference"][0] for r in frame], x[:, 0])
    with pytest.raises(ValueError):
        descent_reference(df, network, distance="l2")


@pytest.mark.parametrize("background", ["optimized", "full"])
def test_dynamic_backgrounds_add_up(spark, data, network, background):
    df, x = data
    rows = dynamic_background_shap(df, network, background, steps=10).orderBy("row_id").collect()
    sums = [sum(r["phi"]) + r["expected_value"] for r in rows]
    assert np.allclose(sums, network.error(x))


def test_backgrounds(spark, data, network):
    df, x = data
    mean = add_reference(df, "mean", df).first()["reference"]
    assert np.allclose(mean, x.mean(axis=0))
    nearest = add_reference(df, "NN", df).orderBy("row_id").collect()
    assert np.allclose([r["reference"] for r in nearest], x)
    assert len(add_reference(df, "single_optimum", network=network).first()["reference"]) == 5
    with pytest.raises(ValueError):
        add_reference(df, "other")
    centres, weights = kmeans_reference(df, k=3)
    assert centres.shape == (3, 5) and weights.sum() == pytest.approx(1.0)
    points, shares = background_summary(df)
    assert points.shape == (40, 5) and shares.sum() == pytest.approx(1.0)
    many = df.unionByName(df).unionByName(df)
    assert background_summary(many)[0].shape[0] <= 20


def test_baselines(spark, data):
    df, x = data
    detector = CentroidDetector(np.ones(5))
    assert np.allclose(phis(reconstruction_error(df, detector)), (1 - x) ** 2)
    noise = phis(uniform_noise(df, seed=4))
    assert (np.abs(noise) <= 1).all() and abs(noise.mean()) < 0.2
    assert np.array_equal(noise, phis(uniform_noise(df.repartition(5), seed=4)))
    assert np.allclose(phis(noise_times_input(df, seed=4)), noise * x)


def test_plans_are_kept_per_width():
    coalitions = Coalitions()
    assert coalitions.plan(4) is coalitions.plan(4)


def test_the_network_sees_few_rows_at_a_time(monkeypatch):
    """However many points a search moves, a pass of the network holds the layers of few of them."""
    network, seen, whole = Network(4, 1, 2, seed=3), [], Network.forward
    monkeypatch.setattr(Network, "forward", lambda self, x, *a, **o: (seen.append(len(x)), whole(self, x, *a, **o))[1])
    x = np.random.default_rng(1).normal(size=(3_000, 4))
    error, gradient = network.error_and_gradient(x)
    found = line_search_descent(Objective(network, x), np.zeros(x.shape, bool), steps=5)
    assert np.allclose(network.error(x), error) and max(seen) <= 1_024
    alone = [network.error_and_gradient(row[None, :]) for row in x[::100]]
    assert np.allclose([e[0] for e, _ in alone], error[::100])
    assert np.allclose([g[0] for _, g in alone], gradient[::100])
    assert np.allclose(found[::100], line_search_descent(Objective(network, x[::100]), np.zeros((30, 4), bool), steps=5))


@pytest.mark.parametrize("options", [{}, {"threshold": 0.5}, {"radius": 1.0}, {"radius": None}])
def test_failed_steps_get_no_gradient(data, network, options):
    _, x = data
    avoid = x[:2] + 0.5 if "radius" in options else None
    objective, rows = Objective(network, x, avoid=avoid, **options), np.arange(len(x))
    value, gradient = objective(x + 0.1, rows)
    below = np.where(rows % 3 == 0, value, value + 1.0)
    some_value, some_gradient = objective(x + 0.1, rows, below)
    assert np.allclose(some_value, value)
    assert np.isnan(some_gradient[::3]).all()
    assert np.allclose(some_gradient[rows % 3 > 0], gradient[rows % 3 > 0])
