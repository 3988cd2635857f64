"""Autoencoder: symmetric ReLU network trained data-parallel, one pass per epoch.

Every task trains on its own rows with Adam, and the weights are averaged after each
epoch, weighted by rows (parameter averaging). Which task holds a row and in which order
it sees it depends on the row id's hash, so models of a set differ by their seeds only.
With one worker this is plain mini-batch training.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.detectors.base import Detector
from relevia.functions.arrow import lists, matrix, sum_vectors, with_vector

# Added to each difference in the distance, batch norm and Adam defaults.
DISTANCE_EPS = 1e-6
NORM_EPS = 1e-5
NORM_MOMENTUM = 0.1
ADAM_BETA1, ADAM_BETA2, ADAM_EPS = 0.9, 0.999, 1e-8
DATA_ORDER_SEED = 42
SHARD_ROWS = 100_000
#: Rows that pass the network together outside training: their layers stay in a core's cache.
CACHED_ROWS = 256


class Network:
    """Weights and the forward and backward passes, on matrices of rows."""

    def __init__(self, n_inputs: int, n_layers: int = 3, n_bottleneck: int = 8, batch_norm: bool = False, seed: int = 0):
        self.shape = {
            "n_inputs": n_inputs, "n_layers": n_layers, "n_bottleneck": n_bottleneck, "batch_norm": batch_norm
        }
        wide = [n_bottleneck * 2**i for i in range(n_layers, 0, -1)]
        sizes = [n_inputs, *wide, n_bottleneck, *wide[::-1], n_inputs]
        self.bottleneck = n_layers
        self.rectified = [i not in (n_layers, len(sizes) - 2) for i in range(len(sizes) - 1)]
        self.normalized = [batch_norm and i < n_layers for i in range(len(sizes) - 1)]
        rng = np.random.default_rng(seed)
        self.weights: list[np.ndarray] = []
        for i, (fan_in, fan_out) in enumerate(zip(sizes, sizes[1:])):
            bound = 1.0 / np.sqrt(fan_in)
            self.weights += [rng.uniform(-bound, bound, (fan_out, fan_in)), rng.uniform(-bound, bound, fan_out)]
            if self.normalized[i]:
                self.weights += [np.ones(fan_out), np.zeros(fan_out)]
        self.running = [
            v for i, n in enumerate(sizes[1:]) if self.normalized[i] for v in (np.zeros(n), np.ones(n))
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def running_flat(self) -> np.ndarray:
        return np.concatenate(self.running) if self.running else np.zeros(0)

    def load(self, flat: np.ndarray, running: np.ndarray | None = None) -> "Network":
        for store, source in ((self.weights, flat), (self.running, running)):
            if source is None:
                continue
            at = 0
            for i, w in enumerate(store):
                store[i] = np.asarray(source[at : at + w.size]).reshape(w.shape)
                at += w.size
        return self

    def _layers(self) -> Iterator[tuple]:
        at, run = 0, 0
        for rectified, normalized in zip(self.rectified, self.normalized):
            if normalized:
                yield rectified, self.weights[at : at + 4], (run, run + 1)
                at, run = at + 4, run + 2
            else:
                yield rectified, self.weights[at : at + 2], None
                at += 2

    def forward(self, x: np.ndarray, training: bool = False, layers: int | None = None) -> tuple[np.ndarray, list]:
        """Output, and what the backward pass needs of each layer."""
        trace = []
        for number, (rectified, parts, slots) in enumerate(self._layers()):
            if layers is not None and number >= layers:
                break
            a = x @ parts[0].T
            a += parts[1]
            norm = None
            if slots is not None:
                if training:
                    mean, var = a.mean(axis=0), a.var(axis=0)
                    unbiased = var * len(a) / max(len(a) - 1, 1)
                    for slot, now in zip(slots, (mean, unbiased)):
                        self.running[slot] = (1 - NORM_MOMENTUM) * self.running[slot] + NORM_MOMENTUM * now
                else:
                    mean, var = self.running[slots[0]], self.running[slots[1]]
                deviation = np.sqrt(var + NORM_EPS)
                centred = (a - mean) / deviation
                norm = (centred, deviation, training)
                a = parts[2] * centred + parts[3]
            if rectified:
                np.maximum(a, 0.0, out=a)
            trace.append((x, a, norm, parts, rectified))
            x = a
        return x, trace

    @staticmethod
    def _backward(trace: list, up: np.ndarray, with_weights: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradient at the input, and at the weights in storage order."""
        collected = []
        for x, a, norm, parts, rectified in reversed(trace):
            if rectified:
                up = up * (a > 0)
            own = []
            if norm is not None:
                centred, deviation, training = norm
                own = [(up * centred).sum(axis=0), up.sum(axis=0)]
                up = up * parts[2]
                if training:
                    up = (up - up.mean(axis=0) - centred * (up * centred).mean(axis=0)) / deviation
                else:
                    up = up / deviation
            if with_weights:
                collected.append([up.T @ x, up.sum(axis=0), *own])
            up = up @ parts[0]
        return up, [g for layer in reversed(collected) for g in layer]

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def embed(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, layers=self.bottleneck + 1)[0]

    def error(self, x: np.ndarray) -> np.ndarray:
        """Reconstruction distance per row; higher is more anomalous."""
        parts = [self._distance(x[i : i + CACHED_ROWS])[0] for i in range(0, len(x), CACHED_ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _distance(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Reconstruction distance, the differences behind it and the trace, of few rows."""
        out, trace = self.forward(x)
        difference = out - x + DISTANCE_EPS
        return np.sqrt((difference**2).sum(axis=1)), difference, trace

    def error_and_gradient(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reconstruction distance and its gradient with respect to the input."""
        if not len(x):
            return np.zeros(0), np.zeros(x.shape)
        parts = [self.measured(x[i : i + CACHED_ROWS]) for i in range(0, len(x), CACHED_ROWS)]
        return np.concatenate([error for error, _ in parts]), np.concatenate([gradient() for _, gradient in parts])

    def measured(self, x: np.ndarray) -> tuple[np.ndarray, Callable[..., np.ndarray]]:
        """Reconstruction distance of few rows, and a function for its gradient at all or some (indices) of them."""
        error, difference, trace = self._distance(x)
        # signs are all that the way back needs, so its rows can be chosen
        signs = [(a > 0 if rectified else None, norm, parts) for _, a, norm, parts, rectified in trace]

        def gradient(rows: np.ndarray | slice = slice(None)) -> np.ndarray:
            direction = difference[rows] / np.maximum(error[rows], 1e-300)[:, None]
            up = direction
            for on, norm, parts in reversed(signs):
                if on is not None:
                    up = up * on[rows]
                if norm is not None:
                    up = up * parts[2] / norm[1]
                up = up @ parts[0]
            return up - direction

        return error, gradient

    def loss_and_gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean reconstruction distance of a training batch and its weight gradient."""
        out, trace = self.forward(x, training=True)
        difference = out - x + DISTANCE_EPS
        error = np.sqrt((difference**2).sum(axis=1))
        up = difference / np.maximum(error, 1e-300)[:, None] / len(x)
        _, gradients = self._backward(trace, up, with_weights=True)
        return float(error.mean()), np.concatenate([g.ravel() for g in gradients])


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate = rate
        self.first, self.second, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = ADAM_BETA1 * self.first + (1 - ADAM_BETA1) * gradient
        self.second = ADAM_BETA2 * self.second + (1 - ADAM_BETA2) * gradient**2
        m = self.first / (1 - ADAM_BETA1**self.steps)
        v = self.second / (1 - ADAM_BETA2**self.steps)
        return values - self.rate * m / (np.sqrt(v) + ADAM_EPS)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Regroup Arrow batches to training batches of ``size`` rows; the last may be short."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(matrix(batch.column(0)))
        rows += batch.num_rows
        while rows >= size:
            block = np.concatenate(held)
            yield block[:size]
            held, rows = [block[size:]], len(block) - size
    if rows:
        yield np.concatenate(held)


class Autoencoder(Detector):
    kind = "autoencoder"

    def __init__(self, network: Network, history: Sequence[float] = ()):
        self.network = network
        self.history = list(history)

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        return -self.network.error(x)

    def reconstruct_batch(self, x: np.ndarray) -> np.ndarray:
        return self.network.reconstruct(x)

    def reconstruct(self, df: DataFrame, features: str = "features", out: str = "reconstruction") -> DataFrame:
        return with_vector(df, [features], out, self.network.reconstruct)

    def embed(self, df: DataFrame, features: str = "features", out: str = "embedding") -> DataFrame:
        return with_vector(df, [features], out, self.network.embed)

    def test(self, df: DataFrame, features: str = "features", out: str = "error") -> DataFrame:
        """The error itself: higher is more anomalous."""
        return with_vector(df, [features], out, self.network.error, scalar=True)

    @classmethod
    def fit(cls, df: DataFrame, seed: int = 0, **options) -> "Autoencoder":
        return fit_model_set(df, [seed], **options)[0]

    def params(self) -> dict:
        return {**self.network.shape, "history": self.history}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"weights": self.network.flat(), "running": self.network.running_flat()}

    @classmethod
    def restore(cls, params, arrays):
        params = dict(params)
        history = params.pop("history")
        return cls(Network(**params).load(arrays["weights"], arrays.get("running")), history)


def fit_model_set(
    df: DataFrame,
    seeds: Sequence[int],
    features: str = "features",
    row_id: str = "row_id",
    n_layers: int = 2,
    n_bottleneck: int = 32,
    batch_norm: bool = False,
    epochs: int = 50,
    batch_size: int = 2048,
    learning_rate: float = 1e-2,
    shard_rows: int = SHARD_ROWS,
) -> list[Autoencoder]:
    """One autoencoder per seed, all trained in the same passes over the data.

    The seeds change the initial weights only; data order and placement are the same. Rows are
    dealt by a hash into shards of about ``shard_rows``, each trained on its own within an epoch, so the
    models follow from the rows and not from the size of the cluster.
    """
    shape = {"n_layers": n_layers, "n_bottleneck": n_bottleneck, "batch_norm": batch_norm}
    specs = [{**shape, "epochs": epochs, "learning_rate": learning_rate, "seed": seed} for seed in seeds]
    return fit_networks(df, specs, features, row_id, batch_size, shard_rows)


def fit_networks(
    df: DataFrame,
    specs: Sequence[Mapping],
    features: str = "features",
    row_id: str = "row_id",
    batch_size: int = 2048,
    shard_rows: int = SHARD_ROWS,
) -> list[Autoencoder]:
    """One autoencoder per choice of shape, epochs, learning rate and seed, all trained in the same passes.

    There are as many passes as the longest training has epochs; a model that is done rests.
    """
    spark = df.sparkSession
    specs = [{"n_layers": 2, "n_bottleneck": 32, "batch_norm": False, "epochs": 50, "learning_rate": 1e-2, "seed": 0, **s} for s in specs]
    shards = max(1, math.ceil(df.count() / shard_rows))
    data = (
        df.select(features, F.xxhash64(F.col(row_id), F.lit(DATA_ORDER_SEED)).alias("_order"))
        .repartition(shards, "_order")
        .sortWithinPartitions("_order")
        .persist()
    )
    try:
        first = data.first()
        if first is None:
            raise ValueError("no training rows")
        width = len(first[0])

        def network(spec: Mapping) -> Network:
            return Network(width, spec["n_layers"], spec["n_bottleneck"], spec["batch_norm"], spec["seed"])

        networks = [network(spec) for spec in specs]
        sizes = [(n.flat().size, n.running_flat().size) for n in networks]
        state = [(n.flat(), np.zeros(size), np.zeros(size), n.running_flat()) for n, (size, _) in zip(networks, sizes)]
        histories: list[list[float]] = [[] for _ in specs]
        steps = 0.0
        for epoch in range(max(spec["epochs"] for spec in specs)):
            active = [i for i, spec in enumerate(specs) if epoch < spec["epochs"]]
            start = spark.sparkContext.broadcast(([state[i] for i in active], steps))
            chosen = [specs[i] for i in active]

            def train(batches: Iterator[pa.RecordBatch], start=start, chosen=chosen) -> Iterator[pa.RecordBatch]:
                begin, done = start.value
                local, optimizers = [], []
                for spec, (weights, m, v, running) in zip(chosen, begin):
                    local.append(network(spec).load(weights, running))
                    adam = Adam(len(weights), spec["learning_rate"])
                    adam.first, adam.second, adam.steps = m.copy(), v.copy(), int(round(done))
                    optimizers.append(adam)
                rows, losses = 0, np.zeros(len(local))
                for block in _batches(batches, batch_size):
                    rows += len(block)
                    for i, (model, adam) in enumerate(zip(local, optimizers)):
                        loss, gradient = model.loss_and_gradient(block)
                        losses[i] += loss * len(block)
                        model.load(adam.step(model.flat(), gradient))
                if rows == 0:
                    return
                parts = [np.array([rows, rows * float(optimizers[0].steps)])]
                for i, (model, adam) in enumerate(zip(local, optimizers)):
                    parts += [losses[i : i + 1], rows * model.flat(), rows * adam.first, rows * adam.second, rows * model.running_flat()]
                yield pa.RecordBatch.from_arrays([lists(np.concatenate(parts)[None, :])], names=["s"])

            parts = data.select(features).mapInArrow(train, "s array<double>")
            # rows and steps, then loss, weights, two Adam moments and running statistics per model
            lengths = [n for i in active for n in (1, sizes[i][0], sizes[i][0], sizes[i][0], sizes[i][1])]
            flat = sum_vectors(parts, "s", 2 + sum(lengths))
            rows, steps = flat[0], flat[1] / flat[0]
            pieces = iter(np.split(flat[2:] / rows, np.cumsum(lengths)[:-1]))
            for i in active:
                histories[i].append(float(next(pieces)[0]))
                state[i] = tuple(next(pieces) for _ in range(4))
            start.unpersist()
        return [
            Autoencoder(network.load(weights, running), history)
            for network, (weights, _, _, running), history in zip(networks, state, histories)
        ]
    finally:
        data.unpersist()
