import numpy as np
import pytest

from relevia.detectors.autoencoder import Adam, Autoencoder, Network, fit_model_set
from relevia.detectors import levels
from relevia.detectors.base import CentroidDetector
from relevia.detectors.iforest import IsolationForest, average_path
from relevia.detectors.ocsvm import OneClassSVM
from relevia.detectors.pca import PcaDetector, moments
from relevia.sources.registry import load_model, save_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4)) @ np.diag([2.0, 1.0, 0.5, 0.1])
    x[:6] += 9.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>").repartition(3).cache(), x


def scores(detector, df):
    return np.array([r["score"] for r in detector.transform(df).orderBy("row_id").collect()])


def test_isolation_forest(spark, data):
    df, x = data
    forest = IsolationForest.fit(df, n_estimators=40, max_samples=64, seed=1)
    assert len(forest.trees) == 40 and forest.sample_rows == 64
    assert all(len(t["field"]) <= 127 for t in forest.trees)
    assert all(len(np.unique(t["field"][np.isfinite(t["threshold"])])) <= 3 for t in forest.trees)
    found = scores(forest, df)
    assert set(np.argsort(found)[:6]) == set(range(6))
    assert (-1 <= found).all() and (found <= 0).all()
    again = IsolationForest.fit(df.repartition(7), n_estimators=40, max_samples=64, seed=1)
    assert np.array_equal(scores(again, df), found)
    share = IsolationForest.fit(df, n_estimators=2, max_samples=0.5)
    assert share.sample_rows == 300
    assert average_path(np.array([1, 2, 3])) == pytest.approx([0.0, 1.0, 2 * (np.log(2) + np.euler_gamma) - 4 / 3])


def _check_tree(x, ids, forest, top_key, tree, fields, rate, limit):
    """Every split lies inside its rows' range of a field that varies; leaves are those that cannot or must not split."""
    mine = x[levels.in_sample(ids, top_key, rate)]
    open_, seen = [(0, np.arange(len(mine)), 0)], 0
    while open_:
        node, rows, depth = open_.pop()
        seen += 1
        values = mine[rows]
        low, high = values[:, fields].min(axis=0), values[:, fields].max(axis=0)
        if tree["left"][node] == node:
            assert len(rows) <= 1 or depth >= limit or (low == high).all()
            assert tree["path"][node] == pytest.approx(depth + float(average_path(len(rows))))
            continue
        field, threshold = tree["field"][node], tree["threshold"][node]
        at = fields.tolist().index(field)
        assert low[at] <= threshold < high[at]
        left = values[:, field] <= threshold
        open_ += [(tree["left"][node], rows[left], depth + 1), (tree["right"][node], rows[~left], depth + 1)]
    assert seen == len(tree["field"])


@pytest.fixture
def by_levels(monkeypatch):
    """Samples of a few hundred rows grow level by level, down to nodes of 40."""
    monkeypatch.setattr("relevia.detectors.iforest.SMALL_SAMPLE", 10)
    monkeypatch.setattr("relevia.detectors.levels.TASK_ROWS", 40)


@pytest.mark.parametrize("most_open", [65_536, 16])
def test_levels_grow_right_trees(spark, data, by_levels, monkeypatch, most_open):
    monkeypatch.setattr("relevia.detectors.levels.MOST_OPEN", most_open)
    df, x = data
    x = x.copy()
    x[300:520] = x[7]  # a point that a third of all rows share
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(3)
    forest = IsolationForest.fit(df, n_estimators=6, max_samples=0.8, seed=4)
    assert forest.sample_rows == 480 and len(forest.trees) == 6
    keys = levels.root_keys(4, 6)
    for t, tree in enumerate(forest.trees):
        assert abs(levels.in_sample(np.arange(600), keys[t], 0.8).sum() - 480) < 50
        _check_tree(x, np.arange(600), forest, keys[t], tree, levels.tree_fields(4, t, 4, 0.8), 0.8, 9)
    found = scores(forest, df)
    again = IsolationForest.fit(df.repartition(7), n_estimators=6, max_samples=0.8, seed=4)
    assert np.array_equal(scores(again, df), found)
    assert set(np.argsort(found)[:5]) <= set(range(6)) | set(range(520, 600)) | set(range(300))


def test_a_forest_as_a_table_scores_alike(spark, data, by_levels, monkeypatch):
    df, _ = data
    whole = IsolationForest.fit(df, n_estimators=8, max_samples=0.8, seed=2)
    monkeypatch.setattr("relevia.detectors.iforest.MOST_NODES", 10)
    monkeypatch.setattr("relevia.detectors.levels.SCORE_ROWS", 16)
    table = IsolationForest.fit(df, n_estimators=8, max_samples=0.8, seed=2)
    assert type(table).__name__ == "TableForest"
    assert scores(table, df) == pytest.approx(scores(whole, df))
    clash = df.selectExpr("row_id", "features", "1 as row", "2 as x", "3 as depth", "4 as part")
    assert table.transform(clash).columns == [*clash.columns, "score"]
    assert scores(table, clash) == pytest.approx(scores(whole, df))
    with pytest.raises(ValueError):
        table.arrays()


def test_levels_of_one_value_and_of_one_row(spark, by_levels):
    rows = [(i, [1.0, 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    forest = IsolationForest.fit(df, n_estimators=3, max_samples=0.9)
    assert all(len(t["field"]) == 1 for t in forest.trees)
    assert len(set(scores(forest, df))) == 1


def test_one_class_svm(spark, data):
    df, _ = data
    model = OneClassSVM.fit(df, nu=0.1, gamma=0.2, components=200, iterations=40)
    found = scores(model, df)
    assert (found < 0).mean() == pytest.approx(0.1, abs=0.02)
    assert set(range(6)) <= set(np.argsort(found)[:30])
    # the dual objective |w|^2 / 2 falls with more steps
    short = OneClassSVM.fit(df, nu=0.1, gamma=0.2, components=200, iterations=3)
    assert np.linalg.norm(model.w) <= np.linalg.norm(short.w) + 1e-9


@pytest.mark.parametrize("options", [{}, {"n_components": 2}, {"n_components": 0.9, "weighted": False}, {"standardization": True}])
def test_pca_by_definition(spark, data, options):
    df, x = data
    n, mean, covariance = moments(df)
    assert n == 600 and np.allclose(mean, x.mean(axis=0)) and np.allclose(covariance, np.cov(x.T))
    model = PcaDetector.fit(df, **options)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1) if options.get("standardization") else x
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(4), np.abs(vectors).argmax(axis=1)])[:, None]
    ratio = values / values.sum()
    keep = options.get("n_components", 4)
    keep = keep if keep >= 1 else int(np.searchsorted(np.cumsum(ratio), keep) + 1)
    weights = ratio if options.get("weighted", True) else np.ones(4)
    distance = np.sqrt(((z[:, None, :] - vectors[None, :keep]) ** 2).sum(axis=2))
    assert np.allclose(scores(model, df), -(distance / weights[:keep]).sum(axis=1))
    from pyspark.sql import functions as F

    by_expression = df.select("row_id", model.expression(F.col("features")).alias("score")).orderBy("row_id")
    assert np.allclose([r["score"] for r in by_expression.collect()], scores(model, df))


@pytest.mark.parametrize("batch_norm", [False, True])
def test_weight_gradient(batch_norm):
    network = Network(5, n_layers=2, n_bottleneck=3, batch_norm=batch_norm, seed=4)
    x = np.random.default_rng(1).normal(size=(7, 5))
    flat = network.flat()
    _, gradient = network.loss_and_gradient(x)
    for i in np.random.default_rng(2).choice(flat.size, 40, replace=False):
        step = np.zeros(flat.size)
        step[i] = 1e-6
        up = network.load(flat + step).loss_and_gradient(x)[0]
        down = network.load(flat - step).loss_and_gradient(x)[0]
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_network_shape():
    network = Network(6, n_layers=3, n_bottleneck=4)
    assert [w.shape for w in network.weights[::2]] == [(32, 6), (16, 32), (8, 16), (4, 8), (8, 4), (16, 8), (32, 16), (6, 32)]
    assert network.embed(np.zeros((2, 6))).shape == (2, 4)


def test_one_worker_equals_plain_training(spark, data):
    df, x = data
    model = Autoencoder.fit(df, seed=3, n_layers=1, n_bottleneck=2, epochs=2, batch_size=100, learning_rate=0.01)
    from pyspark.sql import functions as F

    order = [r["row_id"] for r in df.orderBy(F.xxhash64("row_id", F.lit(42))).select("row_id").collect()]
    network = Network(4, 1, 2, seed=3)
    adam, weights = Adam(network.flat().size, 0.01), network.flat()
    for _ in range(2):
        for start in range(0, 600, 100):
            _, gradient = network.loss_and_gradient(x[order[start : start + 100]])
            weights = adam.step(weights, gradient)
            network.load(weights)
    assert np.allclose(model.network.flat(), weights)


def test_autoencoder(spark, data):
    df, x = data
    model = Autoencoder.fit(df, n_layers=2, n_bottleneck=2, epochs=12, batch_size=64)
    assert model.history[-1] < 0.7 * model.history[0]
    assert np.allclose(scores(model, df), -model.network.error(x))
    row = model.reconstruct(model.embed(df)).where("row_id = 9").first()
    assert np.allclose(row["reconstruction"], model.network.reconstruct(x[9:10])[0])
    assert len(row["embedding"]) == 2
    error = model.test(df).where("row_id = 9").first()["error"]
    assert error == pytest.approx(-scores(model, df)[9])


def test_model_set_differs_by_seed_only(spark, data):
    df, _ = data
    options = {"n_layers": 1, "n_bottleneck": 2, "epochs": 2, "batch_size": 64, "batch_norm": True}
    first, second = fit_model_set(df, [1, 2], **options)
    alone = Autoencoder.fit(df.repartition(5), seed=2, **options)
    assert not np.allclose(first.network.flat(), second.network.flat())
    assert np.allclose(alone.network.flat(), second.network.flat())
    assert np.allclose(alone.network.running_flat(), second.network.running_flat())


def test_registry(spark, data, tmp_path):
    df, x = data
    path = str(tmp_path / "models")
    models = [
        CentroidDetector.fit(df),
        IsolationForest.fit(df, n_estimators=3, max_samples=32),
        OneClassSVM.fit(df, components=20, iterations=2),
        PcaDetector.fit(df),
        Autoencoder.fit(df, n_layers=1, n_bottleneck=2, epochs=1, batch_norm=True),
    ]
    for model in models:
        save_model(spark, model, path, "train_a", metric=0.5)
        loaded = load_model(spark, path, model.kind, "train_a")
        assert np.array_equal(loaded.score_batch(x), model.score_batch(x))
    better = CentroidDetector(np.ones(4))
    save_model(spark, better, path, "train_a", metric=0.9)
    assert np.array_equal(load_model(spark, path, "centroid", "train_a").centre, better.centre)
    with pytest.raises(ValueError):
        load_model(spark, path, "centroid", "train_b")


def test_autoencoder_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "row_id long, features array<double>")
    fits = [Autoencoder.fit(df.repartition(n), n_layers=1, n_bottleneck=2, epochs=2, batch_size=32, shard_rows=100) for n in (1, 7)]
    assert np.allclose(fits[0].network.flat(), fits[1].network.flat(), atol=1e-12)


def test_forest_scores_rows_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    from relevia.detectors.iforest import grow_tree

    forest = IsolationForest([grow_tree(rng.random((64, 4)), np.array([0, 2, 3]), rng) for _ in range(5)], 64)
    x, blocks = rng.random((20_000, 4)), []
    x[7] = np.nan
    whole = IsolationForest._depth
    monkeypatch.setattr(IsolationForest, "_depth", lambda self, x: (blocks.append(len(x)), whole(self, x))[1])
    found = forest.score_batch(x)
    assert max(blocks) < len(x) / 2 and sum(blocks) == len(x)
    for row in (0, 7, 8_191, 8_192, 19_999):
        depth = 0.0
        for tree in forest.trees:
            at, following = -1, 0
            while at != following:
                at = following
                following = int(tree["left"][at] if x[row, tree["field"][at]] <= tree["threshold"][at] else tree["right"][at])
            depth += tree["path"][at]
        assert found[row] == pytest.approx(-(2.0 ** (-depth / (5 * forest._scale()))))
