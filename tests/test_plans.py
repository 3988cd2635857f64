import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.detectors.autoencoder import Autoencoder
from relevia.operators import encode as E
from relevia.operators import groups as G
from relevia.operators import shape as S
from relevia.plans import detect, explain
from relevia.plans import journal as J
from relevia.session import new_table_path
from relevia.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def ledger(spark, folder):
    return J.journal(spark, folder).cache()


def test_journal_keeps_every_order(spark, folder, ledger):
    orders = J.read_table(spark, folder, "orders")
    assert ledger.count() == orders.count() == ledger.select("row_id").distinct().count()
    assert ledger.where("n_lines IS NULL").count() > 0
    assert {r[0] for r in ledger.select("split").distinct().collect()} == {"train", "eval", "test"}


SMALL = {
    "IsolationForest": {"n_estimators": 16, "max_samples": 128},
    "OneClassSVM": {"nu": 0.1, "gamma": 0.1, "components": 50, "iterations": 5},
    "PCA": {"weighted": True},
    "Autoencoder": {"n_layers": 1, "n_bottleneck": 2, "epochs": 3, "batch_size": 64},
    "LocalOutlierFactor": {"n_neighbors": 20},
}


@pytest.mark.parametrize("algorithm", sorted(SMALL))
def test_detector_run(spark, ledger, tmp_path, algorithm):
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "None", "zscore")
    run = detect.detect_anomalies(ledger, encoder, algorithm, SMALL[algorithm], seed=1, out=str(tmp_path), job="t")
    metrics = {r["split"]: r for r in run.metrics.collect()}
    assert set(metrics) == {"eval", "test"}
    assert all(0.5 < r["auc_roc"] <= 1.0 for r in metrics.values())
    assert spark.read.parquet(f"{tmp_path}/scores").count() == ledger.where("split <> 'train'").count()
    record = spark.read.parquet(f"{tmp_path}/runs").first()
    assert record["metrics"]["auc_roc_test"] == pytest.approx(metrics["test"]["auc_roc"])


def test_unknown_algorithm(ledger):
    with pytest.raises(ValueError):
        detect.detect_anomalies(ledger, E.make_encoder([], J.NUMERIC, "None", "zscore"), "LOCI")


def test_grids(spark):
    assert len(detect.param_grid(detect.LEDGER_GRIDS["PCA"])) == 24
    frame = detect.param_grid_frame(spark, detect.LEDGER_GRIDS["PCA"])
    assert {tuple(r) for r in frame.collect()} == {tuple(p.values()) for p in detect.param_grid(detect.LEDGER_GRIDS["PCA"])}
    assert set(detect.FLOW_GRIDS) == {"IsolationForest", "OneClassSVM", "Autoencoder"}


def test_study_covers_grid_and_seeds(ledger):
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "None", "minmax")
    rows = detect.param_study(
        ledger, encoder, "IsolationForest", {"n_estimators": [4, 8], "max_samples": [64]}, seeds=[0, 1]
    ).collect()
    assert len(rows) == 8
    assert {(r["n_estimators"], r["seed"], r["split"]) for r in rows} == {
        (n, s, p) for n in (4, 8) for s in (0, 1) for p in ("eval", "test")
    }


STUDIES = {
    "PCA": {"n_components": [0.5, 3], "whiten": [False], "weighted": [True, False], "standardization": [True, False]},
    "IsolationForest": {"n_estimators": [3, 5], "max_samples": [32, 0.8]},
    "Autoencoder": {"n_layers": [1], "n_bottleneck": [2, 3], "epochs": [1, 3], "batch_size": [64, 128]},
    "LocalOutlierFactor": {"n_neighbors": [5, 8]},
}


@pytest.mark.parametrize("algorithm", sorted(STUDIES))
def test_runs_fitted_together_score_as_alone(ledger, monkeypatch, algorithm):
    monkeypatch.setattr("relevia.detectors.iforest.SMALL_SAMPLE", 100)
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "None", "minmax")
    encoded = detect.encode_splits(ledger, encoder).cache()
    train, rest = encoded.where("split = 'train'"), encoded.where("split <> 'train'")
    runs = [(params, seed) for params in detect.param_grid(STUDIES[algorithm]) for seed in (0, 1)]
    together = detect.run_scores(train, rest, algorithm, runs).toPandas()
    assert sorted(set(together["run"])) == list(range(len(runs)))
    for i in (0, len(runs) // 2, len(runs) - 1):
        _, alone = detect.fit_and_score(encoded, algorithm, *runs[i])
        alone = alone.toPandas().set_index("row_id")["score"].sort_index()
        mine = together[together["run"] == i].set_index("row_id")["score"].sort_index()
        assert mine.index.equals(alone.index)
        assert mine.to_numpy() == pytest.approx(alone.to_numpy(), abs=1e-9)


def test_jobs_of_a_study_do_not_grow_with_its_runs(spark, ledger):
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "None", "zscore")
    jobs = []
    for seeds in ([0], list(range(10))):
        spark.sparkContext.setJobGroup(f"study-{len(seeds)}", "")
        rows = detect.param_study(ledger, encoder, "PCA", detect.LEDGER_GRIDS["PCA"], seeds=seeds).collect()
        assert len(rows) == 2 * 24 * len(seeds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"study-{len(seeds)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


@pytest.fixture(scope="module")
def prepared(ledger):
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "onehot", "minmax").fit(ledger.where("split = 'train'"))
    encoded = encoder.transform(ledger)
    marks = F.array_append(F.array_append(F.array_append(J.gold_marks(), F.lit(0)), F.lit(0)), F.lit(0))
    # marks in source order: three categorical columns, then the numeric ones
    gold = F.concat(F.slice(marks, 7, 3), F.slice(marks, 1, 6))
    rows = S.get_frauds(encoded).select("row_id", "features", gold.alias("gold")).cache()
    train = encoded.where("split = 'train'").select("row_id", "features").cache()
    model = Autoencoder.fit(train, n_layers=1, n_bottleneck=3, epochs=4, batch_size=128)
    groups = list(G.positions_by_source(encoder.catalog()).values())
    return rows, train, model, groups


RUNS = [
    ("shap", "zeros", {"samples": 200}), ("shap", "mean", {"samples": 100}), ("shap", "NN", {"samples": 100}),
    ("shap", "kmeans", {"samples": 100}), ("shap", "train", {"samples": 64}), ("shap", "single_optimum", {"samples": 64}),
    ("shap", "optimized", {"samples": 64, "steps": 5}),
    ("lime", "kmeans", {"samples": 100}), ("gradient", "zeros", {}), ("grad_input", "zeros", {}), ("intgrad", "mean", {}),
    ("lrp", "zeros", {}), ("reconstruction", "zeros", {}), ("uniform_noise", "zeros", {}),
    ("uniform_noise_times_input", "zeros", {}),
]


@pytest.mark.parametrize("method,background,options", RUNS, ids=[f"{m}-{b}" for m, b, _ in RUNS])
def test_explanation_run(prepared, method, background, options):
    rows, train, model, groups = prepared
    explained, report = explain.explain_anomalies(rows, model, method, background, train, groups, **options)
    found = explained.collect()
    assert len(found) == rows.count()
    assert all(len(r["phi"]) == 9 and np.isfinite(r["phi"]).all() for r in found)
    row = report.first()
    assert row["xai"] == method and 0.0 <= row["roc_mean"] <= 1.0


def test_explanations_are_written(spark, prepared, tmp_path):
    rows, train, model, groups = prepared
    explain.explain_anomalies(rows, model, "reconstruction", "zeros", train, groups, out=str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/explanations").count() == rows.count()
    assert spark.read.parquet(f"{tmp_path}/summary").count() == 1
    with pytest.raises(ValueError):
        explain.attribute(rows, model, "other")


def test_model_set(ledger):
    explanations = J.explanation_set(ledger, signed=True)
    pairs, histogram = explain.model_set_consistency(explanations, k=3, bins=10)
    assert pairs.count() == 10
    densities = histogram.groupBy("metric").agg(F.sum("pairs").alias("pairs")).collect()
    assert all(r["pairs"] == 10 for r in densities)
    assert explain.compactness(explanations, by=["seed"]).count() == 5


def test_stream_scores_equal_batch_scores(spark, ledger, tmp_path):
    encoder = E.make_encoder(J.CATEGORICAL, J.NUMERIC, "None", "minmax").fit(ledger)
    model = Autoencoder.fit(encoder.transform(ledger), n_layers=1, n_bottleneck=2, epochs=1)
    source = str(tmp_path / "in")
    ledger.write.parquet(source)
    stream = spark.readStream.schema(ledger.schema).parquet(source)
    query = (
        score_stream(stream, encoder, model).writeStream.format("memory").queryName("stream_scores").outputMode("append").start()
    )
    query.processAllAvailable()
    query.stop()
    batch = model.transform(encoder.transform(ledger)).select("row_id", F.col("score").alias("expected"))
    joined = spark.table("stream_scores").join(batch, "row_id")
    assert joined.count() == ledger.count()
    assert joined.where(F.abs(F.col("score") - F.col("expected")) > 1e-9).count() == 0


def test_paths_are_new_each_time(spark):
    assert new_table_path(spark, "x") != new_table_path(spark, "x")
