"""What the plans must not contain, and windows on hot keys."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from relevia.operators import windows
from relevia.operators.windows import trailing_counts

QUERIES = contract.queries()
# a sample of every family; each also runs in the SQL comparison
PLANNED = [
    "flagship", "zscore", "bucket_outlier", "oversample", "score_report", "fraud_ranks", "shard", "orient", "size_eval",
    "model_set_summary", "pair_euclid", "pair_histogram", "hamming_matrix", "hamming_by_label", "knn", "knn_cells",
    "lof_novelty", "shap_exact", "conn_last_10s", "gold_join", "to_source_long", "hamming_rows", "sparse_onehot", "sparse_centroid",
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_needed_columns_only(spark, folder):
    plan = QUERIES["conn_last_10s"](spark, folder)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "props" not in scan and "value" not in scan.split("Batched")[0]


def test_row_metrics_add_no_shuffle(spark, folder):
    from relevia.operators import explmetrics as M

    df = spark.createDataFrame([([1.0, 2.0], [0, 1])], "phi array<double>, gold array<int>")
    plan = M.with_row_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("crowded", [1, 20, 1 << 16])
def test_trailing_counts_on_a_hot_key(spark, monkeypatch, crowded):
    monkeypatch.setattr(windows, "CROWDED", crowded)
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    seconds = np.sort(rng.choice(np.arange(0, 3000, 0.5), 600))
    keys = np.where(rng.random(600) < 0.5, "hot", rng.choice(["a", "b", "c"], 600))
    rows = [(i, str(k), start + dt.timedelta(seconds=float(s))) for i, (k, s) in enumerate(zip(keys, seconds))]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = {r["id"]: (r["ten"], r["hundred"]) for r in trailing_counts(df, "k", "ts", {"ten": 10, "hundred": 100}).collect()}
    assert len(found) == 600
    for i in range(600):
        same = keys == keys[i]
        for position, reach in enumerate((10, 100)):
            window = same & (seconds >= seconds[i] - reach) & (seconds <= seconds[i])
            assert found[i][position] == window.sum()


@pytest.mark.parametrize("crowded", [1, 1 << 16])
def test_trailing_counts_with_repeats_and_nulls(spark, monkeypatch, crowded):
    monkeypatch.setattr(windows, "CROWDED", crowded)
    rows = [(0, "a", 10.0), (1, "a", 10.0), (2, "a", 12.0), (3, None, 11.0), (4, None, 11.5), (5, "a", None), (6, "a", 400.0)]
    start = dt.datetime(2024, 1, 1)
    data = [(i, k, None if s is None else start + dt.timedelta(seconds=s)) for i, k, s in rows]
    df = spark.createDataFrame(data, "id long, k string, ts timestamp")
    found = {r["id"]: r["near"] for r in trailing_counts(df, "k", "ts", {"near": 2}).collect()}
    assert found == {0: 2, 1: 2, 2: 3, 3: 1, 4: 2, 5: None, 6: 1}


def test_trailing_counts_in_one_shuffle(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts")
    plan = trailing_counts(events, "user_id", "ts", {"near": 600})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_trailing_counts_of_nothing_and_of_long_ranges(spark):
    start = dt.datetime(2024, 1, 1)
    schema = "id long, k string, ts timestamp_ntz, n long"
    assert trailing_counts(spark.createDataFrame([], schema), "k", "ts", {"near": 2}).collect() == []
    # the counts' own names are replaced, columns of other names stay
    df = spark.createDataFrame([(i, "a", start + dt.timedelta(days=i), 7) for i in range(60)], schema).withColumn("near", F.lit("x"))
    found = trailing_counts(df, "k", "ts", {"near": 40 * 86400, "none": 0})
    assert found.columns == ["id", "k", "ts", "n", "near", "none"]
    assert {(r["id"], r["near"], r["none"], r["n"]) for r in found.collect()} == {(i, min(i, 40) + 1, 1, 7) for i in range(60)}
    years = trailing_counts(df, "k", "ts", {"near": 10 * 365 * 86400})
    assert {(r["id"], r["near"]) for r in years.collect()} == {(i, i + 1) for i in range(60)}
