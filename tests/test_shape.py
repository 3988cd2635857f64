import pytest
from pyspark.sql import functions as F

from relevia.operators import shape as S

NAMES = ["Belegnummer", "Position", "Transaktionsart", "Erfassungsuhrzeit"]


@pytest.fixture
def labels(spark):
    rows = [(i, v) for i, v in enumerate(["NonFraud"] * 12 + ["Fraud_A"] * 3 + ["Event_B"] + ["InvoiceKickback1-Fraud"] * 2)]
    return spark.createDataFrame(rows, "row_id long, label string")


def test_notes(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["amount", *NAMES])
    assert S.drop_notes(df).columns == ["amount"]
    assert S.notes_first(df).columns == [*NAMES, "amount"]


def test_frauds_by_prefix_and_suffix(labels):
    assert S.get_frauds(labels).count() == 3
    assert S.get_frauds(labels, events=True).count() == 4
    assert S.get_frauds(labels, suffixes=["-Fraud"]).count() == 5


def test_label_mapping(spark):
    df = spark.createDataFrame([("Scrap",), ("Larceny_III",), ("Anomaly_9",), ("Fraud_X",)], "label string")
    mapped = [r[0] for r in df.select(S.adjust_labels(F.col("label"), "session2")).collect()]
    assert mapped == ["NonFraud", "NonFraud", "Anomaly_9", "Fraud_X"]
    assert [r[0] for r in df.select(S.adjust_labels(F.col("label"), "other")).collect()][0] == "Scrap"
    assert [r[0] for r in df.select(S.binarize_label(F.col("label"))).collect()] == [1, 1, 1, 1]
    normal = spark.createDataFrame([(1,), (0,)], "isNormal tinyint")
    assert [r[0] for r in normal.select(S.binarize_is_normal(F.col("isNormal"))).collect()] == [0, 1]


def test_split_label(labels):
    features, target = S.split_label(labels)
    assert features.columns == ["row_id"] and target.columns == ["row_id", "label"]
    assert S.split_label(labels, keep_label=True)[0].columns == ["row_id", "label"]


def test_oversample_adds_draws(labels, monkeypatch):
    monkeypatch.setattr(S, "DRAWS_PER_PIECE", 4)
    rows = S.oversample(labels, seed=3).collect()
    counts = {}
    for r in rows:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert counts == {"NonFraud": 12, "Fraud_A": 15, "Event_B": 13, "InvoiceKickback1-Fraud": 14}
    assert sum(r["copy"] == 0 for r in rows) == 18
    again = sorted(map(tuple, S.oversample(labels.repartition(5), seed=3).collect()))
    assert again == sorted(map(tuple, rows))


def test_oversample_counts_missing_labels_as_a_class(spark):
    rows = [(i, None) for i in range(3)] + [(10 + i, "a") for i in range(7)] + [(30 + i, "b") for i in range(20)]
    found = S.oversample(spark.createDataFrame(rows, "row_id long, label string")).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in found} == {None: 23, "a": 27, "b": 20}


def test_sample_depends_on_key_only(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    first = {r[0] for r in S.hash_sample(df, 0.1, 1).collect()}
    assert first == {r[0] for r in S.hash_sample(df.repartition(9), 0.1, 1).collect()}
    assert 130 < len(first) < 270
    assert first != {r[0] for r in S.hash_sample(df, 0.1, 2).collect()}


def test_order_and_shards(labels):
    ordered = S.reorder(labels, [14, 2, 13])
    assert [r["row_id"] for r in ordered.orderBy("position").collect()] == [14, 2, 13]
    assert sorted(r["row_id"] for r in S.shard(labels, 1, 5).collect()) == [5, 6, 7, 8, 9]
    assert sorted(r["row_id"] for r in S.renumber(labels.where("row_id > 9")).collect()) == list(range(8))


def test_seeds_and_headers(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.1)], "seed int, phi double")
    assert [r["seed"] for r in S.keep_seeds(df, [2]).collect()] == [2]
    raw = spark.createDataFrame([(1, 2)], [" Proto ", "Bytes"])
    assert S.map_columns(raw, {"Proto": "Traffic"}).columns == ["Traffic", "Bytes"]
