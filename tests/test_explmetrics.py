import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.operators import explmetrics as M
from relevia.operators import groups as G
from relevia.operators.encode import EncodedColumn
from relevia.sources.catalog import flow_group_positions, flow_groups


def metric(spark, metric_column, phi, gold=None, **options):
    arguments = [F.col("phi")] if gold is None else [F.col("phi"), F.col("gold")]
    df = spark.createDataFrame([(list(map(float, phi)), gold or [0] * len(phi))], "phi array<double>, gold array<int>")
    return df.select(metric_column(*arguments, **options).alias("m")).first()["m"]


def test_row_metrics_by_hand(spark):
    phi, gold = [3.0, 1.0, 1.0, 0.0], [1, 1, 0, 0]
    assert metric(spark, M.row_auc_roc, phi, gold) == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert metric(spark, M.row_auc_pr, phi, gold) == pytest.approx((1 + 2 / 3) / 2)
    assert metric(spark, M.row_pearson, phi, gold) == pytest.approx(np.corrcoef(phi, gold)[0, 1])
    assert metric(spark, M.row_cosine, phi, gold) == pytest.approx(4 / np.sqrt(11 * 2))


def test_undefined_rows(spark):
    assert metric(spark, M.row_auc_roc, [1, 2], [1, 1]) is None
    assert metric(spark, M.row_auc_pr, [1, 2], [1, 1]) is None
    assert metric(spark, M.row_auc_pr, [1, 2], [0, 0]) is None
    assert metric(spark, M.row_pearson, [2, 2], [1, 0]) is None
    assert metric(spark, M.row_cosine, [0, 0], [1, 0]) == 0.0


def test_gini(spark):
    assert metric(spark, M.gini_index, [2, 2, 2]) == pytest.approx(0.0)
    assert metric(spark, M.gini_index, [0, 0, 5]) == pytest.approx(2 / 3)
    assert metric(spark, M.gini_index, [-1, -2]) == 0.0
    v = np.sort(np.abs([-4.0, 1.0, 2.0, 0.5]))
    expected = 1 - 2 * np.sum((4 - np.arange(1, 5) + 0.5) * v) / (4 * v.sum())
    assert metric(spark, M.gini_index, [-4.0, 1.0, 2.0, 0.5], absolute=True) == pytest.approx(expected)


def test_distraction(spark):
    assert metric(spark, M.distraction_weight, [3, 1, -9], [1, 0, 0]) == pytest.approx(0.25)
    assert metric(spark, M.distraction_weight, [3, 1, -4], [1, 0, 0], absolute=True) == pytest.approx(5 / 8)
    assert metric(spark, M.distraction_weight, [-3, -1], [1, 0]) == 0.0


@pytest.fixture
def runs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for seed, sign in ((0, 1.0), (1, -1.0)):
        for i in range(30):
            gold = [1, 0, 0, int(rng.random() < 0.5)]
            rows.append((seed, i, [float(sign * (g + rng.normal(0, 0.4))) for g in gold], gold))
    return spark.createDataFrame(rows, "seed int, row_id long, phi array<double>, gold array<int>")


def test_orientation(runs):
    turned = M.orient(runs, by=["seed"])
    means = {r["seed"]: r["roc_mean"] for r in M.mean_row_roc(turned, by=["seed"]).collect()}
    assert means[0] > 0.5 and means[1] > 0.5
    direct = {r["seed"]: r for r in M.size_eval(turned, by=["seed"]).collect()}
    for r in M.size_eval(runs, by=["seed"]).collect():
        for name in r.asDict():
            assert r[name] == pytest.approx(direct[r["seed"]][name]), name
    small = {r["type"]: r for r in M.model_set_summary(runs, subset=[1]).collect()}
    assert (small["large"]["gte_half"], small["large"]["lt_half"]) == (1, 1)
    assert (small["small"]["gte_half"], small["small"]["lt_half"]) == (0, 1)
    assert M.model_set_summary(runs).count() == 1


def test_report_counts_undefined_rows(spark):
    rows = [([1.0, 0.0], [1, 0]), ([1.0, 0.0], [1, 1])]
    row = M.explanation_report(spark.createDataFrame(rows, "phi array<double>, gold array<int>")).first()
    assert (row["rows"], row["rows_with_roc"], row["roc_mean"], row["roc_std"]) == (2, 1, 1.0, 0.0)


def test_long_and_vector_forms(runs):
    names = ["a", "b", "c", "d"]
    long = M.to_long(runs, names, "phi", "phi", ["seed", "row_id"])
    assert long.count() == 240
    back = M.to_vectors(long, names, "phi", ["seed", "row_id"], "again")
    joined = back.join(runs, ["seed", "row_id"])
    assert joined.where(~(F.col("again") == F.col("phi"))).count() == 0


def test_checked_rows(spark):
    explanations = spark.createDataFrame([(1, 0.1), (2, 0.2)], "row_id long, phi double")
    gold = spark.createDataFrame([(1, 1)], "row_id long, gold int")
    assert [r["row_id"] for r in M.checked_rows(explanations, gold).collect()] == [1]
    with pytest.raises(ValueError):
        M.checked_rows(explanations, spark.createDataFrame([(3, 1)], "row_id long, gold int"))


def test_flow_groups_cover_all_columns():
    positions = flow_group_positions()
    assert [len(v) for v in positions.values()] == [1, 5, 4, 3, 36, 19, 4, 36, 19, 4, 4, 5, 1, 1, 1, 1, 1, 1]
    assert [p for v in positions.values() for p in v] == list(range(146))
    assert flow_groups()["Src Conns"][-1] == "Src Conns 3"


def test_source_sums(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "phi array<double>")
    row = df.select(
        G.to_source_columns(F.col("phi"), [[0, 1], [4]]).alias("a"), G.to_source_passthrough(F.col("phi"), [[0, 1], [4]], 5).alias("b")
    ).first()
    assert row["a"] == [3.0, 5.0] and row["b"] == [3.0, 4.0, 3.0, 5.0]
    catalog = [EncodedColumn(0, "c_x", "c", "cat"), EncodedColumn(1, "c_y", "c", "cat"), EncodedColumn(2, "n", "n", "num")]
    long = M.to_long(spark.createDataFrame([(7, [1.0, 2.0, 4.0])], "row_id long, phi array<double>"), ["c_x", "c_y", "n"], "phi", "phi", ["row_id"])
    summed = {r["feature"]: r["phi"] for r in G.to_source_long(long, G.group_map(spark, catalog)).collect()}
    assert summed == {"c": 3.0, "n": 4.0}


def test_names_to_groups(spark):
    names = spark.createDataFrame([(0, "a_b_x"), (1, "a_b_y"), (2, "Betrag_5"), (3, "plain")], "enc_pos int, enc_name string")
    found = {r["source_name"]: r["positions"] for r in G.groups_from_names(names).collect()}
    assert found == {"a_b": [0, 1], "Betrag_5": [2], "plain": [3]}


def test_vector_helpers(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0],)], "v array<double>")
    v = F.col("v")
    row = df.select(
        V.l1_norm(v).alias("l1"), V.l2_norm(v).alias("l2"), V.l2_normalize(v).alias("unit"), V.highlight(v).alias("h"),
        V.top_positions(v, 2).alias("top"), V.top_positions(v, 2, by_magnitude=False).alias("signed"),
        V.add(v, v).alias("sum"), V.scale(v, F.lit(2.0)).alias("twice"),
    ).first()
    assert (row["l1"], row["l2"], row["unit"]) == (7.0, 5.0, [0.6, -0.8, 0.0])
    assert row["h"] == [True, False, False] and row["top"] == [2, 1] and row["signed"] == [1, 3]
    assert row["sum"] == row["twice"] == [6.0, -8.0, 0.0]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert zero.select(V.l2_normalize(v).alias("u")).first()["u"] == [0.0, 0.0]
    tie = spark.createDataFrame([([1.0, -1.0, 1.0],)], "v array<double>")
    assert tie.select(V.top_positions(v, 2).alias("t")).first()["t"] == [3, 2]
