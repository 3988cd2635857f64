import gzip
import json

import pytest
from pyspark.sql import functions as F

from relevia.sources import sinks, tables
from relevia.sources.catalog import (
    FLOW_RENAMES, catalog_names, column_dtypes, column_names, dataset_information, flow_groups, flow_schema, read_catalog,
)
from relevia.operators.shape import map_columns

HEADER = ["Konto", "Währung", "Betrag", "Menge", "Label", "Belegnummer", "Position", "Transaktionsart", "Erfassungsuhrzeit"]
ENGLISH = ["account", "currency", "amount", "quantity", *HEADER[4:]]


@pytest.fixture
def catalog(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    lines = [
        ",".join(str(i) for i in range(10)),
        "ger," + ",".join(HEADER),
        "en," + ",".join(ENGLISH),
        "cat,1.0,1.0,0.0,0.0,-1.0,-1.0,-1.0,-1.0,-1.0",
        "num,0.0,0.0,1.0,1.0,-1.0,-1.0,-1.0,-1.0,-1.0",
    ]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return read_catalog(spark, str(path))


def write_ledger(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(HEADER)] + [",".join(str(v) for v in r) for r in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode("ISO-8859-1"))


def ledger_row(i):
    return (f"K{i}", "Ä" if i % 2 else "", i * 1.5, i, "NonFraud", 100 + i, 1, "x", "10:00:00")


def test_catalog(catalog):
    assert column_dtypes(catalog, "en") == (["amount", "quantity"], ["account", "currency"])
    assert column_names(catalog, "ger") == ["Konto", "Währung", "Betrag", "Menge"]
    assert catalog_names(catalog, "en", ["note"]) == HEADER[4:]
    with pytest.raises(ValueError):
        column_names(catalog, "fr")


def test_ledger(spark, catalog, tmp_path):
    write_ledger(tmp_path / "one.csv", [ledger_row(i) for i in range(50)])
    df = tables.read_ledger(spark, str(tmp_path / "one.csv"), catalog)
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    assert [r["account"] for r in rows] == [f"K{i}" for i in range(50)]
    assert [r["row_id"] for r in rows] == list(range(50))
    assert rows[1]["currency"] == "Ä" and rows[2]["currency"] is None and rows[3]["amount"] == 4.5
    with pytest.raises(ValueError):
        tables.read_ledger(spark, str(tmp_path / "one.csv"), catalog, "fr")


def test_named_splits(spark, catalog, tmp_path, monkeypatch):
    monkeypatch.setitem(tables.TASKS["session1"], "split_id", 4)
    write_ledger(tmp_path / "ex2" / "normal_1.csv", [ledger_row(i) for i in range(3)])
    write_ledger(tmp_path / "ex2" / "fraud_1.csv", [ledger_row(i) for i in range(10)])
    counts = {r["split"]: r["count"] for r in tables.load_splits(spark, str(tmp_path), "my_session1", catalog).groupBy("split").count().collect()}
    assert counts == {"train": 3, "test": 4, "eval": 6}
    for name, rows in (("normal_2", 2), ("fraud_2", 3), ("fraud_3", 4)):
        write_ledger(tmp_path / "ex1" / f"{name}.csv", [ledger_row(i) for i in range(rows)])
    counts = {r["split"]: r["count"] for r in tables.load_splits(spark, str(tmp_path), "session2", catalog).groupBy("split").count().collect()}
    assert counts == {"train": 2, "eval": 3, "test": 4}
    with pytest.raises(ValueError):
        tables.load_splits(spark, str(tmp_path), "other", catalog)


def test_dataset_information(spark):
    row = dataset_information(spark, "a.csv", "b.csv", "info.csv", split_id=7).first()
    assert (row["train_path"], row["eval_path"], row["split_id"]) == ("a.csv", None, 7)


def test_flows(spark, tmp_path):
    names = [n for group in flow_groups().values() for n in group]
    assert len(names) == 146
    lines = [",".join([*names, "isNormal"]), ",".join(["1"] + ["0"] * 145 + ["1"]), ",".join(["0"] * 146 + ["0"])]
    with gzip.open(tmp_path / "train.csv.gz", "wt") as file:
        file.write("\n".join(lines) + "\n")
    df = tables.read_flows(spark, str(tmp_path / "train.csv.gz"), ["isWeekday", "isNormal"], is_normal=True)
    assert df.dtypes == [("isWeekday", "tinyint"), ("isNormal", "tinyint")]
    assert sorted(tuple(r) for r in df.collect()) == [(0, 0), (1, 1)]
    vector = tables.flow_features(df, ["isWeekday"]).orderBy("isWeekday").collect()[1]["features"]
    assert vector == [1.0]
    minmax = flow_schema("minmax", attack_type=True)
    assert "`Duration` float" in minmax and "`isTCP` tinyint" in minmax and len(minmax.split(", ")) == 6 + 1 + 3 + 110 + 6 + 1
    with pytest.raises(ValueError):
        flow_schema("other")
    raw = spark.createDataFrame([(1, 2)], [" Src IP Addr", "Src Connections last 10s "])
    assert map_columns(raw, FLOW_RENAMES).columns == ["Src IP", "Src Conns"]


def test_gold_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "gold.csv"
    text = "iloc,Konto/Nr_,Betrag,Label,Belegnummer\n660,X,,Fraud_A,5\n12,,X,Fraud_B,6\n"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))
    rows = sorted(tuple(r) for r in tables.read_gold(spark, str(path), drop=2).collect())
    assert rows == [(12, "Betrag", 1), (12, "Konto/Nr_", 0), (660, "Betrag", 0), (660, "Konto/Nr_", 1)]
    flows = tmp_path / "flows.csv"
    flows.write_text(",Src IP,attackType,label\n7,X,dos,attacker\n")
    assert [tuple(r) for r in tables.read_gold(spark, str(flows), drop=["attackType", "label"]).collect()] == [(7, "Src IP", 1)]


def test_explanations_round_trip(spark, tmp_path):
    wide = tmp_path / "shap.csv"
    wide.write_text(",a_1,a_2,expected_value\n3,0.5,-1.0,9.0\n")
    assert sorted(tuple(r) for r in tables.read_explanation(spark, str(wide)).collect()) == [(3, "a_1", 0.5), (3, "a_2", -1.0)]
    df = spark.createDataFrame([(s, i, [s + 0.5, float(i)]) for s in (5, 19) for i in range(4)], "seed int, row_id long, phi array<double>")
    folder = str(tmp_path / "set")
    sinks.write_explanation_set(df, folder, "shap_runs", ["x", "y"])
    back = tables.read_explanation_set(spark, folder)
    assert {(r["seed"], r["row_id"], r["feature"], r["phi"]) for r in back.collect()} == {
        (s, i, f, v) for s in (5, 19) for i in range(4) for f, v in (("x", s + 0.5), ("y", float(i)))
    }


def test_explanation_sink(spark, tmp_path):
    path = str(tmp_path / "explanations")
    df = spark.createDataFrame([(1, [0.5])], "row_id long, phi array<double>")
    sinks.write_explanation(df, path, "AE", "shap", "zeros")
    sinks.write_explanation(df, path, "AE", "lime", "kmeans")
    sinks.write_explanation(df, path, "AE", "shap", "zeros", if_exists="ignore")
    rows = spark.read.parquet(path)
    assert rows.count() == 2
    fresh = str(tmp_path / "fresh")
    for method in ("shap", "lime", "shap"):
        sinks.write_explanation(df, fresh, "AE", method, "zeros", if_exists="ignore")
    assert sorted(r["method"] for r in spark.read.parquet(fresh).collect()) == ["lime", "shap"]
    pruned = rows.where(F.col("method") == "lime")
    assert pruned.count() == 1
    assert "PartitionFilters: [isnotnull(method" in pruned._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        sinks.write_explanation(df, path, "AE", "shap", "zeros", if_exists="overwrite")


def test_scores_summaries_and_runs(spark, tmp_path):
    scores = spark.createDataFrame([("eval", 1, -0.5, 1), ("test", 1, -0.1, 0)], "split string, row_id long, score double, y int")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).where("split = 'test'").count() == 1
    for value in (0.5, 0.7):
        sinks.append_summary(spark.createDataFrame([(value,)], "roc_mean double"), str(tmp_path / "summary"))
    assert spark.read.parquet(str(tmp_path / "summary")).count() == 2
    sinks.write_run(spark, str(tmp_path / "runs"), "job", 3, {"nu": 0.05}, {"auc_roc_eval": 0.9, "auc_pr_eval": None})
    row = spark.read.parquet(str(tmp_path / "runs")).first()
    assert json.loads(row["params"]) == {"nu": 0.05} and row["metrics"] == {"auc_roc_eval": 0.9, "auc_pr_eval": None}
