"""The flow path end to end: scan, detector, attribution, source columns, marks."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.operators import explmetrics as M
from relevia.operators.groups import to_source_columns
from relevia.operators.ranking import score_report
from relevia.plans.detect import fit_and_score
from relevia.plans.explain import attribute
from relevia.sources import tables
from relevia.sources.catalog import flow_group_positions, flow_groups

GROUPS = flow_groups()
MOVED = ("Src Pt", "Dst Pt", "Packets", "Bytes")
COLUMNS = [n for names in GROUPS.values() for n in names]


def one_hot_rows(count, rng, attack):
    """Normal flows mostly use the first value of each field; an attack moves four fields."""
    rows = []
    for _ in range(count):
        bits = []
        for source, names in GROUPS.items():
            if len(names) == 1:
                bits.append(int(rng.random() < 0.5))
                continue
            place = len(names) - 1 if attack and source in MOVED else int(rng.random() < 0.1)
            bits += [int(i == place) for i in range(len(names))]
        rows.append(bits)
    return rows


def write_flows(path, rows, is_normal):
    with gzip.open(path, "wt") as file:
        file.write(",".join(["id", *COLUMNS, "isNormal"]) + "\n")
        for i, (bits, normal) in enumerate(zip(rows, is_normal)):
            file.write(",".join(map(str, [i, *bits, normal])) + "\n")


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flows")
    rng = np.random.default_rng(0)
    train = one_hot_rows(400, rng, False) + one_hot_rows(8, rng, True)
    write_flows(folder / "train.csv.gz", train, [1] * len(train))
    mixed = one_hot_rows(60, rng, False) + one_hot_rows(20, rng, True)
    write_flows(folder / "test.csv.gz", mixed, [1] * 60 + [0] * 20)

    def scan(name, split):
        df = tables.read_flows(spark, str(folder / f"{name}.csv.gz"), is_normal=True, leading=["id"])
        return tables.flow_rows(df, split, COLUMNS, "id")

    return scan("train", "train").unionByName(scan("test", "test")).cache()


@pytest.mark.parametrize(
    "algorithm,params",
    [
        ("Autoencoder", {"n_layers": 1, "n_bottleneck": 16, "epochs": 15, "batch_size": 64}),
        ("IsolationForest", {"n_estimators": 64, "max_samples": 0.8}),
        ("OneClassSVM", {"nu": 0.2, "gamma": 0.1, "components": 200, "iterations": 15}),
    ],
)
def test_flow_detectors(flows, algorithm, params):
    _, scores = fit_and_score(flows, algorithm, params, seed=17)
    report = score_report(scores, by=["split"]).first()
    assert report["split"] == "test" and report["auc_roc"] > 0.8


def test_flow_explanations(spark, flows):
    detector, _ = fit_and_score(
        flows, "Autoencoder", {"n_layers": 1, "n_bottleneck": 16, "epochs": 15, "batch_size": 64}
    )
    marks = [int(source in MOVED) for source in GROUPS]
    attacks = flows.where("y = 1").withColumn("gold", F.array(*[F.lit(m) for m in marks]))
    for method, background in (("reconstruction", "zeros"), ("shap", "mean")):
        explained = attribute(attacks, detector, method, background, flows.where("split = 'train'"), samples=400)
        summed = explained.withColumn("phi", to_source_columns(F.col("phi"), list(flow_group_positions().values())))
        report = M.explanation_report(summed, compactness=True).first()
        assert report["rows"] == 20
        assert report["roc_mean"] > 0.8, method
