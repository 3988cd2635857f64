"""Sparse rows against the dense encoder and detectors, on wide columns, and on both ways to read a parameter table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.detectors.base import CentroidDetector
from relevia.detectors.pca import PcaDetector
from relevia.operators import sparse as SP
from relevia.operators.encode import MinMaxScaler, make_encoder

COLUMNS = ["a", "b"]
SCHEMA = "row_id long, a string, b string, x double, features string"


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    rows = [
        (i, None if i % 17 == 0 else f"v{int(draw.zipf(1.5)) % 40}", "" if i % 5 else f"w{i % 3}", float(draw.normal()), "taken")
        for i in range(400)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def dense(df, width):
    out = {}
    for row in df.select("row_id", "features").collect():
        out[row["row_id"]] = np.zeros(width)
        positions = [e["at"] for e in row["features"]]
        assert positions == sorted(set(positions))
        for e in row["features"]:
            out[row["row_id"]][e["at"]] = e["value"]
    return out


@pytest.mark.parametrize("limit", [0, 1000])
def test_positions_are_those_of_the_dense_encoder(spark, table, limit):
    train = table.where("row_id < 200")
    encoder = SP.SparseEncoder(COLUMNS, MinMaxScaler(["x"]), literal_limit=limit).fit(train)
    plain = make_encoder(COLUMNS, ["x"], "onehot", "minmax").fit(train)
    assert encoder.width == len(plain.catalog())
    found = encoder.transform(table)
    assert found.columns == table.columns
    expected = {r["row_id"]: r["features"] for r in plain.transform(table).collect()}
    for row_id, vector in dense(found, encoder.width).items():
        assert vector.tolist() == expected[row_id]
    names = {r["enc_pos"]: (r["enc_name"], r["source_name"]) for r in encoder.names(spark).collect()}
    assert names == {e.position: (e.name, e.source) for e in plain.catalog()}
    seen = {c: {r[0] for r in train.select(F.coalesce(c, F.lit("nan"))).collect()} for c in COLUMNS}
    back = encoder.inverse(found.select("row_id", "features")).collect()
    source = {r["row_id"]: r for r in table.collect()}
    assert len(back) == 400
    for row in back:
        for c in COLUMNS:
            value = source[row["row_id"]][c]
            value = "nan" if value is None else value
            assert row[c] == (value if value in seen[c] else None)


@pytest.mark.parametrize("shipped", [0, 1 << 20])
def test_centroid_equals_the_dense_one(table, shipped):
    train = table.where("row_id < 200")
    encoder = SP.SparseEncoder(COLUMNS, MinMaxScaler(["x"])).fit(train)
    plain = make_encoder(COLUMNS, ["x"], "onehot", "minmax").fit(train)
    detector = SP.SparseCentroid.fit(encoder.transform(train), encoder, shipped_bytes=shipped)
    flat = CentroidDetector.fit(plain.transform(train))
    expected = {r["row_id"]: r["score"] for r in flat.transform(plain.transform(table)).collect()}
    vectors = {r["row_id"]: np.asarray(r["features"]) for r in plain.transform(table).collect()}
    sources = [e.source for e in plain.catalog()]
    found = detector.source_errors(detector.transform(encoder.transform(table), "row_id"), "row_id").collect()
    assert len(found) == 400
    for row in found:
        assert row["score"] == pytest.approx(expected[row["row_id"]], abs=1e-9)
        errors = (vectors[row["row_id"]] - flat.centre) ** 2
        by_source = [sum(v for v, s in zip(errors, sources) if s == c) for c in [*COLUMNS, "x"]]
        assert row["errors"] == pytest.approx(by_source, abs=1e-9)


@pytest.mark.parametrize("shipped", [0, 1 << 20])
def test_components_equal_the_dense_ones(spark, shipped):
    draw = np.random.default_rng(8)
    rows = []
    for i in range(300):
        kind = int(draw.choice(3, p=[0.6, 0.3, 0.1]))
        rows.append((i, f"k{kind}", f"k{kind}" if draw.random() < 0.9 else f"z{int(draw.integers(4))}", float(draw.normal())))
    df = spark.createDataFrame(rows, "row_id long, a string, b string, x double")
    encoder = SP.SparseEncoder(COLUMNS).fit(df)
    plain = make_encoder(COLUMNS, [], "onehot", "None").fit(df)
    flat = PcaDetector.fit(plain.transform(df), n_components=2)
    found = SP.SparsePca.fit(encoder.transform(df), encoder.width, 2, "row_id", oversample=2, iterations=4, shipped_bytes=shipped)
    assert found.weights == pytest.approx(flat.weights, rel=1e-6)
    vectors = np.zeros((encoder.width, 2))
    for row in found.components.rows.collect():
        vectors[row["at"]] = row["vector"]
    assert np.abs(vectors.T @ flat.components.T) == pytest.approx(np.eye(2), abs=1e-5)
    # a component has no sign of its own: compare with the dense score under the same signs
    flat.components = vectors.T
    expected = flat.score_batch(np.asarray([r["features"] for r in plain.transform(df).orderBy("row_id").collect()]))
    scores = [r["score"] for r in found.transform(encoder.transform(df), "row_id").orderBy("row_id").collect()]
    assert scores == pytest.approx(expected.tolist(), rel=1e-6)


def test_a_hundred_thousand_categories(spark):
    """Encoded, inverted and scored; one value holds a third of the rows."""
    n = 150_000
    value = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(n).select(F.col("id").alias("row_id"), value.alias("a"))
    encoder = SP.SparseEncoder(["a"]).fit(df)
    assert encoder.sizes["a"] == 100_001
    encoded = encoder.transform(df)
    back = encoder.inverse(encoded.select("row_id", "features"))
    assert back.join(df.withColumnRenamed("a", "a0"), "row_id").where("a = a0").count() == n
    for shipped in (0, 1 << 20):
        detector = SP.SparseCentroid.fit(encoded, encoder, shipped_bytes=shipped)
        scored = detector.transform(encoded, "row_id").groupBy(F.col("a") == "hot", F.round("score", 9)).count().collect()
        rest = (1 / 3) ** 2 + 100_000 / n**2
        hot, other = -np.sqrt((2 / 3) ** 2 + 100_000 / n**2), -np.sqrt(rest + 1 - 2 / n)
        assert sorted((r[0], r[2]) for r in scored) == [(False, 100_000), (True, 50_000)]
        assert {r[0]: r[1] for r in scored} == {True: pytest.approx(hot, abs=1e-8), False: pytest.approx(other, abs=1e-8)}


@pytest.mark.parametrize("shipped", [0, 1 << 20])
def test_null_and_empty_features(spark, shipped):
    schema = "row_id long, features array<struct<at: long, value: double>>"
    df = spark.createDataFrame([(1, [(0, 2.0), (2, 1.0)]), (2, []), (3, None)], schema)
    params = spark.createDataFrame([(0, True, [3.0]), (1, False, [5.0])], "at long, frequent boolean, vector array<double>")
    table = SP.PositionTable(params, 3, 1, shipped)
    looked = {r["row_id"]: r["v"] for r in table.look_up(df, "row_id", "v").collect()}
    assert looked == {1: [3.0, 0.0], 2: [], 3: None}
    summed = {r["row_id"]: r["v"] for r in table.project(df, "row_id", "v").collect()}
    assert summed == {1: [6.0], 2: [0.0], 3: None}


def test_no_rows_to_fit(spark):
    empty = spark.createDataFrame([], "row_id long, a string")
    encoder = SP.SparseEncoder(["a"]).fit(empty)
    assert encoder.width == 0
    with pytest.raises(ValueError):
        SP.SparseCentroid.fit(encoder.transform(empty), encoder)
