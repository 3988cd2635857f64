import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.operators import encode as E
from relevia.operators import ranking as R


@pytest.fixture
def frame(spark):
    rows = [("a", 1.0, 0.0), ("b", -50.0, 0.0), (None, None, 0.0), ("a", 0.5, 0.0)]
    return spark.createDataFrame(rows, "c string, x double, z double")


def vectors(df):
    return [list(r[0]) for r in df.select("features").collect()]


def test_onehot(frame):
    encoder = E.OneHotEncoder(["c"]).fit(frame)
    assert encoder.categories == {"c": ["a", "b", "nan"]}
    assert vectors(encoder.transform(frame)) == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]]
    assert [n for n, _ in encoder.catalog()] == ["c_a", "c_b", "c_nan"]
    unseen = E.OneHotEncoder(["c"], off_value=-1).fit(frame.where("c = 'a'"))
    assert vectors(unseen.transform(frame)) == [[1], [-1], [-1], [1]]
    assert [r["c"] for r in unseen.inverse(unseen.transform(frame)).collect()] == ["a", None, None, "a"]


@pytest.mark.parametrize("literal", [True, False])
def test_ordinal_both_paths(frame, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr(E, "MAX_LITERAL_CATEGORIES", 0)
    encoder = E.OrdinalEncoder(["c"]).fit(frame.where("c IS NOT NULL"))
    assert (encoder.categories is not None) == literal
    encoded = encoder.transform(frame)
    assert sorted(vectors(encoded)) == [[E.UNSEEN_CODE], [0], [0], [1]]
    back = encoder.inverse(encoded.drop("c"))
    assert sorted(str(r["c"]) for r in back.collect()) == ["None", "a", "a", "b"]


def test_log_scale(frame):
    plain = vectors(E.LogScaler(["x"]).transform(frame))
    assert np.allclose(np.ravel(plain), [1.0, -(np.log10(50) + 1), 0.0, 0.5])
    flagged = E.LogScaler(["x"], nan_bucket=True)
    assert [n for n, _ in flagged.catalog()] == ["x_", "x_0"]
    last = E.LogScaler(["x", "z"], numeric_last=True)
    assert [n for n, _ in last.catalog()] == ["x_0", "z_0", "x_", "z_"]
    assert vectors(last.transform(frame))[2] == [1, 1, 0, 0]


def test_linear_scalers(frame):
    x = np.array([1.0, -50.0, 0.0, 0.5])
    z = E.ZScoreScaler(["x", "z"], nan_bucket=True).fit(frame)
    got = np.array(vectors(z.transform(frame)))
    assert np.allclose(got[:, 0], (x - x.mean()) / x.std())
    assert (got[:, 1] == 0).all() and got[:, 2].tolist() == [0, 0, 1, 0]
    m = np.array(vectors(E.MinMaxScaler(["x"]).fit(frame).transform(frame)))
    assert np.allclose(m[:, 0], (x + 50) / 51)


def recipe_edges(values, strategy, n=5):
    v = np.sort(values[values != 0])
    if strategy == "uniform":
        return np.linspace(v[0], v[-1], n + 1)
    if strategy == "quantile":
        return np.percentile(v, np.linspace(0, 100, n + 1))
    lo, hi = v[int(0.01 * len(v))], v[int(0.99 * len(v))]
    inner = v[(v > lo) & (v < hi)]
    return np.r_[v[0], np.percentile(inner, np.linspace(0, 100, n - 1)), v[-1]]


@pytest.mark.parametrize("strategy", ["uniform", "quantile", "quantile_outlier"])
def test_bucket_edges_and_numbers(spark, monkeypatch, strategy):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 20)
    rng = np.random.default_rng(4)
    values = np.where(rng.random(800) < 0.1, 0.0, rng.normal(0, 50, 800))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    encoder = E.BucketEncoder(["v"], strategy=strategy, encode="ordinal").fit(df)
    edges = recipe_edges(values, strategy)
    assert np.allclose(encoder.edges["v"], edges)
    numbers = np.clip(np.digitize(values + 1e-8 + 1e-5 * np.abs(values), edges[1:]), 0, 4)
    numbers[values == 0] = 5
    assert np.ravel(vectors(encoder.transform(df))).astype(int).tolist() == numbers.tolist()


def test_kmeans_buckets(spark):
    values = [1.0, 2.0, 3.0, 40.0, 41.0, 42.0, 90.0, 91.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    encoder = E.BucketEncoder(["v"], n_buckets=3, strategy="kmeans").fit(df)
    assert encoder.edges["v"] == [1.0, 21.5, 65.75, 91.0]


def test_degenerate_columns(spark):
    df = spark.createDataFrame([(0.0, 7.0, 1.0), (0.0, 0.0, 2.0), (None, 7.0, 2.0)], "zero double, same double, two double")
    encoder = E.BucketEncoder(["zero", "same", "two"], encode="ordinal").fit(df)
    got = vectors(encoder.transform(df))
    assert [g[0] for g in got] == [5, 5, 5]
    assert [g[1] for g in got] == [0, 5, 0]
    wide = E.BucketEncoder(["zero", "same", "two"]).fit(df)
    assert len(wide.catalog()) == 18 == len(vectors(wide.transform(df))[0])
    assert [n for n, _ in wide.catalog()][-1] == "two_0"


def test_encoder_pairs(frame):
    encoder = E.make_encoder(["c"], ["x"], "onehot", "buckets", n_buckets=2).fit(frame)
    catalog = encoder.catalog()
    assert [e.source for e in catalog] == ["c"] * 3 + ["x"] * 3
    assert [e.position for e in catalog] == list(range(6))
    assert all(sum(v) == 2 for v in vectors(encoder.transform(frame)))
    only = E.make_encoder(["c"], ["x"], "None", "log10").fit(frame)
    assert len(vectors(only.transform(frame))[0]) == 1
    for bad in ({"categorical": "x"}, {"numeric": "x"}):
        with pytest.raises(ValueError):
            E.make_encoder(["c"], ["x"], **bad)
    with pytest.raises(ValueError):
        E.BucketEncoder(["x"], strategy="other")


def test_training_counts_are_kept(frame):
    encoder = E.OneHotEncoder(["c"]).fit(frame)
    sums = np.array(vectors(encoder.transform(frame))).sum(axis=0)
    counts = {r["v"]: r["count"] for r in frame.groupBy(F.coalesce("c", F.lit("nan")).alias("v")).count().collect()}
    assert sums.tolist() == [counts[v] for v in encoder.categories["c"]]


def test_long_dictionary_keeps_its_codes(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_LITERAL_CATEGORIES", 5)
    names = [f"{c}{i}" for i in range(40) for c in "aZé"]
    df = spark.createDataFrame([(n, "x" if i % 2 else None) for i, n in enumerate(names)], "a string, b string").repartition(6)
    encoder = E.OrdinalEncoder(["a", "b"]).fit(df)
    place = {v: i for i, v in enumerate(sorted(names))}
    found = encoder.transform(df).collect()
    assert all(r["features"] == [place[r["a"]], 1.0 if r["b"] == "x" else 0.0] for r in found)
    back = encoder.inverse(encoder.transform(df).select("features")).collect()
    assert {r["a"] for r in back} == set(names) and {r["b"] for r in back} == {"x", "nan"}


@pytest.mark.parametrize("ties", [0.0, 0.34, 0.97])
def test_outlier_buckets_read_the_rows_twice(spark, monkeypatch, ties):
    rng = np.random.default_rng(8)
    values = np.round(rng.exponential(5, 20_000) + 0.1, 3)
    values[rng.random(20_000) < ties] = np.quantile(values, 0.01)
    values[:50] = 0.0
    seen = []
    monkeypatch.setattr(E, "RankSelector", lambda *a, **k: seen.append(R.RankSelector(*a, **k)) or seen[-1])
    encoder = E.BucketEncoder(["v"]).fit(spark.createDataFrame([(float(v),) for v in values], "v double"))
    kept = np.sort(values[values != 0])
    low, high = kept[int(len(kept) * 0.01)], kept[int(len(kept) * 0.99)]
    inner = kept[(kept > low) & (kept < high)]
    middle = np.quantile(inner, [0, 1 / 3, 2 / 3, 1])
    assert encoder.edges["v"] == pytest.approx([kept[0], *middle, kept[-1]])
    assert seen[0].passes == 2
