import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.operators import consistency as C
from relevia.operators import similarity as S


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(3)
    values = rng.normal(size=(4, 40, 9))
    values[:, 5] = 0.0
    return values


@pytest.fixture(scope="module")
def long(spark, cube):
    rows = [(s, i, cube[s, i].tolist()) for s in range(4) for i in range(40) if not (s == 3 and i == 7)]
    return spark.createDataFrame(rows, "seed int, row_id long, phi array<double>")


def top(v, k):
    return set(np.argsort(np.abs(v), kind="stable")[-k:])


def direct_pair(a, b, k):
    agree = [len(top(x, k) & top(y, k)) / k for x, y in zip(a, b)]
    signed = [sum(x[f] * y[f] >= 0 for f in top(x, k) & top(y, k)) / k for x, y in zip(a, b)]
    return {
        "euclid_abs": np.linalg.norm(np.abs(a) - np.abs(b), axis=1).mean(),
        "euclid": np.linalg.norm(a - b, axis=1).mean(),
        "sign_disagreement": 1 - np.mean(signed),
        "feature_disagreement": 1 - np.mean(agree),
    }


def windows(v, n):
    order = np.argsort(v, kind="stable")[::-1][:n]
    return [set(order[s : s + 3]) for s in range(n - 2)]


def test_all_pairs(long, cube):
    unit = cube / np.maximum(np.linalg.norm(cube, axis=2, keepdims=True), 1e-300)
    found = C.consistency(long, k=4, ranking_k=0.6).collect()
    assert sorted((r["seed_a"], r["seed_b"]) for r in found) == [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for r in found:
        rows = [i for i in range(40) if not (r["seed_b"] == 3 and i == 7)]
        a, b = unit[r["seed_a"], rows], unit[r["seed_b"], rows]
        assert r["rows"] == len(rows)
        for name, value in direct_pair(a, b, 4).items():
            assert r[name] == pytest.approx(value), name
        ranking = np.mean([
            np.mean([1 - len(p & q) / 3 for p, q in zip(windows(x, 5), windows(y, 5))]) for x, y in zip(a, b)
        ])
        assert r["ranking"] == pytest.approx(ranking)


def test_expression_metrics_agree_with_the_job(long, cube):
    wide, seeds = C.model_columns(long)
    a, b = F.col("m0"), F.col("m1")
    names = ["euclid", "euclid_abs", "sign_disagreement", "feature_disagreement"]
    means = wide.agg(*[F.avg(C.pair_metric(n, a, b, 9, 4)).alias(n) for n in names]).first()
    for name, value in direct_pair(cube[0], cube[1], 4).items():
        assert means[name] == pytest.approx(value)
    itself = wide.select(C.pair_metric("euclid", a, a, 9).alias("d"), C.pair_metric("feature_disagreement", a, a, 9).alias("f"))
    assert all(r["d"] == 0.0 and r["f"] == 0.0 for r in itself.collect())


def test_fraction_k():
    assert C.percent_to_int(0.25, 18) == 5
    for bad in (0.0, 1.2):
        with pytest.raises(ValueError):
            C.percent_to_int(bad, 10)


def test_ranking_needs_one_window(long):
    wide, _ = C.model_columns(long)
    assert wide.select(C.topk_ranking_distance(F.col("m0"), F.col("m1"), 9, 0.25).alias("d")).first()["d"] is None


@pytest.mark.parametrize("k", [1.0, 0.5])
def test_as_written_distance(long, cube, k):
    a, b = cube[0], cube[1]
    n = int(9 * k)

    def orders(x):
        return np.argsort(x, axis=1, kind="stable")[:, -n:]

    distance = np.linalg.norm(a[:, orders(a)] - b[:, orders(b)], axis=1).mean()
    wide, _ = C.model_columns(long)
    assert C.topk_euclid_as_written(wide, "m0", "m1", 9, k).first()[0] == pytest.approx(distance)


def test_histogram(spark):
    rng = np.random.default_rng(5)
    values = rng.gamma(2.0, size=300)
    pairs = spark.createDataFrame([(float(v), 0.4) for v in values], "euclid double, other double")
    found = C.density_histogram(pairs, ["euclid", "other"], bins=10)
    density, edges = np.histogram(values / values.max(), bins=10, density=True)
    rows = {r["bin"]: r for r in found.where("metric = 'euclid'").collect()}
    for i, d in enumerate(density):
        assert (rows[i]["density"] if i in rows else 0.0) == pytest.approx(d)
        if i in rows:
            assert rows[i]["from_value"] == pytest.approx(edges[i])
    flat = found.where("metric = 'other'").collect()
    assert [(r["bin"], r["pairs"], r["density"]) for r in flat] == [(5, 300, pytest.approx(10.0))]


def test_row_similarity(spark, cube):
    rows = [(i, "a" if i % 4 else "b", cube[0, i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, label string, phi array<double>")
    flags = cube[0] > 0.25 * cube[0].max(axis=1, keepdims=True)
    direct = (flags[:, None, :] != flags[None, :, :]).mean(axis=2)
    found = S.hamming_matrix(df).collect()
    assert len(found) == 1600
    assert all(r["distance"] == pytest.approx(direct[r["row_a"], r["row_b"]]) for r in found)
    label = np.array([r[1] for r in rows])
    for r in S.class_distances(df).collect():
        block = direct[np.ix_(label == r["class_a"], label == r["class_b"])]
        if r["class_a"] == r["class_b"]:
            expected = block.sum() / (len(block) * (len(block) - 1))
        else:
            expected = block.mean()
        assert r["distance"] == pytest.approx(expected)


@pytest.mark.parametrize("width", [1, 64, 150])
def test_matrix_in_blocks(spark, monkeypatch, width):
    """Blocks far smaller than the rows, more fields than a word has, equal rows and rows without attributions."""
    monkeypatch.setattr(S, "BLOCK", 8)
    phi = np.random.default_rng(width).random((60, width)) ** 3
    phi[50:] = phi[:10]
    rows = [(i, v.tolist()) for i, v in enumerate(phi)] + [(99, None)]
    df = spark.createDataFrame(rows, "row_id long, phi array<double>")
    flags = phi > 0.25 * phi.max(axis=1, keepdims=True)
    direct = (flags[:, None, :] != flags[None, :, :]).mean(axis=2)
    found = S.hamming_matrix(df).collect()
    assert sorted((r["row_a"], r["row_b"]) for r in found) == [(a, b) for a in range(60) for b in range(60)]
    assert all(r["distance"] == pytest.approx(direct[r["row_a"], r["row_b"]]) for r in found)
    text = ["".join("01"[int(x)] for x in f) for f in flags]
    place = {t: i for i, t in enumerate(text)}
    pairs = S.pattern_matrix(df).collect()
    assert len(pairs) == len(place) ** 2
    for r in pairs:
        assert (r["rows_a"], r["rows_b"]) == (text.count(r["pattern_a"]), text.count(r["pattern_b"]))
        assert r["distance"] == pytest.approx(direct[place[r["pattern_a"]], place[r["pattern_b"]]])


def test_matrix_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "row_id long, phi array<double>")
    assert S.hamming_matrix(df).collect() == [] and S.pattern_matrix(df).collect() == []


@pytest.mark.parametrize("held", [0, 10**9])
def test_pairs_in_tiles_and_chunks(spark, cube, monkeypatch, held):
    """Small tiles and chunks, rows that some models do not explain, and a seed that is not asked for."""
    expected = {
        (r["seed_a"], r["seed_b"]): tuple(r)[2:]
        for r in C.consistency(_explanations(spark, cube), k=3, ranking_k=0.8, seeds=list(range(1, len(cube)))).collect()
    }
    monkeypatch.setattr(C, "TILE_MODELS", 2)
    monkeypatch.setattr(C, "CHUNK_CELLS", 500)
    monkeypatch.setattr(C, "TILE_CELLS", 50)
    monkeypatch.setattr(C, "HELD_PAIRS", held)
    found = C.consistency(_explanations(spark, cube), k=3, ranking_k=0.8, seeds=list(range(1, len(cube)))).collect()
    assert {(r["seed_a"], r["seed_b"]) for r in found} == set(expected)
    for r in found:
        assert tuple(r)[2:] == pytest.approx(expected[r["seed_a"], r["seed_b"]])


def _explanations(spark, cube):
    rows = [(s, i, v.tolist()) for s, m in enumerate(cube) for i, v in enumerate(m) if (s + i) % 7]
    rows.append((1, 10_000, None))
    return spark.createDataFrame(rows, "seed int, row_id long, phi array<double>")


def test_two_thousand_models(spark):
    """No limit of models: every pair is there, and those of the first models equal the direct distances."""
    phi = np.random.default_rng(5).normal(size=(2_000, 6, 4))
    rows = [(s, i, v.tolist()) for s, m in enumerate(phi) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "seed int, row_id long, phi array<double>")
    pairs = C.consistency(df, k=2, normalize=False, seeds=list(range(2_000)))
    apart = np.sqrt(((phi[:20, None] - phi[None]) ** 2).sum(axis=3)).mean(axis=2)
    total = pairs.agg(F.count("rows"), F.sum("rows"), F.sum(F.when(F.col("seed_a") < 20, F.col("euclid")))).first()
    assert total[:2] == (2_000 * 1_999 // 2, 6 * 2_000 * 1_999 // 2)
    assert total[2] == pytest.approx(sum(apart[i, i + 1 :].sum() for i in range(20)))
