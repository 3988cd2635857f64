import numpy as np
import pytest
from pyspark.sql import functions as F

from relevia.operators import ranking as R


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(R, "RANKS_PER_PIECE", 7)


def direct_metrics(score, y):
    """Definitions on sorted arrays, quadratic where that is simplest."""
    pos, neg = score[y == 1], score[y == 0]
    wins = (pos[:, None] < neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    precision = np.array([(pos <= s).sum() / (score <= s).sum() for s in pos])
    order = np.lexsort((y, score))
    ranks = np.flatnonzero(y[order] == 1) + 1
    return {
        "auc_roc": wins / (len(pos) * len(neg)),
        "auc_pr": precision.mean(),
        "rank_mean": ranks.mean(),
        "rank_std": ranks.std(),
        "max_fraud": pos.max(),
        "min_detect": (score <= pos.max()).sum(),
    }, ranks


@pytest.mark.parametrize("ties", [3, 1000])
def test_report_matches_definitions(spark, many_buckets, ties):
    rng = np.random.default_rng(ties)
    score = rng.integers(-ties, ties, 600).astype(float)
    score[:200] = -1.0  # a third of the rows share one score
    y = (rng.random(600) < 0.2).astype(int)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "score double, y int")
    expected, ranks = direct_metrics(score, y)
    row = R.score_report(df).first()
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name
    assert sorted(r["rank"] for r in R.fraud_ranks(df).collect()) == ranks.tolist()
    n = 50
    threshold = np.sort(score)[n]
    row = R.confusion(df, n).first()
    flagged = score <= threshold
    assert row["threshold"] == threshold
    assert (row["tp"], row["fp"]) == ((flagged & (y == 1)).sum(), (flagged & (y == 0)).sum())
    assert (row["fn"], row["tn"]) == ((~flagged & (y == 1)).sum(), (~flagged & (y == 0)).sum())


def test_groups_nulls_and_single_class(spark):
    rows = [("a", -2.0, 1), ("a", -1.0, 0), ("a", None, 1), ("b", -1.0, 0), ("b", -3.0, 0), ("c", -0.0, 1), ("c", 0.0, 0)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    found = {r["g"]: r for r in R.score_report(df, by=["g"]).collect()}
    assert found["a"]["auc_roc"] == 1.0 and found["a"]["auc_pr"] == 1.0
    assert found["b"]["auc_roc"] is None and found["b"]["rank_mean"] is None
    assert found["c"]["auc_roc"] == 0.5


def test_reversed_scores_mirror_auc(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), int(v)) for s, v in zip(rng.normal(size=200), rng.random(200) < 0.3)]
    df = spark.createDataFrame(rows, "score double, y int")
    forward = R.auc_roc(df).first()[0]
    backward = R.auc_roc(df.withColumn("score", -F.col("score"))).first()[0]
    assert forward + backward == pytest.approx(1.0)


def test_rank_selector_matches_sorting(spark, many_buckets):
    rng = np.random.default_rng(2)
    a = np.round(rng.exponential(10, 500), 1)
    b = rng.integers(0, 4, 500).astype(float)
    b[:180] = 2.0
    df = spark.createDataFrame([(float(x), float(z)) for x, z in zip(a, b)], "a double, b double")
    selector = R.RankSelector(df, ["a", "b"], skip_zero=True)
    kept = {"a": np.sort(a[a != 0]), "b": np.sort(b[b != 0])}
    ranks = {c: [0, 7, len(v) // 2, len(v) - 1] for c, v in kept.items()}
    found = selector.select(ranks)
    for c, wanted in ranks.items():
        for r in wanted:
            assert found[c, r].value == kept[c][r]
            assert found[c, r].below == (kept[c] < kept[c][r]).sum()
            assert found[c, r].through == (kept[c] <= kept[c][r]).sum()
    probabilities = [0.0, 0.1, 1 / 3, 0.5, 1.0]
    percentiles = selector.percentiles(
        {c: probabilities for c in kept}, {c: 0 for c in kept}, {c: len(v) for c, v in kept.items()}
    )
    for c, v in kept.items():
        assert percentiles[c] == pytest.approx(np.percentile(v, [100 * p for p in probabilities]))
    with pytest.raises(ValueError):
        selector.select({"a": [10_000]})


def sorted_ranks(values, ranks):
    kept = np.sort(values)
    return {r: (kept[r], (kept < kept[r]).sum(), (kept <= kept[r]).sum()) for r in ranks}


@pytest.mark.parametrize("kind", ["spread", "third", "two", "zeros"])
def test_wanted_ranks_in_two_passes(spark, kind):
    rng = np.random.default_rng(5)
    values = rng.normal(size=30_000)
    if kind == "third":
        values[:10_000] = values[10_000]  # one value holds a third of the rows
    if kind == "two":
        values = np.where(values > 0, 1.5, -2.0)
    if kind == "zeros":
        values = np.where(rng.random(30_000) < 0.4, -0.0, values.round(2))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    selector = R.RankSelector(df, ["v"])
    ranks = [0, 300, 9_999, 15_000, 29_700, 29_999]
    found = selector.select({"v": ranks})
    assert {r: tuple(vars(found["v", r]).values()) for r in ranks} == sorted_ranks(values, ranks)
    assert selector.passes == 2


def test_second_pass_keeps_few_values(spark):
    values = np.random.default_rng(6).normal(size=200_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    selector = R.RankSelector(df, ["v"])
    found = selector.select({"v": [100_000]})
    assert found["v", 100_000].value == np.sort(values)[100_000]
    assert selector._values.where("v IS NOT NULL").count() < 200_000 * (2 * R.SLACK + 4) / 4096


def test_ranks_outside_their_bracket_cost_a_pass(spark):
    # the shares of the sketch are of very different sizes and ranges, so its steps are far from even
    small = [spark.range(40).selectExpr(f"{k} * 1000.0 + id AS v").coalesce(1) for k in range(1, 6)]
    df = spark.range(50_000).selectExpr("id / 1000.0 AS v").coalesce(1)
    for part in small:
        df = df.union(part)
    values = np.array([r[0] for r in df.collect()], dtype=float)
    selector = R.RankSelector(df, ["v"])
    ranks = [0, 10_000, 25_000, 49_000, 50_100, 50_199]
    found = selector.select({"v": ranks})
    assert {r: tuple(vars(found["v", r]).values()) for r in ranks} == sorted_ranks(values, ranks)
    assert selector.passes <= 3
    again = selector.select({"v": [33_333]})  # not expected beforehand
    assert again["v", 33_333].value == np.sort(values)[33_333]


def test_global_index(spark, many_buckets):
    rows = [(i * 3, "x" if i % 3 else "y") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(7)
    found = sorted((r["id"], r["index"]) for r in R.global_index(df, "id").collect())
    assert [i for _, i in found] == list(range(300))
    grouped = R.global_index(df, "id", by=["g"]).collect()
    for g in ("x", "y"):
        assert [r["index"] for r in sorted(grouped, key=lambda r: r["id"]) if r["g"] == g] == list(
            range(sum(1 for _, v in rows if v == g))
        )
