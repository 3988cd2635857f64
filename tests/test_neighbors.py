import numpy as np
import pytest

from relevia.operators import neighbors as N


def frame(spark, ids, x, keys=None):
    rows = [(int(i), v.tolist(), "k" if keys is None else keys[j]) for j, (i, v) in enumerate(zip(ids, x))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, key string")


def brute(query_ids, queries, base_ids, base, k, skip_same, query_keys=None, base_keys=None):
    found = set()
    for i, q in zip(query_ids, queries):
        d = np.sqrt(((base - q) ** 2).sum(axis=1))
        allowed = np.ones(len(base), bool) if not skip_same else base_ids != i
        if query_keys is not None:
            allowed &= base_keys == query_keys[list(query_ids).index(i)]
        order = [j for j in np.lexsort((base_ids, d)) if allowed[j]][:k]
        found |= {(int(i), int(base_ids[j]), r + 1) for r, j in enumerate(order)}
    return found


def triples(df):
    return {(r["query"], r["neighbor"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0.0, 5.0, 20.0)])
    x[:70] = x[0]  # more than a third of the rows are one point
    return rng.permutation(1000)[: len(x)], x


OPTIONS = [{}, {"broadcast_values": 0, "cell_rows": 20, "block_rows": 32}, {"broadcast_values": 0}]


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("skip_same", [True, False])
def test_self_join(spark, points, options, skip_same):
    ids, x = points
    df = frame(spark, ids, x).repartition(5)
    assert triples(N.knn_join(df, df, 4, skip_same=skip_same, **options)) == brute(ids, x, ids, x, 4, skip_same)


@pytest.mark.parametrize("options", OPTIONS[:2])
def test_keyed_join(spark, points, options):
    ids, x = points
    keys = np.array(["hot" if i < 150 else f"k{i % 3}" for i in range(len(x))])
    df = frame(spark, ids, x, keys.tolist())
    found = N.knn_join(df, df, 3, key="key", skip_same=True, **options)
    assert triples(found) == brute(ids, x, ids, x, 3, True, keys, keys)


@pytest.mark.parametrize("options", OPTIONS[:2])
def test_other_queries_and_small_base(spark, points, options):
    ids, x = points
    queries = frame(spark, [5000, 5001], np.array([[0.1, 0, 0], [30.0, 30, 30]]))
    base = frame(spark, ids, x)
    got = triples(N.knn_join(queries, base, 2, **options))
    assert got == brute([5000, 5001], np.array([[0.1, 0, 0], [30.0, 30, 30]]), ids, x, 2, False)
    assert N.knn_join(queries, base.limit(1), 3, **options).count() == 2


@pytest.mark.parametrize("options", OPTIONS[:2])
def test_rows_with_several_keys(spark, points, options):
    """Neighbours per key, as if the join ran once for each key on the rows that have it."""
    ids, x = points
    keys = [[f"k{i % 2}"] if i % 3 else ["k0", "k1", "k0"] for i in range(len(x))]
    keys[3], keys[4] = [], None
    rows = [(int(i), v.tolist(), key) for i, v, key in zip(ids, x, keys)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, key array<string>")
    got = {(r["key"], r["query"], r["neighbor"], r["rank"]) for r in N.knn_join(df, df, 3, key="key", skip_same=True, **options).collect()}
    want = set()
    for one in ("k0", "k1"):
        mine = [j for j, key in enumerate(keys) if key and one in key]
        want |= {(one, *t) for t in brute(ids[mine], x[mine], ids[mine], x[mine], 3, True)}
    assert got == want


def test_pairs_per_query_do_not_grow_with_the_table(spark):
    per_query = []
    for rows in (2_000, 8_000):
        x = np.random.default_rng(rows).random((rows, 2))
        df = frame(spark, range(rows), x).repartition(4)
        counter = spark.sparkContext.accumulator(0)
        queries = df.where("row_id % 10 = 0")
        found = N.knn_join(queries, df, 5, broadcast_values=0, cell_rows=50, compared=counter)
        some = queries.where("row_id % 500 = 0").collect()
        got = {t for t in triples(found) if t[0] % 500 == 0}
        assert got == brute([r["row_id"] for r in some], np.array([r["features"] for r in some]), np.arange(rows), x, 5, False)
        per_query.append(counter.value / (rows / 10))
    assert per_query[1] < 1.5 * per_query[0] and per_query[1] < 800


def test_empty_sides(spark, points):
    ids, x = points
    df = frame(spark, ids, x)
    assert N.knn_join(df, df.limit(0), 2, broadcast_values=0).count() == 0
    assert N.knn_join(df.limit(0), df, 2, broadcast_values=0).count() == 0


def test_nearest_reference(spark, points):
    ids, x = points
    queries = frame(spark, [5000], np.array([[5.0, 5.0, 5.0]]))
    row = N.nn_reference(queries, frame(spark, ids, x)).first()
    j = np.argmin(((x - 5.0) ** 2).sum(axis=1))
    assert row["neighbor"] == ids[j] and row["reference"] == x[j].tolist()


def direct_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, order, axis=1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, order, axis=1), kd[order])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return density[order].mean(axis=1) / density


def test_lof(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(50, 2)), [[9.0, 9.0]]])
    df = frame(spark, range(51), x)
    found = {r["row_id"]: r["lof"] for r in N.lof(df, 6).collect()}
    assert [found[i] for i in range(51)] == pytest.approx(direct_lof(x, 6).tolist())
    assert max(found, key=found.get) == 50
    fresh = N.lof(df.where("row_id < 50"), 6, queries=df.where("row_id = 50")).first()
    assert fresh["lof"] > 2 and fresh["score"] == -fresh["lof"]


@pytest.mark.parametrize("key", [None, "key"])
def test_many_pairs_go_over_the_tree(spark, monkeypatch, key):
    """Queries that would fit a broadcast are not held against every base row when there are many of both."""
    monkeypatch.setattr(N, "SCAN_PAIRS", 100_000, raising=False)
    x = np.random.default_rng(3).random((4_000, 2))
    keys = np.array([f"k{i % 2}" for i in range(len(x))])
    df = frame(spark, range(len(x)), x, keys.tolist()).repartition(4)
    counter = spark.sparkContext.accumulator(0)
    found = N.knn_join(df, df, 3, key=key, skip_same=True, cell_rows=100, compared=counter).where("query % 100 = 0")
    some = np.arange(0, len(x), 100)
    of = [keys[some], keys] if key else [None, None]
    assert triples(found) == brute(some, x[some], np.arange(len(x)), x, 3, True, *of)
    assert 0 < counter.value < len(x) ** 2 / 8


def test_a_tile_keeps_few_rows_per_query(monkeypatch):
    """Candidates of many cells never wait together, whatever the number of cells."""
    rng = np.random.default_rng(4)
    x, k, most = rng.normal(size=(3_000, 32)), 20, []
    tree = N._Tree(x[:60], 8)
    _, _, cell, r = tree.place(x)
    whole = N._keep_best
    monkeypatch.setattr(N, "_keep_best", lambda parts, k: (most.append(sum(len(p[0]) for p in parts)), whole(parts, k))[1])
    ids = np.arange(len(x))
    query, neighbor, _ = N._tile(tree, (ids, x, cell, np.full(len(x), np.inf)), (ids, x, cell, r), k, True, True)
    assert max(most) <= 6 * k * N.TILE_QUERIES
    got = {(q, n) for q, n in zip(query.tolist(), neighbor.tolist()) if q % 300 == 0}
    assert got == {(q, n) for q, n, _ in brute(ids[::300], x[::300], ids, x, k, True)}
