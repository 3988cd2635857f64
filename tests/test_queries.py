"""Every registered query against its SQL, and shape checks for those without."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, folder, duck, name):
    result = QUERIES[name](spark, folder)
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(result.columns)
    assert columns == sorted(names)
    ours = _sorted([tuple(r[c] for c in columns) for r in result.collect()])
    theirs = _sorted([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()])
    assert len(ours) > 0
    assert ours == theirs


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", ["shap_top_features", "ocsvm", "model_set", "bucket_kmeans"])
def test_unchecked_queries_are_finite(spark, folder, name):
    for row in QUERIES[name](spark, folder).collect():
        for value in row:
            assert value is not None
            assert not isinstance(value, float) or math.isfinite(value)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
