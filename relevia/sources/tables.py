"""Scans: ledgers, flows, expert marks and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relevia.operators.ranking import global_index
from relevia.operators.shape import binarize_is_normal, split_by_row
from relevia.sources.catalog import _language_column, flow_schema

# Folder, files and split row of the named tasks.
TASKS = {
    "session1": {"folder": "ex2", "train": "normal_1.csv", "fraud": "fraud_1.csv", "split_id": 19716},
    "session2": {"folder": "ex1", "train": "normal_2.csv", "eval": "fraud_2.csv", "test": "fraud_3.csv"},
}


def with_file_position(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Number the rows of one file 0, 1, 2, ... in file order."""
    return global_index(df.withColumn("_place", F.monotonically_increasing_id()), "_place", out).drop("_place")


def read_ledger(spark: SparkSession, path: str, catalog: DataFrame, language: str = "en") -> DataFrame:
    """Ledger rows with catalog names by position, typed by role, and a ``row_id``."""
    column = _language_column(language)
    roles = catalog.orderBy("pos").select(F.col(column).alias("name"), "role").collect()
    schema = T.StructType(
        [T.StructField(r["name"], T.DoubleType() if r["role"] == "num" else T.StringType()) for r in roles]
    )
    rows = spark.read.csv(path, schema=schema, header=True, encoding="ISO-8859-1", enforceSchema=True)
    return with_file_position(rows)


def load_splits(spark: SparkSession, folder: str, name: str, catalog: DataFrame, language: str = "en") -> DataFrame:
    """Training, evaluation and test rows of a named task in one frame with ``split``."""
    task = next((t for key, t in TASKS.items() if key in name), None)
    if task is None:
        raise ValueError(f"expected one of {sorted(TASKS)} in {name!r}")

    def scan(file: str) -> DataFrame:
        return read_ledger(spark, f"{folder}/{task['folder']}/{file}", catalog, language)

    train = scan(task["train"]).withColumn("split", F.lit("train"))
    if "split_id" in task:
        frauds = scan(task["fraud"])
        return train.unionByName(frauds.withColumn("split", split_by_row(F.col("row_id"), task["split_id"])))
    evaluation = scan(task["eval"]).withColumn("split", F.lit("eval"))
    test = scan(task["test"]).withColumn("split", F.lit("test"))
    return train.unionByName(evaluation).unionByName(test)


def read_flows(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    numeric: str = "quantized",
    is_normal: bool = False,
    attack_type: bool = False,
    leading: Sequence[str] = (),
) -> DataFrame:
    """Encoded flow rows with narrow types; ``leading`` names text columns before them.

    A gzip file is one task: read it once and keep it as Parquet.
    """
    first = "".join(f"`{c}` string, " for c in leading)
    rows = spark.read.csv(path, schema=first + flow_schema(numeric, is_normal, attack_type), header=True)
    return rows.select(*[f"`{c}`" for c in columns]) if columns is not None else rows


def flow_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The encoded flow columns as one vector."""
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]))


def flow_rows(df: DataFrame, split: str, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, split, y, features) of encoded flows, as detector runs expect them."""
    labelled = df.withColumn("y", binarize_is_normal(F.col("isNormal")))
    vectors = flow_features(labelled, columns)
    return vectors.select(F.col(row_id).cast("long").alias("row_id"), F.lit(split).alias("split"), "y", "features")


def read_gold(spark: SparkSession, path: str, drop: int | Sequence[str] = 0) -> DataFrame:
    """(row_id, feature, gold): 1 where the cell is ``X``.

    The first column is the row id, whatever its header. ``drop`` is a count of trailing
    note columns or a list of column names.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    names = raw.columns[1:]
    names = names[: len(names) - drop] if isinstance(drop, int) else [c for c in names if c not in set(drop)]
    marks = raw.select(
        F.col(f"`{raw.columns[0]}`").cast("long").alias("row_id"),
        *[F.coalesce((F.col(f"`{c}`") == "X").cast("int"), F.lit(0)).alias(c) for c in names],
    )
    return marks.unpivot(["row_id"], [f"`{c}`" for c in names], "feature", "gold")


def _wide_to_long(raw: DataFrame, id_column: str, keys: Sequence[str]) -> DataFrame:
    names = [c for c in raw.columns if c not in {id_column, "expected_value", *keys}]
    typed = raw.withColumnRenamed(id_column, "row_id").select(
        F.col("row_id").cast("long").alias("row_id"),
        *[k for k in keys if k != "row_id"],
        *[F.col(f"`{c}`").cast("double").alias(c) for c in names],
    )
    return typed.unpivot(list(keys), [f"`{c}`" for c in names], "feature", "phi")


def read_explanation(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, feature, phi) from a wide file whose first column is the row id."""
    raw = spark.read.csv(path, header=True)
    return _wide_to_long(raw, raw.columns[0], ["row_id"])


def read_explanation_set(spark: SparkSession, folder: str) -> DataFrame:
    """(seed, row_id, feature, phi) from all files of a folder; the seed ends the file name."""
    raw = spark.read.csv(f"{folder}/*.csv", header=True)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"_([0-9]+)\.csv(?:/[^/]*)?$", 1).cast("int")
    return _wide_to_long(raw.select("*", seed.alias("seed")), raw.columns[0], ["seed", "row_id"])
