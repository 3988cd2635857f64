"""Sinks: explanations, scores, summaries and run records, all append-only Parquet."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_COLUMNS = ["model", "method", "background"]


def write_explanation(
    df: DataFrame, path: str, model: str, method: str, background: str, if_exists: str = "append"
) -> None:
    """Write long or vector explanations; ``if_exists`` is ``append`` or ``ignore``.

    Partitioned by run, so that reading one run prunes the others. ``ignore`` leaves a run alone
    that is there already; other runs in the folder do not matter.
    """
    if if_exists not in ("append", "ignore"):
        raise ValueError(f"unknown mode {if_exists!r}")
    run = dict(zip(RUN_COLUMNS, (model, method, background)))
    if if_exists == "ignore" and _has_run(df.sparkSession, path, run):
        return
    tagged = df.withColumns({c: F.lit(v) for c, v in run.items()})
    tagged.write.mode("append").partitionBy(*RUN_COLUMNS).parquet(path)


def _has_run(spark: SparkSession, path: str, run: Mapping[str, str]) -> bool:
    """Whether a run has rows; the filter is on partition columns, so only their folders are listed."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    if not set(run) <= set(found.columns):
        return False
    same = [F.col(c).cast("string") == F.lit(v) for c, v in run.items()]
    return not found.where(same[0] & same[1] & same[2]).isEmpty()


def write_explanation_set(df: DataFrame, folder: str, name: str, features: Sequence[str]) -> None:
    """One set of wide CSV files per seed, named ``<name>_<seed>.csv``, written in one job.

    ``df`` has seed, row_id and the vector phi.
    """
    file = F.concat(F.lit(f"{name}_"), F.col("seed").cast("string"), F.lit(".csv"))
    columns = [F.element_at("phi", i + 1).alias(c) for i, c in enumerate(features)]
    df.select(file.alias("file"), "row_id", *columns).write.mode("append").partitionBy("file").csv(folder, header=True)


def append_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").option("mergeSchema", "true").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores and labels of all splits as (split, row_id, score, y)."""
    scores.select("split", "row_id", "score", "y").write.mode("append").partitionBy("split").parquet(path)


def write_run(
    spark: SparkSession, path: str, job: str, seed: int, params: Mapping, metrics: Mapping[str, float | None]
) -> None:
    """One record per run: job, seed, parameters as JSON, metrics as a map."""
    values = {k: None if v is None else float(v) for k, v in metrics.items()}
    row = [(job, int(seed), json.dumps(dict(params), sort_keys=True, default=str), values)]
    spark.createDataFrame(row, "job string, seed int, params string, metrics map<string,double>").write.mode(
        "append"
    ).parquet(path)
