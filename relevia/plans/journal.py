"""A ledger joined from order tables, in the roles the anomaly operators expect.

The source systems keep a ledger in header and line tables; here the header is
``orders``, the lines are ``lineitem`` and the business partner is ``customer``.
Order lines are summed per order before the join, so the join moves one row per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.operators.shape import NORMAL

CATEGORICAL = ["status", "priority", "segment"]
NUMERIC = ["totalprice", "n_lines", "qty", "amt", "disc", "tax"]

TRAIN_UNTIL = "1998-01-01"
EVAL_UNTIL = "2000-01-01"

# Marks an auditor would set: the value from which a field speaks for a fraud; tax never does.
GOLD_FROM = {"totalprice": 400000.0, "n_lines": 8.0, "qty": 200.0, "amt": 400000.0, "disc": 0.1, "tax": None}

LABEL_RULES = [
    ("Fraud_Kickback", "totalprice >= 475000 AND disc >= 0.09"),
    ("Fraud_Larceny", "qty >= 220"),
    ("Event_Bulk", "n_lines >= 9"),
]

# Trees on the z-scores for a check of scoring: field, threshold, left, right and path of each node.
_END = float("inf")
FIXED_TREES = [
    [(0, 0.5, 1, 2, 0.0), (3, -0.25, 3, 4, 0.0), (2, 1.5, 5, 6, 0.0),
     (0, _END, 3, 3, 4.5), (0, _END, 4, 4, 3.0), (0, _END, 5, 5, 2.75), (0, _END, 6, 6, 2.0)],
    [(4, 0.0, 1, 2, 0.0), (0, _END, 1, 1, 5.25), (1, 1.0, 3, 4, 0.0), (0, _END, 3, 3, 3.5), (0, _END, 4, 4, 2.0)],
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, split, label, categorical and numeric fields; one row per order."""
    lines = (
        read_table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("amt"),
            F.max("l_discount").alias("disc"),
            F.max("l_tax").alias("tax"),
        )
    )
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = (
        read_table(spark, folder, "orders")
        # headers and lines grow together, and the sums are already partitioned by order
        .join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        # an order without a known customer stays, without a segment
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.when(F.col("o_orderdate") < F.lit(TRAIN_UNTIL).cast("timestamp_ntz"), "train")
            .when(F.col("o_orderdate") < F.lit(EVAL_UNTIL).cast("timestamp_ntz"), "eval")
            .otherwise("test")
            .alias("split"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_totalprice").alias("totalprice"),
            F.col("n_lines").cast("double").alias("n_lines"),
            "qty",
            "amt",
            "disc",
            "tax",
        )
    )
    label = F.lit(NORMAL)
    for name, rule in reversed(LABEL_RULES):
        label = F.when(F.expr(rule), F.lit(name)).otherwise(label)
    return joined.withColumn("label", label)


def gold_marks() -> Column:
    """``array<int>``: one mark per numeric field."""
    return F.array(
        *[
            F.lit(0) if GOLD_FROM[c] is None else F.coalesce((F.col(c) >= GOLD_FROM[c]).cast("int"), F.lit(0))
            for c in NUMERIC
        ]
    )


def numeric_values() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0.0)) for c in NUMERIC]


def zscore_params(df: DataFrame, digits: int = 4) -> tuple[list[float], list[float]]:
    """Training mean and population deviation per numeric field, rounded to a fixed scale."""
    fitted = df.where("split = 'train'").agg(
        *[F.round(F.avg(v), digits).alias(f"mean_{c}") for c, v in zip(NUMERIC, numeric_values())],
        *[F.round(F.stddev_pop(v), digits).alias(f"std_{c}") for c, v in zip(NUMERIC, numeric_values())],
    ).first()
    return (
        [fitted[f"mean_{c}"] or 0.0 for c in NUMERIC],
        [fitted[f"std_{c}"] or 1.0 for c in NUMERIC],
    )


def standardized(df: DataFrame) -> DataFrame:
    """Add ``features``: z-scores of the numeric fields with the training parameters."""
    means, stds = zscore_params(df)
    return df.withColumn(
        "features", F.array(*[(v - m) / s for v, m, s in zip(numeric_values(), means, stds)])
    )


def explained(df: DataFrame, signed: bool = False) -> DataFrame:
    """row_id, split, label, phi (squared z-score per field, with its sign if ``signed``), gold."""
    return standardized(df).select(
        "row_id", "split", "label", "segment",
        F.transform("features", lambda z: z * (F.abs(z) if signed else z)).alias("phi"),
        gold_marks().alias("gold"),
    )


def scored(df: DataFrame) -> DataFrame:
    """row_id, split, label, score (lower is more anomalous) and y."""
    return standardized(df).select(
        "row_id", "split", "label",
        (-V.l2_norm(F.col("features"))).alias("score"),
        (F.col("label").startswith("Fraud_")).cast("int").alias("y"),
    )


MAX_MODELS = 1_000


def left_out_segments(df: DataFrame) -> list[str]:
    """The market segments in order; model ``s`` of the set is fitted without segment ``s``."""
    segments = [r[0] for r in df.select("segment").distinct().take(MAX_MODELS + 1)]
    if len(segments) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} segments")
    return sorted(segments)


def explanation_set(
    df: DataFrame, digits: int = 4, signed: bool = False, segments: list[str] | None = None
) -> DataFrame:
    """seed, row_id, phi, gold: one explanation per model of a five-model set.

    Model ``s`` is fitted without the ``s``-th market segment, so the models differ the
    way models trained on different samples do. All fits share one aggregation.
    """
    segments = segments or left_out_segments(df)
    train = df.where("split = 'train'")
    aggregates = []
    for s, left_out in enumerate(segments):
        for c, v in zip(NUMERIC, numeric_values()):
            kept = F.when(F.col("segment") != left_out, v)
            aggregates += [
                F.round(F.avg(kept), digits).alias(f"mean_{s}_{c}"),
                F.round(F.stddev_pop(kept), digits).alias(f"std_{s}_{c}"),
            ]
    fitted = train.agg(*aggregates).first()
    models = []
    for s in range(len(segments)):
        squares = []
        for c, v in zip(NUMERIC, numeric_values()):
            z = (v - (fitted[f"mean_{s}_{c}"] or 0.0)) / (fitted[f"std_{s}_{c}"] or 1.0)
            squares.append(z * (F.abs(z) if signed else z))
        models.append(F.struct(F.lit(s).alias("seed"), F.array(*squares).alias("phi")))
    return (
        df.select("row_id", "label", gold_marks().alias("gold"), F.explode(F.array(*models)).alias("m"))
        .select(F.col("m.seed").alias("seed"), "row_id", "label", F.col("m.phi").alias("phi"), "gold")
    )
