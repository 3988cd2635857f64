"""Row and column shaping: labels, splits, shards, samples, class balancing, order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.functions.hashing import uniform
from relevia.operators.ranking import global_index

NORMAL = "NonFraud"

# Label texts that a task treats as normal.
IGNORED_LABELS = {
    "session1": ["Anomaly_17", "Anomaly_9"],
    "session2": [
        "Larceny_III",
        "Larceny_VI",
        "Corporate_Injury_II",
        "Selling_Kickback_I_10",
        "Selling_Kickback_I_19",
        "Selling_Kickback_I_20",
        "Selling_Kickback_I_30",
        "Selling_Kickback_II",
        "Scrap",
        "Mass_Discount",
    ],
    "simulated": ["Shrinkage", "ShrinkageCorrection"],
}

# Note columns of a ledger.
NOTE_COLUMNS = ["Belegnummer", "Position", "Transaktionsart", "Erfassungsuhrzeit"]


def drop_notes(df: DataFrame, notes: Sequence[str] = NOTE_COLUMNS) -> DataFrame:
    return df.drop(*notes)


def notes_first(df: DataFrame, notes: Sequence[str] = NOTE_COLUMNS) -> DataFrame:
    return df.select(*[f"`{c}`" for c in notes], *[f"`{c}`" for c in df.columns if c not in notes])


def renumber(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Replace the row id by 0, 1, 2, ... in row id order."""
    return global_index(df, row_id, out="_new_id").drop(row_id).withColumnRenamed("_new_id", row_id)


def split_label(
    df: DataFrame, label: str = "label", row_id: str = "row_id", keep_label: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Features and labels as two frames that share the row id."""
    features = df if keep_label else df.drop(label)
    return features, df.select(row_id, label)


def keep_original_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw copies of numeric columns under ``<name>_orig``."""
    return df.withColumns({f"{c}_orig": F.col(f"`{c}`") for c in columns})


def is_fraud(label: Column, events: bool = False, prefixes: Sequence[str] = ("Fraud_",), suffixes: Sequence[str] = ()) -> Column:
    """Whether a label names a fraud (or an event); simulated ledgers mark it by a suffix."""
    tests = [label.startswith(p) for p in prefixes] + [label.endswith(s) for s in suffixes]
    if events:
        tests.append(label.startswith("Event_"))
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def labels_fraud_only(label: Column) -> Column:
    """Every label that is not a fraud becomes the normal label."""
    return F.when(is_fraud(label), label).otherwise(F.lit(NORMAL))


def get_frauds(df: DataFrame, label: str = "label", events: bool = False, **rule) -> DataFrame:
    return df.where(is_fraud(F.col(label), events, **rule))


def adjust_labels(label: Column, task: str | Sequence[str]) -> Column:
    """Map the labels a task cannot detect to normal; ``task`` is a name or a label list."""
    ignored = IGNORED_LABELS.get(task, []) if isinstance(task, str) else list(task)
    return F.when(label.isin(ignored), F.lit(NORMAL)).otherwise(label) if ignored else label


def binarize_label(label: Column) -> Column:
    return (label != NORMAL).cast("int")


def binarize_is_normal(is_normal: Column) -> Column:
    return (F.lit(1) - is_normal).cast("int")


def split_by_row(row_id: Column, split_id: int) -> Column:
    """Rows before ``split_id`` are test rows, the rest are evaluation rows."""
    return F.when(row_id < split_id, F.lit("test")).otherwise(F.lit("eval"))


def with_shard(df: DataFrame, points_per_shard: int, row_id: str = "row_id") -> DataFrame:
    """Number contiguous blocks of rows in row id order."""
    indexed = global_index(df, row_id, out="_index")
    return indexed.withColumn("shard", F.floor(F.col("_index") / points_per_shard)).drop("_index")


def shard(df: DataFrame, number: int, points_per_shard: int, row_id: str = "row_id") -> DataFrame:
    return with_shard(df, points_per_shard, row_id).where(F.col("shard") == number).drop("shard")


def hash_sample(df: DataFrame, fraction: float, seed: int, key: str = "row_id") -> DataFrame:
    """Keep about ``fraction`` of the rows; which ones depends on key and seed only."""
    return df.where(uniform(F.lit(seed), F.col(key)) < F.lit(float(fraction)))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


DRAWS_PER_PIECE = 65_536
MAX_CLASSES = 10_000


def oversample(df: DataFrame, seed: int = 0, label: str = "label", row_id: str = "row_id") -> DataFrame:
    """Add draws with replacement to every class smaller than the largest.

    A smaller class gets as many draws as the largest class has rows. Adds ``copy``:
    0 for the row itself, 1 and up for its draws. Draws are counted per drawn row
    before they meet the rows, so a class of few rows does not gather them in one task.
    Rows without a label are a class like the others.
    """
    counts = class_counts(df, label).take(MAX_CLASSES + 1)
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    own = df.withColumn("copy", F.lit(0).cast("long"))
    if not counts:
        return own
    largest = max(r["rows"] for r in counts)
    smaller = [(r[label], r["rows"]) for r in counts if r["rows"] < largest]
    if not smaller:
        return own
    spark = df.sparkSession
    classes = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(rows).cast("long").alias("rows")) for name, rows in smaller]
    )
    draws = (
        spark.range(largest)
        .select(F.col("id").alias("draw"), F.explode(classes).alias("class"))
        .select(
            F.col("class.name").alias(label),
            "draw",
            F.floor(
                uniform(F.lit(seed), F.coalesce(F.col("class.name").cast("string"), F.lit("")), F.col("draw"))
                * F.col("class.rows")
            )
            .cast("long")
            .alias("_index"),
            F.floor(F.col("draw") / DRAWS_PER_PIECE).alias("_piece"),
        )
        .groupBy(label, "_index", "_piece")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    is_small = F.col(label).isin([name for name, _ in smaller if name is not None])
    if any(name is None for name, _ in smaller):
        is_small = is_small | F.col(label).isNull()
    # a name that no label has stands for the missing one
    named = F.when(F.col(label).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(label).cast("string")))
    small_rows = global_index(df.where(is_small).withColumn("_class", named), row_id, out="_index", by=["_class"])
    draws = draws.withColumn("_class", named).drop(label)
    drawn = small_rows.join(draws, ["_class", "_index"]).select(
        *[f"`{c}`" for c in df.columns],
        F.explode(
            F.sequence(
                F.col("_piece") * DRAWS_PER_PIECE + 1, F.col("_piece") * DRAWS_PER_PIECE + F.col("_times")
            )
        ).alias("copy"),
    )
    return own.unionByName(drawn)


def reorder(df: DataFrame, order: DataFrame | Sequence[int], row_id: str = "row_id") -> DataFrame:
    """Add ``position`` from an explicit id order and keep only the listed rows."""
    if not isinstance(order, DataFrame):
        rows = [(int(i), p) for p, i in enumerate(order)]
        order = df.sparkSession.createDataFrame(rows, f"{row_id} long, position long")
    return df.join(order, row_id)


def keep_seeds(df: DataFrame, seeds: Sequence[int], seed: str = "seed") -> DataFrame:
    return df.where(F.col(seed).isin(list(seeds)))


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Trim header names and replace those in ``mapping``."""
    trimmed = [c.strip() for c in df.columns]
    return df.toDF(*[mapping.get(c, c) for c in trimmed])
