"""Encoded columns back to source columns: group maps and attribution sums."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.operators.encode import EncodedColumn

# Encoded names that carry an underscore of their own.
NAMES_WITH_UNDERSCORE = ("Betrag_5", "Kreditkontr_betrag")


def group_map(spark: SparkSession, catalog: Iterable[EncodedColumn]) -> DataFrame:
    """(enc_pos, enc_name, source_name, kind) of a fitted encoder."""
    rows = [(e.position, e.name, e.source, e.kind) for e in catalog]
    return spark.createDataFrame(rows, "enc_pos int, enc_name string, source_name string, kind string")


def source_of(enc_name: Column, keep: Sequence[str] = NAMES_WITH_UNDERSCORE) -> Column:
    """Source column of an encoded name: the name without its last ``_`` part."""
    return F.when(enc_name.isin(list(keep)), enc_name).otherwise(F.regexp_replace(enc_name, "_[^_]*$", ""))


def groups_from_names(names: DataFrame, keep: Sequence[str] = NAMES_WITH_UNDERSCORE) -> DataFrame:
    """(source_name, positions) from a (enc_pos, enc_name) table."""
    return (
        names.groupBy(source_of(F.col("enc_name"), keep).alias("source_name"))
        .agg(F.array_sort(F.collect_list("enc_pos")).alias("positions"))
    )


def positions_by_source(catalog: Iterable[EncodedColumn]) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for entry in catalog:
        groups.setdefault(entry.source, []).append(entry.position)
    return groups


def to_source_columns(phi: Column, groups: Sequence[Sequence[int]]) -> Column:
    """Sum attributions of encoded columns per group, in group order."""
    return V.group_sums(phi, groups)


def to_source_passthrough(phi: Column, groups: Sequence[Sequence[int]], width: int) -> Column:
    """As ``to_source_columns``; positions in no group come first, unsummed."""
    grouped = {i for group in groups for i in group}
    loose = [[i] for i in range(width) if i not in grouped]
    return V.group_sums(phi, [*loose, *groups])


def to_source_long(explanations: DataFrame, groups: DataFrame) -> DataFrame:
    """The same sums on a long (run keys, row_id, feature, phi) table."""
    keys = [c for c in explanations.columns if c not in ("feature", "phi")]
    return (
        explanations.join(F.broadcast(groups.select("enc_name", "source_name")), F.col("feature") == F.col("enc_name"), "left")
        .groupBy(*keys, F.coalesce("source_name", "feature").alias("feature"))
        .agg(F.sum("phi").alias("phi"))
    )
