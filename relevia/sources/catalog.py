"""Column roles of a ledger, and the encoded columns of network flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Catalog rows, and the columns that are neither categorical nor numeric.
LANGUAGES = {"ger": "name_de", "en": "name_en"}
NOTE_AND_LABEL = ["Label", "Belegnummer", "Position", "Transaktionsart", "Erfassungsuhrzeit"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name_de, name_en, role) from a transposed file with one column per ledger column.

    Its rows are the names per language and two flag rows; role is cat, num or note.
    """
    raw = spark.read.csv(path, header=True)
    tag, positions = raw.columns[0], raw.columns[1:]
    long = raw.unpivot([F.col(f"`{tag}`").alias("tag")], [f"`{p}`" for p in positions], "pos", "value")
    wide = long.groupBy("pos").pivot("tag", ["ger", "en", "cat", "num"]).agg(F.first("value"))
    role = (
        F.when(F.col("cat").cast("double") == 1, "cat").when(F.col("num").cast("double") == 1, "num").otherwise("note")
    )
    return wide.select(
        F.col("pos").cast("int").alias("pos"), F.col("ger").alias("name_de"), F.col("en").alias("name_en"),
        role.alias("role"),
    )


def _language_column(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {sorted(LANGUAGES)}, not {language!r}")
    return LANGUAGES[language]


def catalog_names(catalog: DataFrame, language: str, roles: Sequence[str] = ("cat", "num", "note")) -> list[str]:
    """Column names of the given roles in file order; a catalog is a few dozen rows."""
    column = _language_column(language)
    rows = catalog.where(F.col("role").isin(list(roles))).orderBy("pos").select(column).collect()
    return [r[0] for r in rows]


def column_dtypes(catalog: DataFrame, language: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names."""
    return catalog_names(catalog, language, ["num"]), catalog_names(catalog, language, ["cat"])


def column_names(catalog: DataFrame, language: str) -> list[str]:
    """Source columns without notes and label."""
    return catalog_names(catalog, language, ["cat", "num"])


def dataset_information(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    metadata_path: str,
    eval_path: str | None = None,
    split_id: int | None = None,
) -> DataFrame:
    schema = "train_path string, test_path string, eval_path string, split_id long, metadata_path string"
    return spark.createDataFrame([(train_path, test_path, eval_path, split_id, metadata_path)], schema)


# Source column, encoded names (a number is a count of numbered names).
FLOW_FIELDS: Sequence[tuple[str, Sequence[str] | tuple[str, int]]] = (
    ("Weekday", ["isWeekday"]),
    ("Daytime", ("Daytime", 5)),
    ("Duration", ("Duration", 4)),
    ("Traffic", ["isICMP", "isUDP", "isTCP"]),
    ("Src IP", ("Src IP", 36)),
    ("Src Pt", ("Src Pt", 19)),
    ("Src Conns", ("Src Conns", 4)),
    ("Dst IP", ("Dst IP", 36)),
    ("Dst Pt", ("Dst Pt", 19)),
    ("Dst Conns", ("Dst Conns", 4)),
    ("Packets", ("Packets", 4)),
    ("Bytes", ("Bytes", 5)),
    ("SYN", ["isSYN"]),
    ("ACK", ["isACK"]),
    ("FIN", ["isFIN"]),
    ("URG", ["isURG"]),
    ("PSH", ["isPSH"]),
    ("RES", ["isRES"]),
)

# Fields that min-max encoding keeps as one number.
FLOW_NUMBERS = ("Daytime", "Duration", "Src Conns", "Dst Conns", "Packets", "Bytes")

# Raw flow headers and their short names.
FLOW_RENAMES: Mapping[str, str] = {
    "Date first seen": "Date",
    "Proto": "Traffic",
    "Src IP Addr": "Src IP",
    "Dst IP Addr": "Dst IP",
    "Dst Connections last 10s": "Dst Conns",
    "Src Connections last 10s": "Src Conns",
}


def _encoded_names(names: Sequence[str] | tuple[str, int]) -> list[str]:
    if isinstance(names, tuple):
        return [f"{names[0]} {i}" for i in range(names[1])]
    return list(names)


def flow_groups() -> dict[str, list[str]]:
    """Source column -> encoded column names of the quantized flow table."""
    return {source: _encoded_names(names) for source, names in FLOW_FIELDS}


def flow_group_positions() -> dict[str, list[int]]:
    """Source column -> encoded column positions of the quantized flow table."""
    groups, at = {}, 0
    for source, names in flow_groups().items():
        groups[source] = list(range(at, at + len(names)))
        at += len(names)
    return groups


def flow_schema(numeric: str = "quantized", is_normal: bool = False, attack_type: bool = False) -> str:
    """DDL of an encoded flow table; ``numeric`` is ``quantized`` or ``minmax``."""
    if numeric not in ("quantized", "minmax"):
        raise ValueError(f"unknown numeric encoding {numeric!r}")
    columns = []
    for source, names in flow_groups().items():
        if numeric == "minmax" and source in FLOW_NUMBERS:
            columns.append(f"`{source}` float")
        else:
            columns += [f"`{n}` tinyint" for n in names]
    if is_normal:
        columns.append("`isNormal` tinyint")
    if attack_type:
        columns.append("`attackType` string")
    return ", ".join(columns)
