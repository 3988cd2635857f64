"""Token-ID / binary output: documents as Parquet list columns of token ids, in document order.

Files hold ``doc_id`` (sorted, delta encoded) and ``tokens`` (dictionary encoded: the
vocabulary fits one dictionary page, so an id takes its bit width). Row groups and pages have
set sizes and carry page indexes, so a reader that wants some documents or only their ids
skips the rest.

Nulls: a null text is empty and holds the end id only; a null doc_id sorts first and is kept.
Repeated rows and equal doc_ids are all kept, in any order among themselves. An empty table
gives files without rows. Columns of the input other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevia.llm.encoder import Encoder, default_vocabulary
from relevia.llm.textkit import list_array
from relevia.session import materialize, new_table_path, small_batches

SCHEMA = "doc_id long, tokens array<int>"


@dataclass(frozen=True)
class Layout:
    """Sizes of the files' parts; ``codec`` is applied after the encodings."""

    row_group_bytes: int = 32 << 20
    page_bytes: int = 1 << 20
    page_rows: int = 2000
    dictionary_bytes: int = 1 << 20
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.dictionary.page.size": str(self.dictionary_bytes),
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary#doc_id": "false",
        }


def encode(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tokens``: each text's ids with the end id behind them, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary)
        for batch in batches:
            for first, ids, counts in encoder.column(batch.column(1)):
                tokens = np.insert(ids, np.cumsum(counts), end_id)
                keys = batch.column(0).slice(first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [keys, list_array(tokens, counts + 1, pa.int32())], names=["doc_id", "tokens"]
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    layout: Layout | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> str:
    """Write the ids of all documents in ascending doc_id order; one shuffle, of the texts."""
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    tokens = encode(ordered, vocabulary or default_vocabulary(), end_id)
    with small_batches(docs.sparkSession):
        tokens.write.options(**(layout or Layout()).options()).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, tokens``; filters on doc_id and a choice of columns reach the pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(3)
        offsets = column.offsets.to_numpy()
        ids = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(3)],
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(crc, type=pa.int64()),
            ],
            names=["file", "row", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: where each document's ids begin.

    Starts are sums in two levels, inside each file and over files; files do not overlap in doc_id.
    """
    found = spark.read.schema(SCHEMA).parquet(path)
    found = found.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "tokens"
    )
    # read twice below: written once, so that the ids are read and summed once
    rows = materialize(found.mapInArrow(_digests, "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # one row per file; names carry the number of the range, which is the order of doc_id
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    over_files = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(over_files), F.lit(0)).alias("base"))
    return rows.join(files, "file").select(
        "doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_and_index(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write documents as token files in the shared folder and return the index read back from them."""
    spark = docs.sparkSession
    return token_index(spark, write_tokens(docs, new_table_path(spark, "tokens"), vocabulary, end_id))
