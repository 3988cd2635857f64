"""Token counts by separator scan over flat, unindexed token files.

A flat file is nothing but ids of two bytes each, documents one after the other, each closed by
the end id. Files are cut into blocks of a set size that are searched on their own; what a block
cannot know, where its first document began and how many documents came before, is stitched
by a prefix scan over one small row per block.

Written files come from Spark's own text writer, whose record separator is set to the bytes of
the end id; so they are committed like any table and survive lost executors.

Nulls: a null text is an empty document (its end id only). Ids behind a file's last separator
form one more document with ``ended`` false. Empty tables and empty files give no documents.
Columns other than the text are not read. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevia.llm.encoder import Encoder, default_vocabulary
from relevia.session import materialize, new_table_path

#: The end id of the public vocabulary. A text may hold its name, which is encoded as ordinary text here,
#: so the id is in no text and a scan may rely on it.
END_ID = 50256
BLOCK_BYTES = 8 << 20


def write_flat(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, text: str = "text") -> str:
    """Write texts as flat files of little-endian 16-bit ids, without a shuffle; files follow the input's splits."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary, literal=True)
        for batch in batches:
            for _, ids, counts in encoder.column(batch.column(0)):
                if len(ids) and ids.max() >= 1 << 16:
                    raise ValueError("ids of this vocabulary do not fit 16 bits")
                # another vocabulary may give the end id to plain text, which must not split the document
                if (ids == end_id).any():
                    raise ValueError(f"a text holds the end id {end_id}")
                data = ids.astype("<u2").tobytes()
                ends = 2 * np.cumsum(counts)
                rows = [data[a:b] for a, b in zip((ends - 2 * counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.binary())], names=["ids"])

    separator = int(end_id).to_bytes(2, "little").decode("latin-1")
    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "ids binary")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).option(
        "encoding", "ISO-8859-1"
    ).text(path)
    return path


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as file:
                    data = file.read_at(row["size"], row["at"])
                ids = np.frombuffer(data, dtype="<u2", count=len(data) // 2)
                found = np.flatnonzero(ids == end_id).astype(np.int64) + row["at"] // 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]]),
                        pa.array([row["at"]], type=pa.int64()),
                        pa.array([row["at"] // 2 + len(ids)], type=pa.int64()),
                        pa.array([found], type=pa.list_(pa.int64())),
                    ],
                    names=["path", "at", "stop", "found"],
                )

    return run


def scan_flat(spark: SparkSession, path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, doc_no, start, n_tokens, ended`` of every document; n_tokens includes the end id.

    ``doc_no`` counts from 0 inside a file. Any file system that Arrow reaches by URI will do.
    """
    if block_bytes % 2:
        raise ValueError("blocks must hold whole ids")
    # the content column is not asked for, so only the listing is read
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    blocks = files.filter("length > 0").select(
        F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("path"),
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("at"),
    )
    blocks = blocks.select("path", "at", F.least(F.lit(block_bytes), F.col("length") - F.col("at")).alias("size"))
    # one block is much work and a small row: deal blocks out by name, not by the size of the listing
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(width, "path", "at").mapInArrow(
        _scan(end_id), "path string, at long, stop long, found array<long>"
    )
    found = materialize(found, "separators")
    # the prefix scan has one small row per block of a file; the separators themselves meet its sums by block
    blocks = found.select(
        "path", "at", F.get("found", F.size("found") - 1).alias("last"), F.size("found").cast("long").alias("n_found")
    )
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    sums = blocks.select(
        "path",
        "at",
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last_end"),
        F.coalesce(F.sum("n_found").over(before), F.lit(0)).alias("docs_before"),
        (F.max("at").over(whole) == F.col("at")).alias("is_last"),
    )
    stitched = found.join(sums, ["path", "at"])
    # ids behind the last separator of a file are a document that was not closed
    open_end = F.col("is_last") & (F.coalesce(F.get("found", F.size("found") - 1), F.col("last_end")) < F.col("stop") - 1)
    ends = F.when(open_end, F.concat("found", F.array(F.col("stop") - 1))).otherwise(F.col("found"))
    rows = stitched.withColumn("open_end", open_end).select(
        "path", "found", "last_end", "docs_before", "open_end", F.size("found").alias("n"), F.posexplode(ends).alias("i", "end")
    )
    start = F.when(F.col("i") == 0, F.col("last_end")).otherwise(F.get("found", F.col("i") - 1)) + 1
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("docs_before") + F.col("i")).alias("doc_no"),
        start.alias("start"),
        (F.col("end") - start + 1).alias("n_tokens"),
        (F.col("i") < F.col("n")).alias("ended"),
    )


def count_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write documents as flat files in the shared folder and scan them for token counts."""
    spark = docs.sparkSession
    return scan_flat(spark, write_flat(docs, new_table_path(spark, "flat"), vocabulary, end_id), end_id)
