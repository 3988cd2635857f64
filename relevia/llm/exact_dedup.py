"""Exact dedup by an extendible-hash index on shared files.

1. Every scan task hashes its texts and groups equal ones inside a batch (comparing bytes). It
   writes one record per row, and the packed text once per such local group.
2. A directory over the top bits of the keys is doubled until no bucket is above its
   capacity. Only sizes of key ranges reach the driver, in proportion to the buckets.
3. Each bucket goes to one owner task, which walks its records in key order, chains records
   with equal keys, compares bytes, and writes the classes it finds as index files.
4. Rows find their class through their local group, which is no larger than a batch, so a
   text that a third of all rows share is no hot key anywhere.

Texts are equal when they are identical without blanks (`[\\x20\\x09-\\x0D]`). A null text is empty,
and empty texts equal each other; a null doc_id comes last among ties. Of repeated rows with
one doc_id one stays. Empty tables give empty results. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevia.session import materialize, small_batches

#: Packed bytes that a bucket should hold at most; one key alone may exceed it.
BUCKET_BYTES = 64 << 20
#: Directories have at most so many bits.
MOST_BITS = 22
#: What normalisation deletes: `[\\x20\\x09-\\x0D]`.
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

RECORDS = (
    "doc_id long, task long, local int, row int, sha binary, "
    "key long, size long, packed binary, n long, best_chars long, best_id long, best_row int"
)
INDEX = "task long, local int, key long, chain int, n long, best_chars long, best_id long, best_row int, packed binary"


def records(docs: DataFrame, key_bits: int = 63, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One record per row; the first row of a batch-local group also has the group's text and totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        task = uuid.uuid4().int >> 65
        at = 0
        for batch in batches:
            whole = pc.fill_null(batch.column(1), "")
            ids, chars = batch.column(0).to_pylist(), pc.utf8_length(whole).to_pylist()
            groups: dict[bytes, int] = {}
            # one text at a time is in hand; only a group's first stays
            local = [groups.setdefault(t.as_buffer().to_pybytes().translate(None, BLANK_BYTES), len(groups)) for t in whole.cast(pa.binary())]
            sha = [hashlib.sha256(t).digest() for t in groups]
            best, n, first = {}, [0] * len(groups), {}
            for row, g in enumerate(local):
                order = (-chars[row], ids[row] is None, ids[row] or 0, row)
                best[g] = min(best.get(g, order), order)
                n[g] += 1
                first.setdefault(g, row)
            texts = list(groups)
            lead = [first[g] == row for row, g in enumerate(local)]
            pick = lambda f: [f(g) if is_first else None for g, is_first in zip(local, lead)]
            packed = pick(lambda g: pack(texts[g]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([task] * len(local), pa.int64()),
                    pa.array([at + g for g in local], pa.int32()),
                    pa.array(range(len(local)), pa.int32()),
                    pa.array([sha[g] for g in local], pa.binary()),
                    pa.array(pick(lambda g: xxhash.xxh64_intdigest(texts[g]) >> (64 - key_bits)), pa.int64()),
                    pa.array([None if p is None else len(p) for p in packed], pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array(pick(lambda g: n[g]), pa.int64()),
                    pa.array(pick(lambda g: -best[g][0]), pa.int64()),
                    pa.array(pick(lambda g: ids[best[g][3]]), pa.int64()),
                    pa.array(pick(lambda g: best[g][3]), pa.int32()),
                ],
                names=[f.split()[0] for f in RECORDS.split(", ")],
            )
            at += len(groups)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, RECORDS)


def directory(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each of 2**g directory entries; ``sizes`` has the bytes of 2**bits key ranges.

    A bucket above capacity is split by one more bit, and the directory doubles when the bucket
    used all its bits; entries of a bucket with fewer bits stay together.
    """
    bits = int(math.log2(len(sizes)))
    ahead = np.concatenate(([0], np.cumsum(sizes)))
    depth, buckets, open_ = 0, [], [(0, 0)]
    while open_:
        prefix, own = open_.pop()
        depth = max(depth, own)
        first, last = prefix << (bits - own), (prefix + 1) << (bits - own)
        if ahead[last] - ahead[first] > capacity and own < bits:
            open_ += [(2 * prefix, own + 1), (2 * prefix + 1, own + 1)]
        else:
            buckets.append((first, prefix, own))
    out = np.zeros(1 << depth, dtype=np.int64)
    for number, (_, prefix, own) in enumerate(sorted(buckets)):
        out[prefix << (depth - own) : (prefix + 1) << (depth - own)] = number
    return out


def _directory_of(leads: DataFrame, key_bits: int, bucket_bytes: int) -> tuple[np.ndarray, int]:
    spark = leads.sparkSession
    total = leads.agg(F.sum("size")).first()[0] or 0
    # a few buckets per task at least, so that owners share the work on small inputs too
    capacity = max(1, min(bucket_bytes, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    bits = min(key_bits, MOST_BITS, max(1, math.ceil(math.log2(total / capacity + 1)) + 1))
    ranges = leads.groupBy(F.shiftright("key", key_bits - bits).alias("range")).agg(F.sum("size").alias("size"))
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for row in ranges.collect():
        sizes[row["range"]] = row["size"]
    return directory(sizes, capacity), capacity


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of an owner's records, which come in key order; keeps the texts of one key at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    key, chain = None, []
    for batch in batches:
        column = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        number, kept = [], []
        for k, packed in zip(column["key"], column["packed"]):
            if k != key:
                key, chain = k, []
            # the same packed bytes are the same text; others are compared unpacked
            at = next((i for i, other in enumerate(chain) if other == packed or unpack(other) == unpack(packed)), None)
            if at is None:
                at = len(chain)
                chain.append(packed)
                kept.append(packed)
            else:
                kept.append(None)
            number.append(at)
        column |= {"chain": number, "packed": kept}
        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        arrays = [pa.array(column[f.split()[0]], kinds[f.split()[1]]) for f in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def build_index(found: DataFrame, key_bits: int = 63, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the index of all records: a class (key, chain) per local group, each text once."""
    leads = found.filter("key is not null")
    entries, _ = _directory_of(leads.select("key", "size"), key_bits, bucket_bytes)
    bits = int(math.log2(len(entries)))
    spark = found.sparkSession
    # bounded by the directory: at most 2**MOST_BITS pairs of numbers, a few thousand in practice
    table = spark.createDataFrame(pd.DataFrame({"entry": np.arange(len(entries)), "bucket": entries}))
    owned = (
        leads.withColumn("entry", F.shiftright("key", key_bits - bits))
        .join(F.broadcast(table), "entry")
        .select("bucket", "key", "packed", "task", "local", "n", "best_chars", "best_id", "best_row")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
    )
    return materialize(owned.mapInArrow(_chains, INDEX), "hash-index")


def exact_dedup(
    docs: DataFrame,
    key_bits: int = 63,
    bucket_bytes: int = BUCKET_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the one with most code points stays, then the smallest doc_id.
    """
    with small_batches(docs.sparkSession):
        found = materialize(records(docs, key_bits, doc_id, text), "hash-records")
    index = build_index(found, key_bits, bucket_bytes).drop("packed")
    best = F.min(F.struct(-F.col("best_chars"), F.col("best_id").isNull(), "best_id", "task", "local", "best_row"))
    classes = index.groupBy("key", "chain").agg(F.sum("n").alias("group_size"), best.alias("best"))
    groups = index.select("task", "local", "key", "chain").join(classes, ["key", "chain"])
    groups = groups.select("task", "local", "group_size", "best")
    rows = found.select("doc_id", "task", "local", "row", "sha").join(groups, ["task", "local"])
    kept = (
        (F.col("best.task") == F.col("task"))
        & (F.col("best.local") == F.col("local"))
        & (F.col("best.best_row") == F.col("row"))
    )
    return rows.select(
        "doc_id",
        F.col("best.best_id").alias("keep_id"),
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def bucket_files(spark: SparkSession, index_path: str, low: int, high: int) -> DataFrame:
    """Index entries with keys in [low, high]; the range reaches the files' statistics."""
    return spark.read.parquet(index_path).filter(F.col("key").between(low, high))
