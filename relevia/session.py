"""Session helpers: local test sessions and the shared folder for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relevia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: its driver and
    executors are one process on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="relevia-")
    return _LOCAL_FOLDERS[context.applicationId]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = 2 << 20


def bound_batches(spark: SparkSession, size: int = SMALL_BATCH) -> str:
    """Let rows with whole texts reach Python in batches of at most so many bytes (a longer row is one batch).

    Returns the setting as it was. Batches that are smaller already stay as they are.
    """
    before = spark.conf.get(BATCH_BYTES)
    now = int(re.sub(r"\D", "", before)) if re.fullmatch(r"\d+b?", before) else 0
    if now <= 0 or now > size:
        spark.conf.set(BATCH_BYTES, f"{size}b")
    return before


@contextmanager
def small_batches(spark: SparkSession, size: int = SMALL_BATCH) -> Iterator[None]:
    """The same for the actions inside the block only."""
    before = bound_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let shuffle files go as soon as an action inside the block has ended, not with the driver's garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/relevia/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there, without its lineage."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
