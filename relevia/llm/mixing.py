"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words, so each of its documents has a share of copies, the same for
all. The whole part is taken, the rest is rounded so that the source's words stay on target:
two documents with fractional rests pass words from one to the other, at random and without
bias, until one of them is taken whole or not at all. A task rounds its chunk and has at most
one fractional document left; these are combined in a tree of the same step. The last one of a
source goes to the nearer side, so the source misses its target by half a document at most.

Chunks are dealt out by a hash of the document inside each source, so a hot source is many
chunks. Draws are hashes of the documents' ids: reruns and other layouts agree.

Nulls: a null text has size 0, a null source is a source of its own and comes last; null and
repeated doc_ids are rows of their own. Documents of size 0 take nothing. Empty tables give
empty results. Only the three named columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevia.session import materialize

#: Rows per chunk and residuals per node of the tree.
CHUNK_ROWS = 1024
FAN_IN = 64

ROUNDED = "source string, chunk long, doc_id long, size long, mass double, extra int"


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size``: number of words `[^\\x20\\x09-\\x0D]+` of each text."""
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words.cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_copies: float) -> DataFrame:
    """``source, source_size, n_docs, target``: shares by weight, none above ``most_copies`` times its size.

    What a full source cannot take goes to the others by weight. Then all others have one level
    (target / weight), and the full ones are those with the lowest ``most_copies * size / weight``.
    One row per source is ordered here, not the documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("full", F.lit(float(most_copies)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    # the level if this source and all with higher limits are not full
    level = (total - F.coalesce(F.sum("full").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("full"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level"))))
    target = F.least("full", F.coalesce(final.over(Window.partitionBy())["level"] * F.col("weight"), F.col("full")))
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(struct.pack("<qq", a, b), seed=seed) / 2.0**64


def round_masses(sizes: list[int], masses: list[float], ids: list[int], seed: int) -> tuple[list[int], int | None, float]:
    """Round masses (words, from 0 to a document's size) in order: taken (1) or not (0), what is left and its mass.

    Each step keeps the sum of masses and, in expectation, each mass.
    """
    taken = [0] * len(sizes)
    left, mass = None, 0.0
    for j, (size, other) in enumerate(zip(sizes, masses)):
        if other <= 0 or size == 0:
            continue
        if other >= size:
            taken[j] = 1
            continue
        if left is None:
            left, mass = j, other
            continue
        up, down = min(sizes[left] - mass, other), min(mass, size - other)
        if _draw(seed, ids[left], ids[j]) * (up + down) < down:
            mass, other = mass + up, other - up
        else:
            mass, other = mass - down, other + down
        # sums of doubles may stop a hair from the edge
        edge = 1e-9 * (size + sizes[left])
        left_open, other_open = edge < mass < sizes[left] - edge, edge < other < size - edge
        if not left_open:
            taken[left] = int(mass > sizes[left] / 2)
        if not other_open:
            taken[j] = int(other > size / 2)
        if left_open and other_open:  # cannot be, up to rounding: settle the nearer one
            taken[j], other_open = int(other > size / 2), False
        if not left_open:
            left, mass = (j, other) if other_open else (None, 0.0)
    return taken, left, mass


def _round_group(frame: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "size", "chunk", "mass"], kind="stable", na_position="last").reset_index(drop=True)
    sizes, masses = frame["size"].tolist(), frame["mass"].tolist()
    ids = [-1 if pd.isna(x) else int(x) for x in frame["doc_id"]]
    taken, left, mass = round_masses(sizes, masses, ids, seed)
    extra, rest = taken, [0.0] * len(taken)
    if left is not None:
        if last:
            extra[left] = int(mass >= sizes[left] / 2)
        else:
            extra[left], rest[left] = -1, mass
    frame["extra"], frame["mass"] = extra, rest
    return frame


def pivotal_copies(shares: DataFrame, seed: int = 1, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``source, doc_id, size, extra`` (0 or 1) of rows ``source, n_docs, doc_id, size, mass``.

    Rows with extra -1 on a level are its residuals, at most one per chunk, which names them above.
    """
    chunk = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / chunk_rows))
    rows = shares.select("source", chunk.alias("chunk"), "doc_id", "size", "mass", F.lit(0).alias("extra"))

    def level(df: DataFrame, group, salt: int, last: bool) -> DataFrame:
        def step(frame: pd.DataFrame) -> pd.DataFrame:
            return _round_group(frame, seed + salt, last)[["source", "chunk", "doc_id", "size", "mass", "extra"]]

        return df.groupBy("source", group).applyInPandas(step, ROUNDED)

    most = shares.agg(F.max(F.ceil(F.col("n_docs") / chunk_rows))).first()[0] or 1
    below = materialize(level(rows, F.col("chunk"), 0, most == 1), "mix-chunks")
    settled, residuals, width, depth = [below.filter("extra >= 0")], below.filter("extra < 0"), most, 0
    while width > 1:
        depth, width = depth + 1, -(-width // fan_in)
        group = F.floor(F.col("chunk") / (fan_in**depth))
        above = materialize(level(residuals, group, depth, width == 1), f"mix-level{depth}")
        settled.append(above.filter("extra >= 0"))
        residuals = above.filter("extra < 0")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("source", "doc_id", "size", "extra")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_copies: float = 2.0,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row, and ``source`` and ``copies``."""
    sizes = materialize(document_sizes(docs, doc_id, text, source), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most_copies), "mix-targets")
    # one row per source; Spark broadcasts it when its measured size allows, and splits a hot source when not
    joined = sizes.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(copies)
    joined = joined.withColumn("whole", whole).withColumn("mass", (copies - whole) * F.col("size"))
    rounded = pivotal_copies(joined.select("source", "n_docs", "doc_id", "size", "mass"), seed)
    back = targets.select(F.col("source").alias("target_source"), "source_size", "target", whole.alias("whole"))
    out = rounded.join(back, F.col("source").eqNullSafe(F.col("target_source")))
    copies = F.col("whole") + F.col("extra")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        "source",
        copies.cast("int").alias("copies"),
    )
