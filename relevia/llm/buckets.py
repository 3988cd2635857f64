"""Candidate pairs from buckets of classes that share a key, without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: near(sketch, n, sketches, ns) -> which pairs of rows may be similar; without false negatives
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Pairs that a task compares at a time.
PAIRS = 1 << 16


def _near_pairs(near: Near):
    """Pairs of each group (key, i, j); rows come sorted by group, and one group at a time is kept."""
    names = ["a_d", "a_u", "b_d", "b_u"]

    def pairs(batch: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        d, u, label, n = (batch.column(c).to_numpy() for c in ("d", "u", "label", "n"))
        sketch = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(d), -1)
        left, right = [], []
        # each row meets the later ones of its group
        later = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(d)) - 1
        ends = np.cumsum(later)
        for begin in range(0, int(ends[-1]), PAIRS):
            number = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, number, side="right")
            j = i + 1 + number - (ends[i] - later[i])
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            found = near(sketch[i], n[i], sketch[j], n[j])
            left.append(i[found])
            right.append(j[found])
        left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[left], u[left], d[right], u[right])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in grouped(batches):
            yield pairs(batch, bounds)

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Rows sorted by group (key, i, j), cut between groups: whole groups and where each begins and the last ends."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        done = int(starts[-1]) if len(starts) else 0
        if done:
            yield batch.slice(0, done), [0, *starts.tolist()]
        held = batch.slice(done)
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


#: Blocks that each of a bucket's two parts, its most common label and the rest, is cut into at most.
MOST_BLOCKS = 16


def tiles(
    members: DataFrame, block: int, weight: str | None = None, most_weight: int = 1, most_blocks: int = MOST_BLOCKS
) -> DataFrame:
    """``node, tiles``: members of buckets with several labels, each with the groups ``key, label, i, j`` it is compared in.

    Only classes with different labels are of interest, so the members with a bucket's most common
    label meet the others but not each other. Members are cut into blocks of about ``block``, or in
    buckets that would have more than ``most_blocks`` of them into so many; so a member is in a bounded number of groups
    and their rows grow with the bucket, not with its square. With a ``weight`` column a block
    is also of at most about ``most_weight``, so rows that are large come in smaller blocks. One row
    per node: what a group needs of it is joined once, before ``in_groups`` deals it out.
    """
    one = F.lit(1.0) if weight is None else F.greatest(F.lit(1.0), F.col(weight) * (block / most_weight))
    sizes = members.groupBy("key", "label").agg(F.sum(one).alias("m"))
    mixed = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("labels"), F.max_by("label", "m").alias("main"), F.max("m").alias("most"), F.sum("m").alias("all")
    )
    blocks = lambda m: F.least(F.ceil(m / block), F.lit(most_blocks)).cast("int")
    mixed = mixed.filter("labels > 1").select(
        "key", "main", blocks(F.col("all") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("most")
    )
    rows, turn, is_main = members.join(mixed, "key"), F.xxhash64("node"), F.col("label") == F.col("main")
    own = F.when(is_main, F.col("rest") + F.pmod(turn, F.col("most"))).otherwise(F.pmod(turn, F.col("rest"))).cast("int")
    last = F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1
    bucket = F.struct("key", "label", own.alias("own"), last.alias("last"))
    return rows.select("node", bucket.alias("bucket")).groupBy("node").agg(F.collect_list("bucket").alias("tiles"))


def in_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``tiles`` and what was joined to them, once per group, dealt and sorted so that a task holds one group at a time."""
    rows = rows.select("node.d", "node.u", F.explode("tiles").alias("t"), *columns)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t.last"))))
    i, j = F.least("t.own", "other").alias("i"), F.greatest("t.own", "other").alias("j")
    rows = rows.select("t.key", i, j, "d", "u", F.xxhash64("t.label").alias("label"), *columns)
    # most groups are a few rows, far too few for a call each
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def mixed_rows(buckets: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """The tiles of buckets: key, node and, unless it is left out, the leader that all others were held against already."""
    # a class is in many buckets and has one label
    others = buckets.filter("node != leader") if "leader" in buckets.columns else buckets
    keys = others.groupBy("node").agg(F.collect_list("key").alias("keys"))
    named = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return tiles(named.select("node", "label", F.explode("keys").alias("key")), block)


def pairs_across(buckets: DataFrame, classes: DataFrame, labels: DataFrame, near: Near, block: int) -> DataFrame:
    """Near pairs (a, b) of classes in one bucket and in different components.

    A node is a struct of two longs, d and u. ``classes`` has node, n and sketch (array of
    longs), ``labels`` node and label. Only near pairs leave a group.
    """
    rows = mixed_rows(buckets, labels, block).join(classes.select("node", "n", "sketch"), "node")
    rows = in_groups(rows, ["n", "sketch"])
    found = rows.mapInArrow(_near_pairs(near), "a_d long, a_u long, b_d long, b_u long")
    node = lambda c: F.struct(F.col(f"{c}_d").alias("d"), F.col(f"{c}_u").alias("u"))
    pairs = found.select(F.least(node("a"), node("b")).alias("a"), F.greatest(node("a"), node("b")).alias("b"))
    return pairs.distinct()
