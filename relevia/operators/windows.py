"""Counts over trailing time ranges per key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from relevia.session import materialize

#: Rows of a key in a slice that a task may hold at once.
CROWDED = 1 << 16
#: Ranges (microseconds, two years) up to which places in the order of a batch's slices and times are 64-bit numbers.
LONGEST = 1 << 46
#: Time slices per longest range: a slice's distinct times of one key are the unit of work.
SLICES_PER_RANGE = 8


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; a timestamp without time zone is counted without one."""
    if not isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.unix_micros(ts)
    span = F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    minutes = (F.extract(F.lit("DAY"), span) * 24 + F.extract(F.lit("HOUR"), span)) * 60 + F.extract(
        F.lit("MINUTE"), span
    )
    micros = (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long")
    return minutes.cast("long") * 60_000_000 + micros


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: Mapping[str, float]) -> DataFrame:
    """Add the number of rows with the same key in the seconds before and at each row.

    ``seconds`` maps each new column to its range. A row goes to its key's time slice, as long as the
    longest range, and its time alone to the next slice too; so a slice holds all that its rows count,
    and one shuffle is enough. Keys with more than ``CROWDED`` rows in a slice are counted by running
    sums over shorter slices instead, so a key that holds a third of the table, or a burst of it, is spread.
    Rows with a null key count among themselves; a null time gets null counts.
    """
    reach = {out: int(s * 1_000_000) for out, s in seconds.items()}
    length = max(1, max(reach.values()))
    timed = df.drop(*reach).withColumn("#at", _micros(df, ts))
    known = timed.where("`#at` is not null")
    crowded = known.groupBy(F.col(key).alias("#key"), F.floor(F.col("#at") / length)).agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.where(F.col("n") > CROWDED).select("#key").distinct()
    if length > LONGEST:
        counted = _running_counts(known, key, reach)
    elif crowded.isEmpty():
        counted = _sliced_counts(known, key, reach, length)
    else:
        crowded = materialize(crowded, "crowded-keys")
        same = F.col(key).eqNullSafe(F.col("#key"))
        counted = _sliced_counts(known.join(crowded, same, "left_anti"), key, reach, length)
        counted = counted.unionByName(_running_counts(known.join(crowded, same, "left_semi"), key, reach))
    nothing = {out: F.lit(None).cast("long") for out in reach}
    return counted.unionByName(timed.where("`#at` is null").withColumns(nothing)).drop("#at")


def _sliced_counts(known: DataFrame, key: str, reach: Mapping[str, int], length: int) -> DataFrame:
    """Counts of rows that meet all they count in their own slice; whole slices are held, one after the other."""
    columns = known.columns
    own = F.floor(F.col("#at") / length)
    sent = F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own"))))
    rows = known.withColumn("#sent", sent).select(
        F.col(key).alias("#key"), F.col("#sent.slice").alias("#slice"), F.col("#at").alias("#time"),
        F.when(F.col("#sent.own"), F.struct(*[F.col(f"`{c}`") for c in columns])).alias("#row"),
    )
    rows = rows.repartition("#key", "#slice").sortWithinPartitions("#key", "#slice", "#time")

    def counted(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        # a slice and the one before it span two lengths: a place in the order of all slices and times
        since = batch.column("#time").to_numpy() - (batch.column("#slice").to_numpy() - 1) * length
        first = group * (4 * length)
        place, keep = first + 2 * length + since, np.asarray(batch.column("#row").is_valid())
        upto = np.searchsorted(place, place[keep], side="right")
        found = [pa.array(upto - np.searchsorted(place, place[keep] - r, side="left")) for r in reach.values()]
        row = pc.drop_null(batch.column("#row"))
        return pa.RecordBatch.from_arrays([*row.flatten(), *found], names=[*columns, *reach])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column("#key"), null_encoding="encode").indices.to_numpy()
            slices = batch.column("#slice").to_numpy()
            new = (codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            done = int(np.searchsorted(group, group[-1]))
            if done:
                yield counted(batch.slice(0, done), group[:done])
            held = batch.slice(done)
        if held is not None and held.num_rows:
            yield counted(held, np.zeros(held.num_rows, dtype=np.int64))

    schema = StructType([*known.schema.fields, *[StructField(out, LongType()) for out in reach]])
    return rows.mapInArrow(run, schema)


def _running_counts(timed: DataFrame, key: str, reach: Mapping[str, int]) -> DataFrame:
    """Counts up to now minus counts up to just before the range, for any number of rows in a slice.

    Rows are counted per key and time first, so equal times are one row. Both counts are running sums
    inside short time slices plus the sum of the slices before.
    """
    slice_length = max(1, max(reach.values()) // SLICES_PER_RANGE)
    times = timed.groupBy(F.col(key).alias("_key"), F.col("#at").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    # marks: the time itself, and for each range the last moment that is outside of it
    marks = [F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"), F.lit("").alias("out"))]
    marks += [F.struct((F.col("_at") - r - 1).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(out).alias("out")) for out, r in reach.items()]
    points = times.select("_key", F.col("_at").alias("_origin"), F.explode(F.array(*marks)).alias("_mark"))
    points = points.select("_key", "_origin", "_mark.*", F.floor(F.col("_mark.at") / slice_length).alias("_slice"))
    inside = points.withColumn("_upto", F.sum("n").over(Window.partitionBy("_key", "_slice").orderBy("at")))
    totals = times.groupBy("_key", F.floor(F.col("_at") / slice_length).alias("_slice")).agg(F.sum("_n").alias("_total"))
    # slices without rows of their own may still hold marks
    empty = points.select("_key", "_slice").distinct().withColumn("_total", F.lit(0).cast("long"))
    every = totals.unionByName(empty).groupBy("_key", "_slice").agg(F.sum("_total").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = every.select(
        F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_ahead")
    )
    summed = inside.join(ahead, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    upto = F.col("_upto") + F.col("_ahead")
    now = F.sum(F.when(F.col("out") == "", upto))
    counts = summed.groupBy("_key", "_origin").agg(
        *[(now - F.sum(F.when(F.col("out") == out, upto))).alias(out) for out in reach]
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("#at") == F.col("_origin"))
    return timed.join(counts, same).drop("_key", "_origin")
