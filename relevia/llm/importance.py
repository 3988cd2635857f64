"""Target-distribution importance resampling by bit-sliced aggregation.

A document's features are its runs of one and two words, hashed to 10 000 buckets. A bucket's
gain is the logarithm of how much likelier it is in the target texts than in the documents, as
an integer. A document's weight is the mean gain of its features, got from bit planes: plane j
of a document has bit j of each bucket's count, plane k of the gains has bit k of each gain in
two's complement. The AND of the two has population count n, which adds ``n * 2**(j + k)``
(less, for the sign plane). All sums are integers, so weights are exact. Planes are kept as
64-bit words, those that are zero left out, so memory follows the slice of text at hand.

Gumbel noise from a hash of the doc_id turns weights into scores, and the highest scores are a
draw without replacement in proportion to the exponentials of the weights.

A null or empty text has no features and weight 0. A null doc_id is hashed as an empty one and
comes last among ties. Repeated rows are rows of their own and take ranks one after the other.
An empty table gives an empty result, an empty target no counts. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relevia.llm.textkit import ALNUM, slices, spans
from relevia.session import materialize


@dataclass(frozen=True)
class Method:
    """Buckets of features, least words of a document that may be drawn, share drawn, seed of the noise."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


class Crc32:
    """CRC-32 of many byte ranges, and of two ranges with a space between, by array operations.

    Feeding a byte is linear over single bits, so the state after two ranges is the first one's
    state moved on by the second one's length, plus the second one's state.
    """

    SHORT = 32

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
        self.table = table
        unit = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
        moves = [unit]
        for _ in range(self.SHORT):
            moves.append(table[moves[-1] & 255] ^ (moves[-1] >> 8))
        # moves by fewer bytes than SHORT, then by SHORT, twice SHORT, and so on
        self.short = np.stack(moves[:-1])
        self.long = [moves[-1]]
        for _ in range(32):
            self.long.append(self._through(self.long[-1], self.long[-1]))

    @staticmethod
    def _through(move: np.ndarray, state: np.ndarray) -> np.ndarray:
        return move[0][state & 255] ^ move[1][state >> 8 & 255] ^ move[2][state >> 16 & 255] ^ move[3][state >> 24]

    def shift(self, state: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """States after as many zero bytes."""
        rest = lengths % self.SHORT
        flat = self.short.reshape(-1)
        out = flat[rest * 1024 + (state & 255)] ^ flat[rest * 1024 + 256 + (state >> 8 & 255)]
        out ^= flat[rest * 1024 + 512 + (state >> 16 & 255)] ^ flat[rest * 1024 + 768 + (state >> 24)]
        blocks = lengths // self.SHORT
        for k, move in enumerate(self.long):
            if not (blocks >> k).any():
                break
            at = np.flatnonzero(blocks >> k & 1)
            out[at] = self._through(move, out[at])
        return out

    def states(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """State after each range, before the final flip."""
        lengths = ends - starts
        out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
        order = np.argsort(-lengths, kind="stable")
        long = int(np.searchsorted(-lengths[order], -self.SHORT, side="left"))
        for k in order[:long].tolist():
            out[k] = zlib.crc32(data[starts[k] : ends[k]]) ^ 0xFFFFFFFF
        order = order[long:]
        state, at, size = out[order], starts[order], -lengths[order]
        for step in range(self.SHORT):
            n = int(np.searchsorted(size, -step, side="left"))
            if not n:
                break
            now = state[:n]
            state[:n] = self.table[(now ^ data[at[:n] + step]) & 255] ^ (now >> 8)
        out[order] = state
        return out

    def pair(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """State after the first range, a space and the second range, whose length is given."""
        spaced = self.table[(first ^ 32) & 255] ^ (first >> 8)
        return self.shift(spaced ^ np.uint32(0xFFFFFFFF), length) ^ second


def features(texts: pa.Array, buckets: int, crc: Crc32) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words per text, text of each feature, bucket of each feature), slice by slice."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for first, data, starts in slices(texts):
        begin, end = spans(data, ALNUM)
        text = np.searchsorted(starts, begin, side="right") - 1
        state = crc.states(fold[data], begin, end)
        pairs = np.flatnonzero(text[1:] == text[:-1])
        both = crc.pair(state[pairs], state[pairs + 1], (end - begin)[pairs + 1])
        codes = np.concatenate((state, both)) ^ np.uint32(0xFFFFFFFF)
        words = np.bincount(text, minlength=len(starts) - 1)
        yield first, words, np.concatenate((text, text[pairs])), (codes % np.uint32(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, method: Method = Method(), text: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: one row per task and used bucket, added up by Spark."""
    buckets = method.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = Crc32(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, found in features(batch.column(0), buckets, crc):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    parts = rows.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    # at most one row per bucket reaches the driver
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares per bucket, in doubles."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip((target + 1).tolist(), (source + 1).tolist())
    return np.array([math.floor(1000 * math.log(t * all_source / (s * all_target))) for t, s in pairs], dtype=np.int64)


class GainPlanes:
    """Gains as bit planes in two's complement, each packed in 64-bit words."""

    def __init__(self, values: np.ndarray) -> None:
        self.words = -(-len(values) // 64)
        bits = max(int(np.abs(values).max(initial=0)).bit_length() + 1, 1)
        padded = np.zeros(64 * self.words, dtype=np.int64)
        padded[: len(values)] = values
        self.planes, self.factors = [], []
        for k in range(bits):
            flags = (padded >> k & 1).astype(np.uint8).reshape(-1, 64)
            self.planes.append(np.packbits(flags, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64))
            self.factors.append(-(1 << k) if k == bits - 1 else 1 << k)

    def sums(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the gains of each text's features, from the planes of its bucket counts."""
        out = np.zeros(texts, dtype=np.int64)
        keys, counts = np.unique(text * (64 * self.words) + bucket, return_counts=True)
        word, bit = keys >> 6, np.uint64(1) << (keys & 63).astype(np.uint64)
        for j in range(int(counts.max(initial=0)).bit_length()):
            at = np.flatnonzero(counts >> j & 1)
            if not len(at):
                continue
            place = word[at]
            heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            plane = np.bitwise_or.reduceat(bit[at], heads)
            owner, column = np.divmod(place[heads], self.words)
            sums = np.zeros(len(plane), dtype=np.int64)
            for own, factor in zip(self.planes, self.factors):
                sums += factor * np.bitwise_count(plane & own[column]).astype(np.int64)
            opens = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[opens]] += np.add.reduceat(sums, opens) << j
        return out


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document in thousandths, rounded down; fixed by its id and the seed."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, n_words long, part long, at long"


def score_documents(
    docs: DataFrame, gain: np.ndarray, method: Method = Method(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Weight and score of every row, with its number of words and where it lies (part, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, planes, at = Crc32(), GainPlanes(gain), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0)
            for first, words, owner, bucket in features(batch.column(1), method.buckets, crc):
                n = len(words)
                many = np.bincount(owner, minlength=n)
                weight = planes.sums(owner, bucket, n) // np.maximum(many, 1)
                own = ids.slice(first, n)
                score = weight + np.array([noise(i, method.seed) for i in own.to_pylist()], dtype=np.int64)
                columns = [many, weight, score, words, np.full(n, part), np.arange(at, at + n)]
                yield pa.RecordBatch.from_arrays(
                    [own, *[pa.array(c, pa.int64()) for c in columns]], names=[f.split()[0] for f in SCORED.split(", ")]
                )
                at += n

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCORED)


def draw(scored: DataFrame, method: Method = Method()) -> DataFrame:
    """Rank the highest scores of the documents that may be drawn; all rows stay, the rest without a rank.

    Ranks are sums in three levels: rows of higher scores (a score is an integer of some tens of
    thousands, so its histogram is small), rows of the same score with a smaller id or an earlier part, and
    the place inside the part. A doc_id that many rows share is thus counted part by part.
    """
    fits = F.col("n_words") >= method.least_words
    able = scored.filter(fits)
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = levels.select(
        "score",
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"),
        F.floor(F.sum("n").over(total) * method.percent / 100).alias("drawn"),
    )
    # ids that are null come last among equal scores
    keys = ["score", F.col("doc_id").isNull().alias("no_id"), "doc_id", "part"]
    cells = able.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("score").orderBy("no_id", "doc_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.join(F.broadcast(levels), "score").filter("above + ahead < drawn")
    cells = cells.select(*[F.col(k).alias(f"c_{k}") for k in ("score", "doc_id", "part")], "above", "ahead", "drawn")
    inside = Window.partitionBy("score", "doc_id", "part").orderBy("at")
    same = (F.col("score") == F.col("c_score")) & (F.col("part") == F.col("c_part"))
    same &= F.col("doc_id").eqNullSafe(F.col("c_doc_id"))
    numbered = able.withColumn("place", F.row_number().over(inside)).join(cells, same, "left")
    rank = F.col("above") + F.col("ahead") + F.col("place")
    names = ["doc_id", "n_features", "weight", "score"]
    taken = numbered.select(*names, F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"), "n_words")
    return taken.unionByName(scored.filter(~fits).select(*names, F.lit(None).cast("long").alias("rank"), "n_words"))


def resample(
    docs: DataFrame, target: DataFrame, method: Method = Method(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every document; drawn ones have a rank from 1 on."""
    gain = gains(bucket_counts(docs, method, text), bucket_counts(target, method, text))
    return draw(materialize(score_documents(docs, gain, method, doc_id, text), "importance"), method)


def drawn_documents(
    docs: DataFrame, target: DataFrame, method: Method = Method(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn."""
    ranks = resample(docs, target, method, doc_id, text).filter("rank is not null")
    picked = ranks.select(F.col("doc_id").alias("#drawn")).distinct()
    return docs.join(picked, docs[doc_id].cast("long").eqNullSafe(picked["#drawn"]), "left_semi")
