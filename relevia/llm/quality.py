"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its whole text. Weights are learned from
preference pairs, a document of label 1 over one of label 0, by logistic loss on the difference
of their features. The threshold is the strength at the quantile that the share of label 0 has
among all labelled rows outside the held-out third, an exact order statistic of their strengths, and
the score is the logistic of the distance to it.

Features are counted over all bytes, words and lines of a text; language, source, ids and
labels are not among them. The weights are fitted on a bounded sample of labelled rows (about
``most_rows`` per label, chosen by a hash of id and text; equal rows are one row with a count);
everything else is over all rows.

Nulls: a null text is empty; empty texts have features of zero and are scored by them. Rows
without a label or with a label other than 0 and 1 are not learned from; a null doc_id has no
label and is not held out. Repeated rows count as often as they stand. Equal texts have equal
scores. Without rows of both labels every score is 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.llm.textkit import NON_BLANK, Hasher, byte_set, list_array, slices, spans, word_hashes
from relevia.operators.ranking import RankSelector
from relevia.session import materialize

#: Labelled rows of each label that a fit uses at most, about.
MOST_ROWS = 10_000
PAIRS = 200_000

_HASHER = Hasher(seed=11)
_LINES = ~byte_set((0x0A, 0x0A))
_GROUPS = [
    [*range(0x61, 0x7B)], [*range(0x41, 0x5B)], [*range(0x30, 0x3A)], [0x20], [0x0A], [*range(0x80, 0x100)],
    *[[ord(c)] for c in "|#$%&*!?.,:;-_/<>{}()[]=+@"], [*range(0, 9), *range(11, 32), 127],
]
_CLASSES = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS):
    _CLASSES[_g, _i] = 1.0
WIDTH = len(_GROUPS) + 10


def text_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features of (texts, WIDTH)) per slice."""
    for first_row, data, starts in slices(column):
        n = len(starts) - 1
        hashes, bounds, first, last = word_hashes(data, starts, _HASHER, NON_BLANK)
        line_first, line_last = spans(data, _LINES)
        prefix = _HASHER.prefix(data)
        lines = _HASHER.ranges(prefix, line_first, line_last)
        line_bounds = np.searchsorted(line_first, starts)
        length = (last - first).astype(float)
        ends = ~(NON_BLANK & (byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))))[data[last - 1]]
        upper = byte_set((0x41, 0x5A))
        shout = upper[data[first]] & upper[data[np.minimum(first + 1, len(data) - 1)]]
        out = np.zeros((n, WIDTH))
        for i in range(n):
            counts = np.bincount(data[starts[i] : starts[i + 1] - 1], minlength=256)
            size = max(1, starts[i + 1] - 1 - starts[i])
            out[i, : len(_GROUPS)] = np.sqrt(counts @ _CLASSES / size)
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            words, own = b - a, length[a:b]
            c, d = line_bounds[i], line_bounds[i + 1]
            out[i, len(_GROUPS) :] = (
                np.log1p(words),
                own.mean(),
                own.std(),
                np.log(own.max()),
                len(np.unique(hashes[a:b])) / words,
                np.log1p(words / len(np.unique(hashes[a:b]))),
                ends[a:b].mean(),
                shout[a:b].mean(),
                len(np.unique(lines[c:d])) / max(1, d - c),
                np.log1p(words / max(1, d - c)),
            )
        yield first_row, out


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        # summed row by row, so that a strength does not depend on the rows beside it
        return (np.clip((features - self.center) / self.scale, -6, 6) * self.weights).sum(axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(features) - self.threshold, -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """``doc_id, y, n`` of the labels that may be learned from; n counts equal rows."""
    rows = labels.filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.filter("y in (0, 1)").groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("n"))


def labelled_features(docs: DataFrame, known: DataFrame, rate: dict[int, float], seed: int, doc_id: str, text: str) -> DataFrame:
    """``y, x, n`` of a share of the labelled rows; texts are not shuffled, features of rows below the rate are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in text_features(batch.column(2)):
                keys = [batch.column(i).slice(first, len(x)) for i in (0, 1)]
                rows = list_array(x.ravel(), np.full(len(x), WIDTH), pa.float64())
                yield pa.RecordBatch.from_arrays([*keys, rows], names=["doc_id", "draw", "x"])

    key, content = F.col(doc_id).cast("long"), F.col(text).cast("string")
    draw = F.pmod(F.xxhash64(key, F.coalesce(content, F.lit("")), F.lit(seed)), F.lit(1 << 30))
    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull())
    rows = rows.select(key.alias("doc_id"), draw.alias("draw"), content.alias("text"))
    rows = rows.filter(F.col("draw") < max(rate.values()) * (1 << 30)).mapInArrow(run, "doc_id long, draw long, x array<double>")
    below = F.when(F.col("y") == 1, F.lit(float(rate[1]))).otherwise(F.lit(float(rate[0]))) * (1 << 30)
    chosen = rows.join(known, "doc_id").filter(F.col("draw") < below)
    return chosen.groupBy("y", "x").agg(F.sum("n").alias("n"))


def labelled_strengths(docs: DataFrame, known: DataFrame, model: QualityModel, doc_id: str, text: str) -> DataFrame:
    """``strength, y`` of all labelled rows outside the held-out third, each as often as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in text_features(batch.column(1)):
                keys = batch.column(0).slice(first, len(x))
                yield pa.RecordBatch.from_arrays([keys, pa.array(model.strength(x))], names=["doc_id", "strength"])

    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    rows = rows.mapInArrow(run, "doc_id long, strength double").join(known, "doc_id")
    return rows.select("strength", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("strength", "y")


def quantile_threshold(strengths: DataFrame) -> float:
    """Halfway between the strengths on both sides of the quantile of label 0's share; ``strength, y`` is read twice."""
    zeros, rows = strengths.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.lit(1))).first()
    if not rows:
        return 0.0
    low, high = min(max(zeros - 1, 0), rows - 1), min(zeros, rows - 1)
    found = RankSelector(strengths, ["strength"]).select({"strength": [low, high]})
    return (found["strength", low].value + found["strength", high].value) / 2


def fit_bradley_terry(
    x: np.ndarray, y: np.ndarray, share_of_zero: float, pairs: int, seed: int, count: np.ndarray | None = None
) -> QualityModel:
    """Weights by Newton steps on preference pairs; the threshold by the quantile of these rows' strengths.

    ``count`` tells how often each row stands.
    """
    if len(np.unique(y)) < 2:
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    count = np.ones(len(y)) if count is None else count.astype(float)
    center = np.average(x, axis=0, weights=count)
    scale = np.sqrt(np.average((x - center) ** 2, axis=0, weights=count))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - center) / scale, -6, 6)
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    often = [count[side] / count[side].sum() for side in (better, worse)]
    difference = z[draw.choice(better, pairs, p=often[0])] - z[draw.choice(worse, pairs, p=often[1])]
    weights = np.zeros(WIDTH)
    ridge = 1e-3 * pairs * np.eye(WIDTH)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -40, 40)))
        gradient = difference.T @ (1 - p) - ridge @ weights
        step = np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference + ridge, gradient)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ weights
    # the sample is not in the labels' proportions: weigh rows back
    weight = count * np.where(y == 1, (1 - share_of_zero) / count[better].sum(), share_of_zero / count[worse].sum())
    order = np.argsort(strength, kind="stable")
    upto = np.cumsum(weight[order])
    at = min(int(np.searchsorted(upto, share_of_zero - 1e-12)), len(order) - 2)
    threshold = (strength[order[at]] + strength[order[at + 1]]) / 2
    return QualityModel(center, scale, weights, float(threshold))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    most_rows: int = MOST_ROWS,
    pairs: int = PAIRS,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> QualityModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1: the weights from at most about
    ``most_rows`` rows of a label, the threshold from all.
    """
    known = _known(labels, label, doc_id)
    # labelled rows are counted by ids alone, so that repeated ids do not outgrow the sample
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = known.join(ids, "doc_id").groupBy("y").agg(F.sum(F.col("n") * F.col("rows")).alias("rows"))
    total = {r.y: r.rows for r in joined.collect()}
    if len(total) < 2:
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    rate = {y: min(1.0, most_rows / n) for y, n in total.items()}
    rows = labelled_features(docs, known, rate, seed, doc_id, text).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, WIDTH))
    y, n = rows["y"].to_numpy().astype(int), rows["n"].to_numpy()
    # collected rows come in no set order
    order = np.lexsort((y, *x.T))
    model = fit_bradley_terry(x[order], y[order], total[0] / sum(total.values()), pairs, seed, n[order])
    strengths = materialize(labelled_strengths(docs, known, model, doc_id, text), "strengths")
    return replace(model, threshold=quantile_threshold(strengths))


def score_documents(docs: DataFrame, model: QualityModel, column: str = "score", text: str = "text") -> DataFrame:
    """docs with one more column, the score; a column of that name is replaced. No shuffle."""
    kept = docs.drop(column)
    at = kept.columns.index(text)
    names = [*kept.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in text_features(batch.column(at)):
                part = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], names=names)

    kept = kept.withColumn(text, F.col(text).cast("string"))
    return kept.mapInArrow(run, kept.withColumn(column, F.lit(0.0)).schema)


def score_column(model: QualityModel, text: str = "text") -> Column:
    """The score as a column: only texts go to Python and only scores come back; other columns stay in the JVM."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.score(x) for _, x in text_features(texts))]))

    return score(F.col(text).cast("string"))


def quality_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = fit_quality(docs, labels, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = score_documents(rows, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
