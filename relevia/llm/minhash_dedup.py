"""MinHash near-dedup with odd sketches.

1. A scan turns each text into its set of shingles of ``width`` words (64-bit hashes; a text of
   fewer words is one shingle) and keeps a fingerprint of the set, its MinHash bands and its odd sketch: each MinHash sample flips one
   bit of a small bitmap, so that the bits in which two bitmaps differ tell how many samples
   differ, most precisely where similarity is high.
2. Rows with the same set are one class from here on, however many they are.
3. Classes that share a band are candidates. Each is first held against the least class of
   its band only, so a band of m classes gives m pairs. Sketches sort out what is far from the
   threshold; what is left is confirmed on the full sets, read from the texts again.
4. Components of the confirmed links are found. Where a band still holds classes of different
   components, its pairs across components are compared in blocks of a set size inside tasks:
   sketch against sketch first, which leaves the classes with a near one in another component,
   then these on their full sets. A task joins components as it goes, and only the links that
   join some leave it, fewer than it has classes.

With 24 bands of 4 samples a pair at the threshold of 0.8 shares no band with probability 3e-6, at
0.85 with 2e-8. The sketch bound lies five standard errors, of the samples and of the bitmap's
collisions together, above the bits that differ at the threshold; a pair fails it with less than 1e-6.

Nulls: a null text has no words; texts without words have an empty set and are linked with
nothing. A null doc_id is a row like others and comes last where the smallest counts. Repeated
rows are in one class; ties cannot arise; empty tables give empty results. Only the two named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.llm.buckets import grouped, in_groups, mixed_rows, tiles
from relevia.llm.components import connected_components
from relevia.llm.textkit import NON_BLANK, Hasher, list_array, mix, slices, word_hashes
from relevia.session import materialize, small_batches

_LAST = (1 << 63) - 1
_HASHER = Hasher(seed=5)
#: Shingles of the full sets in one block, 16 MB.
BLOCK_ITEMS = 1 << 21
#: Blocks that a part of a bucket is cut into at most where the full sets go along; more than of sketches, which are small.
SET_BLOCKS = 64


@dataclass(frozen=True)
class Method:
    """Similarity in percent, bands of samples, samples and bits of the odd sketch, classes per block, words of a shingle."""

    percent: int = 80
    bands: int = 24
    rows: int = 4
    samples: int = 192
    bits: int = 512
    block: int = 512
    width: int = 2

    @property
    def most_different_bits(self) -> int:
        """Bits that may differ at the threshold: their mean and five standard errors.

        The variance is that of the number of differing samples, through the slope of the mean, and
        that of the parities of a bitmap into which so many (twice the samples that differ) are thrown.
        """
        similarity = self.percent / 100
        thrown = 2 * self.samples * (1 - similarity)
        mean = self.bits / 2 * (1 - math.exp(-2 * thrown / self.bits))
        slope = 2 * math.exp(-2 * thrown / self.bits)
        sampling = slope**2 * self.samples * similarity * (1 - similarity)
        parity = self.bits / 4 * (1 - math.exp(-4 * thrown / self.bits))
        return math.ceil(mean + 5 * math.sqrt(sampling + parity))


def shingle_sets(column: pa.Array, width: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted shingles of all texts, bounds) per slice: sets of 64-bit hashes of ``width`` words each."""
    for first_row, data, starts in slices(column):
        words, bounds, _, _ = word_hashes(data, starts, _HASHER, NON_BLANK)
        runs = [words]
        for size in range(2, width + 1):
            runs.append(mix(runs[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + words[size - 1 :]) if len(words) >= size else words[:0])
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if 0 < b - a < width:
                # a run that is a text of its own is no shingle of a longer one
                sets.append(mix(runs[b - a - 1][a : a + 1] ^ np.uint64(0x5851F42D4C957F2D)))
                continue
            found = np.sort(runs[-1][a : max(a, b - width + 1)])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found)
        sizes = np.array([len(s) for s in sets])
        yield first_row, np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums per set."""
    out = []
    for turn in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values * np.uint64(turn) + np.uint64(turn >> 7)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out


def _signatures(values: np.ndarray, bounds: np.ndarray, method: Method) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty sets, as (sets, bands) and (sets, bits / 64)."""
    seeds = mix(np.arange(1, 2 * method.samples + 1, dtype=np.uint64))
    factor, shift = (seeds[: method.samples] >> np.uint64(32)).astype(np.uint32) | 1, seeds[method.samples :].astype(np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    sets = len(bounds) - 1
    least = np.empty((method.samples, sets), dtype=np.uint64)
    work = np.empty_like(short)
    for i in range(method.samples):
        np.multiply(short, factor[i], out=work)
        np.add(work, shift[i], out=work)
        least[i] = np.minimum.reduceat(work, bounds[:-1])
    keys = np.empty((sets, method.bands), dtype=np.uint64)
    for band in range(method.bands):
        key = np.full(sets, band + 1, dtype=np.uint64)
        for row in least[band * method.rows : (band + 1) * method.rows]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, band] = key
    odd = np.zeros((sets, method.bits), dtype=bool)
    at = np.arange(sets)
    for i in range(method.samples):
        odd[at, (mix(least[i] + (np.uint64(i + 1) << np.uint64(40))) % np.uint64(method.bits)).astype(np.int64)] ^= True
    sketch = np.packbits(odd, axis=1).view(np.int64)
    return keys.view(np.int64), sketch


def signatures(docs: DataFrame, method: Method, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, f1, f2, bands, sketch`` per row; bands and sketch are empty for an empty set."""
    schema = "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in shingle_sets(batch.column(1), method.width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                bands, sketch = np.zeros((0, method.bands), np.int64), np.zeros((0, method.bits // 64), np.int64)
                if len(full):
                    bands, sketch = _signatures(values, np.concatenate((bounds[full], bounds[-1:])), method)
                f1, f2 = fingerprints(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(f1),
                        pa.array(f2),
                        list_array(bands.ravel(), (sizes > 0) * bands.shape[1], pa.int64()),
                        list_array(sketch.ravel(), (sizes > 0) * sketch.shape[1], pa.int64()),
                    ],
                    names=["doc_id", "n", "f1", "f2", "bands", "sketch"],
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def _differing_bits(a: Column, b: Column) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda total, x: total + x)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """``node, items``: the shingles of the wanted classes, from the text of one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, bounds in shingle_sets(batch.column(3), width):
                part = batch.slice(first, len(bounds) - 1)
                f1, f2 = fingerprints(values, bounds)
                # another row of the same doc_id may have another text
                own = (f1 == part.column(1).to_numpy()) & (f2 == part.column(2).to_numpy())
                lists = list_array(values.view(np.int64), np.diff(bounds), pa.int64())
                out = pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "items"])
                yield out.filter(pa.array(own))

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("d"), F.col(text).cast("string").alias("t"))
    rows = rows.join(wanted.select("node", "f1", "f2", F.col("node.d").alias("d")), "d").select("node", "f1", "f2", "t")
    sets = rows.mapInArrow(run, f"node {dict(wanted.dtypes)['node']}, items array<long>")
    return sets.dropDuplicates(["node"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, method: Method, doc_id: str, text: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are as similar as asked: by sketch, then on the full sets."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.filter(100 * F.least("n_a", "n_b") >= method.percent * F.greatest("n_a", "n_b"))
    near = near.filter(_differing_bits(F.col("s_a"), F.col("s_b")) <= method.most_different_bits)
    near = materialize(near.select("a", "b", "n_a", "n_b"), "near-pairs")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    sets = materialize(_sets_of(docs, classes.select("node", "f1", "f2").join(wanted, "node"), method.width, doc_id, text), "near-sets")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("items").alias("i_a")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("items").alias("i_b")), "b")
    common = F.size(F.array_intersect("i_a", "i_b"))
    return full.filter(100 * common >= method.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _pairs_to_check(key: int, n: np.ndarray, sketch: np.ndarray, bands: np.ndarray, method: Method) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) that are near by sketch, with the bucket's key as the first that both share."""
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        found = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1) <= method.most_different_bits
        found &= 100 * np.minimum(n[rest], n[i]) >= method.percent * np.maximum(n[rest], n[i])
        later = np.flatnonzero(found) + i + 1
        if len(later):
            first = (bands[later] == bands[i]).argmax(axis=1)
            yield i, later[bands[i][first] == key]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each group (key, i, j) of sorted rows, its classes once: (rows, key, n, sketch, bands)."""
    for batch, bounds in grouped(batches):
        node = np.stack([batch.column("d").to_numpy(), batch.column("u").to_numpy()])
        for first, last in zip(bounds[:-1], bounds[1:]):
            once = np.sort(np.unique(node[:, first:last], axis=1, return_index=True)[1])
            part = batch.slice(first, last - first)
            part = part.take(pa.array(once)) if len(once) < last - first else part
            wide = lambda c: part.column(c).flatten().to_numpy().reshape(part.num_rows, -1)  # noqa: E731, B023
            yield part, part.column("key")[0].as_py(), part.column("n").to_numpy(), wide("sketch").view(np.uint64), wide("bands")


def _active(method: Method):
    """Classes of a group with a near class in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, n, sketch, bands in _groups(batches):
            label, keep = part.column("label").to_numpy(), np.zeros(len(n), dtype=bool)
            for i, later in _pairs_to_check(key, n, sketch, bands, method):
                later = later[label[later] != label[i]]
                keep[later] = True
                keep[i] |= len(later) > 0
            if keep.any():
                yield part.select(["key", "d", "u", "label", "n"]).filter(pa.array(keep))

    return run


def _joining_links(method: Method):
    """Links of a group that join components, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key, n, sketch, bands in _groups(batches):
            label = part.column("label").to_numpy().copy()
            # all sets of the group as one array, each sorted
            items, bounds = part.column("items").values.to_numpy(), part.column("items").offsets.to_numpy()
            links = []
            for i, later in _pairs_to_check(key, n, sketch, bands, method):
                own = items[bounds[i] : bounds[i + 1]]
                for j in later.tolist():
                    if label[i] != label[j]:
                        other = items[bounds[j] : bounds[j + 1]]
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * common >= method.percent * (len(own) + len(other) - common):
                            links.append((i, j))
                            label[label == label[j]] = label[i]
            if links:
                left, right = (part.take(pa.array([link[side] for link in links])) for side in (0, 1))
                columns = [x.column(c) for x in (left, right) for c in ("d", "u")]
                yield pa.RecordBatch.from_arrays(columns, names=["a_d", "a_u", "b_d", "b_u"])

    return run


def links_across(
    buckets: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, method: Method, doc_id: str, text: str
) -> DataFrame:
    """Links (a, b) between components among classes that share a bucket; enough of them to join all that are linked."""
    parts = classes.select("node", "n", "sketch", "bands")
    rows = in_groups(mixed_rows(buckets, labels, method.block).join(parts, "node"), ["n", "sketch", "bands"])
    active = rows.mapInArrow(_active(method), "key long, d long, u long, label long, n long").distinct()
    node = F.struct("d", "u").alias("node")
    active = materialize(active.select("key", node, "label", "n"), "near-active")
    wanted = active.select("node").distinct()
    sets = materialize(_sets_of(docs, classes.select("node", "f1", "f2").join(wanted, "node"), method.width, doc_id, text), "near-sets")
    rows = tiles(active, method.block, "n", BLOCK_ITEMS, SET_BLOCKS).join(parts, "node").join(sets, "node")
    with small_batches(rows.sparkSession):
        rows = in_groups(rows, ["n", "sketch", "bands", "items"])
        links = rows.mapInArrow(_joining_links(method), "a_d long, a_u long, b_d long, b_u long")
        found = materialize(links, "near-joining")
    side = lambda c: F.struct(F.col(f"{c}_d").alias("d"), F.col(f"{c}_u").alias("u")).alias(c)
    return found.select(side("a"), side("b"))


def _labelled(docs: DataFrame, method: Method, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row's ``doc_id, n, f1, f2``, and ``f1, f2, n, label`` of every set that is not empty."""
    rows = materialize(signatures(docs, method, doc_id, text), "near-rows")
    known = F.coalesce("doc_id", F.lit(_LAST))
    # rows with the same set: the order of classes is that of their smallest doc_id
    classes = rows.filter("n > 0").groupBy("f1", "f2", "n").agg(
        F.min(known).alias("d"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    node = F.struct("d", F.monotonically_increasing_id().alias("u"))
    classes = materialize(classes.select(node.alias("node"), "f1", "f2", "n", "bands", "sketch"), "near-classes")

    bands = classes.select("node", F.explode("bands").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    buckets = materialize(bands.join(leaders.select("key", "leader", "m"), "key"), "near-buckets")
    pairs = buckets.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirm(pairs, classes, docs, method, doc_id, text), "near-links")
    labels = connected_components(links, "near")
    several = buckets.filter("m > 2")
    more = materialize(links_across(several, classes, labels, docs, method, doc_id, text), "near-links")
    if not more.isEmpty():
        labels = connected_components(links.union(more), "near")
    named = classes.select("f1", "f2", "n", "node").join(labels, "node", "left")
    return rows, named.select("f1", "f2", "n", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, method: Method | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; see the module."""
    rows, named = _labelled(docs, method or Method(), doc_id, text)
    named = named.select("f1", "f2", "n", F.col("label")["d"].alias("least"))
    # the empty set has a fingerprint of its own but no class
    out = rows.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(_LAST)))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def fingerprint_column(method: Method, text: str = "text") -> Column:
    """The fingerprint (two longs) of a text's shingles; only texts go to Python."""

    @F.arrow_udf("array<long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = [np.stack(fingerprints(v, b), axis=1) for _, v, b in shingle_sets(texts, method.width)]
        flat = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return list_array(flat.ravel(), np.full(len(flat), 2), pa.int64())

    return fingerprint(F.col(f"`{text}`").cast("string"))


def keep_one(docs: DataFrame, method: Method | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id (null last), whatever other rows have that id.

    Texts without words are in no group; of their rows that repeat an id, one stays. All columns stay.
    """
    method = method or Method()
    rows, named = _labelled(docs, method, doc_id, text)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    first = rows.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(own).alias("own")).join(named, ["f1", "f2", "n"])
    first = first.groupBy("label").agg(F.min(F.struct("own.no_id", "own.id", "f1", "f2")).alias("row")).select("row.*")
    empty = rows.filter("n = 0").select(own.alias("own"), "f1", "f2").select("own.*", "f1", "f2").distinct()
    stay = first.unionByName(empty)
    number = F.col(f"`{doc_id}`").cast("long")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        number.isNull().alias("no_id"),
        F.coalesce(number, F.lit(0)).alias("id"),
        fingerprint_column(method, text).alias("f"),
    )
    keyed = keyed.select("doc", "no_id", "id", F.col("f")[0].alias("f1"), F.col("f")[1].alias("f2"))
    keys = ["no_id", "id", "f1", "f2"]
    # rows that repeat an id and a set are one before they meet anything
    return keyed.groupBy(*keys).agg(F.first("doc").alias("doc")).join(stay, keys, "left_semi").select("doc.*")
