"""Exact nearest-neighbour joins (Euclidean) and the local outlier factor.

A few query rows are sent to every task, which keeps its own k best per query; only
those candidates are shuffled. Many query rows, or pairs of rows, are joined over a tree of pivots with two
levels, as many as the base rows ask for:

1. Every base row gets a top pivot, a cell (a pivot below it) and its distance to that pivot.
   Neighbouring tops make a group.
2. Every query is held against the group it falls into, its own cell first, which gives it a radius of
   its own that surely holds k rows.
3. With that radius it goes on to the other groups, there to the cells, and in these to the rows that the
   triangle inequality leaves; the radius shrinks with every nearer row. Groups are worked off in blocks of
   bounded size, whatever their size, and a task keeps k rows per query.

So a query meets the rows around it, and their number does not grow with the table where the
values have few dimensions. Ties in distance go to the smaller id. A row with several keys (an
array column) has neighbours for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relevia.functions.arrow import matrix
from relevia.session import materialize

BROADCAST_VALUES = 4_000_000
BLOCK_VALUES = 4_000_000
#: So many query rows are always held against all base rows; more of them only up to this number of pairs.
FEW_QUERIES = 1_024
SCAN_PAIRS = 8_000_000_000
#: Distances worked out at a time.
CACHED_VALUES = 262_144
#: Base rows of a cell, on average; the number of pivots follows, up to ``BROADCAST_VALUES`` values in all.
CELL_ROWS = 512

_CANDIDATES = "query long, neighbor long, distance double, key string"


def _near(
    query_ids: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, skip_same: bool, radius: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (row of the query, neighbor, distance) with all base rows within the radius that are among a query's k nearest."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(base):
        return found[0]
    width = base.shape[1]
    base_squares = (base**2).sum(axis=1)
    turned = np.concatenate((-2.0 * base.T, base_squares[None, :]))
    # few enough distances at a time that they stay in a core's cache
    step = max(16, CACHED_VALUES // len(base))
    for start in range(0, len(queries), step):
        block, block_ids = queries[start : start + step], query_ids[start : start + step]
        block_squares = (block**2).sum(axis=1)
        # rounding of the quick distances, bounded by the size of their terms
        slack = 1e-12 * (1.0 + 4.0 * (base_squares.max() + block_squares.max()))
        # squares less the query's own, which is on the side of the limit
        squares = np.concatenate((block, np.ones((len(block), 1))), axis=1) @ turned
        close = squares <= (_widened(radius[start : start + step]) ** 2 - block_squares + slack)[:, None]
        crowded = np.flatnonzero(np.count_nonzero(close, axis=1) > 4 * k)
        if len(crowded):
            some = squares[crowded]
            if skip_same:
                some[block_ids[crowded][:, None] == base_ids[None, :]] = np.inf
            wanted = min(k, len(base))
            limit = np.partition(some, wanted - 1, axis=1)[:, wanted - 1]
            close[crowded] &= some <= limit[:, None] + slack
        row, column = np.divmod(np.flatnonzero(close), len(base))
        if skip_same:
            other = block_ids[row] != base_ids[column]
            row, column = row[other], column[other]
        # the quick distances only shortlist; the final order uses exact differences
        some = max(1, BROADCAST_VALUES // (4 * max(1, width)))
        parts = [np.sqrt(((base[column[i : i + some]] - block[row[i : i + some]]) ** 2).sum(axis=1)) for i in range(0, len(row), some)]
        exact = np.concatenate(parts) if parts else np.zeros(0)
        part = (row + start, base_ids[column], exact)
        # many rows at one distance: only the first k of each query go on
        found.append(_keep_best([part], k) if len(row) > 4 * k * len(block) else part)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


class _Nearest:
    """The k best base rows so far of each query row, and with them the radius that a better one must be in."""

    def __init__(self, k: int, radius: np.ndarray):
        self.k, self.radius = k, np.array(radius, dtype=np.float64)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, row: np.ndarray, neighbor: np.ndarray, distance: np.ndarray) -> None:
        if len(row):
            self.waiting.append((row, neighbor, distance))
            self.count += len(row)
        # what waits is bounded by what is held, whatever the number of calls
        if 2 * self.count > self.k * len(self.radius):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        self.held = _keep_best([self.held, *self.waiting], self.k)
        self.waiting, self.count = [], 0
        row, _, distance = self.held
        counts = np.bincount(row, minlength=len(self.radius))
        full = np.flatnonzero(counts == self.k)
        last = np.cumsum(counts)[full] - 1
        self.radius[full] = np.minimum(self.radius[full], distance[last])


_NAMES = ["query", "neighbor", "distance", "key"]


def _candidate_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray], key: str) -> list[pa.Array]:
    named = pa.repeat(pa.scalar(key, pa.string()), len(found[0]))
    return [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64()), named]


def _standard(df: DataFrame, row_id: str, features: str, key: str | None) -> DataFrame:
    if key and isinstance(df.schema[key].dataType, T.ArrayType):
        group = F.explode(F.array_distinct(F.col(key).cast("array<string>")))
    else:
        group = F.col(key).cast("string") if key else F.lit("")
    return df.select(
        F.col(row_id).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"), group.alias("key")
    ).where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("key").isNotNull())


def _scan_join(queries: pa.Table, base: DataFrame, k: int, skip_same: bool) -> DataFrame:
    by_key: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in pc.unique(queries.column("key")).to_pylist():
        members = queries.filter(pc.equal(queries.column("key"), name))
        by_key[name] = np.asarray(members.column("id")), matrix(members.column("x"))
    shipped = base.sparkSession.sparkContext.broadcast(by_key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, _Nearest] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column(0))
            values = matrix(batch.column(1))
            for name in pc.unique(batch.column(2)).to_pylist():
                if name not in shipped.value:
                    continue
                query_ids, queries = shipped.value[name]
                here = np.asarray(pc.equal(batch.column(2), name))
                if name not in kept:
                    kept[name] = _Nearest(k, np.full(len(query_ids), np.inf))
                kept[name].add(*_near(query_ids, queries, ids[here], values[here], k, skip_same, kept[name].radius))
                kept[name].merge()
        for name, best in kept.items():
            row, neighbor, distance = best.held
            yield pa.RecordBatch.from_arrays(_candidate_batch((shipped.value[name][0][row], neighbor, distance), name), names=_NAMES)

    return base.select("id", "x", "key").mapInArrow(scan, _CANDIDATES)


def _keep_best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, neighbor, distance = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((neighbor, distance, query))
    query, neighbor, distance = query[order], neighbor[order], distance[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return query[keep], neighbor[keep], distance[keep]


class _Tree:
    """Pivots in two levels: each cell's pivot belongs to the top pivot nearest to it."""

    def __init__(self, pivots: np.ndarray, tops: int):
        self.tops = pivots[:tops]
        nearest = _nearest(pivots, self.tops)
        order = np.argsort(nearest, kind="stable")
        self.cells = pivots[order]
        self.bounds = np.searchsorted(nearest[order], np.arange(tops + 1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Top, distance to it, cell and distance to its pivot: nearest top, then nearest cell below it."""
        top = _nearest(x, self.tops)
        cell = np.zeros(len(x), dtype=np.int64)
        for t in np.unique(top).tolist():
            here = top == t
            cell[here] = self.bounds[t] + _nearest(x[here], self.cells[self.bounds[t] : self.bounds[t + 1]])
        return top, _norms(x - self.tops[top]), cell, _norms(x - self.cells[cell])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    step = max(1, BROADCAST_VALUES // max(1, len(points)))
    squares = (points**2).sum(axis=1)
    parts = [np.argmin(squares - 2.0 * x[i : i + step] @ points.T, axis=1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_PLACED = "id long, x array<double>, key string, top int, top_r double, cell int, r double"


def _placed(df: DataFrame, tree: _Tree) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            top, top_r, cell, r = shipped.value.place(matrix(batch.column(1)))
            arrays = [pa.array(top, pa.int32()), pa.array(top_r), pa.array(cell, pa.int32()), pa.array(r)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[f.split()[0] for f in _PLACED.split(", ")])

    return df.select("id", "x", "key").mapInArrow(run, _PLACED)


def _widened(distance: np.ndarray) -> np.ndarray:
    """A bound with room for rounding."""
    return distance + 1e-9 * (1.0 + np.abs(distance))


def _bound_from_pivots(far: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Radius that surely holds ``need`` rows, of the greatest distance (cells, queries) and size of each cell; inf if there are too few."""
    order = np.argsort(far, axis=0)
    enough = np.cumsum(sizes[order], axis=0) >= need[None, :]
    first = enough.argmax(axis=0)
    bound = np.take_along_axis(far, order, axis=0)[first, np.arange(far.shape[1])]
    return np.where(enough[-1], _widened(bound), np.inf)


#: Queries of a tile that are worked off together, and cells times queries of a step.
TILE_QUERIES = 2_048
TILE_CELLS = 1_000_000


def _tile(
    tree: _Tree, here: tuple[np.ndarray, ...], there: tuple[np.ndarray, ...], k: int, skip_same: bool, own: bool, compared: Accumulator | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbor, distance) of the k nearest of ``there`` (ids, x, cell, r) within the radius of ``here`` (ids, x, cell, radius).

    ``own``: the queries are in cells of this tile, whose rows are compared first.
    """
    ids, x, cell, radius = here
    order = np.argsort(there[2], kind="stable")
    base_ids, points, base_cell, r = (v[order] for v in there)
    starts = np.flatnonzero(np.r_[True, base_cell[1:] != base_cell[:-1]])
    ends = np.append(starts[1:], len(base_cell))
    cells, sizes = base_cell[starts], ends - starts
    inner, outer = np.minimum.reduceat(r, starts), np.maximum.reduceat(r, starts)
    centres = tree.cells[cells]
    centre_squares = (centres**2).sum(axis=1)
    sorted_ids = np.sort(base_ids) if skip_same else None
    step = int(np.clip(TILE_CELLS // len(cells), 16, TILE_QUERIES))
    # queries of a cell are next to each other, so few cells concern a step
    by_cell = np.argsort(cell, kind="stable")
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(ids), step):
        rows = by_cell[at : at + step]
        mine, names = x[rows], ids[rows]
        best = _Nearest(k, radius[rows])

        def compare(who: np.ndarray, number: int, low: float, high: float) -> None:
            part = slice(starts[number], ends[number])
            ring = (_widened(r[part]) >= low) & (r[part] <= _widened(high))
            if ring.any():
                row, neighbor, distance = _near(names[who], mine[who], base_ids[part][ring], points[part][ring], k, skip_same, best.radius[who])
                best.add(who[row], neighbor, distance)
                if compared is not None:
                    compared.add(len(who) * int(ring.sum()))

        place = np.minimum(np.searchsorted(cells, cell[rows]), len(cells) - 1)
        home = np.flatnonzero(cells[place] == cell[rows]) if own else np.zeros(0, np.int64)
        for number in np.unique(place[home]).tolist():
            compare(home[place[home] == number], number, -np.inf, np.inf)
        best.merge()
        # distances to the pivots (cells, queries), by their least and greatest value with rounding
        squares = (mine**2).sum(axis=1)
        quick = centre_squares[:, None] + squares[None, :] - 2.0 * centres @ mine.T
        slack = 1e-12 * (1.0 + 4.0 * (centre_squares.max() + squares.max()))
        low, high = np.sqrt(np.maximum(quick - slack, 0.0)), np.sqrt(np.maximum(quick + slack, 0.0))
        lost = np.flatnonzero(~np.isfinite(best.radius))
        if len(lost):
            need = np.full(len(lost), k)
            if skip_same:
                need += np.searchsorted(sorted_ids, names[lost], "right") - np.searchsorted(sorted_ids, names[lost], "left")
            best.radius[lost] = _bound_from_pivots(high[:, lost] + outer[:, None], sizes, need)
        # rows of a cell lie in a ring around its pivot, and a neighbour in one around the query
        near = (low <= _widened(outer[:, None] + best.radius)) & (_widened(high + best.radius) >= inner[:, None])
        near[place[home], home] = False
        nearest_first = np.where(near, low, np.inf).min(axis=1)
        for number in np.argsort(nearest_first, kind="stable")[: np.isfinite(nearest_first).sum()].tolist():
            who = np.flatnonzero(near[number])
            least, most = low[number, who], high[number, who]
            still = (least <= _widened(outer[number] + best.radius[who])) & (_widened(most + best.radius[who]) >= inner[number])
            who, least, most = who[still], least[still], most[still]
            if len(who):
                compare(who, number, (least - best.radius[who]).min(), (most + best.radius[who]).max())
        best.merge()
        row, neighbor, distance = best.held
        out.append((names[row], neighbor, distance))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _groups_of_tops(tops: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """A group for each top pivot: neighbouring tops go together up to ``most`` rows."""
    group, left = np.zeros(len(tops), dtype=np.int64), np.ones(len(tops), dtype=bool)
    at, number, held = 0, 0, 0
    while True:
        if held and held + rows[at] > most:
            number, held = number + 1, 0
        group[at], left[at] = number, False
        held += int(rows[at])
        rest = np.flatnonzero(left)
        if not len(rest):
            return group
        at = int(rest[np.argmin(_norms(tops[rest] - tops[at]))])


def _cell_join(
    queries: DataFrame, base: DataFrame, k: int, skip_same: bool, cell_rows: int, block_rows: int, width: int, compared: Accumulator | None
) -> DataFrame:
    spark = base.sparkSession
    rows = base.count()
    count = max(1, min(math.ceil(rows / cell_rows), BROADCAST_VALUES // max(1, width)))
    # the rows of least hash are a random choice; as many reach the driver as are sent to every task later
    chosen = base.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], _CANDIDATES)
    pivots = np.unique(matrix(chosen.column("x")), axis=0)
    tree = _Tree(np.random.default_rng(0).permutation(pivots), math.ceil(math.sqrt(len(pivots))))
    base = materialize(_placed(base, tree), "neighbour-base")
    queries = materialize(_placed(queries, tree), "neighbour-queries")
    reach, held = np.full(len(tree.tops), -np.inf), np.zeros(len(tree.tops), dtype=np.int64)
    for r in base.groupBy("top").agg(F.max("top_r").alias("reach"), F.count(F.lit(1)).alias("n")).collect():
        reach[r["top"]], held[r["top"]] = r["reach"], r["n"]
    # base groups by query blocks make about twice as many tiles as there are tasks at once; no block is too large for a task
    side = math.ceil(math.sqrt(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base_block = min(block_rows, max(cell_rows, math.ceil(rows / side)))
    query_block = min(block_rows, max(cell_rows, math.ceil(queries.count() / side)))
    group = _groups_of_tops(tree.tops, held, base_block)

    def grouped(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.get(F.lit(group.tolist()), F.col("top")).cast("int"))

    # one row per key and group: how many blocks its base rows make
    blocks = grouped(base).groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / base_block).cast("int").alias("base_blocks"))
    blocks = materialize(blocks, "neighbour-blocks")
    shipped = spark.sparkContext.broadcast((tree, reach, group))

    def block_of(blocks: str):
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    def meet(visits: DataFrame, own: bool) -> DataFrame:
        """Queries and base rows of a key and group in blocks of both."""

        def match(here: pa.Table, there: pa.Table) -> pa.Table:
            if not here.num_rows or not there.num_rows:
                return pa.table(_candidate_batch((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), ""), names=_NAMES)
            left, right = (
                (np.asarray(t.column("id")), matrix(t.column("x")), np.asarray(t.column("cell")), np.asarray(t.column(c)))
                for t, c in ((here, "radius"), (there, "r"))
            )
            found = _tile(shipped.value[0], left, right, k, skip_same, own, compared)
            return pa.table(_candidate_batch(found, here.column("key")[0].as_py()), names=_NAMES)

        several = visits.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("query_blocks"))
        plan = materialize(blocks.join(several, ["key", "part"]), "neighbour-plan")
        keys = ["key", "part", "qb", "bb"]
        left = visits.join(plan, ["key", "part"]).withColumn("qb", block_of("query_blocks")).withColumn("bb", every("base_blocks"))
        right = grouped(base).join(plan, ["key", "part"]).withColumn("qb", every("query_blocks")).withColumn("bb", block_of("base_blocks"))
        left, right = left.select("id", "x", "cell", "radius", *keys), right.select("id", "x", "cell", "r", *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, _CANDIDATES)

    home = grouped(queries).withColumn("radius", F.lit(float("inf")))
    near = materialize(meet(home, True), "neighbour-own")
    # with k rows found in its own group, a query only looks for nearer ones in others
    distances = near.groupBy(F.col("query").alias("id"), "key").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    known = distances.select("id", "key", F.coalesce(F.get("d", F.lit(k - 1)), F.lit(float("inf"))).alias("within"))
    known = grouped(queries).join(known, ["id", "key"], "left").select(
        "id", "x", "key", "cell", "part", F.coalesce("within", F.lit(float("inf"))).alias("radius")
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, spread, groups = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, radius = matrix(batch.column(1)), np.asarray(batch.column(4)), np.asarray(batch.column(5))
            for number in range(groups.max() + 1):
                near = np.zeros(len(x), dtype=bool)
                for top in np.flatnonzero((groups == number) & (spread >= 0)):
                    near |= _norms(x - pivots.tops[top]) <= _widened(spread[top] + radius)
                near = np.flatnonzero(near & (own != number))
                if len(near):
                    part = batch.take(pa.array(near))
                    numbers = pa.array(np.full(len(near), number), pa.int32())
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], numbers, part.column(5)], names=batch.schema.names)

    visits = known.mapInArrow(visit, "id long, x array<double>, key string, cell int, part int, radius double")
    visits = materialize(visits, "neighbour-visits")
    return near.unionByName(meet(visits, False))


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int = 5,
    row_id: str = "row_id",
    features: str = "features",
    key: str | None = None,
    skip_same: bool = False,
    broadcast_values: int = BROADCAST_VALUES,
    cell_rows: int = CELL_ROWS,
    block_rows: int | None = None,
    compared: Accumulator | None = None,
) -> DataFrame:
    """(query, neighbor, distance, rank): the k nearest base rows of every query row.

    ``key`` restricts neighbours to rows with the same key; with an array column a row has several keys,
    and the result one more column, the key that its k neighbours share with it. ``skip_same`` leaves a
    row out of its own neighbours. The result is exact on both paths. ``compared`` counts the pairs of rows
    whose distance was worked out in the tree.
    """
    query_rows = _standard(queries, row_id, features, key)
    base_rows = _standard(base, row_id, features, key)
    sample = query_rows.select("x").take(1)
    width = len(sample[0]["x"]) if sample else 1
    fits = max(1, broadcast_values // max(1, width))
    shipped = query_rows.limit(fits + 1).toArrow() if broadcast_values else None
    scan = shipped is not None and shipped.num_rows <= fits
    if not scan or shipped.num_rows > FEW_QUERIES:
        # read several times below
        base_rows = materialize(base_rows, "neighbour-input")
        scan = scan and shipped.num_rows * base_rows.count() <= SCAN_PAIRS
    if scan:
        candidates = _scan_join(shipped, base_rows, k, skip_same)
    else:
        rows = block_rows or max(1, BLOCK_VALUES // width)
        candidates = _cell_join(query_rows, base_rows, k, skip_same, cell_rows, rows, width, compared)
    order = Window.partitionBy("query", "key").orderBy("distance", "neighbor")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    several = key is not None and isinstance(queries.schema[key].dataType, T.ArrayType)
    return ranked.select("query", "neighbor", "distance", "rank", *(["key"] if several else []))


def nn_reference(queries: DataFrame, base: DataFrame, row_id: str = "row_id", features: str = "features", **options) -> DataFrame:
    """Nearest base row of each query row, with its vector."""
    nearest = knn_join(queries, base, 1, row_id, features, **options)
    vectors = base.select(F.col(row_id).alias("neighbor"), F.col(features).alias("reference"))
    return nearest.join(vectors, "neighbor").select(
        F.col("query").alias(row_id), "neighbor", "distance", "reference"
    )


# Fixed value: keeps the density of coincident points finite.
DENSITY_FLOOR = 1e-10


def lof(
    base: DataFrame,
    k: int = 20,
    queries: DataFrame | None = None,
    row_id: str = "row_id",
    features: str = "features",
    **options,
) -> DataFrame:
    """(row_id, lof, score): local outlier factor; score = -lof, lower is more anomalous.

    Without ``queries`` every base row is compared with the others; with them the base
    rows are the normal data and the query rows are scored.
    """
    inner = knn_join(base, base, k, row_id, features, skip_same=True, **options)
    k_distance = inner.groupBy(F.col("query").alias("neighbor")).agg(F.max("distance").alias("k_distance"))

    def densities(edges: DataFrame) -> DataFrame:
        reach = F.greatest("distance", "k_distance")
        return (
            edges.join(k_distance, "neighbor")
            .groupBy("query")
            .agg((F.lit(1.0) / (F.avg(reach) + DENSITY_FLOOR)).alias("density"))
        )

    base_density = densities(inner)
    edges = inner if queries is None else knn_join(queries, base, k, row_id, features, **options)
    own = base_density if queries is None else densities(edges)
    around = base_density.select(F.col("query").alias("neighbor"), F.col("density").alias("near"))
    return (
        edges.join(around, "neighbor")
        .groupBy("query")
        .agg(F.avg("near").alias("near"))
        .join(own, "query")
        .select(
            F.col("query").alias(row_id),
            (F.col("near") / F.col("density")).alias("lof"),
            (-F.col("near") / F.col("density")).alias("score"),
        )
    )
