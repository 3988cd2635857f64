"""How much the explanations of a set of models differ from each other."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.functions import vectors as V
from relevia.functions.arrow import matrix
from relevia.session import bound_batches


def percent_to_int(k: float, n: int) -> int:
    """A fraction of ``n`` as a count, rounded up."""
    if not 0.0 < k <= 1.0:
        raise ValueError(f"k must be in (0, 1], not {k}")
    return int(math.ceil(k * n))


def _count(k: float, width: int) -> int:
    return percent_to_int(k, width) if k < 1 else int(k)


def euclid(a: Column, b: Column) -> Column:
    return V.euclidean(a, b)


def euclid_abs(a: Column, b: Column) -> Column:
    return V.euclidean(V.absolute(a), V.absolute(b))


def feature_agreement(a: Column, b: Column, k: int) -> Column:
    """Overlap of the two top-k field sets by magnitude, as a share of k."""
    return F.size(F.array_intersect(V.top_positions(a, k), V.top_positions(b, k))) / F.lit(float(k))


def sign_agreement(a: Column, b: Column, k: int) -> Column:
    """As ``feature_agreement``, counting only fields whose signs do not oppose."""
    shared = F.array_intersect(V.top_positions(a, k), V.top_positions(b, k))
    agreeing = F.filter(shared, lambda i: F.element_at(a, i) * F.element_at(b, i) >= 0)
    return F.size(agreeing) / F.lit(float(k))


def topk_euclid(a: Column, b: Column, width: int, k: float = 0.25) -> Column:
    """Euclidean distance of the ``int(k * width)`` largest values of each side, by rank."""
    n = int(width * k)

    def largest(v: Column) -> Column:
        return F.slice(F.reverse(F.array_sort(v)), 1, n)

    return V.euclidean(largest(a), largest(b))


def topk_ranking_distance(a: Column, b: Column, width: int, k: float = 0.25, window: int = 3) -> Column:
    """Mean share of fields that differ in sliding windows over the two top rankings.

    Null when the top holds fewer fields than one window.
    """
    n = int(width * k)
    if n < window:
        return F.lit(None).cast("double")
    steps = n - window + 1

    def mean_miss(top_a: Column, top_b: Column) -> Column:
        missed = F.transform(
            F.sequence(F.lit(1), F.lit(steps)),
            lambda s: F.lit(1.0)
            - F.size(F.array_intersect(F.slice(top_a, s, window), F.slice(top_b, s, window))) / F.lit(float(window)),
        )
        return V.total(missed) / F.lit(float(steps))

    return V.let(
        V.top_positions(a, n, by_magnitude=False),
        lambda top_a: V.let(V.top_positions(b, n, by_magnitude=False), lambda top_b: mean_miss(top_a, top_b)),
    )


PAIR_METRICS = {
    "euclid": lambda a, b, k, width: euclid(a, b),
    "euclid_abs": lambda a, b, k, width: euclid_abs(a, b),
    "sign_disagreement": lambda a, b, k, width: F.lit(1.0) - sign_agreement(a, b, _count(k, width)),
    "feature_disagreement": lambda a, b, k, width: F.lit(1.0) - feature_agreement(a, b, _count(k, width)),
    "topk_euclid": lambda a, b, k, width: topk_euclid(a, b, width, k),
    "ranking": lambda a, b, k, width: topk_ranking_distance(a, b, width, k),
}


def pair_metric(name: str, a: Column, b: Column, width: int, k: float = 3) -> Column:
    """Distance of two explanations of the same row by metric name."""
    return PAIR_METRICS[name](a, b, k, width)


#: Models that ``model_columns`` gives a column each; ``consistency`` has its own, larger bound on the list of seeds.
MAX_MODELS = 1_000
MAX_SEEDS = 100_000
#: Numbers of a chunk of rows and of the differences of a tile that are held at once, models to a side of a tile,
#: and the pairs up to which a task adds up over all its rows before it sends anything.
CHUNK_CELLS = 4_000_000
TILE_CELLS = 2_000_000
TILE_MODELS = 32
HELD_PAIRS = 100_000


def model_columns(
    df: DataFrame, phi: str = "phi", seeds: Sequence[int] | None = None
) -> tuple[DataFrame, list[int]]:
    """One row per explained row with one array column per model (``m0``, ``m1``, ...).

    Naming the ``seeds`` saves the pass that looks for them.
    """
    if seeds is None:
        seeds = [r[0] for r in df.select("seed").distinct().take(MAX_MODELS + 1)]
    if len(seeds) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models in one set")
    seeds = sorted(seeds)
    wide = df.groupBy("row_id").agg(
        *[F.first(F.when(F.col("seed") == s, F.col(phi)), ignorenulls=True).alias(f"m{i}") for i, s in enumerate(seeds)]
    )
    return wide, seeds


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Boolean flags of each row's k largest magnitudes; ties go to the later position."""
    order = np.argsort(np.abs(values), axis=1, kind="stable")[:, -k:]
    flags = np.zeros(values.shape, dtype=bool)
    np.put_along_axis(flags, order, True, axis=1)
    return flags


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.sqrt((values**2).sum(axis=1, keepdims=True))
    return values / np.where(norm == 0.0, 1.0, norm)


def _window_sets(values: np.ndarray, n: int, window: int) -> np.ndarray:
    """(rows, windows, width) flags of the fields in each ranking window."""
    order = np.argsort(values, axis=1, kind="stable")[:, ::-1][:, :n]
    steps = n - window + 1
    flags = np.zeros((len(values), steps, values.shape[1]), dtype=bool)
    for s in range(steps):
        np.put_along_axis(flags[:, s, :], order[:, s : s + window], True, axis=1)
    return flags


def _model_cubes(column: pa.Array, seeds: np.ndarray, cells_per_number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """((rows, models, width) attributions, absent ones zero, and which are there) for chunks of a bounded size."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column)))])
    flat = column.flatten()
    seed, phi = pc.struct_field(flat, "seed"), pc.struct_field(flat, "phi")
    lengths = np.asarray(pc.fill_null(pc.list_value_length(phi), 0))
    width = int(lengths.max()) if len(lengths) else 0
    if width == 0:
        return
    ends = np.cumsum(lengths)
    values = np.asarray(pc.cast(phi.flatten(), pa.float64()).to_numpy(zero_copy_only=False))
    model, row = np.searchsorted(seeds, np.asarray(seed)), np.repeat(np.arange(len(column)), np.diff(offsets))
    step = max(1, CHUNK_CELLS // (len(seeds) * width * cells_per_number))
    for start in range(0, len(column), step):
        size = min(step, len(column) - start)
        cube = np.full((size, len(seeds), width), np.nan)
        mine = np.arange(offsets[start], offsets[start + size])
        mine = mine[lengths[mine] == width]
        cube[row[mine] - start, model[mine]] = values[(ends[mine] - width)[:, None] + np.arange(width)]
        present = ~np.isnan(cube[:, :, 0])
        cube[~present] = 0.0
        yield cube, present


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, models of a, models of b): dot products of flags."""
    return np.matmul(a.astype(np.float64), b.astype(np.float64).swapaxes(-1, -2))


def consistency(
    df: DataFrame,
    k: float = 5,
    ranking_k: float | None = None,
    normalize: bool = True,
    phi: str = "phi",
    seeds: Sequence[int] | None = None,
) -> DataFrame:
    """Mean distance of every model pair over the rows both explain.

    A row's models are brought together once by row id. A task takes its rows in chunks and the model pairs
    in tiles: all pairs of two blocks of models at a time, by matrix products and whole differences. So it
    holds a chunk and a tile, whatever the number of models; sums leave it once per task, or once per chunk
    where there are more than ``HELD_PAIRS`` pairs, and are added up before they are shuffled. With ``ranking_k``
    the sliding-window ranking distance is added.
    """
    bound_batches(df.sparkSession)
    if seeds is None:
        seeds = [r[0] for r in df.select("seed").distinct().take(MAX_SEEDS + 1)]
        if len(seeds) > MAX_SEEDS:
            raise ValueError(f"more than {MAX_SEEDS} models in one set")
    else:
        df = df.where(F.col("seed").isin(list(seeds)))
    known = np.array(sorted(seeds), dtype=np.int64)
    window = 3
    names = ["euclid_abs", "euclid", "sign_disagreement", "feature_disagreement"]
    if ranking_k is not None:
        names.append("ranking")

    def prepared(cube: np.ndarray) -> dict[str, np.ndarray | None]:
        rows, models, width = cube.shape
        flat = cube.reshape(-1, width)
        if normalize:
            flat = _unit(flat)
        top_n = _count(k, width)
        tops = _top(flat, top_n)
        of = {"phi": flat, "top": tops, "up": tops & (flat >= 0), "down": tops & (flat <= 0), "none": tops & (flat == 0)}
        of = {n: v.reshape(rows, models, width) for n, v in of.items()}
        of["ranks"] = None
        if ranking_k is not None and int(width * ranking_k) >= window:
            flags = _window_sets(flat, int(width * ranking_k), window)
            # (rows, windows, models, width)
            of["ranks"] = flags.reshape(rows, models, -1, width).swapaxes(1, 2)
        return of

    def tile_sums(of: dict, present: np.ndarray, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        """(models of i, models of j, names) sums and the rows behind them."""
        top_n = _count(k, of["phi"].shape[2])
        both = present[:, i, None] & present[:, None, j]
        distances = []
        for values in (np.abs(of["phi"]), of["phi"]):
            a, b, sums = values[:, i], values[:, j], np.zeros(both.shape[1:])
            step = max(1, TILE_CELLS // (a.shape[1] * b.shape[1] * a.shape[2]))
            for r in range(0, len(a), step):
                apart = ((a[r : r + step, :, None] - b[r : r + step, None]) ** 2).sum(axis=3)
                sums += np.where(both[r : r + step], np.sqrt(apart), 0.0).sum(axis=0)
            distances.append(sums)
        shared = _products(of["top"][:, i], of["top"][:, j])
        agree = _products(of["up"][:, i], of["up"][:, j]) + _products(of["down"][:, i], of["down"][:, j])
        agree -= _products(of["none"][:, i], of["none"][:, j])
        for same in (agree, shared):
            distances.append(np.where(both, 1.0 - same / top_n, 0.0).sum(axis=0))
        if ranking_k is not None:
            overlap = 1.0
            if of["ranks"] is not None:
                overlap = _products(of["ranks"][:, :, i], of["ranks"][:, :, j]).mean(axis=1) / window
            distances.append(np.where(both, 1.0 - overlap, 0.0).sum(axis=0))
        return np.stack(distances, axis=2), both.sum(axis=0)

    def sent(sums: np.ndarray, rows: np.ndarray, i: slice, j: slice) -> pa.RecordBatch:
        a, b = np.nonzero((rows > 0) & (np.arange(i.start, i.stop)[:, None] < np.arange(j.start, j.stop)))
        columns = [pa.array(known[a + i.start], pa.int32()), pa.array(known[b + j.start], pa.int32()), pa.array(rows[a, b])]
        columns += [pa.array(sums[a, b, m]) for m in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=["seed_a", "seed_b", "rows", *names])

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = len(known)
        blocks = [slice(s, min(s + TILE_MODELS, models)) for s in range(0, models, TILE_MODELS)]
        tiles = [(i, j) for n, i in enumerate(blocks) for j in blocks[n:]]
        held: list | None = [None] * len(tiles) if models * (models - 1) // 2 <= HELD_PAIRS else None
        for batch in batches:
            # five flags or values a number, and the windows of a ranking beside them
            for cube, present in _model_cubes(batch.column(0), known, 5 if ranking_k is None else 5 + 2 * TILE_MODELS):
                of = prepared(cube)
                for n, (i, j) in enumerate(tiles):
                    sums, rows = tile_sums(of, present, i, j)
                    if held is None:
                        yield sent(sums, rows, i, j)
                    elif held[n] is None:
                        held[n] = (sums, rows)
                    else:
                        held[n] = (held[n][0] + sums, held[n][1] + rows)
        for n, found in enumerate(held or ()):
            if found is not None:
                yield sent(*found, *tiles[n])

    schema = "seed_a int, seed_b int, rows long, " + ", ".join(f"{n} double" for n in names)
    sets = df.groupBy("row_id").agg(F.collect_list(F.struct(F.col("seed").cast("long").alias("seed"), F.col(phi).alias("phi"))).alias("set"))
    partial = sets.select("set").mapInArrow(add_pairs, schema)
    return partial.groupBy("seed_a", "seed_b").agg(
        F.sum("rows").alias("rows"), *[(F.sum(n) / F.sum("rows")).alias(n) for n in names]
    )


def density_histogram(pairs: DataFrame, metrics: Sequence[str], bins: int = 75) -> DataFrame:
    """Density histogram of every pair metric between its own minimum and maximum.

    A Euclidean metric that exceeds 1 is divided by its maximum first. Empty bins are
    left out. The range of a constant metric is widened by one half on both sides.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    long = pairs.select(cells.alias("s")).select("s.*").where(F.col("value").isNotNull())
    limits = long.groupBy("metric").agg(
        F.max("value").alias("top"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.lit(1)).alias("total"),
    )
    shrink = F.when(F.col("metric").contains("euclid") & (F.col("top") > 1.0), F.col("top")).otherwise(F.lit(1.0))
    flat = F.col("low") == F.col("high")
    limits = (
        limits.withColumn("shrink", shrink)
        .withColumns({"low": F.col("low") / F.col("shrink"), "high": F.col("high") / F.col("shrink")})
        .withColumns({
            "low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
            "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")),
        })
        .withColumn("step", (F.col("high") - F.col("low")) / bins)
    )
    place = F.floor((F.col("value") / F.col("shrink") - F.col("low")) / F.col("step"))
    return (
        long.join(limits, "metric")
        .withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int"))
        .groupBy("metric", "bin")
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.first(F.col("low") + F.col("bin") * F.col("step")).alias("from_value"),
            (F.count(F.lit(1)) / F.first(F.col("total") * F.col("step"))).alias("density"),
        )
    )


MAX_ORDER_CELLS = 2_000_000


def topk_euclid_as_written(df: DataFrame, a: str, b: str, width: int, k: float = 1.0) -> DataFrame:
    """The variant that reads every row under every row's ranking, as one mean over a set.

    For rank j the distance of row i is the norm over all rows r of ``a[i, order_a[r, j]]
    - b[i, order_b[r, j]]``. Counting how often two fields meet at a rank replaces the
    pass over r, so the work per row depends on the field count only.
    """
    n = int(width * k)
    if n * width * width > MAX_ORDER_CELLS:
        raise ValueError("too many fields for the rank table")
    ranked = df.select(
        V.top_positions(F.col(a), n, by_magnitude=False).alias("ra"),
        V.top_positions(F.col(b), n, by_magnitude=False).alias("rb"),
    )
    met = (
        ranked.select(F.posexplode(F.arrays_zip("ra", "rb")).alias("j", "p"))
        .groupBy("j", F.col("p.ra").alias("fa"), F.col("p.rb").alias("fb"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    table = np.zeros((n, width, width))
    for row in met.collect():
        table[row["j"], row["fa"] - 1, row["fb"] - 1] = row["n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = matrix(batch.column(0)), matrix(batch.column(1))
            squares = (
                (x**2) @ table.sum(axis=2).T + (y**2) @ table.sum(axis=1).T
                - 2.0 * np.einsum("if,jfg,ig->ij", x, table, y, optimize=True)
            )
            means = np.sqrt(np.maximum(squares, 0.0)).mean(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([float(means.sum())]), pa.array([len(means)])], names=["s", "n"])

    parts = df.select(a, b).mapInArrow(add, "s double, n long")
    return parts.agg((F.sum("s") / F.sum("n")).alias("distance"))
