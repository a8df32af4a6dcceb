"""Resamples of a table in one pass: every row is read once and counted in all replicates (O13, O14, O16).

Two md5 hashes a, b of a row give its draw (a + r b) mod P in replicate r, so draws
are repeatable whatever the partitioning, uniform, and independent between rows and
pairwise between replicates. A task folds its rows into sums of replicates; what
is shuffled grows with replicates and tasks, not with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import text_hash
from encore.session import checkpointed, ship_package

#: Modulus of the draws; rows of a numpy block; rows of a block of weights alone; draws made at a time; cuts that all draws are compared with; cells that one pass cuts an interval into.
P = 2**31 - 1
ROWS, WEIGHED, DRAWN, FAR, SPLITS = 2_048, 16_384, 131_072, 5, 64


def poisson_cuts() -> list[int]:
    """A draw counts as often as the number of these cuts that it reaches: a Poisson(1) weight."""
    out, p, total, i = [], exp(-1.0), 0.0, 0
    while 1.0 - total > 2.0**-31:
        total += p
        out.append(int(total * P))
        i += 1
        p /= i
    return out


def with_draws(df: DataFrame, row_id: Sequence[str], seed: int) -> DataFrame:
    return df.withColumns({"__a": text_hash(*row_id, seed=seed) % P, "__b": text_hash(*row_id, seed=seed + 1) % P})


def draws(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """Draws (row, replicate) of replicates 1, 2, ..."""
    return (a[:, None] + np.arange(1, replicates + 1) * b[:, None]) % P


def few(flags: np.ndarray) -> np.ndarray:
    """Places of the rare true flags; their number is a multiple of 128. Sixteen pieces are laid over one another before the search."""
    width = len(flags) // 16
    found = np.flatnonzero(np.bitwise_or.reduce(flags.view(np.uint64).reshape(16, -1), axis=0).view(bool))
    places = (np.arange(16)[:, None] * width + found).ravel()
    return places[flags[places]]


def weight_tiles(a: np.ndarray, b: np.ndarray, replicates: int) -> Iterator[tuple[int, np.ndarray]]:
    """Poisson(1) weights (replicate, row) as bytes, at most one per cut: the first replicate's place and the weights of some
    replicates, in an array that the next ones overwrite, so that arrays stay in the cache.

    A draw is the one of ``held`` replicates before plus ``held`` b, less P if that reaches P: sums below 2 P fit into
    32 bits, and below P the difference wraps round to a larger number. The few draws beyond the first ``FAR`` cuts are looked up.
    """
    cuts = np.array(poisson_cuts(), np.uint32)
    held = max(1, min(replicates, DRAWN // max(1, len(a))))
    drawn, step = np.ascontiguousarray(draws(a, b, held).T, np.uint32), (b * held % P).astype(np.uint32)
    less, part, flags = np.empty_like(drawn), np.empty(drawn.shape, np.uint8), np.zeros(-(-drawn.size // 128) * 128, bool)
    reached = flags[: drawn.size].reshape(drawn.shape)
    for start in range(0, replicates, held):
        if start:
            np.add(drawn, step, out=drawn)
            np.subtract(drawn, np.uint32(P), out=less)
            np.minimum(drawn, less, out=drawn)
        np.greater_equal(drawn, cuts[0], out=part.view(bool))
        for cut in cuts[1:FAR]:
            np.greater_equal(drawn, cut, out=reached)
            np.add(part, reached.view(np.uint8), out=part)
        np.greater_equal(drawn, cuts[FAR], out=reached)
        far = few(flags)
        part.reshape(-1)[far] += np.searchsorted(cuts[FAR:], drawn.reshape(-1)[far], "right").astype(np.uint8)
        yield start, part[: replicates - start]


def small_weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights (replicate, row) as bytes."""
    out = np.empty((replicates, len(a)), np.uint8)
    for start, part in weight_tiles(a, b, replicates):
        out[start : start + len(part)] = part
    return out


def weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights (row, replicate)."""
    return np.ascontiguousarray(small_weights(a, b, replicates).T, np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch[n].to_numpy(zero_copy_only=False) for n in names]


def exact_kind(value: np.ndarray) -> type:
    """Floats of 32 bits if they hold every weighted sum of a block's values: whole numbers below 2**24."""
    whole = len(value) < 2**20 and bool((value == np.rint(value)).all()) and np.abs(value).sum() * len(poisson_cuts()) < 2**24
    return np.float32 if whole else np.float64


def replicate_means(df: DataFrame, x: str, row_id: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Mean of ``x`` in each resample: rep, stat."""
    ship_package(df.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(replicates), np.zeros(replicates, np.int64)
        for batch in blocks(batches, WEIGHED):
            value, a, b = numbers(batch, "x", "__a", "__b")
            kind = exact_kind(value)
            value, one = value.astype(kind), np.ones(len(value), kind)
            for start, part in weight_tiles(a, b, replicates):
                w, reps = part.astype(kind), slice(start, start + len(part))
                total[reps] += w @ value
                count[reps] += (w @ one).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(count), pa.array(total)], ["rep", "w", "s"])

    rows = with_draws(df.where(F.col(x).isNotNull()), row_id, seed).select(F.col(x).cast("double").alias("x"), "__a", "__b")
    sums = rows.mapInArrow(summed, "rep int, w long, s double").groupBy("rep").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    return sums.where("w > 0").select("rep", (F.col("s") / F.col("w")).alias("stat"))


def _counts(rows: DataFrame, starts: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (cell, replicate) of the rows by cell; a cell begins at each of ``starts``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(starts), replicates), np.int64)
        for batch in blocks(batches, WEIGHED):
            value, a, b = numbers(batch, "x", "__a", "__b")
            cell = np.searchsorted(starts, value, "right") - 1
            order = np.argsort(cell, kind="stable")
            used, first = np.unique(cell[order], return_index=True)
            found[used] += np.add.reduceat(small_weights(a[order], b[order], replicates), first, axis=1, dtype=np.uint32).T
        cell, rep = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(rep.astype(np.int32)), pa.array(found[cell, rep])], ["cell", "rep", "w"])

    sums = rows.mapInArrow(counted, "cell int, rep int, w long").groupBy("cell", "rep").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros((len(starts), replicates), np.int64)
    out[sums["cell"].to_numpy(), sums["rep"].to_numpy()] = sums["w"].to_numpy()
    return out


def _inside(rows: DataFrame, starts: np.ndarray, ends: np.ndarray) -> DataFrame:
    """Rows whose value lies in one of the intervals [start, end), with the place ``i`` of the interval."""

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch["x"].to_numpy()
            i = np.searchsorted(starts, value, "right") - 1
            held = (i >= 0) & (value < ends[i])
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(held)) for c in batch.columns[:3]), pa.array(i[held].astype(np.int32))], ["x", "__a", "__b", "i"])

    return rows.select("x", "__a", "__b").mapInArrow(tagged, "x double, __a long, __b long, i int")


def replicate_medians(df: DataFrame, x: str, row_id: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Median of ``x`` in each resample (the mean of the two middle rows): rep, stat.

    Each pass cuts the intervals that hold a middle row of some replicate at ``SPLITS``
    quantiles into those values and the gaps between them, and counts weights by
    (cell, replicate). A middle row at one of the values is found, one in a gap is
    looked for there by the next pass. The driver holds cells x replicates counts.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = with_draws(df.where(F.col(x).isNotNull() & ~F.isnan(x)), row_id, seed)
    rows = checkpointed(rows.select((F.col(x).cast("double") + 0.0).alias("x"), "__a", "__b"))
    quantiles = F.percentile_approx("x", [k / SPLITS for k in range(1, SPLITS)], 10_000)
    starts, ends = np.array([-np.inf]), np.array([np.inf])
    total = None
    while True:
        live = _inside(rows, starts, ends)
        shape = live.groupBy("i").agg(F.min("x").alias("low"), quantiles.alias("q")).collect()
        values = np.unique([v for r in shape for v in (r["low"], *r["q"])])
        if not len(values):
            return spark.createDataFrame([], "rep int, stat double")
        cells = np.unique(np.concatenate([values, np.nextafter(values, np.inf), starts[starts > -np.inf]]))
        found = _counts(live, cells, replicates)
        if total is None:
            total = found.sum(axis=0)
            kept = np.flatnonzero(total)
            open_ = [(side, j, int(r), int(n - 1 + side) // 2, 0) for j, (r, n) in enumerate(zip(kept, total[kept])) for side in (0, 1)]
            middle = np.zeros((2, len(kept)))
        ahead = np.vstack([np.zeros(replicates, np.int64), np.cumsum(found, axis=0)])
        after, chosen = [], []
        for side, j, r, rank, i in open_:
            first, last = np.searchsorted(cells, starts[i], "left"), np.searchsorted(cells, ends[i], "left")
            cell = int(np.searchsorted(ahead[first + 1 : last + 1, r] - ahead[first, r], rank, "right")) + first
            if values[min(np.searchsorted(values, cells[cell]), len(values) - 1)] == cells[cell]:
                middle[side, j] = cells[cell]
            else:
                after.append((side, j, r, rank - int(ahead[cell, r] - ahead[first, r])))
                chosen.append(cell)
        if not after:
            stats = [(int(r) + 1, float(m)) for r, m in zip(kept, middle.mean(axis=0))]
            return spark.createDataFrame(stats, "rep int, stat double")
        used = np.unique(chosen)
        starts, ends = cells[used], np.append(cells, np.inf)[used + 1]
        open_ = [(*state, int(np.searchsorted(used, cell))) for state, cell in zip(after, chosen)]


# ---- sums of clusters ---------------------------------------------------------


def cluster_sums(rows: DataFrame, columns: Sequence[str], reps: int, k: int, dims: int, assign: Callable) -> np.ndarray:
    """Sums (replicate, cluster, ...) of weight, squared length and vector.

    ``assign`` gives for arrays of a block (vectors, then ``columns``) the labels and
    weights (row, replicate) of its rows. Vectors of sums are merged by Spark; the
    driver gets replicates x clusters of them.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((reps, k, dims + 2))
        for batch in blocks(batches):
            vectors = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            full = np.concatenate([np.ones((len(vectors), 1)), (vectors**2).sum(axis=1, keepdims=True), vectors], axis=1)
            labels, w = assign(vectors, *numbers(batch, *columns))
            for r in range(reps):
                shares = (labels[:, r, None] == np.arange(k)) * w[:, r, None]
                out[r] += shares.T @ full
        rep, cluster = np.divmod(np.arange(reps * k, dtype=np.int32), k)
        flat = pa.ListArray.from_arrays(np.arange(reps * k + 1, dtype=np.int32) * (dims + 2), out.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(cluster.astype(np.int32)), flat], ["rep", "cluster", "s"])

    found = rows.mapInArrow(summed, "rep int, cluster int, s array<double>").select("rep", "cluster", array_to_vector("s").alias("s"))
    merged = found.groupBy("rep", "cluster").agg(Summarizer.metrics("sum").summary(F.col("s")).alias("m")).select("rep", "cluster", vector_to_array("m.sum").alias("s"))
    out = np.zeros((reps, k, dims + 2))
    for r in merged.collect():
        out[r["rep"], r["cluster"]] = r["s"]
    return out


def replicate_sums(rows: DataFrame, columns: Sequence[str], reps: int, width: int, dims: int, measure: Callable) -> np.ndarray:
    """Sums (replicate, width) of what ``measure`` gives for a block, as ``cluster_sums`` calls it."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((reps, width))
        for batch in blocks(batches):
            vectors = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            out += measure(vectors, *numbers(batch, *columns))
        rep, at = np.divmod(np.arange(reps * width, dtype=np.int32), width)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(at.astype(np.int32)), pa.array(out.ravel())], ["rep", "at", "s"])

    found = rows.mapInArrow(summed, "rep int, at int, s double").groupBy("rep", "at").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((reps, width))
    out[found["rep"].to_numpy(), found["at"].to_numpy()] = found["s"].to_numpy()
    return out


def vector_rows(df: DataFrame, vector: str, row_id: str, seed: int, **more: Column) -> tuple[DataFrame, int]:
    """Stored rows with the vector as an array ``x``, the draws and ``more``, and the length of vectors."""
    ship_package(df.sparkSession)
    rows = with_draws(df, [row_id], seed).select(vector_to_array(vector).alias("x"), "__a", "__b", *(c.alias(n) for n, c in more.items()))
    rows = checkpointed(rows)
    return rows, rows.agg(F.max(F.size("x"))).first()[0] or 0


def label_index(df: DataFrame, label: str) -> tuple[Column, int]:
    """The place of a label among the sorted labels; clusters are few."""
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    return (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1).cast("int"), len(labels)


def spread(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calinski-Harabasz index of each replicate, and the centres (replicate, cluster, dimension), from cluster sums."""
    n, squares, total = sums[..., 0], sums[..., 1], sums[..., 2:]
    centres = np.divide(total, n[..., None], out=np.zeros_like(total), where=n[..., None] > 0)
    rows, used = n.sum(axis=1), (n > 0).sum(axis=1)
    mean = total.sum(axis=1) / np.maximum(rows, 1)[:, None]
    between = (n * ((centres - mean[:, None]) ** 2).sum(axis=2)).sum(axis=1)
    within = squares.sum(axis=1) - (n * (centres**2).sum(axis=2)).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (between / (used - 1)) / (within / (rows - used)), centres


def scatter_index(scatter: np.ndarray, n: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Davies-Bouldin index of each replicate from summed distances to the centres."""
    out = np.empty(len(n))
    for r in range(len(n)):
        used = n[r] > 0
        mean, c = scatter[r, used] / n[r, used], centres[r, used]
        gap = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        with np.errstate(divide="ignore"):
            out[r] = ((mean[:, None] + mean) / gap).max(axis=1).mean()
    return out


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (row, centre)."""
    return np.maximum((vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(axis=1), 0.0)
