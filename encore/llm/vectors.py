"""Audio vectors of tracks: rows fit for comparison, cuts into slices of bounded size, and pairs of slices and query blocks."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.session import checkpointed

#: Rows of one slice and of one block of queries at most (on average), and slices at least, so that small tables use all cores.
SLICE_ROWS, BLOCK_ROWS, SLICES = 32_768, 8_192, 24


def usable(tracks: DataFrame, track_id: str, audio_vector: str, nonzero: bool = False, **more: Column) -> tuple[DataFrame, int, int]:
    """Stored rows that can be compared, their number, and the length of their vectors.

    Columns: row (a key of its own for each row), track_id, vector (array<double>)
    and ``more``. Vectors that are null or empty, hold null or non-finite numbers,
    or (``nonzero``) only zeros take no part; neither do vectors of another length
    than that of the usable row with the smallest id (null last).
    """
    rows = tracks.select(F.col(track_id).alias("track_id"), F.col(audio_vector).cast("array<double>").alias("vector"), *(c.alias(k) for k, c in more.items()))
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where((F.size("vector") > 0) & fit)
    if nonzero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    order = F.struct(F.col("track_id").isNull(), "track_id", F.size("vector"))
    n, size = rows.agg(F.count(F.lit(1)), F.min_by(F.size("vector"), order)).first()
    return rows.where(F.size("vector") == F.lit(size or 0)), n, size or 0


def scaled(vector: str, scale: int, most: int) -> Column:
    """Components as integers floor(scale * x); beyond +-``most`` they stay there."""
    high = F.lit(float(most))
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, high), -high)).cast("long"))


def largest_component(dims: int, terms: int = 1) -> int:
    """The largest integer component whose products still add up to a long, ``terms`` products for each of ``dims``."""
    return isqrt((2**63 - 1) // max(1, dims * terms))


def paired(rows: DataFrame, n: int, queries: DataFrame, asked: int) -> tuple:
    """``rows`` and ``queries`` grouped by (slice, block), to be cogrouped: each query meets each row once.

    Rows are dealt to slices and queries to blocks by a hash of their key ``row``,
    so no key makes a slice larger; a task holds one slice and one block.
    """
    slices, blocks = max(SLICES, -(-n // SLICE_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    key = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = rows.withColumn("slice", key(slices)).withColumn("block", every(blocks))
    queries = queries.withColumn("block", key(blocks)).withColumn("slice", every(slices))
    return rows.groupBy("slice", "block"), queries.groupBy("slice", "block")


def matrix(column: pa.ChunkedArray, dims: int, kind: type = np.float64) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def places(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each row in the order of its id, null last; equal ids share a place."""
    ids = column.to_pylist()
    at = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    return np.array([at.get(v, len(at)) for v in ids], np.int64)
