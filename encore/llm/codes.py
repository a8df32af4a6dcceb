"""Compressed audio vectors: one code for each part of a vector, found by intersecting bitmasks of entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.vectors import largest_component, matrix, scaled, usable
from encore.session import checkpointed, ship_package

#: Bits of a mask, the entries of a codebook at most.
MOST = 64


def roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(squares.astype(float)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


class Part:
    """The entries of one part: sorted coordinates of each dimension, with the mask of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        self.sorted, self.before = [], []
        for column in entries.T:
            order = np.argsort(column, kind="stable")
            self.sorted.append(column[order])
            self.before.append(np.append(np.uint64(0), np.bitwise_or.accumulate(bits[order])))
        first = entries[:, 0] if entries.shape[1] else np.zeros(len(entries), np.int64)
        self.by_first = np.argsort(first, kind="stable")

    def inside(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries whose every coordinate lies within ``radius`` of the point's."""
        masks = np.full(len(points), ~np.uint64(0) >> np.uint64(MOST - len(self.entries)))
        for d, (values, before) in enumerate(zip(self.sorted, self.before)):
            first = np.searchsorted(values, points[:, d] - radius, "left")
            last = np.searchsorted(values, points[:, d] + radius, "right")
            masks &= before[last] & ~before[first]
        return masks

    def distances(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - self.entries[entry]) ** 2).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point (ties: the lower index) and its squared distance.

        The distance to some entry is the initial radius. Nothing outside its box is
        nearer or as near, so the entries in the intersection of all dimensions are
        exact candidates; they are compared in the order of their indexes.
        """
        if not self.entries.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        guess = self.by_first[np.minimum(np.searchsorted(self.sorted[0], points[:, 0]), len(self.entries) - 1)]
        distance = self.distances(points, guess)
        best = np.full(len(points), MOST, np.int64)
        masks = self.inside(points, roots(distance))
        open_ = np.arange(len(points))
        while len(open_):
            mask = masks[open_]
            low = mask & (~mask + np.uint64(1))
            entry = np.log2(low.astype(float)).astype(np.int64)
            found = self.distances(points[open_], entry)
            better = (found < distance[open_]) | ((found == distance[open_]) & (entry < best[open_]))
            at = open_[better]
            distance[at], best[at] = found[better], entry[better]
            masks[open_] = mask ^ low
            open_ = open_[masks[open_] != 0]
        return best, distance


def cuts(dims: int, parts: int) -> list[int]:
    """Bounds of ``parts`` consecutive parts, equal where ``parts`` divides ``dims``."""
    return [i * dims // parts for i in range(parts + 1)]


def start_codebooks(rows: DataFrame, dims: int, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors of the first ids (null last; equal ids by their numbers)."""
    first = rows.orderBy(F.col("track_id").asc_nulls_last(), "numbers").limit(entries).select("numbers").collect()
    numbers = np.array([r[0] for r in first], np.int64).reshape(len(first), dims)
    at = cuts(dims, parts)
    return [numbers[:, a:b] for a, b in zip(at, at[1:])]


def refined(rows: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts, an unused one stays.

    Every task adds up its rows and hands over one row for each entry in use, so the
    shuffle and the driver hold parts x entries sums whatever the number of rows.
    """
    at = cuts(dims, len(books))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [Part(b) for b in books]
        sums, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            numbers = matrix(pa.chunked_array([batch["numbers"]]), dims, np.int64)
            for p, part in enumerate(built):
                points = numbers[:, at[p] : at[p + 1]]
                code, _ = part.nearest(points)
                counts[p] += np.bincount(code, minlength=len(part.entries))
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    high, low = (np.add.reduceat(x[order], first, axis=0) for x in (points >> 20, points & 0xFFFFF))
                    sums[p][used] += high.astype(object) * (1 << 20) + low
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([e for _, e in used], pa.int32()),
                pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                pa.array([[str(v) for v in sums[p][e]] for p, e in used], pa.list_(pa.string())),
            ],
            ["part", "entry", "n", "sums"],
        )

    found = rows.select("numbers").mapInArrow(summed, "part int, entry int, n long, sums array<string>")
    width = max(b.shape[1] for b in books)
    totals = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).cast("string").alias(f"s{d}") for d in range(width)]
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        for d in range(out[r["part"]].shape[1]):
            out[r["part"]][r["entry"], d] = int(r[f"s{d}"]) // r["n"]
    return out


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, in decimal and joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(
    tracks: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, track_id: str = "track_id", audio_vector: str = "audio_vector", culture: str = "culture"
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of the audio vectors and the codebooks: track_id, code, error, culture_error.

    Components become integers floor(scale * x) and vectors are cut into ``parts``
    consecutive parts. The codebook of each part starts as that part of the first
    ``entries`` (at most 64) ids; each of ``rounds`` assigns every part to the
    nearest entry (squared distance, ties to the lower index) and moves entries to
    the floor of the mean. ``code`` is two hex digits for each part, ``error`` the sum
    of squared distances, ``culture_error`` the sum of errors of all tracks of that
    culture (null is one of its own), at most the largest long.

    Vectors that are null, empty or not finite, and those of another length than
    that of the first id, are left out; so are none others: null and repeated ids
    keep their rows. Components stay at the largest integer whose error fits a long.
    Parts are as equal as they can be where their number does not divide the length.
    An empty table gives no rows and empty codebooks. Other columns are not read.
    """
    if not 0 < entries <= MOST or parts < 1:
        raise ValueError(f"from 1 to {MOST} entries and at least one part")
    spark = tracks.sparkSession
    ship_package(spark)
    rows, _, dims = usable(tracks, track_id, audio_vector, culture=F.col(culture))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = checkpointed(rows.select("track_id", "culture", scaled("vector", scale, largest_component(dims, 4)).alias("numbers")))
    books = start_codebooks(rows, dims, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = refined(rows, books, dims)
    at = cuts(dims, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [Part(b) for b in books]
        for batch in batches:
            numbers = matrix(pa.chunked_array([batch["numbers"]]), dims, np.int64)
            found = [part.nearest(numbers[:, at[p] : at[p + 1]]) for p, part in enumerate(built)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["track_id"], batch["culture"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(e for _, e in found))], ["track_id", "culture", "code", "error"])

    codes = checkpointed(rows.mapInArrow(coded, f"track_id {kinds['track_id']}, culture {kinds['culture']}, code string, error long"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    errors = codes.groupBy("culture").agg(total.alias("culture_error")).withColumnRenamed("culture", "of")
    out = codes.join(errors, F.col("culture").eqNullSafe(F.col("of")))
    return out.select("track_id", "code", "error", "culture_error"), books
