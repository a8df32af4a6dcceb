"""Hard negatives for contrastive training: tracks of another culture that score nearly as high as an anchor's own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.llm.vectors import largest_component, matrix, paired, places, scaled, usable
from encore.session import checkpointed, ship_package

#: Reference directions, rows they are chosen from, rows of a cell, and the slack of an angle and of a bound.
REFERENCES, SAMPLE, CELL = 16, 1024, 64
SLACK_ANGLE, SLACK_BOUND = 1e-9, 1e-9


def directions(vectors: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` unit vectors among ``vectors``, each the farthest in angle from those before it."""
    lengths = np.sqrt((vectors**2).sum(axis=1))
    units = vectors[lengths > 0] / lengths[lengths > 0, None]
    chosen: list[int] = []
    nearest = np.full(len(units), np.inf)
    while len(chosen) < count and nearest.max(initial=0) > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles(units, units[chosen[-1:]])[:, 0])
        nearest[chosen] = 0
    return units[chosen]


def angles(units: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of unit (or zero) vectors to each reference, accurate at 0 and pi as well."""
    out = np.empty((len(units), len(references)))
    for j, r in enumerate(references):
        out[:, j] = 2 * np.arctan2(np.sqrt(((units - r) ** 2).sum(axis=1)), np.sqrt(((units + r) ** 2).sum(axis=1)))
    return out


def bounds(low: np.ndarray, high: np.ndarray, shortest: np.ndarray, longest: np.ndarray, anchor: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score with an anchor of all vectors whose angles and lengths lie in the given intervals.

    The triangle inequality of angles gives an interval of the angle for each
    reference; the intersection becomes one of the cosine, times lengths one of
    the score. Rounding only widens it.
    """
    near = np.maximum(np.maximum(low - anchor, anchor - high).max(axis=1, initial=0.0) - SLACK_ANGLE, 0.0)
    far = np.minimum(np.minimum(anchor + high, 2 * np.pi - anchor - low).min(axis=1, initial=np.pi) + SLACK_ANGLE, np.pi)
    most, least = np.cos(near), np.cos(far)
    top = length * np.where(most > 0, longest, shortest) * most
    bottom = length * np.where(least > 0, shortest, longest) * least
    slack = SLACK_BOUND * length * longest + 1
    return bottom - slack, top + slack


class Slice:
    """Rows of a slice in cells of similar direction, with the intervals of angles and lengths of each cell."""

    def __init__(self, table: pa.Table, references: np.ndarray, dims: int):
        vectors = matrix(table["numbers"], dims, np.int64)
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        found = matrix(table["angles"], len(references)) if len(references) else np.empty((len(vectors), 0))
        nearest = found.argmin(axis=1) if len(references) else np.zeros(len(vectors), int)
        order = np.lexsort((found[np.arange(len(found)), nearest] if len(references) else lengths, nearest))
        self.vectors, self.lengths, self.angles = vectors[order], lengths[order], found[order]
        self.rows = table["row"].to_numpy()[order]
        self.places = places(table["track_id"])[order]
        self.order = order
        labels = table["culture"].combine_chunks()
        self.codes, self.labels = labels.dictionary_encode().indices.to_numpy(zero_copy_only=False)[order], {v: i for i, v in enumerate(labels.dictionary_encode().dictionary.to_pylist())}
        self.starts = np.arange(0, len(order), CELL)
        cut = lambda f, x: f.reduceat(x, self.starts, axis=0)
        self.low, self.high = cut(np.minimum, self.angles), cut(np.maximum, self.angles)
        self.shortest, self.longest = cut(np.minimum, self.lengths), cut(np.maximum, self.lengths)

    def cells(self, angle: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        return bounds(self.low, self.high, self.shortest, self.longest, angle, length)

    def members(self, cells: np.ndarray) -> np.ndarray:
        """Places of the rows of ``cells``."""
        at = (self.starts[cells][:, None] + np.arange(CELL)).ravel()
        return at[at < len(self.rows)]

    def best(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((self.rows[at], self.places[at], -scores))


def top_alike(part: Slice, vector: np.ndarray, angle: np.ndarray, length: float, row: int, code: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` other rows of label ``code``: places and scores; cells by falling bound until none can add a row."""
    _, top = part.cells(angle, length)
    order = np.argsort(-top, kind="stable")
    at, scores, done, step = np.empty(0, int), np.empty(0, np.int64), 0, 4
    while done < len(order):
        least = scores[-1] if len(scores) >= wanted else None
        if least is not None and top[order[done]] < least:
            break
        mine = part.members(order[done : done + step])
        mine = mine[(part.codes[mine] == code) & (part.rows[mine] != row)]
        if least is not None and len(mine):
            mine = mine[bounds(part.angles[mine], part.angles[mine], part.lengths[mine], part.lengths[mine], angle, length)[1] >= least]
        done, step = done + step, 2 * step
        at, scores = np.concatenate([at, mine]), np.concatenate([scores, part.vectors[mine] @ vector])
        keep = part.best(at, scores)[:wanted]
        at, scores = at[keep], scores[keep]
    return at, scores


def in_windows(part: Slice, vector: np.ndarray, angle: np.ndarray, length: float, code: int, windows: list[tuple[int, int]], wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most score) the first ``wanted`` rows of another label inside it: places and scores."""
    least, most = min(w[0] for w in windows), max(w[1] for w in windows)
    bottom, top = part.cells(angle, length)
    at = part.members(np.flatnonzero((top >= least) & (bottom <= most)))
    at = at[part.codes[at] != code]
    bottom, top = bounds(part.angles[at], part.angles[at], part.lengths[at], part.lengths[at], angle, length)
    at = at[(top >= least) & (bottom <= most)]
    scores = part.vectors[at] @ vector
    at, scores = at[(scores >= least) & (scores <= most)], scores[(scores >= least) & (scores <= most)]
    order = part.best(at, scores)
    at, scores = at[order], scores[order]
    out = []
    for low, high in windows:
        first, last = np.searchsorted(-scores, -high, "left"), np.searchsorted(-scores, -low, "right")
        last = min(last, first + wanted)
        out.append((at[first:last], scores[first:last]))
    return out


def _window(score: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """Integers n with low_percent * score <= 100 * n <= high_percent * score."""
    return -(-low_percent * score // 100), high_percent * score // 100


def _runner(references: np.ndarray, dims: int, schema: pa.Schema, each):
    """The function of one slice of tracks and one block of anchors; ``each`` yields (anchor, slot, places, scores)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        part = Slice(left, references, dims)
        vectors = matrix(right["numbers"], dims, np.int64)
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        angle = matrix(right["angles"], len(references)) if len(references) else np.empty((len(vectors), 0))
        codes = [part.labels.get(v, -1) for v in right["culture"].to_pylist()]
        found = [x for i, code in enumerate(codes) for x in each(part, right, i, vectors[i], angle[i], float(lengths[i]), code)]
        sizes = [len(at) for _, _, at, _ in found]
        if not sum(sizes):
            return schema.empty_table()
        who, slot = np.repeat([f[0] for f in found], sizes), np.repeat([f[1] for f in found], sizes)
        at = np.concatenate([f[2] for f in found])
        scores = np.concatenate([f[3] for f in found])
        columns = [right["row"].take(who), pa.array(slot, pa.int32()), pa.array(part.rows[at]), left["track_id"].take(part.order[at]), pa.array(scores)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    return run


def hard_negatives(
    tracks: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = 256,
    track_id: str = "track_id",
    audio_vector: str = "audio_vector",
    culture: str = "culture",
) -> DataFrame:
    """Hard negatives of anchor tracks: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become integers floor(scale * x), the score of two tracks is their
    inner product, and higher scores come first (ties: the smaller id, null last).
    An anchor's positives are its first ``positives`` other rows of the same culture.
    For each of them the first ``negatives`` rows of another culture are returned
    whose score n satisfies low_percent * p <= 100 * n <= high_percent * p for the
    positive's score p.

    Each row stores its angles to ``REFERENCES`` directions, which are chosen from
    ``SAMPLE`` rows and decide speed only. Against an anchor they give an interval of
    the cosine and, times lengths, of the score, rounded outwards; cells of rows and
    then rows are scored only where the interval overlaps a window that is still
    open. Slices and blocks of anchors are dealt by a hash, each pair is one task's
    work, and only the best of a slice leave it.

    Null cultures, null, empty or non-finite vectors and vectors of another length
    than that of the first id take no part. Repeated ids are rows of their own.
    Components stay at the largest integer whose scores still fit a long. Anchors
    without positives, positives without negatives and empty tables give no row.
    Other columns of ``tracks`` are not read.
    """
    spark = tracks.sparkSession
    ship_package(spark)
    known = tracks.where(F.col(culture).isNotNull())
    rows, n, dims = usable(known, track_id, audio_vector, culture=F.col(culture), anchor=F.coalesce(anchors, F.lit(False)))
    rows = rows.withColumn("numbers", scaled("vector", scale, largest_component(dims))).drop("vector")
    sample = rows.select("numbers", F.xxhash64("row").alias("at")).orderBy("at").limit(SAMPLE).collect()
    references = directions(np.array([r["numbers"] for r in sample], float).reshape(len(sample), dims), REFERENCES)

    def with_angles(batches):
        for batch in batches:
            vectors = matrix(pa.chunked_array([batch["numbers"]]), dims)
            lengths = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
            found = angles(np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0), references)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())], [*batch.schema.names, "angles"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{k} {v}" for k, v in kinds.items())
    rows = checkpointed(rows.mapInArrow(with_angles, f"{ddl}, angles array<double>"))
    asked = rows.where("anchor").drop("anchor")
    rows, count = rows.drop("anchor"), asked.count()
    out = f"anchor_row long, slot int, row long, found_id {kinds['track_id']}, score long"
    like = spark.createDataFrame([], out).toArrow().schema
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "row")

    def matches(queries: DataFrame, each, wanted: int) -> DataFrame:
        left, right = paired(rows, n, queries, count)
        found = left.cogroup(right).applyInArrow(_runner(references, dims, like, each), out)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)

    def alike(part, right, i, vector, angle, length, code):
        if code >= 0:
            yield (i, 0, *top_alike(part, vector, angle, length, right["row"][i].as_py(), code, positives))

    def windowed(part, right, i, vector, angle, length, code):
        given = right["scores"][i].as_py()
        spans = [(k, _window(s, low_percent, high_percent)) for k, s in enumerate(given)]
        spans = [(k, w) for k, w in spans if w[0] <= w[1]]
        if spans:
            for (k, _), (at, scores) in zip(spans, in_windows(part, vector, angle, length, code, [w for _, w in spans], negatives)):
                yield i, k, at, scores

    own = matches(asked, alike, positives).select("anchor_row", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own = checkpointed(own)
    scores = own.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    queries = checkpointed(asked.join(scores, "row"))
    hard = matches(queries, windowed, negatives).select("anchor_row", "slot", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asked.select(F.col("row").alias("anchor_row"), F.col("track_id").alias("anchor_id"))
    return hard.join(own, ["anchor_row", "slot"]).join(names, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
