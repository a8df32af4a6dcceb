"""Toxic (explicit) track names by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from encore.llm.words import slices, texts
from encore.session import ship_package

_WORD = re.compile(r"\w+")
#: Bits of the hash space, terms of the first stage and their least |z|, factors per term and stage, rows a term of the second stage is in at least.
BITS, TERMS, LEAST_Z, FACTORS, LEAST_ROWS = 22, 1024, 3.0, 4, 3
#: Words without a term that a worker remembers.
MEMORY = 500_000


def terms_of(word: str) -> list[int]:
    """Hash buckets of a word: the word itself and its starts of four and five letters."""
    own = [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)]
    return [zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in own]


def words_of(name: str) -> set[str]:
    """Distinct lower-cased words of the whole name."""
    return set(_WORD.findall(name.lower()))


def buckets(name: str) -> np.ndarray:
    """Sorted distinct hash buckets of all words of a name."""
    return np.unique(np.array([t for w in words_of(name) for t in terms_of(w)], np.int64))


class Machine:
    """Bias, weights and factors of the terms it knows, by sorted bucket; per worker a bounded memory of words."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place = {t: i for i, t in enumerate(terms.tolist())}
        self.dull: set[str] = set()

    def known(self, name: str) -> list[int]:
        """Places of the terms of a name; words without one are looked up once."""
        if len(self.dull) > MEMORY:
            self.dull = set()
        found: set[int] = set()
        for word in words_of(name).difference(self.dull):
            own = [self.place[t] for t in terms_of(word) if t in self.place]
            found.update(own)
            if not own:
                self.dull.add(word)
        return sorted(found)

    def logit(self, row: np.ndarray) -> float:
        """Log-odds of a name given as its sorted distinct buckets."""
        return self.sum_of(np.searchsorted(self.terms, np.intersect1d(row, self.terms, assume_unique=True)))

    def sum_of(self, held: list[int] | np.ndarray) -> float:
        v = self.factors[held]
        return float(self.bias + self.weights[held].sum() + 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum())

    def score(self, names: list[str]) -> list[float]:
        out = []
        for name in names:
            z = self.sum_of(self.known(name))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def chosen_terms(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Buckets whose share differs most between the classes, at most ``size``, in order."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return np.empty(0, np.int64)
    held, counts = np.unique(np.concatenate(rows), return_counts=True)
    toxic, own = np.unique(np.concatenate([r for r, t in zip(rows, y) if t]), return_counts=True)
    of = np.zeros(len(held), np.int32)
    of[np.searchsorted(held, toxic)] = own
    share = counts / len(y)
    z = (of / n1 - (counts - of) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    strong = np.abs(z) * ((counts > 2) & (np.abs(z) >= LEAST_Z))
    order = np.argsort(-strong, kind="stable")[:size]
    return np.sort(held[order[strong[order] > 0]]).astype(np.int64)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, size: int = TERMS, factors: int = FACTORS) -> Machine:
    """Two stages: the terms whose share differs most between the classes, then every term of ``LEAST_ROWS`` rows or more.

    The second stage learns what the first leaves unexplained, so words that say nothing
    alone but something together get their pair; shrinkage keeps the rest at 0.
    A term has the factors of both stages side by side, so scores add up.
    """
    base = fit_strong(rows, y, size, factors)
    if not 0 < y.sum() < len(y):
        return base
    rest = fit_rest(rows, y, np.array([base.logit(r) for r in rows], np.float32), factors)
    weights, both = rest.weights.copy(), np.zeros((len(rest.terms), 2 * factors), np.float32)
    at = np.searchsorted(rest.terms, base.terms)
    weights[at] += base.weights
    both[at, :factors], both[:, factors:] = base.factors, rest.factors
    keep = (weights != 0) | both.any(axis=1)
    return Machine(rest.terms[keep], base.bias + rest.bias, weights[keep], both[keep])


def fit_rest(rows: list[np.ndarray], y: np.ndarray, offset: np.ndarray, factors: int, epochs: int = 12, rate: float = 0.05, shrink: float = 2e-3, batch: int = 256) -> Machine:
    """Logistic loss beyond ``offset`` by sparse adaptive steps; weights and rows of factors shrink towards 0."""
    held, counts = np.unique(np.concatenate(rows), return_counts=True)
    terms = held[counts >= LEAST_ROWS].astype(np.int64)
    known = [np.searchsorted(terms, np.intersect1d(r, terms, assume_unique=True)) for r in rows]
    rng = np.random.default_rng(0)
    w, v, b = np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), factors)).astype(np.float32), 0.0
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-3, np.float32), np.full(len(terms), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            sizes = np.array([len(known[i]) for i in part])
            at, row = np.concatenate([known[i] for i in part]), np.repeat(np.arange(len(part)), sizes)
            used, place = np.unique(at, return_inverse=True)
            total = lambda values: np.bincount(row, values, len(part))
            sums = np.stack([total(v[at, f]) for f in range(factors)], axis=1)
            z = offset[part] + b + total(w[at]) + 0.5 * ((sums**2).sum(axis=1) - total((v[at] ** 2).sum(axis=1)))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            dw = np.bincount(place, error[row], len(used))
            dv = np.stack([np.bincount(place, error[row] * sums[row, f], len(used)) for f in range(factors)], axis=1) - v[used] * dw[:, None]
            seen_w[used] += dw**2
            seen_v[used] += (dv**2).mean(axis=1)
            seen_b += error.sum() ** 2
            step, turn = rate / np.sqrt(seen_w[used]), (rate / np.sqrt(seen_v[used]))[:, None]
            moved = w[used] - step * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            moved = v[used] - turn * dv
            v[used] = moved * np.maximum(1 - turn * shrink / np.maximum(np.sqrt((moved**2).sum(axis=1, keepdims=True)), 1e-9), 0)
            b -= rate / np.sqrt(seen_b) * error.sum()
    return Machine(terms, float(b), w, v)


def fit_strong(rows: list[np.ndarray], y: np.ndarray, size: int, factors: int, epochs: int = 20, rate: float = 0.02, decay: float = 0.01, batch: int = 128) -> Machine:
    """Logistic loss by Adam with decoupled decay over the chosen terms; the pair term is learned with the linear one."""
    terms = chosen_terms(rows, y, size)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    rng = np.random.default_rng(0)
    w, v, b = np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), factors)).astype(np.float32), np.array([prior], np.float32)
    if not len(terms):
        return Machine(terms, float(prior), w, v)
    known = [np.searchsorted(terms, np.intersect1d(r, terms, assume_unique=True)) for r in rows]
    params, first, second, step = [w, v, b], [np.zeros_like(p) for p in (w, v, b)], [np.zeros_like(p) for p in (w, v, b)], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            x = np.zeros((len(part), len(terms)), np.float32)
            for i, r in enumerate(part):
                x[i, known[r]] = 1
            sums = x @ v
            z = b + x @ w + 0.5 * (sums**2 - x @ v**2).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32) / len(part)
            grads = [x.T @ error, x.T @ (error[:, None] * sums) - v * (x.T @ error)[:, None], np.array([error.sum()])]
            step += 1
            for p, g, m, s in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if p is not b:
                    p -= rate * decay * p
    return Machine(terms, float(b[0]), w, v)


def held_out(track_id):
    """True where crc32 of the id as text is a multiple of 5; null ids are never held out."""
    return F.coalesce(F.crc32(track_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def sized(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, broadcast if they are few, so that no text is shuffled for a sample."""
    return F.broadcast(ids) if most <= BROADCAST_IDS else ids


def with_score(
    tracks: DataFrame,
    labels: DataFrame,
    track_id: str = "track_id",
    track_name: str = "track_name",
    explicit: str = "explicit",
    score: str = "score",
    max_rows: int = 20_000,
    label_id: str = "track_id",
) -> DataFrame:
    """All rows and columns of ``tracks`` with a column ``score``; see ``score_explicit``."""
    spark = tracks.sparkSession
    ship_package(spark)
    if score in tracks.columns:
        raise ValueError(f"tracks has a column {score} already")
    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"))
    marked = labels.select(F.col(label_id).alias("id"), F.col(explicit).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    taught = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [buckets(t) for t in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), part.column(2)], ["y", "terms", "mixed"])

    named = rows.join(sized(taught, max_rows), "id").select("y", "name", F.xxhash64("id", "name").alias("mixed"))
    drawn = named.mapInArrow(hashed, "y int, terms array<int>, mixed long")
    sample = drawn.orderBy("mixed", "y").limit(max_rows).toArrow()  # repeated ids give more rows than ids
    lists = sample["terms"].combine_chunks()
    known = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []
    order = sorted(range(len(known)), key=lambda i: (zlib.crc32(known[i].tobytes()), len(known[i])))
    y = np.asarray(sample["y"].to_pylist(), np.float64)
    sent = spark.sparkContext.broadcast(fit_machine([known[i] for i in order], y[order] if len(y) else y))
    at = tracks.columns.index(track_name)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for part in slices(batches):
            scores = pa.array(machine.score(texts(part.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, score])

    return tracks.mapInArrow(scored, StructType([*tracks.schema.fields, StructField(score, DoubleType())]))


def score_explicit(
    tracks: DataFrame, labels: DataFrame, track_id: str = "track_id", track_name: str = "track_name", explicit: str = "explicit", max_rows: int = 20_000
) -> DataFrame:
    """Score every whole track name for toxicity as ``labels.explicit`` (0 or 1) marks it.

    The machine is fitted on at most ``max_rows`` labelled names, chosen by a hash
    of the id among those that are not held out; this bounds what reaches the driver
    (hash buckets only), also where an id has many rows. It learns a weight per term
    and, through their factors, one per pair of terms: first of the terms whose
    share differs most between the classes, then of all others. All names are scored
    where they lie, without a shuffle; id, language and source are no inputs.

    Null names are empty and get the score of no terms. Null labels and null ids
    teach nothing; of repeated labels the largest counts. Without labels of both
    classes every score is the smoothed base rate. An empty table gives no rows;
    other columns are ignored.

    Columns: track_id, held_out, score, predicted (1 if score >= 0.5).
    """
    rows = tracks.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"))
    scored = with_score(rows, labels, "id", "name", explicit, max_rows=max_rows, label_id=track_id)
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select(F.col("id").alias(track_id), held_out(F.col("id")).alias("held_out"), "score", predicted.alias("predicted"))
