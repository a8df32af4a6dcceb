"""Quality of plays by co-training a view of their text and a view of their metadata."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.html_text import STOP_WORDS
from encore.llm.toxicity import held_out, sized
from encore.llm.words import slices, texts
from encore.session import ship_package

#: Bins of a number, and the probability from which a view teaches the other.
BINS, SURE = 16, 0.97
SYMBOLS = "*&%$#@~^=_<>{}[]\\/+"


def content_of(name: str) -> tuple[float, ...]:
    """The view of the whole text: length, variety, repeats, case, symbols and lines."""
    words, lines = name.split(), name.split("\n")
    n, chars = max(1, len(words)), max(1, len(name))
    return (
        np.log1p(len(words)),
        len("".join(words)) / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(STOP_WORDS.__contains__, words)) / n,
        sum(map(name.count, "0123456789")) / chars,
        sum(map(name.count, ".?")) / n,
        name.count("!") / n,
        name.count("|") / n,
        sum(map(name.count, SYMBOLS)) / chars,
        len(set(lines)) / len(lines),
        np.log1p(len(name) / len(lines)),
        np.log1p(max(map(len, words), default=0)),
    )


class Binned:
    """Additive logistic model over binned numbers and categories."""

    def __init__(self, columns: list[list]):
        self.codes = []
        for values in columns:
            if any(isinstance(v, str) for v in values):
                self.codes.append({v: i + 1 for i, (v, _) in enumerate(sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0])))})
            else:
                known = np.array([v for v in values if v is not None], float)
                self.codes.append(np.unique(np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1])) if len(known) else np.empty(0))
        sizes = [2 + len(c) for c in self.codes]
        self.starts = np.append(0, np.cumsum(sizes))
        self.weights = np.zeros(self.starts[-1] + 1)

    def places(self, columns: list[list]) -> np.ndarray:
        """Weights that each row adds up: one per column."""
        out = []
        for start, code, values in zip(self.starts, self.codes, columns):
            if isinstance(code, dict):
                out.append([start + (code.get(v, 0) if v is not None else len(code) + 1) for v in values])
            else:
                numbers = np.array([np.nan if v is None else v for v in values], float)
                out.append(start + np.where(np.isnan(numbers), len(code) + 1, np.searchsorted(code, numbers, "right")))
        return np.array(out, np.int64).T.reshape(-1, len(self.codes))

    def logits(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(1) + self.weights[-1]

    def fit(self, places: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> None:
        x = np.zeros((len(y), len(self.weights)), np.float32)
        x[np.arange(len(y))[:, None], places] = 1
        x[:, -1] = 1
        self.weights = newton(x, y, ridge)


def newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression; the last column is the intercept and is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w


class CoTrained:
    """Two views that taught each other, and how their calibrated logits combine."""

    def __init__(self, views: list[list[list]], y: np.ndarray, rounds: int, grow: int):
        """``views`` holds the columns of each view for all rows; ``y`` is NaN where a row has no label."""
        marked = np.flatnonzero(~np.isnan(y))
        self.prior = float(np.log(((y[marked] == 1).sum() + 0.5) / ((y[marked] == 0).sum() + 0.5)))
        self.models, self.pseudo = [], [{}, {}]
        if len(np.unique(y[marked])) < 2:
            return
        models = [Binned(v) for v in views]
        places = [m.places(v) for m, v in zip(models, views)]
        checks, taught = marked[::5], np.setdiff1d(marked, marked[::5])
        free = set(np.flatnonzero(np.isnan(y)).tolist())
        for _ in range(rounds + 1):
            for model, at, extra in zip(models, places, self.pseudo):
                rows = np.concatenate((taught, np.fromiter(extra, np.int64, len(extra))))
                model.fit(at[rows], np.concatenate((y[taught], np.fromiter(extra.values(), float, len(extra)))))
            pool = np.array(sorted(free), np.int64)
            if not len(pool):
                break
            chances = [1 / (1 + np.exp(-np.clip(m.logits(at[pool]), -30, 30))) for m, at in zip(models, places)]
            told: list[dict[int, float]] = [{}, {}]
            for view, p in enumerate(chances):
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    best = np.argsort(-sure, kind="stable")[:grow]
                    told[1 - view].update((int(pool[i]), label) for i in best if sure[i] >= SURE)
            clash = {i for i in told[0].keys() & told[1].keys() if told[0][i] != told[1][i]}
            for extra, new in zip(self.pseudo, told):
                extra.update((i, label) for i, label in new.items() if i not in clash)
            free -= told[0].keys() | told[1].keys()
        self.models = models
        self.scales = []
        for model, at in zip(models, places):
            z = model.logits(at[checks])
            self.scales.append(newton(np.column_stack((z, np.ones(len(z)))), y[checks], 1e-3))
        parts = [s[0] * m.logits(at[checks]) + s[1] for s, m, at in zip(self.scales, models, places)]
        self.mix = newton(np.column_stack((*parts, np.ones(len(checks)))), y[checks], 1e-2)

    def score(self, views: list[list[list]]) -> list[np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        n = len(views[0][0])
        if not self.models:
            return [np.full(n, 1 / (1 + np.exp(-self.prior)))] * 3
        parts = [s[0] * m.logits(m.places(v)) + s[1] for s, m, v in zip(self.scales, self.models, views)]
        both = self.mix[0] * parts[0] + self.mix[1] * parts[1] + self.mix[2]
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*parts, both)]


def _views(part: pa.RecordBatch, first: int) -> list[list[list]]:
    content = list(zip(*map(content_of, texts(part.column(first)))))
    meta = [part.column(first + k).to_pylist() for k in (1, 2, 3)]
    return [list(map(list, content)), [meta[0], meta[1], [None if v is None else float(np.log1p(max(v, 0))) for v in meta[2]]]]


def score_quality(
    plays: DataFrame,
    labels: DataFrame,
    track_id: str = "track_id",
    track_name: str = "track_name",
    platform: str = "platform",
    conn_country: str = "conn_country",
    ms_played: str = "ms_played",
    quality: str = "quality",
    max_rows: int = 20_000,
    pool_rows: int = 20_000,
    rounds: int = 4,
    grow: int = 1_000,
) -> DataFrame:
    """Score every play for quality as ``labels.quality`` (0 or 1) marks it.

    Two views never see each other's input: the content of the whole track name,
    and platform, country and length. Both learn from at most ``max_rows`` labelled
    plays that are not held out. In each of ``rounds`` rounds a view labels those
    of at most ``pool_rows`` unlabelled plays that it is surest of, up to ``grow``
    per class, and hands them to the other view; contradictions are dropped. On a
    fifth of the labelled plays each view is calibrated and the calibrated logits
    are combined. Then all plays are scored where they lie, without a shuffle. The
    two bounds limit what reaches the driver, a few numbers per chosen play, also
    where an id has many rows.

    Null names are empty; null metadata is a category of its own. Null labels and
    ids teach nothing; of repeated labels the largest counts. Without labels of
    both classes every score is the smoothed base rate. An empty table gives no
    rows; other columns are ignored.

    Columns: track_id, held_out, content_score, meta_score, score, predicted, kept (score >= 0.5).
    """
    spark = plays.sparkSession
    ship_package(spark)
    meta = [F.col(platform).cast("string").alias("platform"), F.col(conn_country).cast("string").alias("country"), F.col(ms_played).cast("double").alias("length")]
    rows = plays.select(F.col(track_id).alias("id"), F.col(track_name).alias("name"), *meta)
    marked = labels.select(F.col(track_id).alias("id"), F.col(quality).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    mixed = F.xxhash64("id")
    taught = marked.where(~held_out(F.col("id"))).orderBy(mixed, "id").limit(max_rows)
    free = rows.select("id").where("id IS NOT NULL").join(marked.select("id"), "id", "left_anti").distinct()
    pool = free.where(~held_out(F.col("id"))).orderBy(mixed, "id").limit(pool_rows).withColumn("y", F.lit(None).cast("int"))
    wide = [f"v{i}" for i in range(len(content_of("")))]

    def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            content, (a, b, c) = _views(part, 2)
            columns = [part.column(0), part.column(1), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64()), *(pa.array(v, pa.float64()) for v in content)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "platform", "country", "length", *wide])

    kind = rows.schema["id"].dataType.simpleString()
    chosen = rows.join(sized(taught.unionByName(pool), max_rows + pool_rows), "id").select("id", "y", "name", "platform", "country", "length")
    shape = f"id {kind}, y int, platform string, country string, length double, " + ", ".join(f"{v} double" for v in wide)
    seen = chosen.mapInArrow(viewed, shape)
    sample = seen.orderBy(F.xxhash64("id", *wide), "id").limit(max_rows + pool_rows).toArrow()  # repeated ids give more rows than ids
    sample = sample.sort_by([(c, "ascending") for c in ("id", *wide)])
    y = np.array([np.nan if v is None else v for v in sample["y"].to_pylist()], float)
    views = [[sample[v].to_pylist() for v in wide], [sample[c].to_pylist() for c in ("platform", "country", "length")]]
    sent = spark.sparkContext.broadcast(CoTrained(views, y, rounds, grow))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches):
            scores = [pa.array(s, pa.float64()) for s in model.score(_views(part, 1))]
            yield pa.RecordBatch.from_arrays([part.column(0), *scores], ["id", "content_score", "meta_score", "score"])

    out = rows.mapInArrow(score, f"id {kind}, content_score double, meta_score double, score double")
    kept = F.col("score") >= 0.5
    return out.select(
        F.col("id").alias(track_id), held_out(F.col("id")).alias("held_out"), "content_score", "meta_score", "score", kept.cast("int").alias("predicted"), kept.alias("kept")
    )
