"""Forests of sessions: what they read and how their accuracy is counted."""

import random

import pytest
from pyspark.sql import functions as F

from encore.operators import models as ML


def samples(rows, n=300):
    rng = random.Random(5)
    data = []
    for i in range(n):
        artist = rng.randrange(3)
        data.append((i, artist, *[float(rng.randrange(2) if j else artist == rng.randrange(4)) for j in range(len(ML.SESSION_FEATURES))]))
    return rows(data, "event_id int, artist_id int, " + ", ".join(f"{c} double" for c in ML.SESSION_FEATURES))


def test_forests_read_even_sorted_parts(rows, monkeypatch):
    """However few files the rows came in; equal rows follow one another inside a part."""
    seen = []

    class Forest(ML.RandomForestClassifier):
        def fit(self, data):
            parts = data.groupBy(F.input_file_name()).agg(F.collect_list(F.struct(*ML.SESSION_FEATURES)).alias("r")).collect()
            seen.append([[tuple(x) for x in p.r] for p in parts])
            return super().fit(data)

    monkeypatch.setattr(ML, "RandomForestClassifier", Forest)
    monkeypatch.setattr(ML, "FOREST_ROWS", 60, raising=False)
    ML.session_artist_classifier(samples(rows).coalesce(1), "artist_id", "event_id", trees=2, folds=2)
    assert len(seen) == 3
    for parts in seen:
        assert len(parts) == 5 and min(map(len, parts)) > 10
        assert all(p == sorted(p) for p in parts)


def test_accuracy_counts_every_test_row(rows):
    df = samples(rows)
    model, row = ML.session_artist_classifier(df, "artist_id", "event_id", trees=4, folds=2)
    row = row.first()
    tested = model.transform(df.withColumn("__a", F.col("artist_id").cast("string"))).filter(ML._hash_share("event_id", seed=42) >= 0.8)
    right = tested.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count("*")).first()
    assert (row.accuracy, row.n_test) == (pytest.approx(right[0], abs=1e-12), right[1]) and row.n_samples == 300
