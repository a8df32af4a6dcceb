"""Co-training: exchange of labels, held-out accuracy, calibration, nulls and missing classes."""

import random

import numpy as np

from encore.llm.quality import CoTrained, score_quality

SCHEMA = "track_id long, track_name string, platform string, conn_country string, ms_played long, score double"
LABELS = "track_id long, quality int, platform string"


def play(rng, i, good):
    words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 60))]
    name = " ".join(words) + "." if good else rng.choice([" ".join([words[0]] * 40), " ".join(w.upper() + "!!" for w in words), " | ".join(words)])
    return (i, name, "phone" if good == (rng.random() < 0.9) else "bot", rng.choice(["DE", "VN", None]), rng.randrange(1000), 1.0)


def test_held_out_accuracy(spark, rows):
    rng = random.Random(1)
    data = [play(rng, i, i % 3 != 0) for i in range(1500)]
    got = score_quality(rows(data, SCHEMA), rows([(i, int(i % 3 != 0), "") for i in range(600)], LABELS)).collect()
    assert len(got) == 1500
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) and r.predicted == int(r.kept) for r in got)
    held = [r for r in got if r.held_out or r.track_id >= 600]
    assert sum(r.kept == (r.track_id % 3 != 0) for r in held) >= 0.98 * len(held)
    meta = [r for r in held if (r.meta_score >= 0.5) == (r.track_id % 3 != 0)]
    assert len(meta) >= 0.8 * len(held)


def test_views_teach_each_other():
    """The second view has labels for one platform only; the first teaches it the others."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000).astype(float)
    first = [(y * 4 + rng.normal(0, 0.3, 2000)).tolist()]
    names = np.where(y == 1, "good", "bad").astype(object)
    names[:800] = "seen"
    views = [first, [list(names)]]
    partly = y.copy()
    partly[800:] = np.nan
    alone, taught = CoTrained(views, partly, 0, 500), CoTrained(views, partly, 4, 500)
    assert not alone.pseudo[0] and len(taught.pseudo[1]) >= 900
    truth = {i: y[i] for i in taught.pseudo[1]}
    assert np.mean([taught.pseudo[1][i] == t for i, t in truth.items()]) > 0.99
    rows = slice(800, 2000)
    meta = taught.models[1].logits(taught.models[1].places([list(names[rows])]))
    assert np.mean((meta > 0) == (y[rows] == 1)) > 0.95


def test_nulls_one_class_repeats_and_empty(spark, rows):
    data = [(1, None, None, None, None, 0.0), (None, "x", "a", "b", 5, 0.0), (2, "", "a", "b", -5, 0.0), (2, "", "a", "b", -5, 0.0), (3, "long " * 30_000, "a", "b", 1, 0.0)]
    got = score_quality(rows(data, SCHEMA), rows([(1, 1, ""), (2, None, ""), (None, 0, "")], LABELS)).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert score_quality(rows(data, SCHEMA), rows([], LABELS)).count() == 5
    both = score_quality(rows(data, SCHEMA), rows([(1, 1, ""), (2, 0, ""), (3, 1, "")], LABELS)).collect()
    assert len(both) == 5 and all(0 <= r.score <= 1 for r in both)
    assert score_quality(rows([], SCHEMA), rows([(1, 1, "")], LABELS)).count() == 0
