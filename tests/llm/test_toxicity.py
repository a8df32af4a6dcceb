"""The factorization machine: pairs, gradients' effect, held-out accuracy, nulls and missing classes."""

import random
import zlib

import numpy as np

from encore.llm import toxicity
from encore.llm.toxicity import Machine, buckets, fit_machine, score_explicit

SCHEMA = "track_id long, track_name string, score string, y string"
LABELS = "track_id long, explicit int, name string"
WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]


def test_pairs_that_no_weight_explains():
    """Either word alone is clean, both together are toxic, as an insult with a group mention."""
    rng = random.Random(1)
    names, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        names.append(" ".join(rng.sample(WORDS, 5) + ["insult"] * a + ["groupname"] * b))
        y.append(float(a and b))
    machine = fit_machine([buckets(n) for n in names], np.array(y))
    scores = machine.score(["insult wai", "groupname wai", "insult groupname wai", "wai wbj"])
    assert [s >= 0.5 for s in scores] == [False, False, True, False]
    v = machine.factors[machine.known("insult groupname")]
    assert 0.5 * ((v.sum(0) ** 2) - (v**2).sum(0)).sum() > 0


def test_words_that_say_nothing_alone():
    """Toxic where two words are both there or both missing: no weight and no share of a single word tells."""
    rng = random.Random(3)
    names, y = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        names.append(" ".join(rng.sample(WORDS, 5) + ["insult"] * a + ["groupname"] * b))
        y.append(float(a == b))
    scores = fit_machine([buckets(n) for n in names[:3000]], np.array(y[:3000])).score(names[3000:])
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in zip(scores, y[3000:])]) > 0.95


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    names = [" ".join(rng.choice(WORDS, 6)) for _ in range(30)]
    terms = np.unique(np.concatenate([buckets(n) for n in names]))
    machine = Machine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    for name, score in zip(names, machine.score(names)):
        at = np.searchsorted(terms, buckets(name)).tolist()
        z = 0.3 + sum(machine.weights[i] for i in at) + sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_rows_that_reach_the_driver_are_bounded(spark, rows, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit_machine", lambda known, y: taken.append(len(known)) or fit_machine(known, y))
    data = [(1 if i % 3 == 0 else i + 2, f"name {i}", "", "") for i in range(900)]
    assert score_explicit(rows(data, SCHEMA), rows([(1, 1, ""), (3, 0, ""), (4, 1, ""), (6, 0, "")], LABELS), max_rows=7).count() == 900
    assert taken == [7]


def test_held_out_accuracy_and_columns(spark, rows):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices(WORDS, k=20) + ["Vilename!"] * (i % 4 == 0) * 2), "x", "1") for i in range(1200)]
    labels = [(i, int(i % 4 == 0), "z") for i in range(1200)]
    got = score_explicit(rows(data, SCHEMA), rows(labels, LABELS)).collect()
    assert len(got) == 1200
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.track_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.track_id % 4 == 0) for r in held) >= 0.98 * len(held)


def test_held_out_labels_teach_nothing(spark, rows):
    data = [(i, f"name {'odd' if i % 2 else 'even'}", "", "") for i in range(300)]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    a = score_explicit(rows(data, SCHEMA), rows([(i, i % 2, "") for i in range(300)], LABELS)).collect()
    b = score_explicit(rows(data, SCHEMA), rows([(i, 1 - i % 2 if i in held else i % 2, "") for i in range(300)], LABELS)).collect()
    assert sorted((r.track_id, r.score) for r in a) == sorted((r.track_id, r.score) for r in b)


def test_nulls_repeats_one_class_and_empty(spark, rows):
    data = [(1, None, "", ""), (None, "x", "", ""), (2, "", "", ""), (2, "", "", ""), (3, "long " * 30_000, "", "")]
    labels = [(1, 1, ""), (1, 0, ""), (2, None, ""), (None, 1, "")]
    got = score_explicit(rows(data, SCHEMA), rows(labels, LABELS)).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert score_explicit(rows(data, SCHEMA), rows([], LABELS)).count() == 5
    assert score_explicit(rows([], SCHEMA), rows(labels, LABELS)).count() == 0
