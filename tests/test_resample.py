"""Resamples folded in one pass against the same draws in numpy."""

import hashlib

import numpy as np
import pytest

from encore.operators import resample as R
from encore.operators import stats as H

SEED = 42


def draws(ids, reps):
    h = lambda i, s: int(hashlib.md5(f"{i}|{s}".encode()).hexdigest()[:15], 16) % R.P
    a, b = np.array([h(i, SEED) for i in ids]), np.array([h(i, SEED + 1) for i in ids])
    return R.draws(a, b, reps), R.weights(a, b, reps)


def test_weights_are_poisson():
    w = draws(range(3000), 40)[1]
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    pairs = np.corrcoef(w.T)
    assert abs(pairs[np.triu_indices(40, 1)]).max() < 0.09


@pytest.mark.parametrize("splits", [4, 64])
def test_medians_of_ties_gaps_and_wide_values(rows, monkeypatch, splits):
    monkeypatch.setattr(R, "SPLITS", splits)
    rng = np.random.default_rng(splits)
    x = np.concatenate([np.full(150, 3.0), rng.normal(3, 1e-9, 60), rng.normal(0, 1e6, 150), rng.integers(-3, 9, 140).astype(float)])
    df = rows([(i, float(v)) for i, v in enumerate(x)] + [(900, None), (901, float("nan"))], "id long, x double")
    w = draws(range(len(x)), 25)[1]
    got = {r["rep"]: r["stat"] for r in R.replicate_medians(df, "x", ["id"], 25, SEED).collect()}
    assert got == {r + 1: pytest.approx(np.median(np.repeat(x, w[:, r])), abs=0) for r in range(25)}


def test_medians_of_few_rows_and_none(rows):
    got = R.replicate_medians(rows([(1, 5.0), (2, 7.0)], "id long, x double"), "x", ["id"], 30, SEED).collect()
    w = draws([1, 2], 30)[1]
    assert {r["rep"]: r["stat"] for r in got} == {r + 1: np.median(np.repeat([5.0, 7.0], w[:, r])) for r in range(30) if w[:, r].any()}
    assert R.replicate_medians(rows([(1, None)], "id long, x double"), "x", ["id"], 5, SEED).collect() == []


def clusters(rows, n=90):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 1.2, (n // 3, 3)) for c in (0, 3, 5)])
    data = [(i, v.tolist(), "abc"[i // (n // 3)]) for i, v in enumerate(x)]
    return x, H.with_vector(rows(data, "id long, v array<double>, label string"), "v")


def test_silhouette_interval(rows):
    x, df = clusters(rows)
    labels = np.arange(90) // 30
    w = draws(range(90), 20)[1]
    stats = []
    for r in range(20):
        at = np.repeat(np.arange(90), w[:, r])
        d = ((x[at][:, None] - x[at]) ** 2).sum(axis=2)
        own = labels[at][:, None] == labels[at]
        a = np.where(own, d, 0).sum(axis=1) / (own.sum(axis=1) - 1)
        b = np.min([np.where(labels[at] == c, d, 0).sum(axis=1) / (labels[at] == c).sum() + np.where(labels[at] == c, np.inf, 0) for c in range(3)], axis=0)
        stats.append(((b - a) / np.maximum(a, b)).mean())
    row = H.bootstrap_silhouette(df, "features", "label", "id", 20).first()
    assert (row.ci_low, row.ci_high) == (pytest.approx(np.quantile(stats, 0.025)), pytest.approx(np.quantile(stats, 0.975)))
    assert row.replicates == 20 and row.ci_low < row.estimate < row.ci_high


def lloyd(x, w, centres):
    for _ in range(H.STEPS):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([np.average(x[near == c], axis=0, weights=w[near == c]) if w[near == c].sum() else centres[c] for c in range(len(centres))])
        if abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)


def test_cluster_stability(rows):
    x, df = clusters(rows)
    drawn, w = draws(range(90), 6)
    a = np.array([int(hashlib.md5(f"{i}|{SEED}".encode()).hexdigest()[:15], 16) % R.P for i in range(90)])
    base = lloyd(x, np.ones(90), H.first_centres(x, a, 3))
    for row in H.cluster_stability(df, "features", "id", 3, 6).collect():
        mine = w[:, row.rep - 1]
        again = lloyd(x, mine, H.first_centres(x[mine > 0], drawn[mine > 0, row.rep - 1], 3))
        pairs = rows([(int(p), int(q)) for p, q in zip(base[mine > 0], again[mine > 0])], "a int, b int")
        assert row.n == (mine > 0).sum() and row.ari == pytest.approx(H.adjusted_rand_index(pairs, "a", "b").first().ari)


@pytest.mark.parametrize("drawn", [7, 131_072])
def test_small_weights_count_the_cuts_reached(monkeypatch, drawn):
    """Bytes (replicate, row) from 32-bit steps, also where a draw is 0 or P - 1 and replicates are no multiple of those made at a time."""
    monkeypatch.setattr(R, "DRAWN", drawn)
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.integers(0, R.P, 3000), [0, R.P - 1, R.P - 1, 0, 5]])
    b = np.concatenate([rng.integers(0, R.P, 3000), [0, R.P - 1, 1, 1, R.P - 5]])
    got = R.small_weights(a, b, 53)
    assert got.dtype == np.uint8
    np.testing.assert_array_equal(got.T, (R.draws(a, b, 53)[..., None] >= np.array(R.poisson_cuts())).sum(axis=2))
    assert R.small_weights(a[:0], b[:0], 4).shape == (4, 0)


def test_weight_tiles_hold_some_replicates_only(monkeypatch):
    """The weights of all replicates never lie in memory at once: each tile is written over the last one."""
    monkeypatch.setattr(R, "DRAWN", 6_000)
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, R.P, 1_001), rng.integers(0, R.P, 1_001)
    tiles = [(start, part.ctypes.data, part.copy()) for start, part in R.weight_tiles(a, b, 53)]
    assert [start for start, *_ in tiles] == list(range(0, 53, 5)) and len({at for _, at, _ in tiles}) == 1
    np.testing.assert_array_equal(np.vstack([part for *_, part in tiles]).T, R.weights(a, b, 53))


def test_few_finds_flags_at_the_edges_of_pieces():
    for places in ([], [0], [127], [7, 8, 9, 120, 255, 256, 2_047], list(range(0, 2_048, 3))):
        flags = np.zeros(2_048, bool)
        flags[places] = True
        assert sorted(R.few(flags)) == places


@pytest.mark.parametrize("values", [lambda g: g.integers(-9, 50, 400).astype(float), lambda g: g.normal(0, 1, 400), lambda g: g.integers(2**40, 2**41, 400).astype(float)])
def test_means_of_whole_broken_and_large_values(rows, values):
    x = values(np.random.default_rng(2))
    df = rows([(i, float(v)) for i, v in enumerate(x)] + [(900, None)], "id long, x double")
    w = draws(range(len(x)), 30)[1]
    got = {r["rep"]: r["stat"] for r in R.replicate_means(df, "x", ["id"], 30, SEED).collect()}
    assert got == {r + 1: pytest.approx(x @ w[:, r] / w[:, r].sum(), rel=1e-12) for r in range(30)}
    assert R.exact_kind(x) is (np.float32 if abs(x).max() <= 50 and x[0] == round(x[0]) else np.float64)
    assert R.exact_kind(np.array([1.0, np.nan])) is R.exact_kind(np.array([np.inf])) is R.exact_kind(np.array([2.0**21])) is np.float64
