import datetime as dt

import numpy as np
import pytest

from encore.operators import joins as J
from encore.operators import timeseries as TS

D0 = dt.date(2024, 1, 1)


def series(rows, xs, name="s"):
    return rows([(name, D0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(xs)], "signal string, date date, x double")


def brute_points(x, size=7):
    n = len(x)
    return {i: (abs(np.var(x[i - size : i]) - np.var(x[i : i + size])), abs(np.mean(x[i - size : i]) - np.mean(x[i : i + size]))) for i in range(size, n - size)}


@pytest.mark.parametrize("n", [14, 15, 80])
def test_shift_scores_and_points(rows, n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(4, 1, n - n // 2)]).round(3)
    df = series(rows, x)
    exp = brute_points(x)
    got = {r.idx: r.score for r in TS.two_sided_shift(df, ["signal"], "date", "x", 7, 1.0, 2.0).collect() if r.score is not None}
    assert got.keys() == exp.keys() and np.allclose([got[i] for i in exp], [v + 2 * m for v, m in exp.values()])
    scores = np.array([v for v, _ in exp.values()])
    bound = scores.mean() + 2 * scores.std() if len(scores) else 0
    points = {r.idx for r in TS.change_points(df, ["signal"], "date", "x").collect()}
    assert points == {i for i, (v, _) in exp.items() if v > bound + 1e-12}


def test_spaced_points_follow_the_greedy_rule(rows):
    rng = np.random.default_rng(3)
    x = np.where(np.arange(120) % 40 < 20, 0, 5) + rng.normal(0, 0.3, 120)
    cand = [i for i, (v, m) in brute_points(x).items() if v + m > 1.5 * np.std(x)]
    kept = []
    for i in cand:
        if not kept or i - kept[-1] >= 7:
            kept.append(i)
    got = sorted(r.idx for r in TS.spaced_change_points(series(rows, x), ["signal"], "date", "x").collect())
    assert got == kept and len(kept) > 2


def test_flat_signal_has_no_points(rows):
    df = series(rows, [1.0] * 40)
    assert TS.change_points(df, ["signal"], "date", "x").count() == 0
    assert TS.linear_trends(df, ["signal"], "date", "x").count() == 1
    assert TS.component_strength(TS.seasonal_decompose(df, ["signal"], "date", "x"), ["signal"], "x").count() == 1


def test_short_series_have_shorter_periods(rows):
    """17 rows have a period of 4: outer rows of the moving average count half."""
    x = [float((i % 4) * 3 + i) for i in range(17)]
    got = TS.seasonal_decompose(series(rows, x), ["signal"], "date", "x").orderBy("date").collect()
    for i in range(2, 15):
        assert abs(got[i].trend - (x[i - 2] / 2 + sum(x[i - 1 : i + 2]) + x[i + 2] / 2) / 4) < 1e-9
    assert all(abs(r.x - r.trend - r.seasonal - r.residual) < 1e-9 for r in got)
    assert len({round(r.seasonal, 9) for r in got}) == 4
    assert TS.seasonal_decompose(series(rows, x[:3]), ["signal"], "date", "x").count() == 3


def test_chain_and_anchor_merging(rows):
    data = [(D0 + dt.timedelta(days=d), "s", float(d), 0.5) for d in (0, 3, 6, 20)]
    df = rows(data, "date date, signal string, magnitude double, confidence double")
    chain = TS.merge_chain(df, [], "date", "signal").orderBy("group_no").collect()
    assert [r.n_points for r in chain] == [3, 1]
    anchor = TS.merge_anchor(df, [], "date", "signal").orderBy("head").collect()
    assert [((r["head"] - D0).days, r.n_points, r.change_type) for r in anchor] == [
        (0, 2, "multi_signal_shift"), (6, 1, "single_signal_shift"), (20, 1, "single_signal_shift"),
    ]


def test_anchor_matches_brute_force(rows):
    rng = np.random.default_rng(5)
    days = sorted(int(d) for d in rng.integers(0, 120, 40))
    df = rows([(D0 + dt.timedelta(days=d), f"s{i % 3}", 1.0) for i, d in enumerate(days)], "date date, signal string, magnitude double")
    heads, sizes = [], []
    for d in days:
        if heads and d - heads[-1] <= 3:
            sizes[-1] += 1
        else:
            heads.append(d)
            sizes.append(1)
    got = TS.merge_anchor(df, [], "date", "signal").orderBy("head").collect()
    assert [((r["head"] - D0).days, r.n_points) for r in got] == list(zip(heads, sizes))


def test_trend_of_a_perfect_line(rows):
    r = TS.linear_trends(series(rows, range(20)), ["signal"], "date", "x").first()
    assert r.slope == pytest.approx(1.0) and r.significant and r.direction == "increasing" and r.p_value < 1e-9


def test_decay_fit_recovers_the_curve(rows):
    h = [1, 7, 14, 30, 60, 90]
    df = rows([("a", d, float(0.9 * np.exp(-0.01 * d))) for d in h], "series string, h int, acc double")
    best = TS.decay_fit(df, ["series"], "h", "acc").filter("is_best").first()
    assert best.model == "exponential" and best.a == pytest.approx(0.9) and best.b == pytest.approx(0.01)


def test_within_days_bounds(rows):
    left = rows([(D0,)], "a date")
    right = rows([(D0 + dt.timedelta(days=d),) for d in (-8, -7, 0, 7, 8)], "b date")
    assert sorted(r.day_diff for r in J.within_days(left, right, "a", "b", 7).collect()) == [-7, 0, 7]


def test_context_drops_empty_sides(rows):
    daily = rows([(D0 + dt.timedelta(days=i), float(i < 5)) for i in range(10)], "date date, x double")
    shift = rows([(D0,), (D0 + dt.timedelta(days=5),)], "d date")
    out = J.context_before_after(daily, shift, "date", "d", ["x"]).collect()
    assert [(r.d - D0).days for r in out] == [5] and out[0].x_pct == -100.0


def test_month_clustering_zero_fills(rows):
    df = rows([(dt.date(2024, 3, 1),), (dt.date(2024, 3, 9),)], "date date")
    out = TS.month_clustering(df, "date").orderBy("rank").collect()
    assert len(out) == 12 and out[0].month == 3 and out[0].n == 2 and out[0].chi_square == pytest.approx(22.0)


def test_stability_without_change_points_is_the_whole_range(rows):
    daily = rows([(D0 + dt.timedelta(days=i), 1, 0.5) for i in range(10)], "date date, n_plays int, x double")
    out = TS.stability_periods(daily, daily.filter("1 = 0"), "date", ["x"], "n_plays").collect()
    assert [(r.kind, r.n) for r in out] == [("whole", 10)]


def test_plateau_is_one_peak(rows):
    df = series(rows, [0, 1, 5, 5, 5, 1, 0, 0, 3, 0])
    got = [(r.idx, r.kind) for r in TS.local_extrema(df, ["signal"], "date", "x").orderBy("idx").collect()]
    assert got == [(2, "peak"), (6, "valley")]  # the last rise stays below the 70 % quantile
