import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.functions import tails
from encore.operators import stats as H


def test_tail_constants():
    # textbook critical values
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_upper(-1.812461123, 10) == pytest.approx(0.95, abs=1e-8)
    assert tails.f_upper(3.325834530, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(18.307038053, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    for k, n, p in [(3, 10, 0.5), (0, 5, 0.2), (5, 5, 0.2)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert tails.binomial_upper(k, n, p) == pytest.approx(exact)


def test_fdr_with_ties_and_one(rows):
    ps = [0.01, 0.04, 0.04, 0.03, 1.0]
    df = rows([(i, p) for i, p in enumerate(ps)], "id long, p double")
    got = {r.id: r.p_adjusted for r in H.fdr_bh(df, "p").collect()}
    order = np.argsort(ps, kind="stable")
    adj, low = [0.0] * 5, 1.0
    for rank in range(5, 0, -1):
        low = min(low, ps[order[rank - 1]] * 5 / rank)
        adj[order[rank - 1]] = low
    assert [got[i] for i in range(5)] == pytest.approx(adj)


def avg_rank(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_wilcoxon_with_ties_and_zeros(rows):
    base, better = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [2.0, 2.0, 5.0, 3.0, 6.0, 9.0, 7.0, 10.0]
    d = np.subtract(better, base)
    r = avg_rank(abs(d))
    exp = r[d > 0].sum() + r[d == 0].sum() / 2
    row = H.wilcoxon_signed_rank(rows(list(zip(base, better)), "a double, b double"), "a", "b").first()
    assert row.statistic == pytest.approx(exp) and row.n == 8


def test_mann_whitney_ties(rows):
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 4.0, 4.0, 5.0]
    r = avg_rank(a + b)
    row = H.mann_whitney(rows([("a", x) for x in a] + [("b", x) for x in b], "g string, x double"), "x", "g", "a", "b").first()
    assert row.statistic == pytest.approx(r[: len(a)].sum() - 15)


def test_constant_input_gives_null_not_an_error(rows):
    df = rows([(1.0, 2.0)] * 8, "a double, b double")
    assert H.paired_t(df, "a", "b").first().statistic is None
    assert H.one_sample_t(df, "a", 0.5).first().statistic is None


def test_cluster_indices_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 1, (30, 4)) for c in (0, 4, 8)])
    lab = np.repeat([0, 1, 2], 30)
    df = H.with_vector(spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(lab, x))], "id long, l int, v array<double>"), "v")
    cen = np.array([x[lab == c].mean(0) for c in range(3)])
    within = sum(((x[lab == c] - cen[c]) ** 2).sum() for c in range(3))
    between = sum(30 * ((cen[c] - x.mean(0)) ** 2).sum() for c in range(3))
    assert H.calinski_harabasz(df, "features", "l").first().calinski_harabasz == pytest.approx((between / 2) / (within / 87))
    s = [np.linalg.norm(x[lab == c] - cen[c], axis=1).mean() for c in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cen[i] - cen[j]) for j in range(3) if j != i) for i in range(3)])
    assert H.davies_bouldin(df, "features", "l").first().davies_bouldin == pytest.approx(db)
    base = H.permutation_baseline(df, "features", "l", "id", 3, 20).first()
    assert base.replicates == 20 and base.p_ch == pytest.approx(1 / 21) and base.p_db == pytest.approx(1 / 21)


def test_rand_index(rows):
    same = rows([(i % 3, (i % 3 + 1) % 3) for i in range(30)], "a int, b int")
    assert H.adjusted_rand_index(same, "a", "b").first().ari == pytest.approx(1.0)


def test_bootstrap_is_repeatable_and_covers(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"))
    one = H.bootstrap_ci(df, "x", ["id"], 100).first()
    two = H.bootstrap_ci(df.repartition(7), "x", ["id"], 100).first()
    assert one.ci_low == pytest.approx(two.ci_low) and one.ci_low < 4.5 < one.ci_high
    med = H.bootstrap_ci(df, "x", ["id"], 30, median=True).first()
    assert med.ci_low <= med.estimate <= med.ci_high


def test_count_of_change_points_against_expectation(rows):
    import datetime as dt

    df = rows([("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(50)], "signal string, date date, x double")
    r = H.change_count_test(df, ["signal"], "date", "x").first()
    assert r.observed == 0 and r.statistic == pytest.approx(math.log(50))
