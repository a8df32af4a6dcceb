import numpy as np
import pytest
from pyspark.sql import functions as F

from encore.operators import latent as L
from encore.operators import models as ML
from encore.operators import recommend as M


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.random((25, 3)) @ rng.random((3, 15)) + 0.01 * rng.random((25, 15))
    cells = [(i, j, float(a[i, j])) for i in range(25) for j in range(15)]
    users, items, spectrum = L.svd_factors(spark.createDataFrame(cells, "u int, i int, x double"), "u", "i", "x", 3, 4)
    s = np.linalg.svd(a, compute_uv=False)
    got = [r.singular_value for r in spectrum.orderBy("factor").collect()]
    assert got == pytest.approx(s[:3], rel=1e-4)
    u = users.toPandas().sort_values("u")[["f0", "f1", "f2"]].to_numpy()
    v = items.toPandas().sort_values("i")[["f0", "f1", "f2"]].to_numpy()
    assert np.linalg.norm(a - u @ v.T) < 1.01 * np.sqrt((s[3:] ** 2).sum()) + 1e-6


def test_svd_of_windows_is_orthonormal_and_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 2)
    rng = np.random.default_rng(5)
    blocks = {w: rng.random((30, 4)) @ rng.random((4, 12 + w)) + 0.05 * rng.random((30, 12 + w)) for w in (1, 2)}
    blocks[3] = np.outer(np.arange(1.0, 9.0), np.ones(5))  # rank one
    cells = [(w, i, j, float(x)) for w, a in blocks.items() for (i, j), x in np.ndenumerate(a)]
    table = spark.createDataFrame(cells, "w int, u int, i int, x double").repartition(7)
    users, items, spectrum = L.svd_factors(table, "u", "i", "x", 3, window="w")
    users, items, spectrum = users.toPandas(), items.toPandas(), spectrum.toPandas()
    for w, a in blocks.items():
        s = np.linalg.svd(a, compute_uv=False)[:3]
        got = spectrum[spectrum.w == w].sort_values("factor")
        assert got.singular_value.to_numpy() == pytest.approx(s, rel=1e-6, abs=1e-8)
        u = users[users.w == w].sort_values("u")[["f0", "f1", "f2"]].to_numpy()
        v = items[items.w == w].sort_values("i")[["f0", "f1", "f2"]].to_numpy()
        rank = (s > 1e-8).sum()
        assert (v.T @ v)[:rank, :rank] == pytest.approx(np.eye(rank), abs=1e-9)
        assert u.T @ u == pytest.approx(np.diag(s**2), abs=1e-6)
        best = np.linalg.svd(a)
        assert u @ v.T == pytest.approx((best[0][:, :3] * best[1][:3]) @ best[2][:3], abs=1e-4)


def test_matrix_indices_are_contiguous_and_sorted(rows):
    df = rows([(10, 7, 1.0), (10, 3, 2.0), (4, 7, 3.0), (4, 7, 4.0)], "u long, i long, v double")
    got = {(r.u, r.i): (r.user_idx, r.item_idx, r.rating) for r in L.interaction_matrix(df, "u", "i", "v", rows_per_cell=1).collect()}
    assert got[(4, 7)] == (0, 1, pytest.approx(np.log1p(7.0))) and got[(10, 3)][:2] == (1, 0)


def test_standardise_constant_column(rows):
    out = L.standardise(rows([(1.0, 5.0), (3.0, 5.0)], "a double, b double")).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_nmf_is_non_negative(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("u"), (F.floor(F.col("id") / 6)).alias("i"), (F.col("id") % 5).cast("double").alias("x"))
    users, items, error = L.nmf_factors(df, "u", "i", "x", 2, iterations=3)
    assert items.select(F.min(F.array_min("features"))).first()[0] >= 0 and error.first().reconstruction_error >= 0


def test_ratio_forecast_stays_in_bounds(spark):
    df = spark.range(40).select(F.format_string("2020-%03d", "id").alias("m"), (0.5 + 0.4 * F.sin("id")).alias("r"))
    out = ML.ratio_forecaster(df, "m", "r", months=6).orderBy("months_ahead").collect()
    assert len(out) == 6 and all(0 <= r.predicted <= 1 for r in out)


def test_personality_score_in_bounds_and_first_artist(rows):
    tracks = rows([(1, "Drake feat X", "western", 0.7, None), (2, "none", "unknown", 0.1, 0.2)], "track_id int, artist_name string, culture string, energy double, valence double")
    p = [{"id": "p", "text": "western", "artists": [("drake", 50), ("x", 100)], "vietnamese": 0.1, "western": 0.9}]
    got = {r.track_id: r.personality_score for r in M.personality_scores(tracks, p, ["energy", "valence"]).collect()}
    assert got[1] == pytest.approx((0.4 + 0.4 * 0.5 + 0.2 * 0.9) / 1.0)
    assert 0 <= got[2] <= 1


def test_text_keys_are_indexed_in_order(rows):
    names = ["zed", "Ána", "bob", "bobby-long-name-a", "bobby-long-name-b", ""]
    df = rows([(n, 1, 1.0) for n in names], "u string, i long, v double")
    got = {r.u: r.user_idx for r in L.interaction_matrix(df, "u", "i", "v", rows_per_cell=1).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(names, key=lambda n: n.encode())


def test_clusters_are_fitted_on_even_parts(spark, monkeypatch):
    """One part of many rows with equal features is cut, and no row is lost."""
    monkeypatch.setattr(L, "PART_ROWS", 100)
    fits, real = [], L.KMeans.fit
    monkeypatch.setattr(L.KMeans, "fit", lambda self, df: fits.append([len(p) for p in df.select("a").rdd.glom().collect()]) or real(self, df))
    values = [(i, *[float((i % 5) * 10 + j) if i < 500 else 7.0 for j in range(5)]) for i in range(1000)]
    df = spark.createDataFrame(values, "id int, a double, b double, c double, d double, e double").coalesce(1)
    out = L.audio_clusters(df, ["a", "b", "c", "d", "e"])
    assert sum(fits[0]) == 1000 and len(fits[0]) == 10 and max(fits[0]) < 200
    assert out.count() == 1000 and out.select("audio_cluster").distinct().count() == 5
