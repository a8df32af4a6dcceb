"""What the factorisations keep on disk and send: blocks of the matrix, and shuffle files of one round."""

import numpy as np
import pytest

from encore.operators import latent as L


@pytest.mark.parametrize("cells", [7, 10_000])
def test_block_products_match_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(L, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(1)
    a = rng.random((40, 6)) * (rng.random((40, 6)) < 0.5)
    a[:, 2] = 1.0  # a busy item, cut over several blocks
    rows = [(f"u{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    blocks = L._Blocks(spark.createDataFrame([*rows, ("u1", None, 9.0)], "u string, i int, __x double"), [], "u", "i", ["f0", "f1"])
    f = rng.random((6, 2))
    factors = spark.createDataFrame([(j, *map(float, f[j])) for j in range(6)], "i int, f0 double, f1 double")
    turn = {None: np.array([[1.0, 2.0], [0.0, 1.0]])}
    got = {r.u: (r.f0, r.f1) for r in blocks.times(blocks.routed("i", factors), "i", "u", turn).collect()}
    want = a @ f @ turn[None]
    assert len(got) == 40 and all(got[f"u{i}"] == pytest.approx(want[i]) for i in range(40))
    sent = blocks.routed("i", factors).count()
    assert sent <= 6 + blocks.cells.select("__b").distinct().count()  # rows per key and block, not per cell
    blocks.release()


def test_each_round_of_nmf_cuts_its_lineage(spark, monkeypatch):
    """Only then Spark drops the shuffle files of earlier rounds before the fit ends."""
    made, real = [], L.ALS
    monkeypatch.setattr(L, "ALS", lambda **given: made.append(real(**given)) or made[-1])
    data = [(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(5)]
    L.nmf_factors(spark.createDataFrame(data, "u int, i int, x double"), "u", "i", "x", 2, iterations=3)
    assert made[0].getCheckpointInterval() == 1 and spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("cells", [7, 10_000])
def test_item_rows_stay_in_their_blocks(spark, monkeypatch, cells):
    """A round sends user rows only: the one product by itself is that of the noise, and items that fill a block are summed apart."""
    monkeypatch.setattr(L, "BLOCK_CELLS", cells)
    calls, real = [], L._Blocks.times
    monkeypatch.setattr(L._Blocks, "times", lambda self, sent, on, to, turns=None: calls.append(on) or real(self, sent, on, to, turns))
    rng = np.random.default_rng(3)
    a = rng.random((30, 8)) * (rng.random((30, 8)) < 0.6)
    a[:, 2] = 1.0
    data = [(f"u{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    spectrum = L.svd_factors(spark.createDataFrame(data, "u string, i int, x double"), "u", "i", "x", 3, 3, wanted=())[2]
    got = [r.singular_value for r in spectrum.orderBy("factor").collect()]
    assert got == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3], rel=1e-9)
    assert len(calls) == (1 if cells > 7 else 7)
