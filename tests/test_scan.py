"""The cell-wise scans against plain pandas, with one key that owns most rows and several cell widths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from encore.operators import scan


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(7)
    n = 600
    user = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 8, n))
    t = np.sort(rng.integers(0, 5000, n))
    label = rng.choice(list("abc"), n, p=[0.6, 0.3, 0.1])
    pdf = pd.DataFrame({"id": np.arange(n), "user": user, "t": t, "label": label, "v": rng.random(n).round(3)})
    return pdf, spark.createDataFrame(pdf).cache()


WIDTHS = [1, 37, 400, 100000, "hot"]


def cell(width):
    """A fixed width, or adaptive slices small enough to cut the busy key."""
    return scan.HotCells(50, 2) if width == "hot" else scan.number_cell("t", width)


@pytest.mark.parametrize("width", WIDTHS)
def test_segment_rows(log, width):
    pdf, df = log
    out = scan.segment_rows(df, ["user"], ["t", "id"], ["t", "label"], lambda p, c: c["t"] - p["t"] > 12, cell(width))
    got = out.select("id", "is_start", "segment_no", "row_no", "position", F.col("prev.t").alias("pt")).toPandas().sort_values("id")
    exp = pdf.sort_values(["user", "t", "id"]).copy()
    exp["pt"] = exp.groupby("user").t.shift()
    exp["is_start"] = ~((exp.t - exp.pt) <= 12)
    exp["segment_no"] = exp.groupby("user").is_start.cumsum()
    exp["row_no"] = exp.groupby("user").cumcount() + 1
    exp["position"] = exp.groupby(["user", "segment_no"]).cumcount() + 1
    exp = exp.sort_values("id")
    for c in ("is_start", "segment_no", "row_no", "position"):
        assert (got[c].astype(int).to_numpy() == exp[c].astype(int).to_numpy()).all(), c
    assert got.pt.fillna(-1).tolist() == exp.pt.fillna(-1).tolist()


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours(log, width):
    pdf, df = log
    out = scan.neighbours(df, ["user"], ["t", "id"], ["label"], cell(width), forward=True)
    got = out.select("id", F.col("prev.label").alias("p"), F.col("next.label").alias("n")).toPandas().sort_values("id")
    exp = pdf.sort_values(["user", "t", "id"]).copy()
    exp["p"], exp["n"] = exp.groupby("user").label.shift(), exp.groupby("user").label.shift(-1)
    exp = exp.sort_values("id")
    assert got.p.fillna("-").tolist() == exp.p.fillna("-").tolist()
    assert got.n.fillna("-").tolist() == exp.n.fillna("-").tolist()


@pytest.mark.parametrize("width", WIDTHS)
def test_halo_gives_exact_row_frames(log, width):
    pdf, df = log
    ext, w = scan.haloed(df, ["user"], ["t", "id"], ["v"], cell(width), before=9, after=4)
    out = scan.drop_ghosts(ext.withColumn("s", F.sum("v").over(w.rowsBetween(-9, 4))))
    got = out.select("id", "s").toPandas().sort_values("id").s.to_numpy()
    exp = {}
    for _, g in pdf.sort_values(["user", "t", "id"]).groupby("user"):
        v = g.v.to_numpy()
        for i, row in enumerate(g.id):
            exp[row] = v[max(0, i - 9) : i + 5].sum()
    assert np.allclose(got, [exp[i] for i in sorted(exp)])


@pytest.mark.parametrize("keys", [[], ["user"]])
def test_numbered(log, keys):
    pdf, df = log
    got = scan.numbered(df, keys, ["t", "id"], cell("hot")).toPandas().sort_values("id")
    srt = pdf.sort_values(["t", "id"])
    rank = (srt.groupby("user").cumcount() if keys else pd.Series(range(len(srt)), index=srt.index)) + 1
    assert got.row_no.tolist() == rank.sort_index().tolist()
    total = pdf.groupby("user").id.transform("size") if keys else pd.Series(len(pdf), index=pdf.index)
    assert got.row_count.tolist() == total.tolist()


def test_exact_quantiles_match_linear_interpolation(log):
    pdf, df = log
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    row = scan.exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(row), np.quantile(pdf.v, probs))
    by = scan.exact_quantiles(df, "v", [0.5], ["user"]).toPandas().set_index("user").q_0
    assert np.allclose(by.sort_index(), pdf.groupby("user").v.median())


def test_exact_quantiles_with_one_dominant_value(rows):
    df = rows([(1.0,)] * 50 + [(2.0,)] * 3 + [(None,)], "x double")
    assert scan.exact_quantiles(df, "x", [0.5, 0.99]).first()["q_0"] == 1.0


def test_value_counts_below(log):
    pdf, df = log
    got = scan.value_counts_below(df, "v", rows_per_cell=50).toPandas().sort_values("v")
    counts = pdf.groupby("v").size()
    assert got.n.tolist() == counts.tolist()
    assert got.below.tolist() == (counts.cumsum() - counts).tolist()
    assert set(got.total) == {len(pdf)}


def spread(df, keys, order, rows_per_cell=50):
    """Rows per slice of each key."""
    cells = scan.HotCells(rows_per_cell).apply(df, keys, order)
    return [r["count"] for r in cells.groupBy(*keys, scan.CELL).count().collect()]


def test_outliers_and_bursts_do_not_fill_one_slice(spark):
    """One row in 1970, and half of all rows at the same second, told apart by their ids."""
    rows = [(1, 0 if i == 0 else 10**9 if i % 2 else 10**9 + i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "user int, t long, id int")
    sizes = spread(df, ["user"], ["t", "id"])
    assert len(sizes) > 40 and max(sizes) < 200
    numbered = scan.numbered(df, ["user"], ["t", "id"], scan.HotCells(50)).select("id", "row_no").collect()
    want = {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r.id: r.row_no for r in numbered} == want


def test_texts_with_a_common_start_are_cut(spark):
    names = [f"Customer#0000000{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sizes = spread(df, [], ["name"])
    assert len(sizes) > 40 and max(sizes) < 300
    got = scan.numbered(df, [], ["name"], scan.HotCells(50)).collect()
    assert {r.name: r.row_no for r in got} == {n: i + 1 for i, n in enumerate(names)}


def test_keys_that_are_not_busy_are_one_slice(log):
    _, df = log
    assert len(spread(df, ["user"], ["t", "id"], 10_000)) == df.select("user").distinct().count()


def test_edges_only_of_keys_that_are_cut(rows):
    """Rows of a key of one slice are not ranked for edges; frames over the busy key are exact."""
    data = [("busy", i, float(i % 17)) for i in range(400)] + [(f"k{i % 30}", i, 1.0) for i in range(300)]
    df, cells = rows(data, "k string, i int, v double"), scan.HotCells(100)
    flags = cells.apply(df, ["k"], ["i"], "hot").groupBy("hot").agg(F.collect_set("k").alias("k")).collect()
    assert {r["hot"]: len(r["k"]) for r in flags} == {True: 1, False: 30}
    ext, w = scan.haloed(df, ["k"], ["i"], ["v"], cells, before=3)
    assert "__hot" not in ext.columns and {r["k"] for r in ext.filter("__ghost").collect()} == {"busy"}
    got = {r["i"]: r["m"] for r in scan.drop_ghosts(ext.withColumn("m", F.sum("v").over(w.rowsBetween(-3, 0)))).filter("k = 'busy'").collect()}
    assert got == {i: sum(float(j % 17) for j in range(max(0, i - 3), i + 1)) for i in range(400)}
