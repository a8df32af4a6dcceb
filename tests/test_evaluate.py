import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from encore.operators import evaluate as V
from encore.operators import quality as Q
from encore.operators import ranking as K


def test_ndcg_and_precision(rows):
    recs = rows(
        [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (2, "y", 2), (3, "p", 1), (3, "q", 2), (3, "p", 3)],
        "u int, i string, rank int",
    )
    test = rows([(1, "c"), (1, "z"), (3, "p"), (3, "p")], "u int, i string")
    ndcg = {r.u: r.ndcg for r in V.ndcg(recs, test, ["u"], "i", 3).collect()}
    assert ndcg[1] == pytest.approx((1 / math.log2(4)) / 1.0) and ndcg[2] == 0.0 and ndcg[3] == pytest.approx(1.0)
    pr = {r.u: (r.precision, r.recall) for r in V.precision_recall(recs, test, ["u"], "i", 3).collect()}
    assert pr[1] == (pytest.approx(1 / 3), 0.5) and pr[2] == (0.0, 0.0) and pr[3] == (pytest.approx(1 / 3), 1.0)


def test_entropy(rows):
    df = rows([(1, "a"), (2, "a"), (2, "b")], "u int, c string")
    got = {r.u: r.cultural_diversity for r in V.normalised_entropy(df, ["u"], "c").collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(1.0, abs=1e-8)


def log(rows, n):
    t = dt.datetime(2024, 1, 1)
    return rows([(i, t + dt.timedelta(hours=i // 2)) for i in range(n)], "id long, ts timestamp")


def test_ratio_split_sizes_and_ties(rows):
    out = V.ratio_split(log(rows, 13), "ts", "id", 0.8).orderBy("id").collect()
    assert [r.split for r in out] == ["train"] * 10 + ["test"] * 3


def test_three_way_and_integrity(rows):
    out = V.three_way_time_split(log(rows, 23), "ts", "id")
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 17, "validation": 2, "test": 4}
    assert V.split_integrity(out, ["id"], "split", "ts").first().valid


def test_seeded_split_is_exact_disjoint_and_stable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = V.seeded_split(df, ["id"], strata=["g"])
    two = V.seeded_split(df.repartition(5), ["id"], strata=["g"])
    assert one.exceptAll(two).count() == 0 and one.count() == 1000
    sizes = {(r.g, r.split): r["count"] for r in one.groupBy("g", "split").count().collect()}
    assert sizes[(0, "test")] == 66 and sizes[(0, "validation")] == 33 and sizes[(1, "test")] == 66
    folds = [r["count"] for r in V.kfold(df, ["id"], 5).groupBy("fold").count().collect()]
    assert folds == [200] * 5


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert V.data_fingerprint(df).first() == V.data_fingerprint(df.orderBy(F.desc("id"))).first()
    assert V.data_fingerprint(df).first() != V.data_fingerprint(df.filter("id < 99")).first()


def test_balanced_negatives_keep_the_ratio(spark):
    df = spark.range(500).withColumn("pos", F.col("id") % 25 == 0)
    out = K.balanced_negatives(df, "pos", ["id"], 3).groupBy("pos").count().collect()
    assert {r.pos: r["count"] for r in out} == {True: 20, False: 60}


def test_top_k_and_modes_break_ties_by_key(rows):
    df = rows([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "k string")
    assert [(r.k, r.plays) for r in K.top_k(df, "k", 2).collect()] == [("a", 2), ("b", 2)]
    assert K.arg_max(df, "k").first().k == "a"


def test_min_support_is_one_pass(rows):
    df = rows([(1, "x"), (1, "y"), (2, "x"), (3, "z"), (3, "z")], "u int, i string")
    assert sorted(tuple(r) for r in Q.min_support(df, "u", "i", 2, 2).select("u", "i").collect()) == [(3, "z"), (3, "z")]


def test_evaluate_splits_uses_each_row_once_per_split(rows):
    df = log(rows, 1500).withColumn("u", F.col("id") % 3)
    splits = V.expanding_splits(df, "ts", 5, 10, 8, 100, 50)
    tagged = V.assign_splits(df, splits, "ts").groupBy("split_id", "split").count()
    got = {(r.split_id, r.split): r["count"] for r in tagged.collect()}
    for r in splits.collect():
        assert got[(r.split_id, "train")] == r.n_train and got[(r.split_id, "test")] == r.n_test
