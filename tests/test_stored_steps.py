"""Steps that several later ones read are computed once, and independent fits run side by side."""

from encore.operators import latent as L
from encore.operators import models as ML
from encore.plans import QUERIES, Tables
from encore.plans import models as P

SF = "/root/testdata/sf0.001"


def test_bridges_are_labelled_once(spark, monkeypatch):
    calls, real = [], P.labelled
    monkeypatch.setattr(P, "labelled", lambda t: calls.append(1) or real(t))
    assert QUERIES["l21_detect_bridges"](tables(spark)).columns[0] == "track_id"
    assert len(calls) == 1


def test_moods_are_computed_once_and_fitted_side_by_side(spark, monkeypatch):
    calls, made, real, rest, boosted = [], [], P.moods, ML.OneVsRest, ML.GBTClassifier
    monkeypatch.setattr(P, "moods", lambda t: calls.append(1) or real(t))
    monkeypatch.setattr(ML, "GBTClassifier", lambda **given: boosted(**{**given, "maxIter": 1}))
    monkeypatch.setattr(ML, "OneVsRest", lambda **given: made.append(rest(**given)) or made[-1])
    QUERIES["l19_mood_classifier"](tables(spark))
    assert len(calls) == 1 and made[0].getParallelism() == 8


def test_scans_of_the_feature_table_are_stored(spark, monkeypatch):
    stored, real = [], L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: stored.append(df.columns) or real(df))
    QUERIES["l2_feature_table"](tables(spark))
    last = [c[-1] for c in stored]
    assert last.count("is_start") == 1 and "label_transition" in last and "hours_since_track" in last


def test_spectrum_numbers_items_only(spark, monkeypatch):
    calls, real = [], L.numbered
    monkeypatch.setattr(L, "numbered", lambda df, *given: calls.append(df.columns) or real(df, *given))
    monkeypatch.setattr(L, "svd_factors", lambda *given, **more: (None, None, spark.createDataFrame([(0, 1.0, 1.0)], "factor int, singular_value double, explained double")))
    QUERIES["l5_svd_factors"](tables(spark))
    assert calls == [["item_id"]]


def test_keys_of_the_matrix_are_found_once(spark, monkeypatch):
    stored, real = [], L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: stored.append(df.columns) or real(df))
    out = L.interaction_matrix(tables(spark).baskets, "user_id", "item_id", "quantity", 10, 5)
    assert ["user_id"] in stored and ["item_id"] in stored
    found = out.toPandas()
    for key, idx in (("user_id", "user_idx"), ("item_id", "item_idx")):
        places = found[[key, idx]].drop_duplicates().sort_values(key)
        assert list(places[idx]) == list(range(len(places)))


def tables(spark):
    return Tables(spark, SF)
