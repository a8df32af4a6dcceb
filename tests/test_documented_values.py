"""Queries of fitted models and resampling pass no value below the operators' documented defaults."""

import inspect

import pytest

import __spark_entry__ as entry
from encore.operators import latent, models, stats

FOLDER = "/root/testdata/sf0.001"
CASES = [
    ("l5_svd_factors", latent, "svd_factors", ["k", "iterations"]),
    ("l6_nmf_factors", latent, "nmf_factors", ["k", "iterations"]),
    ("l7_factor_sweep", latent, "factor_sweep", ["counts", "iterations"]),
    ("l9_factor_stability", latent, "factor_stability", ["windows", "k", "iterations"]),
    ("l13_volume_regressor", models, "expanding_cv", ["folds"]),
    ("l14_volume_forecast", models, "volume_regressor", ["trees", "depth"]),
    ("l17_session_artist_classifier", models, "session_artist_classifier", ["trees", "folds"]),
    ("l19_mood_classifier", models, "mood_classifier", ["trees"]),
    ("l20_bridge_classifier", models, "bridge_classifier", ["top", "trees", "depth"]),
    ("l21_detect_bridges", models, "bridge_classifier", ["top", "trees", "depth"]),
    ("o13_permutation_baseline", stats, "permutation_baseline", ["replicates"]),
    ("o14_bootstrap_cluster_stability", stats, "cluster_stability", ["replicates"]),
    ("o16_bootstrap_ci_mean", stats, "bootstrap_ci", ["replicates"]),
    ("o16_bootstrap_ci_median", stats, "bootstrap_ci", ["replicates"]),
]


class Called(Exception):
    pass


@pytest.mark.parametrize("key,module,name,values", CASES)
def test_query_takes_the_defaults(spark, monkeypatch, key, module, name, values):
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kwargs):
        given = signature.bind(*args, **kwargs)
        given.apply_defaults()
        raise Called({v: given.arguments[v] for v in values})

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Called) as seen:
        entry.queries()[key](spark, FOLDER)
    assert seen.value.args[0] == {v: signature.parameters[v].default for v in values}


def test_factor_stability_takes_every_window(rows):
    data = [(u, i, float((u * i + w) % 5 + 1), w) for w in (1, 2, 3) for u in range(12) for i in range(10)] + [(1, 1, 1.0, None)]
    table = rows(data, "u int, i int, v double, w int")
    out = latent.factor_stability(table, "u", "i", "v", "w", k=2, iterations=2).collect()
    assert len(out) == 2 and all(r.n_pairs == 2 for r in out)
