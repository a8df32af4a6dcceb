"""The registry and, at the smallest scale, one group of queries per family against the oracle."""

import re

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "a2_parse_history_record", "a4_flatten_play_item", "b1_calendar_parts", "b12_platform_category", "b22_parse_list_string",
    "c2_pattern_hit_score", "c5_weighted_culture_scores", "c9_keyword_vote_scores_capped", "d2_quality_filter_counts", "d3_min_support_filter",
    "d17_impute_median", "e10_recency_penalty_join", "e15_pairwise_distance", "e16_new_top_k_vs_previous_year", "f1_session_stats",
    "f3_activity_by_dimension", "f35_artist_discovery", "g1_sessionize", "g2_derive_users", "g7_rolling_mean_last_n", "g9_rolling_distinct_entities",
    "g15_class_transitions_after_run", "g24_exposure_windows", "h2_top_k_scores", "i3_overlap_report", "j1_change_points",
    "j3_merge_change_points_chain", "j10_seasonal_decompose", "k1_bridge_candidates", "l4_interaction_matrix", "l18_mood_features",
    "j16_major_shifts", "l16_session_features", "l10_measured_personalities", "m4_user_profile", "m5_recommend", "m7_context_score", "m9_contextual_recommend",
    "m11_ensemble_recommend", "m12_system_insights", "n17_compare_runs", "o13_permutation_baseline", "o16_bootstrap_ci_median", "n1_expanding_splits", "n9_ndcg_at_k", "o2_wilcoxon_signed_rank", "o5_mann_whitney_u", "o12_davies_bouldin",
]


def test_keys_are_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(re.fullmatch(r"(([a-o]|op)\d+_[a-z0-9_]+|pipeline)", k) for k in queries)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", CHECKED)
def test_query_matches_oracle(spark, key):
    got = entry.queries()[key](spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).execute(entry.oracle_sql()[key]).fetchdf()) == ""
