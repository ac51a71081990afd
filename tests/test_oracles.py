"""Spark queries against their DuckDB oracles on sf0.001 (a family sample;
set QUIRE_ALL_ORACLES=1 to run every registered oracle)."""

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.oracle_check import rows_of

SAMPLE = [
    "flagship_run_report", "ag3_seed_stats_n", "ag8_curve_band", "jn3_match_log_keys", "sc21_explode_means",
    "pf3_gate_verdict", "pf5_combine_rule_classifier", "pf7_accept_upload", "sc4_last_tokens",
    "sc1_extract_json", "wn1_reflection_fold", "wn2_novelty_fold", "wn9_growing_prefixes",
    "ag1_ensemble_scores", "wn14_feedback_items", "sc13_review_score", "sc14_improvement_prompt",
    "wn20_kfold", "wn23_epoch_batches", "jn22_draw_with_replacement", "jn16_vocab_encode", "wn19_fewshot_prompts",
    "ag16_roc_auc", "ag17_average_precision", "ag18_weighted_cross_entropy",
    "wn4_best_so_far_min", "wn7_smooth_hanning", "wn12_future_window_label", "wn15_attempt_outcome", "wn25_ema",
    "sc9_cite_keys", "jn5_missing_cites", "jn6_match_idea_by_name", "jn20_top_documents", "sc6_pick_venue",
    "jn12_pair_distance_stats", "jn13_focus_point", "jn15_inverse_cdf_sampling", "ag24_knn_kl_divergence",
    "ag31_total_variation", "src3_discover_runs", "src8_read_xyz_frames", "ss3_streaming_attempts",
    "ss1_streaming_assemble", "ud1_plugin_text_scorer",
]
NAMES = sorted(E.oracle_sql()) if os.environ.get("QUIRE_ALL_ORACLES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, srows) == rows_of(dcols, res.fetchall())
