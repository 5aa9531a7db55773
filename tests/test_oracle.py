"""Spark queries against their DuckDB oracle SQL (a cross-family sample by
default; TURNSTILE_FULL_ORACLE=1 runs every query with an oracle)."""

import os

import pytest

from conftest import SF_ORACLE, SF_SMALL
from oracle_check import compare, duck

SAMPLE = ["d01_count_to_pct", "d04_attrition_workflow", "d05_cost_label_table", "s03_csv_sink",
          "p21_row_number", "j01_left_join", "a08_proportion_table", "a12_skewness", "a14_table_profile",
          "w03_running_sum", "w06_ntile", "w07_rank_average_ties", "w09_fill_down", "o06_even_sample",
          "r04_separate", "f05_currency_label", "f09_relevel", "e01_metrics_by_threshold", "e02_auc",
          "e11_gain_lift_deciles", "e12_gain_lift_16_groups", "v07_savings_all_thresholds",
          "v09_threshold_optimisation", "v12_sensitivity_grid", "g04_recommend_one_employee",
          "m09_discretize", "d08_get_cor", "d13_histogram", "l01_split", "st01_stream_score_and_recommend",
          "e01_metrics_by_threshold_binned", "v07_savings_binned_thresholds", "e14_dashboard_gain_lift",
          "k04_per_row_table_function"]

FULL = os.environ.get("TURNSTILE_FULL_ORACLE") == "1"
SF = SF_ORACLE if FULL else SF_SMALL


def _names():
    from turnstile.plans.registry import load_all
    cat = load_all()
    if FULL:
        return [n for n, e in cat.items() if e.sql is not None]
    return [n for n in SAMPLE if n in cat]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, catalog, con, name):
    r = compare(spark, con, catalog[name], SF)
    assert r["status"] in ("ok", "near"), r


def test_every_query_has_builder_and_most_have_oracles(catalog):
    with_sql = [n for n, e in catalog.items() if e.sql]
    assert len(catalog) >= 150
    assert len(with_sql) / len(catalog) > 0.8
