"""Physical plans: chunk windows are dealt out by chunk."""

import re

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["b1_feature_table", "w3_prior_rolling_stats", "p7_gap_aware_fill", "b8_holdout_ensemble_score", "w8_absent_hour_imputation", "w14_running_error"])
def test_chunk_windows_follow_an_exchange_by_chunk(spark, sf, name):
    lines = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    windows = [i for i, x in enumerate(lines) if re.search(r"\bWindow \[", x) and (spec := re.search(r"\], \[([^\]]*)\], \[[^\]]*\]$", x.strip())) and re.search(r"\b_(chunk|part|b)#", spec[1])]
    assert windows
    for i in windows:
        below = next(x for x in lines[i:] if "Exchange" in x)
        assert re.search(r"hashpartitioning\([^)]*_(chunk|part|b)#", below), below


@pytest.mark.parametrize("name,scans,exchanges", [("b17_walk_forward_summary", 12, 26), ("b27_shadow_evaluation", 6, 15), ("j24_fold_weather_overlay", 8, 8), ("a27_scoreability", 4, 7), ("a44_bootstrap_mean_interval", 3, 7)])
def test_shared_frames_are_made_once(spark, sf, name, scans, exchanges):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan ExistingRDD", plan)) <= scans
    assert len(re.findall(r"\bExchange\b", plan)) <= exchanges
