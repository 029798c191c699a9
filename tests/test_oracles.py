"""A cross-section of the registered queries against their SQL twins, and rules for the whole registry."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF

SAMPLE = ["P2_apply_label_rules", "P15_confuser_conditions", "A1_confusion", "A3_score_metrics_by_rule", "A6_laterality_swaps", "A20_wound_detail", "A26_pixel_iou",
          "J4_agree_two_readers", "J5_pair_all_models", "J12_publish_guard", "V2_acceptance_checks", "W4_id_window_groups", "W8_ovr_auc", "F21_cause_flags", "F1_site_features",
          "G1_assign_folds", "G3_near_duplicate_groups", "G4_bootstrap_ci", "E2_events_to_classes", "V1_validate_predictions", "M12_em_prior", "X1_quota_mix", "S2_read_records",
          "R2_stream_event_state"]


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    res = oracle.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(res.fetchall(), cols)


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 180
    assert all(re.match(r"^([A-Z]\w*|op\d+_\w+|pipeline)$", n) for n in queries)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["A3_score_metrics", "J5_pair_models", "G4_bootstrap_ci", "F21_cause_flags", "A13_key_pixel_ratio", "E6_fallback_fill", "J11_manifest_diff", "W8_ovr_auc"])
def test_plans_hold_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["A5_site_accuracy"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_orderdate" not in schema
