"""Plan-shape guards: no cross joins, pushed filters, distributed ordered statistics."""

import pytest

from retainlens.plans import catalog
from tools.plan_summary import summarise


@pytest.mark.parametrize("name", ["q_roc_auc", "q_evaluation_report", "q_full_check", "q_retrain_gate",
                                  "q_class_weights", "q_chi_square", "q_ks", "q_audit", "q_stratified_split"])
def test_no_cross_joins(spark, sf, name):
    ops, _ = summarise(catalog.QUERIES[name](spark, sf))
    assert ops["BroadcastNestedLoopJoin"] == 0 and ops["CartesianProduct"] == 0


def test_log_window_pushed_to_scan(spark, sf):
    _, pushed = summarise(catalog.QUERIES["q_prediction_stats"](spark, sf))
    assert any("GreaterThanOrEqual(ts" in p and "LessThan(ts" in p for p in pushed)


def test_ordered_stats_are_bucketed(spark, sf):
    df = catalog.QUERIES["q_roc_auc"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the running-sum window is partitioned by range bucket, and the input is read from a checkpoint
    assert "_part" in plan and "ExistingRDD" in plan
