"""Plan-shape guards: properties the scale design relies on, checked on the physical plans."""

import os

import pytest

from tests.conftest import SF_SMALL
from tidemark.plans.registry import QUERIES, wh

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")

MODEL_QUERIES = {"churn_predictions", "churn_scorecard", "model_info", "churn_tier_summary_model",
                 "portfolio_overview_model", "batch_score_model", "churn_model_invariants"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_latest_address_window_is_limited_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(wh(spark, SF_SMALL).int_customer_locations)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_delivered_filter_and_pruning_reach_the_scan(spark):
    from tidemark.operators import marts as M
    w = wh(spark, SF_SMALL)
    df = M.fact_orders(w.stg_orders, w.stg_customers, w.int_order_items_aggregated, w.stg_order_payments,
                       w.int_order_reviews_aggregated)
    plan = plan_of(df)
    assert "EqualTo(order_status,delivered)" in plan
    assert "ReadSchema: struct<order_id:string,product_id:string,seller_id:string,price" in plan


def test_item_grain_models_have_no_expand_or_sort_aggregate(spark):
    from tidemark.operators import marts as M
    w = wh(spark, SF_SMALL)
    for df in (w.stg_order_payments, w.int_order_items_aggregated,
               M.mart_seller_metrics(w.stg_sellers, w.raw("order_items"), w.stg_orders, w.int_order_reviews_aggregated)):
        plan = plan_of(df)
        assert "Expand" not in plan and "SortAggregate" not in plan


def test_funded_customers_leave_no_checkpoint(spark):
    plan = plan_of(QUERIES["funded_customers"](spark, SF_SMALL))
    assert "ExistingRDD" not in plan and "CheckpointRDD" not in plan


def test_no_python_udfs_anywhere(spark):
    for name in sorted(set(QUERIES) - MODEL_QUERIES):
        plan = plan_of(QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
