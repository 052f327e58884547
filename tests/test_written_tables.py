"""Checks counted while tables are written, the month-partitioned fact table and its refresh."""

import os

from pyspark.sql import functions as F

from tidemark.operators import analytics as A
from tidemark.operators import marts as M
from tidemark.operators import quality as DQ
from tidemark.plans.warehouse import Warehouse
from tidemark.sinks.tables import refresh_months

SF = "/root/testdata/sf0.001"


def test_checks_are_counted_as_rows_are_written(spark, tmp_path):
    rows = [("a", "c1", "delivered", "2020-01-01"), ("a", "c2", None, "2020-01-01"), ("a", "c2", "lost", None), (None, "c3", "shipped", None),
            (None, None, "shipped", "2020-01-01"), ("b", "c4", "created", "2020-01-01")]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, order_status string, order_purchase_timestamp string")
    path = str(tmp_path / "t")
    got = DQ.write_checked(df, "raw_orders", lambda d: d.write.parquet(path), keyed=True, arrange=lambda d: d.sortWithinPartitions("customer_id"))
    assert got == {"not_null:order_id": 2, "not_null:customer_id": 1, "not_null:order_status": 1, "not_null:order_purchase_timestamp": 2,
                   "accepted_values:order_status": 1, "unique:order_id": 1}
    back = spark.read.parquet(path)
    assert back.columns == df.columns and back.count() == len(rows)
    # the same numbers as an aggregation over the table
    again = DQ.grouped_checks({"raw_orders": (back, ["order_id"], DQ.row_checks("raw_orders"))}).collect()
    assert {f"{r.test}:{r.column}": r.failures for r in again} == got


def test_report_reads_no_written_mart_again(spark):
    w = Warehouse.for_testdata(spark, SF)
    report = DQ.warehouse_dq_report(w.model, w.counted_at_write)
    assert report.where("status <> 'pass'").count() == DQ.warehouse_dq_report(w.model).where("status <> 'pass'").count()
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, DQ.warehouse_dq_report(w.model).collect()))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "mart_seller_metrics" not in plan and "mart_customer_metrics" not in plan


def test_window_opens_its_months_only(spark):
    w = Warehouse.for_testdata(spark, SF)
    plan = A.revenue_trends(w.fact_by_month, "month", "1994-01-01", "1996-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "purchase_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert w.fact_orders.columns == M.fact_orders(w.stg_orders, w.stg_customers, w.int_order_items_aggregated,
                                                  w.stg_order_payments, w.int_order_reviews_aggregated).columns


def files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet"))
            for d in os.listdir(path) if "=" in d}


def test_one_changed_month_rewrites_one_partition(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact = spark.range(600).select(F.col("id").alias("order_id"), F.expr("timestamp_ntz'2021-01-15' + make_interval(0, cast(id % 6 as int))").alias("purchased_at"),
                                   (F.col("id") * 3).alias("total"))
    fact = fact.unionByName(spark.sql("select 1000L order_id, cast(null as timestamp_ntz) purchased_at, 1L total"))
    M.by_month(fact).write.partitionBy(M.MONTH).parquet(path)
    before = files(path)
    assert len(before) == 7 and refresh_months(spark, M.by_month(fact), path, M.MONTH) == [] and files(path) == before
    new = fact.withColumn("total", F.when(F.col("order_id") == 8, 0).otherwise(F.col("total")))
    assert refresh_months(spark, M.by_month(new), path, M.MONTH) == ["202103"]
    after = files(path)
    assert [d for d in before if before[d] != after[d]] == [f"{M.MONTH}=202103"]
    fewer = new.where("month(purchased_at) <> 5 or purchased_at is null")
    assert refresh_months(spark, M.by_month(fewer), path, M.MONTH) == ["202105"]
    back = spark.read.parquet(path).drop(M.MONTH)
    assert back.exceptAll(fewer).count() == 0 and fewer.exceptAll(back).count() == 0


def test_portfolio_parts_add_up(spark):
    """Sums of two parts of the customers, merged, are the whole's; reading them runs no job."""
    w = Warehouse.for_testdata(spark, SF)
    half = F.xxhash64("customer_unique_id") % 2 == 0
    mart, pred = w.mart_customer_metrics, w.churn_predictions_baseline
    parts = [A.portfolio_sums(mart.where(h), pred.where(h)).first() for h in (half, ~half)]
    whole = A.portfolio_sums(mart, pred).first()
    assert tuple(a + b for a, b in zip(*parts)) == tuple(whole) == tuple(w.portfolio_sums.first())
    plan = A.portfolio_kpis(w.portfolio_sums)._jdf.queryExecution().executedPlan().toString()
    assert plan.strip().startswith("LocalTableScan") and plan.strip().count("\n") == 0
    assert A.portfolio_kpis(w.portfolio_sums).first() == A.portfolio_overview(mart, pred).first()


def test_empty_tables_are_written_and_counted(spark, tmp_path):
    """Also where the optimizer finds out that nothing is left."""
    schema = "order_id string, customer_id string, order_status string, order_purchase_timestamp string"
    some = spark.createDataFrame([("a", "c", "delivered", "x")], schema)
    cases = [spark.createDataFrame([], schema), some.where("false"), some.join(some.select("order_id").where("order_id > 'b'"), "order_id")]
    for k, df in enumerate(cases):
        for keyed in (False, True):
            path = str(tmp_path / f"{k}{keyed}")
            got = DQ.write_checked(df, "raw_orders", lambda d: d.write.parquet(path), keyed=keyed)  # noqa: B023
            assert set(got.values()) == {0} and len(got) == 5 + keyed
            assert spark.read.schema(schema).parquet(path).count() == 0
