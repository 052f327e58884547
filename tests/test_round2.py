"""One model path at every size, spend bounds that reach the scan, storage only where all executors see it."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bi, churn, customers
from tidemark.session import shared_root


def test_candidates_do_not_depend_on_size(spark):
    def gbt(n, **kw):
        est = dict(churn.candidate_models(n, **kw))["Gradient Boosted Trees"]
        return {p.name: v for p, v in est.extractParamMap().items()}

    assert gbt(10) == gbt(10_000_000) and "validationIndicatorCol" not in gbt(10_000_000)
    assert gbt(10, early_stopping=True)["validationIndicatorCol"] == "_validation"


def test_unknown_model_is_refused(spark):
    with pytest.raises(ValueError, match="no candidate"):
        churn.train_churn_model(spark.range(1), model_choice="oracle")


def test_spend_bounds_are_exact_and_pushed(spark, tmp_path):
    path = str(tmp_path / "view")
    spark.sql("""select cast(x as decimal(14,2)) lifetime_spend, 'u' customer_unique_id, 'c' city, 'S' state
                 from values (1.00), (1.01), (1.02) t(x)""").write.parquet(path)
    view = spark.read.parquet(path)
    got = customers.filter_customers(view, min_spend=1.005, max_spend=1.015)
    assert [float(r.lifetime_spend) for r in got.collect()] == [1.01]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "cast(lifetime_spend" not in plan  # a cast on the column would keep the bounds from the scan


def test_negative_share_goes_by_the_order_score(spark):
    fact = spark.sql("""select * from values ('a', 3.5, true), ('b', 2.0, true), ('c', null, false)
                        t(order_id, avg_review_score, has_negative_review)""") \
        .withColumns({"total_revenue": F.lit(1.0), "freight_revenue": F.lit(0.0), "is_late_delivery": F.lit(False)})
    dim = spark.sql("select * from values ('u', false), ('v', true) t(customer_unique_id, is_repeat_buyer)")
    pred = spark.sql("select 1.0D revenue_at_risk, 'x' retention_priority, 'High' risk_tier, 0.9D churn_probability")
    row = bi.bi_measures(fact, dim, None, pred).first()
    assert float(row.negative_review_share) == pytest.approx(33.33, abs=0.01)
    assert float(row.high_risk_share) == 50.0


def test_storage_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session())


def test_half_a_second_late_is_late(spark):
    from tidemark.operators import staging
    orders = spark.sql("""select id order_id, id customer_id, 'delivered' order_status, est order_purchase_timestamp,
                                 est order_approved_at, est order_delivered_carrier_date,
                                 dlv order_delivered_customer_date, est order_estimated_delivery_date
                          from values ('late', timestamp_ntz '2020-01-01 00:00:00', timestamp_ntz '2020-01-01 00:00:00.5'),
                                      ('open', timestamp_ntz '2020-01-01 00:00:00', null) t(id, est, dlv)""")
    got = {r.order_id: (r.delivery_delay_days, r.delivery_delay_micros) for r in staging.stg_orders(orders).collect()}
    assert got == {"late": (0.5 / 86400, 500_000), "open": (None, None)}


def test_model_checks_count_bad_rows_and_repeated_complete_keys(spark):
    from tidemark.operators import quality
    df = spark.sql("select * from values (1, 'x'), (1, null), (2, 'y'), (null, 'x'), (null, 'z') t(k, v)")
    bad = [("not_null", "k", F.col("k").isNull()), ("not_null", "v", F.col("v").isNull()),
           ("accepted_values", "v", F.col("v").isNotNull() & ~F.col("v").isin(["x", "y"]))]
    got = {(r.test, r.column): r.failures for r in quality.grouped_checks({"m": (df, ["k"], bad)}).collect()}
    assert got == {("unique", "k"): 1, ("not_null", "k"): 2, ("not_null", "v"): 1, ("accepted_values", "v"): 1}
    empty = quality.grouped_checks({"m": (df.where("false"), ["k"], bad)}).collect()
    assert [r.failures for r in empty] == [0, 0, 0, 0]


def test_constraints_find_orphans(spark):
    from tidemark.operators import quality
    one = {"customers": "select 'c' customer_id", "mql": "select 'm' mql_id",
           "orders": "select * from values ('o', 'c'), ('p', 'gone'), ('q', null) t(order_id, customer_id)",
           "order_items": "select * from values ('o', 1.0, -1.0), ('z', -2.0, 0.0), ('z', 1.0, 0.0) t(order_id, price, freight_value)",
           "order_payments": "select 'o' order_id", "order_reviews": "select 'y' order_id, 6 review_score",
           "closed_deals": "select 'n' mql_id"}
    row = quality.dq_constraints({n: spark.sql(q) for n, q in one.items()}).first()
    assert row.asDict() == {"negative_price": 1, "negative_freight": 1, "score_out_of_range": 1, "orders_without_customer": 1,
                            "items_without_order": 2, "payments_without_order": 0, "reviews_without_order": 1,
                            "deals_without_lead": 1}


def test_overview_counts_scores_of_customers_who_left_the_mart(spark):
    from tidemark.operators import analytics
    mart = spark.sql("select 'a' customer_unique_id, 2 lifetime_orders, 100.0 lifetime_spend, 50.0 avg_order_value, true is_repeat_buyer")
    pred = spark.sql("""select * from values ('a', 10.0, 0.5D, 'Medium', 'x'), ('gone', 5.0, 0.9D, 'High', 'x')
                        t(customer_unique_id, revenue_at_risk, churn_probability, risk_tier, retention_priority)""")
    row = analytics.portfolio_overview(mart, pred).first()
    assert (row.total_customers, row.portfolio_revenue_at_risk, row.high_risk_customers_count) == (1, 15.0, 1)


def test_failed_upsert_leaves_the_store_and_a_version_is_never_overwritten(spark, tmp_path):
    from tidemark.sinks import tables as SK
    path = str(tmp_path / "store")
    assert SK.read_store(spark, path) is None
    for v in (1, 2, 3):
        SK.upsert(spark, path, spark.createDataFrame([("a", v)], "k string, v int"), ["k"])
    assert SK.read_store(spark, path).first().v == 3
    failing = spark.createDataFrame([("a", 0)], "k string, v int").withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        SK.upsert(spark, path, failing, ["k"])
    assert SK.read_store(spark, path).first().v == 3
    assert sorted(p.name for p in tmp_path.joinpath("store").iterdir()) == ["v-000000002", "v-000000003"]
    with pytest.raises(Exception, match="exists"):
        SK._publish(spark, f"{path}/v-000000002", f"{path}/v-000000003")


def test_changed_input_has_another_fingerprint(spark, tmp_path):
    from tidemark.plans.warehouse import _input_fingerprint
    spark.range(3).write.parquet(str(tmp_path / "in" / "t.parquet"))
    a = _input_fingerprint(spark, str(tmp_path / "in"))
    assert a == _input_fingerprint(spark, f"file://{tmp_path}/in")
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in" / "t.parquet"))
    assert a != _input_fingerprint(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="not exist"):
        _input_fingerprint(spark, str(tmp_path / "missing"))


def test_sources_are_looked_up_in_every_candidate_folder(spark, tmp_path):
    from tidemark.sources.csv import find_source
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("a\n")
    assert find_source(spark, "x.csv", [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]) == f"file://{tmp_path}/b/x.csv"
    assert find_source(spark, "y.csv", [str(tmp_path / "b")]) is None
