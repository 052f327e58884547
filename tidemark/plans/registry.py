"""Named queries over the test data: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query runs the whole pipeline slice it needs over the complete input
tables (through the warehouse, which writes each mart once per input).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import rfm as RFM
from .warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]


def wh(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse.for_testdata(spark, sf_dir)


def _attr(name: str, drop: tuple[str, ...] = ()) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(wh(spark, sf_dir), name)
        return df.drop(*drop) if drop else df
    q.__name__ = name
    return q


QUERIES: dict[str, Query] = {}

for _n in ["stg_customers", "stg_order_items", "stg_order_payments", "stg_order_reviews",
           "stg_products", "stg_sellers", "stg_marketing_leads", "stg_closed_deals",
           "int_order_items_aggregated", "int_order_reviews_aggregated", "int_customer_locations",
           "int_customer_orders", "int_customer_fulfillment", "int_customer_reviews",
           "fact_orders", "dim_customers", "mart_customer_metrics", "mart_product_metrics",
           "mart_seller_metrics", "mart_marketing_funnel", "rfm_segments"]:
    QUERIES[_n] = _attr(_n)
QUERIES["stg_orders"] = _attr("stg_orders", drop=("delivery_delay_micros",))

QUERIES["rfm_summary"] = lambda s, d: RFM.rfm_summary(wh(s, d).rfm_segments)
QUERIES["segments_overview"] = lambda s, d: A.segments_overview(wh(s, d).rfm_segments)
QUERIES["revenue_trends"] = lambda s, d: A.revenue_trends(wh(s, d).fact_orders, "month")
QUERIES["revenue_trends_week"] = lambda s, d: A.revenue_trends(wh(s, d).fact_orders, "week")
QUERIES["revenue_trends_day"] = lambda s, d: A.revenue_trends(wh(s, d).fact_orders, "day")
QUERIES["revenue_trends_window"] = lambda s, d: A.revenue_trends(
    wh(s, d).fact_by_month, "month", start_date="1994-01-01", end_date="1996-12-31")
QUERIES["cohort_retention"] = lambda s, d: A.cohort_retention(wh(s, d).fact_orders)
def _cohort_matrix(s, d):
    """The matrix with each cohort's map as text (m0=100.00,m1=...)."""
    rates = F.transform(F.filter(F.transform(
        F.sequence(F.lit(0), F.lit(12)), lambda i: F.struct(F.concat(F.lit("m"), i).alias("m"), F.element_at(
            "retention_rates", F.concat(F.lit("m"), i)).cast("decimal(5,2)").alias("rate"))),
        lambda x: x["rate"].isNotNull()), lambda x: F.concat_ws("=", x["m"], x["rate"]))
    return (A.cohort_matrix(A.cohort_retention(wh(s, d).fact_orders))
            .withColumn("retention_rates", F.array_join(rates, ",")))


QUERIES["cohort_matrix"] = _cohort_matrix

# ------------------------------------------------------------------ churn, scores, reports
from ..operators import bi as BI  # noqa: E402
from ..operators import catalog as CAT  # noqa: E402
from ..operators import churn as C  # noqa: E402
from ..operators import customers as CU  # noqa: E402
from ..operators import marketing as MK  # noqa: E402
from ..operators import paging as PG  # noqa: E402
from ..operators import quality as DQ  # noqa: E402
from ..operators import retention as RT  # noqa: E402
from ..operators import scoring as SC  # noqa: E402
from ..sources.schemas import EXPECTED_ROW_COUNTS, MARKETING_TABLES  # noqa: E402

BUDGET = 150000.0
# What-if scenario parameters: feature overrides applied to every customer.
SCENARIOS = [("fix_delivery", {"late_order_ratio": 0.0, "avg_delivery_delay_days": 0.0}),
             ("bad_experience", {"late_order_ratio": 1.0, "avg_review_score": 1.0}),
             ("second_order", {"lifetime_orders": 2.0})]


def _baseline_scorer():
    return SC.formula_scorer(lambda: 0.8 * F.col("recency_days").cast("double")
                             / (F.col("recency_days").cast("double") + 365.0)
                             + 0.2 * F.col("late_order_ratio").cast("double"))


def _pb(s, d):
    return wh(s, d).churn_predictions_baseline


def _view(s, d, model: bool = False):
    w = wh(s, d)
    return w.customer_profile_model if model else w.customer_profile


def _rec(s, d):
    return wh(s, d).playbook_recommendations


QUERIES.update({
    "churn_features": lambda s, d: wh(s, d).churn_features,
    "churn_predictions_baseline": _pb,
    "churn_predictions": lambda s, d: wh(s, d).churn_predictions,
    "churn_scorecard": lambda s, d: C.scorecard(s, wh(s, d).churn_model),
    "model_info": lambda s, d: C.model_info(s, wh(s, d).churn_model_path),
    "churn_tier_summary": lambda s, d: C.tier_summary(_pb(s, d)),
    "churn_priority_summary": lambda s, d: C.priority_summary(_pb(s, d)),
    "churn_exec_summary": lambda s, d: C.exec_summary(_pb(s, d)),
    "churn_tier_summary_model": lambda s, d: C.tier_summary(wh(s, d).churn_predictions),
    "portfolio_overview": lambda s, d: A.portfolio_kpis(wh(s, d).portfolio_sums),
    "portfolio_overview_scan": lambda s, d: A.portfolio_overview(wh(s, d).mart_customer_metrics, wh(s, d).churn_predictions_baseline),
    "portfolio_overview_model": lambda s, d: A.portfolio_overview(wh(s, d).mart_customer_metrics, wh(s, d).churn_predictions),
    "rar_summary": lambda s, d: A.rar_summary(_pb(s, d)),
    "rar_by_tier": lambda s, d: A.rar_by_tier(_pb(s, d)),
    "rar_by_priority": lambda s, d: A.rar_by_priority(_pb(s, d)),
    "top_at_risk": lambda s, d: A.top_at_risk(_view(s, d)),
    "customer_list": lambda s, d: CU.customer_list(_view(s, d)),
    "customer_list_filtered": lambda s, d: CU.customer_list(
        _view(s, d), page=2, page_size=10, sort_by="revenue_at_risk", sort_order="desc",
        risk_tier="Medium", state="eu", min_spend=100000.0, search="u1"),
    "at_risk_queue": lambda s, d: CU.at_risk_queue(_view(s, d)),
    "customer_360": lambda s, d: CU.customer_360(_view(s, d)).select(
        "customer_unique_id", "city", "state", "zip_prefix", "first_purchased_at", "latest_purchased_at", "recency_days",
        "customer_lifespan_days", "lifetime_orders", "is_repeat_buyer", "basket.*", "fulfillment.*", "reviews.*", "rfm.*",
        "churn.*"),
    "campaign_export": lambda s, d: CU.campaign_export(_view(s, d)),
    "product_list": lambda s, d: CAT.product_list(wh(s, d).mart_product_metrics),
    "product_list_search": lambda s, d: CAT.product_list(
        wh(s, d).mart_product_metrics, page=1, page_size=15, category="ar", sort_by="avg_unit_price",
        sort_order="asc", search="P1"),
    "category_summary": lambda s, d: CAT.category_summary(wh(s, d).mart_product_metrics),
    "seller_list": lambda s, d: CAT.seller_list(wh(s, d).mart_seller_metrics, page_size=25),
    "seller_top_categories": lambda s, d: CAT.seller_top_categories(wh(s, d).stg_order_items, wh(s, d).stg_products),
    "seller_detail": lambda s, d: CAT.seller_detail(
        wh(s, d).mart_seller_metrics,
        CAT.seller_top_categories(wh(s, d).stg_order_items, wh(s, d).stg_products))
    .withColumn("top_categories", F.array_join("top_categories", "; ")),
    "funnel_overview": lambda s, d: MK.funnel_overview(wh(s, d).mart_marketing_funnel),
    "channel_attribution": lambda s, d: MK.channel_attribution(wh(s, d).mart_marketing_funnel),
    "velocity_overall": lambda s, d: MK.velocity_overall(wh(s, d).mart_marketing_funnel),
    "velocity_by_segment": lambda s, d: MK.velocity_by_segment(wh(s, d).mart_marketing_funnel),
    "velocity_by_lead_type": lambda s, d: MK.velocity_by_lead_type(wh(s, d).mart_marketing_funnel),
    "velocity_summary": lambda s, d: MK.velocity_summary(wh(s, d).mart_marketing_funnel),
    "segment_performance": lambda s, d: MK.segment_performance(wh(s, d).mart_marketing_funnel),
    "lead_list": lambda s, d: MK.lead_list(wh(s, d).mart_marketing_funnel, page=1, page_size=30),
    "playbook_recommendation": lambda s, d: RT.playbook_recommendation(_view(s, d), RT.playbooks(s)),
    "campaign_roi": lambda s, d: RT.campaign_roi(_rec(s, d)),
    "pool_economics": lambda s, d: RT.pool_economics(RT.pools_from_recommendations(_rec(s, d))),
    "budget_allocation": lambda s, d: RT.budget_allocation(RT.pools_from_recommendations(_rec(s, d)), BUDGET),
    "budget_summary": lambda s, d: RT.budget_summary(RT.pools_from_recommendations(_rec(s, d)), BUDGET),
    "funded_customers": lambda s, d: RT.funded_customers(
        _rec(s, d), RT.budget_allocation(RT.pools_from_recommendations(_rec(s, d)), BUDGET)),
    "whatif_baseline": lambda s, d: SC.whatif_baseline(_view(s, d)),
    # flat; the drivers are the query risk_drivers
    "batch_score": lambda s, d: SC.batch_score(SC.feature_defaults(
        SC.whatif_baseline(_view(s, d))), _baseline_scorer()).drop("top_feature_contributions"),
    "batch_score_model": lambda s, d: SC.batch_score(SC.feature_defaults(
        SC.whatif_baseline(_view(s, d))),
        SC.model_scorer(wh(s, d).churn_model)),
    "whatif_scenarios": lambda s, d: SC.whatif_scenarios(
        SC.whatif_baseline(_view(s, d)), SCENARIOS, _baseline_scorer()),
    "raw_delivered_orders": lambda s, d: DQ.raw_delivered_orders(wh(s, d).raw("orders"), wh(s, d).raw("customers")),
    "raw_order_revenue": lambda s, d: DQ.raw_order_revenue(wh(s, d).raw("order_items")),
    "raw_ingestion_summary": lambda s, d: DQ.raw_ingestion_summary(
        {n: wh(s, d).raw(n) for n in EXPECTED_ROW_COUNTS},
        {n: ("raw_marketing" if n in MARKETING_TABLES else "raw") for n in EXPECTED_ROW_COUNTS}),
    "table_health": lambda s, d: DQ.table_health(
        wh(s, d).raw("orders"), wh(s, d).raw("customers"), wh(s, d).mart_customer_metrics, wh(s, d).fact_orders,
        wh(s, d).mart_marketing_funnel, wh(s, d).rfm_segments, _pb(s, d))  # the formula's scores need no stored model
    .withColumn("anomalies", F.array_join("anomalies", "; ")),
    "bi_measures": lambda s, d: BI.bi_measures(wh(s, d).fact_orders, wh(s, d).dim_customers,
                                               wh(s, d).mart_customer_metrics, _pb(s, d)),
    "bi_late_by_state": lambda s, d: BI.bi_late_by_state(wh(s, d).fact_orders, wh(s, d).dim_customers),
})


def _csv_raw(s, d, table: str):
    from ..sources.csv import load_raw
    return load_raw(s, [wh(s, d).csv_of([table])], "all", [table])[table]


def _csv_summary(s, d):
    from ..sources.csv import SCHEMA_OF, load_raw
    return DQ.raw_ingestion_summary(load_raw(s, [wh(s, d).csv_dir], "all"), SCHEMA_OF)


QUERIES.update({
    "dq_report": lambda s, d: DQ.warehouse_dq_report(wh(s, d).model, wh(s, d).counted_at_write),
    "csv_ingest_summary": _csv_summary,
    "csv_ingest_orders": lambda s, d: _csv_raw(s, d, "orders"),
    "csv_ingest_order_reviews": lambda s, d: _csv_raw(s, d, "order_reviews"),
    "csv_ingest_order_items": lambda s, d: _csv_raw(s, d, "order_items"),
    "csv_ingest_closed_deals": lambda s, d: _csv_raw(s, d, "closed_deals"),
})


def _partial_profiles(s, d):
    """Partial feature profiles (five fields, as a caller would send), for every customer."""
    return _view(s, d).select("customer_unique_id", "lifetime_spend", "lifetime_orders",
                              "avg_delivery_delay_days", "avg_review_score", "segment")


def _upserted(s, d, name):
    from ..sinks import tables as SK
    w = wh(s, d)
    if name == "rfm":
        out = SK.upsert_rfm(s, f"{w.root}/store/rfm_segments", w.rfm_segments)
        return out.drop("updated_at")
    out = SK.upsert_predictions(s, f"{w.root}/store/churn_predictions", w.churn_predictions_baseline)
    return out.drop("predicted_at")


def _upsert_of_two_runs(s, d):
    """Two runs with keys of their own and shared ones: the earlier run's own keys stay as they were."""
    from ..sinks import tables as SK
    rfm, path = wh(s, d).rfm_segments, f"{wh(s, d).root}/store/rfm_two_runs"
    SK.upsert_rfm(s, path, rfm.where("r_score <= 3").withColumn("segment", F.lit("earlier run")))
    return SK.upsert_rfm(s, path, rfm.where("r_score >= 3")).drop("updated_at")


def _split_summary(s, d):
    train, test = C.stratified_split(C.model_frame(wh(s, d).churn_features))
    return (train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
            .groupBy("split", "is_churned").agg(F.count(F.lit(1)).alias("customers")))


QUERIES.update({
    "rfm_input": lambda s, d: RFM.rfm_input(wh(s, d).mart_customer_metrics),
    "churn_dataset": lambda s, d: C.churn_dataset(wh(s, d).mart_customer_metrics, wh(s, d).rfm_segments),
    "churn_split_summary": _split_summary,
    "customer_page_meta": lambda s, d: PG.page_meta(
        CU.filter_customers(_view(s, d), risk_tier="Medium"), 3, 20),
    "dq_constraints": lambda s, d: DQ.dq_constraints({n: wh(s, d).raw(n) for n in EXPECTED_ROW_COUNTS}),
    "dq_row_counts": lambda s, d: DQ.dq_row_counts(QUERIES["raw_ingestion_summary"](s, d), EXPECTED_ROW_COUNTS, s),
    "feature_defaults": lambda s, d: SC.feature_defaults(_partial_profiles(s, d)),
    "rfm_upsert_two_runs": _upsert_of_two_runs,
    "rfm_segments_upserted": lambda s, d: _upserted(s, d, "rfm"),
    "churn_predictions_upserted": lambda s, d: _upserted(s, d, "churn"),
})

TIGHT_BUDGET = 10000.0  # funds only part of the pools: exercises the skip / exhaust branches of the fold

QUERIES.update({
    "budget_allocation_tight": lambda s, d: RT.budget_allocation(
        RT.pools_from_recommendations(_rec(s, d)), TIGHT_BUDGET),
    "budget_summary_tight": lambda s, d: RT.budget_summary(RT.pools_from_recommendations(_rec(s, d)), TIGHT_BUDGET),
    "funded_customers_tight": lambda s, d: RT.funded_customers(
        _rec(s, d), RT.budget_allocation(RT.pools_from_recommendations(_rec(s, d)), TIGHT_BUDGET)),
})


def _stream_ingest(s, d, table: str):
    """Raw table loaded by the Structured Streaming CSV-drop ingest (exactly once per file)."""
    from ..sources.schemas import SOURCE_FILES
    from ..streaming.ingest import ingest_drops
    w = wh(s, d)
    drops = f"{w.csv_of([table])}/{SOURCE_FILES[table]}"
    target, ckpt = f"{w.root}/stream/{table}", f"{w.root}/stream/_checkpoints/{table}"
    ingest_drops(s, table, drops, target, ckpt)
    return s.read.parquet(target)


QUERIES.update({
    "stream_ingest_orders": lambda s, d: _stream_ingest(s, d, "orders"),
    "stream_ingest_order_reviews": lambda s, d: _stream_ingest(s, d, "order_reviews"),
})


def _ingest(s, d, module: str):
    from ..sources.csv import MODULES
    from ..sources.ingest import run_ingest
    w = wh(s, d)
    return run_ingest(s, [w.csv_of(MODULES[module])], f"{w.root}/ingest/{module}", module=module, truncate=True)


QUERIES.update({
    "ingest_all": lambda s, d: _ingest(s, d, "all"),
    "ingest_marketing": lambda s, d: _ingest(s, d, "marketing"),
})


QUERIES.update({
    # one row per (customer, fired rule): the drivers of batch_score, flat
    "risk_drivers": lambda s, d: SC.batch_score(SC.feature_defaults(
        SC.whatif_baseline(_view(s, d))), _baseline_scorer())
    .select("customer_unique_id", F.inline("top_feature_contributions")),
})


def _customer_keyset_page2(s, d):
    """Page 2 of the default customer list by keyset paging: the cursor is page 1's last
    (lifetime_spend, customer_unique_id); no rows before it are re-sorted or skipped."""
    from ..operators import paging
    view = _view(s, d).select(*CU.SUMMARY_COLUMNS)
    last = CU.customer_list(_view(s, d), page=1, page_size=20).select("lifetime_spend", "customer_unique_id").tail(1)
    after = (last[0][0], last[0][1]) if last else None
    return paging.keyset_page(view, "lifetime_spend", False, "customer_unique_id", after, 20)


QUERIES["customer_list_keyset"] = _customer_keyset_page2


# ------------------------------------------------------------ evaluation, medians, tied quintiles
def _tied_quintiles(s, d):
    """Quintile scores of counts with so many ties that edges may collide, rising and falling."""
    m = wh(s, d).mart_customer_metrics.select("customer_unique_id", "late_orders_count", "negative_reviews_count")
    out = RFM.quintile_score(m, "late_orders_count", "late_score")
    out = RFM.quintile_score(out, "late_orders_count", "late_score_falling", ascending=False)
    return RFM.quintile_score(out, "negative_reviews_count", "negative_score_falling", ascending=False)


def _medians(s, d):
    """What the imputer learns from the model's numeric features, over all customers."""
    from ..functions.imputer import MedianImputer
    model = MedianImputer(inputCols=C.NUMERIC_FEATURES, outputCols=[f"{c}__imp" for c in C.NUMERIC_FEATURES]).fit(
        C.model_frame(wh(s, d).churn_features))
    return s.createDataFrame(list(zip(model.getInputCols(), model.getOrDefault(model.medians))), "feature string, median double")


def _model_invariants(s, d):
    """Violations of every rule that holds for any model's scores, and the number of scored customers."""
    w = wh(s, d)
    p, prob = w.churn_predictions.withColumnRenamed("churn_probability", "p"), F.col("p")
    p = p.join(w.churn_features.select("customer_unique_id", "m_score", F.col("is_churned").alias("label"),
                                       F.col("lifetime_spend").alias("spend")), "customer_unique_id", "full")
    vip = F.col("m_score") >= 4
    rules = {
        "customers": F.lit(True), "not_scored_or_unknown": prob.isNull() | F.col("m_score").isNull(),
        "probability_out_of_range": ~prob.between(0, 1),
        "tier": ~F.col("risk_tier").eqNullSafe(F.when(prob >= 0.7, "High").when(prob >= 0.3, "Medium").otherwise("Low")),
        "revenue_at_risk": F.abs(F.col("revenue_at_risk") - prob * F.col("monetary_value").cast("double")) > 0.006,
        "monetary_value": F.col("monetary_value") != F.round("spend", 2), "label": F.col("is_churned") != F.col("label"),
        "priority": (F.col("retention_priority").startswith("Priority 1") != (vip & (prob >= 0.7)))
        | (F.col("retention_priority").startswith("Priority 2") != (vip & (prob < 0.3)))}
    counts = p.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.expr("stack({}, {})".format(len(rules), ", ".join(f"'{n}', {n}" for n in rules))).alias("rule", "n"))


# What-if overrides of every type: numbers, a flag and the segment.
TYPED_SCENARIOS = [("win_back", {"segment": "Champions", "lifetime_orders": 2}),
                   ("lapse", {"segment": "At Risk", "has_late_delivery": True, "avg_review_score": 1.0}),
                   ("punctual", {"late_order_ratio": 0.0, "has_late_delivery": False})]


def _typed_formula():
    """A probability that rests on features of every type."""
    risky = F.col("segment").isin("At Risk", "Lost / Inactive")
    return (0.5 * F.col("recency_days").cast("double") / (F.col("recency_days").cast("double") + 365.0)
            + 0.2 * F.col("late_order_ratio").cast("double") + F.when(F.col("lifetime_orders") < 2, 0.05).otherwise(0.0)
            + F.when(F.col("has_late_delivery") > 0, 0.1).otherwise(0.0) + F.when(risky, 0.15).otherwise(0.0))


def _campaign_csv(s, d):
    """The campaign file written as CSV and read back."""
    from ..sinks.tables import write_csv
    path = f"{wh(s, d).root}/export/campaign"
    out = CU.campaign_export(_view(s, d))
    write_csv(out, path)
    back = s.read.schema(out.schema).option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if t == "string" else c for c, t in out.dtypes])


QUERIES.update({
    "churn_eval_baseline": lambda s, d: C.evaluation(_pb(s, d).withColumnRenamed("churn_probability", "p")),
    "churn_feature_medians": _medians,
    "churn_model_invariants": _model_invariants,
    "rfm_quintile_tied": _tied_quintiles,
    "bi_measures_by_state_and_month": lambda s, d: BI.bi_measures_by_state_and_month(
        wh(s, d).fact_orders, wh(s, d).dim_customers, _pb(s, d)),
    "whatif_typed": lambda s, d: SC.whatif_scenarios(
        SC.whatif_baseline(_view(s, d)), TYPED_SCENARIOS, SC.formula_scorer(_typed_formula)).drop("impact_summary"),
    "product_detail": lambda s, d: CAT.product_detail(wh(s, d).mart_product_metrics, "P1"),
    "customer_rfm": lambda s, d: CU.customer_rfm(wh(s, d).rfm_segments, "U1"),
    "customer_churn": lambda s, d: CU.customer_churn(_pb(s, d), "U1"),
    "campaign_csv": _campaign_csv,
})
