"""Customer queries: filtered list, 360 profile, at-risk queue, CRM campaign export."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import rules
from ..functions.core import fmt_fixed
from . import paging

SORT_COLUMNS = {
    "lifetime_spend": "lifetime_spend", "recency_days": "recency_days",
    "lifetime_orders": "lifetime_orders", "avg_order_value": "avg_order_value",
    "first_purchased_at": "first_purchased_at", "latest_purchased_at": "latest_purchased_at",
    "revenue_at_risk": "revenue_at_risk", "churn_probability": "churn_probability",
}
SUMMARY_COLUMNS = ["customer_unique_id", "city", "state", "zip_prefix", "first_purchased_at",
                   "latest_purchased_at", "recency_days", "customer_lifespan_days", "lifetime_orders",
                   "is_repeat_buyer", "lifetime_spend", "avg_order_value", "segment", "churn_probability",
                   "risk_tier", "revenue_at_risk", "retention_priority"]


def customer_view(mart: DataFrame, rfm: DataFrame, pred: DataFrame) -> DataFrame:
    """mart ⟕ RFM ⟕ predictions, one row per customer (all joins on the unique key)."""
    return (mart.join(rfm.select("customer_unique_id", "segment", "r_score", "f_score", "m_score",
                                 "rfm_score", "rfm_label"), "customer_unique_id", "left")
            .join(pred.select("customer_unique_id", "churn_probability", "risk_tier", "revenue_at_risk",
                              "retention_priority", "monetary_value", "is_churned"), "customer_unique_id", "left"))


def _spend_bound(view: DataFrame, value: float, rounding: str) -> F.Column:
    """The bound in the column's own type, so that the comparison reaches the scan."""
    kind = view.schema["lifetime_spend"].dataType
    if not isinstance(kind, DecimalType):
        return F.lit(value)
    return F.lit(Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale), rounding=rounding)).cast(kind)


def filter_customers(view: DataFrame, segment: str | None = None, risk_tier: str | None = None,
                     retention_priority: str | None = None, state: str | None = None,
                     min_spend: float | None = None, max_spend: float | None = None,
                     search: str | None = None) -> DataFrame:
    return paging.where_all(view, [
        paging.eq("segment", segment), paging.eq("risk_tier", risk_tier),
        paging.eq("retention_priority", retention_priority),
        paging.eq("state", state.strip().upper() if state else None),
        None if min_spend is None else F.col("lifetime_spend") >= _spend_bound(view, min_spend, ROUND_CEILING),
        None if max_spend is None else F.col("lifetime_spend") <= _spend_bound(view, max_spend, ROUND_FLOOR),
        paging.ilike_any(["customer_unique_id", "city", "state"], search),
    ])


def customer_list(view: DataFrame, page: int = 1, page_size: int = 20, sort_by: str = "lifetime_spend",
                  sort_order: str = "desc", **filters) -> DataFrame:
    sort_col = SORT_COLUMNS.get(sort_by, "lifetime_spend")
    rows = filter_customers(view, **filters).select(*SUMMARY_COLUMNS)
    return paging.page(rows, sort_col, sort_order.lower() == "asc", "customer_unique_id", page, page_size)


def at_risk_queue(view: DataFrame, page: int = 1, page_size: int = 20, risk_tier: str | None = None,
                  retention_priority: str | None = None) -> DataFrame:
    """Customers by revenue at risk, highest first (no default tier filter)."""
    return customer_list(view, page, page_size, "revenue_at_risk", "desc", risk_tier=risk_tier,
                         retention_priority=retention_priority)


def customer_360(view: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Nested profile per customer; ``rfm`` / ``churn`` are NULL when the customer has none."""
    df = view if customer_id is None else view.where(F.col("customer_unique_id") == customer_id)
    rfm = F.when(F.col("segment").isNotNull(), F.struct("r_score", "f_score", "m_score", "rfm_score",
                                                         "rfm_label", "segment"))
    churn = F.when(F.col("churn_probability").isNotNull(), F.struct(
        "churn_probability", "risk_tier", "revenue_at_risk", "retention_priority"))
    return df.select(
        "customer_unique_id", "city", "state", "zip_prefix", "first_purchased_at", "latest_purchased_at",
        "recency_days", "customer_lifespan_days", "lifetime_orders", "is_repeat_buyer",
        F.struct("lifetime_spend", "lifetime_product_spend", "lifetime_freight_spend", "avg_order_value",
                 "lifetime_items", "avg_items_per_order", "total_unique_products_purchased",
                 "total_unique_sellers_contacted").alias("basket"),
        F.struct("avg_delivery_delay_days", "max_delivery_delay_days", "late_orders_count",
                 "on_time_orders_count", "late_order_ratio", "has_late_delivery").alias("fulfillment"),
        F.struct("total_reviews_submitted", "avg_review_score", "negative_reviews_count",
                 "positive_reviews_count", "has_negative_review", "negative_review_ratio").alias("reviews"),
        rfm.alias("rfm"), churn.alias("churn"))


def customer_rfm(rfm: DataFrame, customer_id: str) -> DataFrame:
    return rfm.where(F.col("customer_unique_id") == customer_id)


def customer_churn(pred: DataFrame, customer_id: str) -> DataFrame:
    return pred.where(F.col("customer_unique_id") == customer_id)


def campaign_export(view: DataFrame, strict_labels: bool = False, **filters) -> DataFrame:
    """CRM campaign rows, formatted as text, by revenue at risk (NULLs last)."""
    f = filter_customers(view, **filters)
    fmt = lambda c, d: fmt_fixed(F.col(c).cast("double"), d)
    return (f.orderBy(F.col("revenue_at_risk").desc_nulls_last(), F.col("customer_unique_id"))
            .select("customer_unique_id",
                    F.coalesce("state", F.lit("")).alias("state"),
                    F.coalesce("city", F.lit("")).alias("city"),
                    F.coalesce(fmt("lifetime_spend", 2), F.lit("0.00")).alias("lifetime_spend"),
                    F.coalesce(F.col("lifetime_orders"), F.lit(0)).cast("long").alias("lifetime_orders"),
                    F.coalesce(fmt("recency_days", 1), F.lit("")).alias("recency_days"),
                    F.coalesce("segment", F.lit("")).alias("segment"),
                    F.coalesce(fmt("churn_probability", 4), F.lit("")).alias("churn_probability"),
                    F.coalesce("risk_tier", F.lit("")).alias("risk_tier"),
                    F.coalesce(fmt("revenue_at_risk", 2), F.lit("0.00")).alias("revenue_at_risk"),
                    F.coalesce("retention_priority", F.lit("")).alias("retention_priority"),
                    rules.recommended_action(F.col("retention_priority"), F.col("risk_tier"), strict_labels)
                    .alias("recommended_action")))
