"""Staging layer: projection, cleaning and the delivered-orders filter.

Each function maps raw DataFrame(s) to one staging DataFrame. They are lazy
views: Catalyst fuses them into whatever reads them, so the delivered filter
and column pruning reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import MICROS_PER_DAY, micros_between


def _clean_lower(c: str) -> F.Column:
    return F.lower(F.trim(F.col(c)))


def stg_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_prefix"),
        _clean_lower("customer_city").alias("city"),
        F.upper(F.trim("customer_state")).alias("state"))


def stg_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders only; delay in fractional days (+ late, - early)."""
    dlv, est = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    delay = micros_between(est, dlv)
    return (orders.where(F.col("order_status") == "delivered")
            .select("order_id", "customer_id", "order_status",
                    F.col("order_purchase_timestamp").alias("purchased_at"),
                    F.col("order_approved_at").alias("approved_at"),
                    F.col("order_delivered_carrier_date").alias("shipped_at"),
                    dlv.alias("delivered_at"),
                    est.alias("estimated_delivery_at"),
                    (F.col("order_status") == "delivered").alias("is_delivered"),
                    (delay.cast("double") / MICROS_PER_DAY).alias("delivery_delay_days"),
                    delay.alias("delivery_delay_micros")))


def stg_order_items(order_items: DataFrame, delivered_orders: DataFrame) -> DataFrame:
    """Items of delivered orders (semi join: order_id is unique in orders)."""
    return (order_items.join(delivered_orders.select("order_id"), "order_id", "left_semi")
            .select("order_id", "order_item_id", "product_id", "seller_id",
                    F.col("shipping_limit_date").alias("shipping_limit_at"),
                    "price", "freight_value",
                    (F.col("price") + F.col("freight_value")).alias("item_revenue")))


def stg_order_payments(order_payments: DataFrame) -> DataFrame:
    """One row per order.

    Primary payment type = type of the highest non-null payment value; ties
    broken by the lowest payment_sequential (the source query leaves ties
    open). Value and sequence are one number that orders like the pair, so the
    payments of an order and type are reduced by a hash aggregate, and the few
    types of an order by another. Payments are dealt by order once, which
    serves both.
    """
    key = F.col("payment_value").cast("decimal(25,2)") * 100 * (1 << 32) - F.col("payment_sequential")
    by_type = (order_payments.repartition("order_id").groupBy("order_id", "payment_type")
               .agg(F.max(key.cast("decimal(38,0)")).alias("key"), F.sum("payment_value").alias("value"),
                    F.sum("payment_installments").alias("installments")))
    best = F.array_max(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "payment_type"))))
    return (by_type.groupBy("order_id")
            .agg(best["payment_type"].alias("primary_payment_type"),
                 F.sum("value").cast("decimal(22,2)").alias("total_payment_value"),
                 F.sum("installments").alias("total_installments"),
                 F.count("payment_type").alias("payment_method_count"))
            .withColumn("has_multiple_payment_methods", F.col("payment_method_count") > 1)
            .select("order_id", "primary_payment_type", "total_payment_value", "total_installments",
                    "payment_method_count", "has_multiple_payment_methods"))


def stg_order_reviews(order_reviews: DataFrame) -> DataFrame:
    s = F.col("review_score")
    return (order_reviews.where(s.isNotNull())
            .select("review_id", "order_id", "review_score",
                    (s <= 2).alias("is_negative_review"), (s >= 4).alias("is_positive_review"),
                    "review_comment_title", "review_comment_message",
                    F.col("review_creation_date").alias("review_created_at"),
                    F.col("review_answer_timestamp").alias("review_answered_at")))


def stg_products(products: DataFrame, translations: DataFrame) -> DataFrame:
    """English category via the translation dimension.

    The dimension is one row per category (71 in the full load, bounded by the
    category vocabulary, not by data volume); AQE broadcasts it when small.
    """
    t = translations.select("product_category_name", "product_category_name_english")
    return (products.join(t, "product_category_name", "left")
            .select("product_id",
                    F.col("product_category_name").alias("category_name_pt"),
                    F.coalesce("product_category_name_english", "product_category_name").alias("category_name_en"),
                    F.col("product_name_lenght").alias("product_name_length"),
                    F.col("product_description_lenght").alias("product_description_length"),
                    "product_photos_qty", "product_weight_g", "product_length_cm",
                    "product_height_cm", "product_width_cm"))


def stg_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", F.col("seller_zip_code_prefix").alias("zip_prefix"),
                          _clean_lower("seller_city").alias("city"),
                          F.upper(F.trim("seller_state")).alias("state"))


def stg_marketing_leads(mql: DataFrame) -> DataFrame:
    return mql.select("mql_id", "first_contact_date", "landing_page_id",
                      F.coalesce(F.nullif(_clean_lower("origin"), F.lit("")), F.lit("unknown")).alias("origin"))


def stg_closed_deals(deals: DataFrame) -> DataFrame:
    return deals.select(
        "mql_id", "seller_id", "sdr_id", "sr_id", "won_date",
        _clean_lower("business_segment").alias("business_segment"),
        _clean_lower("lead_type").alias("lead_type"),
        _clean_lower("lead_behaviour_profile").alias("lead_behaviour_profile"),
        F.coalesce("has_company", F.lit(False)).alias("has_company"),
        F.coalesce("has_gtin", F.lit(False)).alias("has_gtin"),
        "average_stock",
        _clean_lower("business_type").alias("business_type"),
        F.coalesce("declared_product_catalog_size", F.lit(0)).cast("decimal(12,2)").alias("declared_product_catalog_size"),
        F.coalesce("declared_monthly_revenue", F.lit(0)).cast("decimal(14,2)").alias("declared_monthly_revenue"))
