"""Intermediate layer: per-order and per-customer aggregates.

Order-grain aggregates are built *before* joining to customers so that the
joins stay one-to-one (no fan-out). Per-customer rollups group by
``customer_unique_id`` — partial (map-side) aggregation keeps a hot customer
from landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import MICROS_PER_DAY, avg_days, micros_between, ratio, rnd


def int_order_items_aggregated(items: DataFrame) -> DataFrame:
    """Totals per order. The products and sellers of an order are gathered as sets, map-side
    first (they hold an order's distinct values, not its rows), so no row is expanded once per
    distinct count and there is one exchange."""
    return (items.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("item_count"),
                 F.sum("price").cast("decimal(14,2)").alias("product_revenue"),
                 F.sum("freight_value").cast("decimal(14,2)").alias("freight_revenue"),
                 F.sum("item_revenue").cast("decimal(14,2)").alias("total_order_item_revenue"),
                 F.size(F.collect_set("product_id")).cast("long").alias("unique_products_count"),
                 F.size(F.collect_set("seller_id")).cast("long").alias("unique_sellers_count")))


def int_order_reviews_aggregated(reviews: DataFrame) -> DataFrame:
    return (reviews.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("reviews_count"),
                 rnd(F.avg("review_score"), 2).cast("decimal(3,2)").alias("avg_review_score"),
                 F.min("review_score").alias("min_review_score"),
                 F.max("review_score").alias("max_review_score"),
                 F.bool_or("is_negative_review").alias("has_negative_review"),
                 F.bool_or("is_positive_review").alias("has_positive_review"),
                 F.max("review_created_at").alias("latest_review_created_at")))


def _customer_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")


def int_customer_locations(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Address on the customer's most recent delivered order.

    ``row_number() = 1`` per customer, newest purchase first (NULLs last),
    ties by ``customer_id`` ascending. Spark plans this as a WindowGroupLimit,
    which keeps only the top row per customer on the map side before the
    shuffle, so even a very hot customer ships one row per map task.
    """
    w = Window.partitionBy("customer_unique_id").orderBy(
        F.col("purchased_at").desc_nulls_last(), F.col("customer_id").asc())
    base = (orders.select("customer_id", "purchased_at")
            .join(customers.select("customer_id", "customer_unique_id", "city", "state", "zip_prefix"),
                  "customer_id"))
    return (base.withColumn("location_rank", F.row_number().over(w))
            .where(F.col("location_rank") == 1)
            .select("customer_unique_id", F.col("city").alias("primary_city"),
                    F.col("state").alias("primary_state"), F.col("zip_prefix").alias("primary_zip_prefix")))


def int_customer_orders(orders: DataFrame, customers: DataFrame, items_agg: DataFrame) -> DataFrame:
    """Lifetime rollup per customer.

    The base is one row per delivered order, so ``count(*)`` equals the
    distinct order count; "unique products/sellers" are sums of per-order
    distinct counts, as in the source model.
    """
    base = (orders.select("order_id", "customer_id", "purchased_at")
            .join(items_agg, "order_id", "left")
            .join(customers.select("customer_id", "customer_unique_id"), "customer_id"))
    z = F.lit(0)
    return (base.groupBy("customer_unique_id")
            .agg(F.min("purchased_at").alias("first_purchased_at"),
                 F.max("purchased_at").alias("latest_purchased_at"),
                 F.count(F.lit(1)).alias("lifetime_orders"),
                 F.sum(F.coalesce("item_count", z)).cast("int").alias("lifetime_items"),
                 F.sum(F.coalesce("product_revenue", z)).cast("decimal(14,2)").alias("lifetime_product_spend"),
                 F.sum(F.coalesce("freight_revenue", z)).cast("decimal(14,2)").alias("lifetime_freight_spend"),
                 F.sum(F.coalesce("total_order_item_revenue", z)).cast("decimal(14,2)").alias("lifetime_spend"),
                 F.sum(F.coalesce("unique_products_count", z)).cast("int").alias("total_unique_products_purchased"),
                 F.sum(F.coalesce("unique_sellers_count", z)).cast("int").alias("total_unique_sellers_contacted"))
            .withColumn("avg_order_value",
                        rnd(ratio(F.col("lifetime_spend"), F.col("lifetime_orders")), 2).cast("decimal(12,2)"))
            .select("customer_unique_id", "first_purchased_at", "latest_purchased_at", "lifetime_orders",
                    "lifetime_items", "lifetime_product_spend", "lifetime_freight_spend", "lifetime_spend",
                    "avg_order_value", "total_unique_products_purchased", "total_unique_sellers_contacted"))


def int_customer_fulfillment(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivery experience per customer.

    Averages are taken over delay microseconds (exact integer sums) and
    converted to days once, so every engine gets the same double.
    A NULL delay counts as neither late nor on time but stays in the ratio's
    denominator.
    """
    base = _customer_orders(orders.select("order_id", "customer_id", "delivery_delay_micros"), customers)
    d = F.col("delivery_delay_micros")
    late = F.when(d > 0, 1).otherwise(0)
    on_time = F.when(d <= 0, 1).otherwise(0)
    return (base.groupBy("customer_unique_id")
            .agg(rnd(avg_days(d), 2).alias("avg_delivery_delay_days"),
                 rnd(F.max(d) / MICROS_PER_DAY, 2).alias("max_delivery_delay_days"),
                 F.sum(late).cast("int").alias("late_orders_count"),
                 F.sum(on_time).cast("int").alias("on_time_orders_count"),
                 rnd(ratio(F.sum(late), F.count(F.lit(1))), 4).cast("decimal(6,4)").alias("late_order_ratio"),
                 (F.sum(late) > 0).alias("has_late_delivery")))


def int_customer_reviews(orders: DataFrame, customers: DataFrame, reviews_agg: DataFrame) -> DataFrame:
    """Review behaviour per customer over reviewed orders (unweighted mean of order means)."""
    base = (orders.select("order_id", "customer_id")
            .join(reviews_agg, "order_id")
            .join(customers.select("customer_id", "customer_unique_id"), "customer_id"))
    neg = F.col("has_negative_review")
    return (base.groupBy("customer_unique_id")
            .agg(F.sum("reviews_count").cast("int").alias("total_reviews_submitted"),
                 rnd(F.avg("avg_review_score"), 2).cast("decimal(3,2)").alias("avg_review_score"),
                 F.count_if(neg).alias("negative_reviews_count"),
                 F.count_if(F.col("has_positive_review")).alias("positive_reviews_count"),
                 F.bool_or(neg).alias("has_negative_review"),
                 rnd(ratio(F.count_if(neg), F.count(F.lit(1))), 4).cast("decimal(6,4)").alias("negative_review_ratio")))


# ------------------------------------------------------------------ single-pass rollup over the fact table
def customer_rollup(fact_orders: DataFrame) -> DataFrame:
    """Every per-customer measure of the orders, fulfillment and reviews models in ONE aggregation.

    ``fact_orders`` already holds one row per delivered order with its
    customer, item totals (0 when none), delay and review summary (NULL /
    0 / false when unreviewed), so the three customer models are column
    subsets of this rollup: one scan of the written fact table and one
    shuffle by customer instead of three order-level joins and shuffles.
    An order counts as *reviewed* when ``reviews_count > 0`` (exactly the
    orders present in the order-review aggregate).
    """
    d = micros_between(F.col("estimated_delivery_at"), F.col("delivered_at"))
    late = F.when(d > 0, 1).otherwise(0)
    on_time = F.when(d <= 0, 1).otherwise(0)
    reviewed = F.col("reviews_count") > 0
    neg = F.col("has_negative_review") & reviewed
    z = F.lit(0)
    n_reviewed = F.count_if(reviewed)
    return (fact_orders.groupBy("customer_unique_id")
            .agg(F.min("purchased_at").alias("first_purchased_at"),
                 F.max("purchased_at").alias("latest_purchased_at"),
                 F.count(F.lit(1)).alias("lifetime_orders"),
                 F.sum(F.coalesce("item_count", z)).cast("int").alias("lifetime_items"),
                 F.sum("product_revenue").cast("decimal(14,2)").alias("lifetime_product_spend"),
                 F.sum("freight_revenue").cast("decimal(14,2)").alias("lifetime_freight_spend"),
                 F.sum("total_revenue").cast("decimal(14,2)").alias("lifetime_spend"),
                 F.sum("unique_products_count").cast("int").alias("total_unique_products_purchased"),
                 F.sum("unique_sellers_count").cast("int").alias("total_unique_sellers_contacted"),
                 rnd(avg_days(d), 2).alias("avg_delivery_delay_days"),
                 rnd(F.max(d) / MICROS_PER_DAY, 2).alias("max_delivery_delay_days"),
                 F.sum(late).cast("int").alias("late_orders_count"),
                 F.sum(on_time).cast("int").alias("on_time_orders_count"),
                 rnd(ratio(F.sum(late), F.count(F.lit(1))), 4).cast("decimal(6,4)").alias("late_order_ratio"),
                 (F.sum(late) > 0).alias("has_late_delivery"),
                 n_reviewed.alias("_reviewed_orders"),
                 F.sum(F.when(reviewed, F.col("reviews_count"))).cast("int").alias("total_reviews_submitted"),
                 rnd(F.avg(F.when(reviewed, F.col("avg_review_score"))), 2).cast("decimal(3,2)").alias("avg_review_score"),
                 F.count_if(neg).alias("negative_reviews_count"),
                 F.count_if(F.col("has_positive_review") & reviewed).alias("positive_reviews_count"),
                 F.bool_or(F.when(reviewed, F.col("has_negative_review"))).alias("has_negative_review"),
                 rnd(ratio(F.count_if(neg), n_reviewed), 4).cast("decimal(6,4)").alias("negative_review_ratio"))
            .withColumn("avg_order_value",
                        rnd(ratio(F.col("lifetime_spend"), F.col("lifetime_orders")), 2).cast("decimal(12,2)")))


ORDER_COLS = ["customer_unique_id", "first_purchased_at", "latest_purchased_at", "lifetime_orders", "lifetime_items",
              "lifetime_product_spend", "lifetime_freight_spend", "lifetime_spend", "avg_order_value",
              "total_unique_products_purchased", "total_unique_sellers_contacted"]
FULFILLMENT_COLS = ["customer_unique_id", "avg_delivery_delay_days", "max_delivery_delay_days", "late_orders_count",
                    "on_time_orders_count", "late_order_ratio", "has_late_delivery"]
REVIEW_COLS = ["customer_unique_id", "total_reviews_submitted", "avg_review_score", "negative_reviews_count",
               "positive_reviews_count", "has_negative_review", "negative_review_ratio"]


def customer_locations_from_fact(fact_orders: DataFrame, customers: DataFrame) -> DataFrame:
    """``int_customer_locations`` over the fact table (same ranking: newest purchase, then customer_id)."""
    return int_customer_locations(fact_orders.select("customer_id", "purchased_at"), customers)
