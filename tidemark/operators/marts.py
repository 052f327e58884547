"""Mart layer: fact/dimension tables and customer, product, seller, funnel marts.

Join order is chosen so that little is dealt twice: the narrow orders meet their
customer first and are then dealt by ``order_id``; all order-grain inputs are already
hash partitioned on it by their aggregations, so the left joins need no extra exchange
and the wide result stays where it is, by ``order_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import MICROS_PER_DAY, ratio, rnd, whole_days


def fact_orders(orders: DataFrame, customers: DataFrame, items_agg: DataFrame,
                payments: DataFrame, reviews_agg: DataFrame) -> DataFrame:
    z, f = F.lit(0), F.lit(False)
    joined = (orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
              .join(items_agg, "order_id", "left")
              .join(payments, "order_id", "left")
              .join(reviews_agg, "order_id", "left"))
    return joined.select(
        "order_id", "customer_id", "customer_unique_id", "order_status", "purchased_at",
        "approved_at", "shipped_at", "delivered_at", "estimated_delivery_at", "delivery_delay_days",
        (F.col("delivery_delay_days") > 0).alias("is_late_delivery"),
        F.coalesce("item_count", z).alias("item_count"),
        F.coalesce("unique_products_count", z).alias("unique_products_count"),
        F.coalesce("unique_sellers_count", z).alias("unique_sellers_count"),
        F.coalesce("product_revenue", z).cast("decimal(14,2)").alias("product_revenue"),
        F.coalesce("freight_revenue", z).cast("decimal(14,2)").alias("freight_revenue"),
        F.coalesce("total_order_item_revenue", z).cast("decimal(14,2)").alias("total_revenue"),
        "total_payment_value", "primary_payment_type", "total_installments",
        F.coalesce("has_multiple_payment_methods", f).alias("has_multiple_payment_methods"),
        F.coalesce("reviews_count", z).alias("reviews_count"),
        "avg_review_score",
        F.coalesce("has_negative_review", f).alias("has_negative_review"),
        F.coalesce("has_positive_review", f).alias("has_positive_review"))


#: Partition column of the fact table: the purchase month as the number yyyymm, 0 without a purchase time.
MONTH = "purchase_month"


def by_month(fact: DataFrame) -> DataFrame:
    """Fact rows dealt by purchase month, as many tasks to a month as its size asks for, sorted by purchase time
    inside each (row-group statistics then prune within the month)."""
    month = F.year("purchased_at") * 100 + F.month("purchased_at")
    return fact.withColumn(MONTH, F.coalesce(month, F.lit(0))).hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, "purchased_at")


def in_months(fact: DataFrame, start_date: str | None, end_date: str | None) -> DataFrame:
    """Rows of the months that a window of purchase dates (yyyy-mm-dd) touches; the window itself is the caller's filter."""
    number = lambda date: int(date[:4]) * 100 + int(date[5:7])
    if start_date and MONTH in fact.columns:
        fact = fact.where(F.col(MONTH) >= number(start_date))
    if end_date and MONTH in fact.columns:
        fact = fact.where(F.col(MONTH) <= number(end_date))
    return fact


def dim_customers(customer_orders: DataFrame, locations: DataFrame) -> DataFrame:
    return (customer_orders.join(locations, "customer_unique_id")
            .select("customer_unique_id", F.col("primary_city").alias("city"),
                    F.col("primary_state").alias("state"), F.col("primary_zip_prefix").alias("zip_prefix"),
                    "first_purchased_at", "latest_purchased_at", "lifetime_orders",
                    (F.col("lifetime_orders") > 1).alias("is_repeat_buyer"),
                    whole_days(F.col("first_purchased_at"), F.col("latest_purchased_at")).alias("customer_tenure_days")))


def mart_customer_metrics(customer_orders: DataFrame, locations: DataFrame, fulfillment: DataFrame,
                          reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """30-column customer mart.

    Recency is measured against the newest purchase in the delivered data:
    a global maximum read once like a scalar subquery and used as a literal.
    """
    newest = orders.agg(F.max("purchased_at").cast("string").alias("m")).first()["m"]
    z = F.lit(0)
    j = (customer_orders.withColumn("max_dataset_timestamp", F.lit(newest).cast("timestamp_ntz"))
         .join(locations, "customer_unique_id"))
    if fulfillment is not None:  # separate models; None when customer_orders already carries them
        j = j.join(fulfillment, "customer_unique_id", "left")
    if reviews is not None:
        j = j.join(reviews, "customer_unique_id", "left")
    return j.select(
        "customer_unique_id", F.col("primary_city").alias("city"), F.col("primary_state").alias("state"),
        F.col("primary_zip_prefix").alias("zip_prefix"), "first_purchased_at", "latest_purchased_at",
        whole_days(F.col("latest_purchased_at"), F.col("max_dataset_timestamp")).alias("recency_days"),
        whole_days(F.col("first_purchased_at"), F.col("latest_purchased_at")).alias("customer_lifespan_days"),
        "lifetime_orders", (F.col("lifetime_orders") > 1).alias("is_repeat_buyer"),
        "lifetime_spend", "lifetime_product_spend", "lifetime_freight_spend", "avg_order_value",
        "lifetime_items",
        rnd(ratio(F.col("lifetime_items"), F.col("lifetime_orders")), 2).cast("decimal(6,2)").alias("avg_items_per_order"),
        "total_unique_products_purchased", "total_unique_sellers_contacted",
        F.coalesce("avg_delivery_delay_days", z).cast("decimal(12,2)").alias("avg_delivery_delay_days"),
        F.coalesce("max_delivery_delay_days", z).cast("decimal(12,2)").alias("max_delivery_delay_days"),
        F.coalesce("late_orders_count", z).alias("late_orders_count"),
        F.coalesce("on_time_orders_count", F.col("lifetime_orders").cast("int")).alias("on_time_orders_count"),
        F.coalesce("late_order_ratio", z).cast("decimal(6,4)").alias("late_order_ratio"),
        F.coalesce("has_late_delivery", F.lit(False)).alias("has_late_delivery"),
        F.coalesce("total_reviews_submitted", z).alias("total_reviews_submitted"),
        "avg_review_score",
        F.coalesce("negative_reviews_count", z).alias("negative_reviews_count"),
        F.coalesce("positive_reviews_count", z).alias("positive_reviews_count"),
        F.coalesce("has_negative_review", F.lit(False)).alias("has_negative_review"),
        F.coalesce("negative_review_ratio", z).cast("decimal(6,4)").alias("negative_review_ratio"))


def mart_customer_metrics_from_rollup(rollup: DataFrame, locations: DataFrame, orders: DataFrame) -> DataFrame:
    """The customer mart from the single-pass rollup: one join (rollup and locations are both
    partitioned by customer, so it needs no further shuffle) plus the one-row recency benchmark."""
    r = rollup.withColumn("total_reviews_submitted",
                          F.when(F.col("_reviewed_orders") > 0, F.col("total_reviews_submitted")))
    for c in ["avg_review_score", "negative_reviews_count", "positive_reviews_count", "has_negative_review",
              "negative_review_ratio"]:
        r = r.withColumn(c, F.when(F.col("_reviewed_orders") > 0, F.col(c)))
    return mart_customer_metrics(r.select(*[c for c in rollup.columns if c != "_reviewed_orders"]),
                                 locations, None, None, orders)


def mart_product_metrics(products: DataFrame, items: DataFrame, reviews_agg: DataFrame) -> DataFrame:
    """Per-product sales; averages are item-weighted. Unsold products kept with zeros."""
    sales = (items.select("order_id", "order_item_id", "product_id", "price", "item_revenue")
             .join(reviews_agg.select("order_id", "avg_review_score"), "order_id", "left")
             .groupBy("product_id")
             .agg(F.count("order_item_id").alias("total_units_sold"),
                  F.count_distinct("order_id").alias("total_orders_count"),
                  rnd(F.coalesce(F.sum("item_revenue"), F.lit(0)), 2).alias("total_revenue"),
                  rnd(F.coalesce(F.avg("price"), F.lit(0)), 2).alias("avg_unit_price"),
                  rnd(F.coalesce(F.avg("avg_review_score"), F.lit(0)), 2).alias("s_avg_review_score")))
    z = F.lit(0)
    return (products.join(sales, "product_id", "left")
            .select("product_id", "category_name_pt", "category_name_en",
                    F.coalesce("total_units_sold", z).cast("long").alias("total_units_sold"),
                    F.coalesce("total_orders_count", z).cast("long").alias("total_orders_count"),
                    F.coalesce("total_revenue", z).cast("decimal(14,2)").alias("total_revenue"),
                    F.coalesce("avg_unit_price", z).cast("decimal(10,2)").alias("avg_unit_price"),
                    F.col("s_avg_review_score").cast("decimal(10,2)").alias("avg_review_score"),
                    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
                    "product_photos_qty"))


def mart_seller_metrics(sellers: DataFrame, items: DataFrame, orders: DataFrame,
                        reviews_agg: DataFrame) -> DataFrame:
    """Per-seller scorecard; every average runs over item rows (item-weighted).

    Missing delay or review counts as "not late" / "not positive". ``items`` are the raw items: joining the
    delivered orders also selects them. Items, orders and reviews meet on order_id, where a seller's items of
    an order become one row, with its products as a set (no further exchange). A row for its numbers and one for
    each product are then reduced by (seller, product), map-side first, and only that by seller: both
    distinct counts are row counts, and a seller with a third of all items is spread over its products.
    """
    m, r, n = F.col("delivery_delay_micros"), F.col("avg_review_score"), F.col("n")
    by_order = (items.select("order_id", "order_item_id", "seller_id", "product_id",
                             (F.col("price") + F.col("freight_value")).alias("item_revenue"))
                .join(orders.select("order_id", "delivery_delay_micros"), "order_id")
                .groupBy("order_id", "seller_id")
                .agg(F.count("order_item_id").alias("n"), F.sum("item_revenue").alias("revenue"),
                     F.count("item_revenue").alias("n_revenue"), F.count(F.lit(1)).alias("n_rows"),
                     F.max("delivery_delay_micros").alias("delivery_delay_micros"),
                     F.collect_set("product_id").alias("products"))
                .join(reviews_agg.select("order_id", "avg_review_score"), "order_id", "left"))
    rows = F.col("n_rows")
    parts = {"orders": F.lit(1).cast("long"), "items": n, "rows": rows, "revenue": F.col("revenue"), "n_revenue": F.col("n_revenue"),
             "delay": m.cast("decimal(18,0)") * rows, "n_delay": F.when(m.isNotNull(), rows),
             "late": F.when(m > 0, rows), "review": r * rows, "n_review": F.when(r.isNotNull(), rows),
             "positive": F.when(r >= 4.0, rows)}
    numbers = F.struct(F.lit(None).cast("string").alias("product_id"), *[c.alias(k) for k, c in parts.items()])
    types = {f.name: f.dataType for f in by_order.select(*[c.alias(k) for k, c in parts.items()]).schema}
    products = F.transform("products", lambda p: F.struct(p.alias("product_id"), *[F.lit(None).cast(types[k]).alias(k) for k in parts]))
    agg = (by_order.select("seller_id", F.inline(F.concat(F.array(numbers), products)))
           .groupBy("seller_id", "product_id").agg(*[F.sum(k).alias(k) for k in parts])
           .groupBy("seller_id").agg(*[F.sum(k).alias(k) for k in parts], F.count("product_id").alias("products")))
    z = F.lit(0)
    some = lambda k: F.coalesce(F.col(k), z)
    mean = lambda k, by, scale: F.coalesce((F.col(k) / F.nullif(F.col(by), z)).cast(f"decimal(38,{scale})"), z)
    agg = agg.select(
        "seller_id", F.col("orders").alias("total_orders_fulfilled"), F.col("items").alias("total_items_sold"),
        F.col("products").alias("total_unique_products"), rnd(some("revenue"), 2).alias("total_revenue"),
        rnd(mean("revenue", "n_revenue", 6), 2).alias("avg_item_value"),
        rnd(F.coalesce(ratio(F.col("delay"), F.col("n_delay")) / MICROS_PER_DAY, F.lit(0.0)), 1).alias("avg_delivery_delay_days"),
        rnd(ratio(some("late"), F.col("rows")) * 100.0, 2).alias("late_delivery_rate"),
        rnd(mean("review", "n_review", 6), 2).alias("s_avg_review_score"),
        rnd(ratio(some("positive"), F.col("rows")) * 100.0, 2).alias("positive_reviews_rate"))
    return (sellers.join(agg, "seller_id", "left")
            .select("seller_id", "city", "state", "zip_prefix",
                    some("total_orders_fulfilled").cast("long").alias("total_orders_fulfilled"),
                    some("total_items_sold").cast("long").alias("total_items_sold"),
                    some("total_unique_products").cast("long").alias("total_unique_products"),
                    some("total_revenue").cast("decimal(14,2)").alias("total_revenue"),
                    some("avg_item_value").cast("decimal(10,2)").alias("avg_item_value"),
                    F.col("avg_delivery_delay_days").cast("decimal(10,1)").alias("avg_delivery_delay_days"),
                    some("late_delivery_rate").cast("decimal(5,2)").alias("late_delivery_rate"),
                    F.col("s_avg_review_score").cast("decimal(10,2)").alias("avg_review_score"),
                    some("positive_reviews_rate").cast("decimal(5,2)").alias("positive_reviews_rate")))


def mart_marketing_funnel(leads: DataFrame, deals: DataFrame, seller_metrics: DataFrame) -> DataFrame:
    sp = seller_metrics.select(F.col("seller_id").alias("sp_seller_id"), "total_orders_fulfilled",
                               F.col("total_revenue").alias("sp_total_revenue"))
    # sellers go to the few deals first: most leads have no deal, and so no seller to join on
    d = (deals.withColumnRenamed("mql_id", "d_mql_id")
         .join(sp, F.col("seller_id") == F.col("sp_seller_id"), "left"))
    j = leads.join(d, F.col("mql_id") == F.col("d_mql_id"), "left")
    return j.select(
        "mql_id", "first_contact_date", "landing_page_id", "origin",
        F.col("d_mql_id").isNotNull().alias("is_won"), "won_date",
        F.date_diff("won_date", "first_contact_date").cast("int").alias("days_to_close"),
        "seller_id", "sdr_id", "sr_id", "business_segment", "lead_type", "lead_behaviour_profile",
        "business_type", "has_company", "has_gtin",
        F.coalesce("declared_monthly_revenue", F.lit(0)).cast("decimal(14,2)").alias("declared_monthly_revenue"),
        F.coalesce("declared_product_catalog_size", F.lit(0)).cast("decimal(12,2)").alias("declared_product_catalog_size"),
        (F.col("sp_seller_id").isNotNull() & F.coalesce(F.col("total_orders_fulfilled") > 0, F.lit(False)))
        .alias("is_active_marketplace_seller"),
        F.coalesce("total_orders_fulfilled", F.lit(0)).cast("long").alias("actual_orders_fulfilled"),
        F.coalesce("sp_total_revenue", F.lit(0)).cast("decimal(14,2)").alias("actual_marketplace_revenue"))
