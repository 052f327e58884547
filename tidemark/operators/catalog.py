"""Product, category and seller queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import rnd_double
from . import paging

PRODUCT_SORT = {c: c for c in ["total_revenue", "total_units_sold", "total_orders_count",
                                "avg_unit_price", "avg_review_score"]}
SELLER_SORT = {c: c for c in ["total_revenue", "total_orders_fulfilled", "total_items_sold",
                               "avg_review_score", "late_delivery_rate", "avg_item_value"]}


def product_list(products: DataFrame, page: int = 1, page_size: int = 20, category: str | None = None,
                 sort_by: str = "total_revenue", sort_order: str = "desc", search: str | None = None) -> DataFrame:
    f = paging.where_all(products, [
        paging.ilike_any(["category_name_en", "category_name_pt"], category),
        paging.ilike_any(["product_id", "category_name_en", "category_name_pt"], search)])
    return paging.page(f, PRODUCT_SORT.get(sort_by, "total_revenue"), sort_order.lower() == "asc",
                       "product_id", page, page_size)


def category_summary(products: DataFrame) -> DataFrame:
    """Per (category, pt name): products, units, revenue, mean of product avg price, mean review."""
    return (products.groupBy(F.coalesce("category_name_en", "category_name_pt", F.lit("uncategorized")).alias("category"),
                             "category_name_pt")
            # product_id is the mart's key (checked unique by dq_report): a plain count is the
            # distinct count, without the expand stage and extra shuffle of a distinct aggregate.
            .agg(F.count("product_id").alias("total_products"),
                 F.coalesce(F.sum("total_units_sold"), F.lit(0)).cast("long").alias("total_units_sold"),
                 rnd_double(F.coalesce(F.sum("total_revenue"), F.lit(0)), 2).alias("total_revenue"),
                 rnd_double(F.coalesce(F.avg("avg_unit_price"), F.lit(0)), 2).alias("avg_price"),
                 rnd_double(F.coalesce(F.avg("avg_review_score"), F.lit(0)), 2).alias("avg_review_score"))
            .orderBy(F.desc("total_revenue"), "category", "category_name_pt"))


def product_detail(products: DataFrame, product_id: str) -> DataFrame:
    return products.where(F.col("product_id") == product_id)


def seller_list(sellers: DataFrame, page: int = 1, page_size: int = 20, state: str | None = None,
                sort_by: str = "total_revenue", sort_order: str = "desc", search: str | None = None) -> DataFrame:
    f = paging.where_all(sellers, [paging.eq("state", state.strip().upper() if state else None),
                                   paging.ilike_any(["seller_id", "city"], search)])
    return paging.page(f, SELLER_SORT.get(sort_by, "total_revenue"), sort_order.lower() == "asc",
                       "seller_id", page, page_size)


def seller_top_categories(items: DataFrame, products: DataFrame, top_n: int = 5) -> DataFrame:
    """Items sold per (seller, category), top ``top_n`` categories per seller.

    Items are first counted per (seller, category) — a partial aggregation —
    so the per-seller window sorts at most one row per category, however
    many items a seller has. Ties broken by category name.
    """
    cat = F.coalesce("category_name_en", "category_name_pt", F.lit("other"))
    counts = (items.select("seller_id", "product_id")
              .join(products.select("product_id", cat.alias("category")), "product_id")
              .groupBy("seller_id", "category").agg(F.count(F.lit(1)).alias("items_sold")))
    w = Window.partitionBy("seller_id").orderBy(F.desc("items_sold"), F.asc("category"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("seller_id", "category", "items_sold", "rank"))


def seller_detail(sellers: DataFrame, top_categories: DataFrame, seller_id: str | None = None) -> DataFrame:
    """Seller scorecard + ordered top categories; recent_orders_count = total orders fulfilled."""
    s = sellers if seller_id is None else sellers.where(F.col("seller_id") == seller_id)
    t = top_categories if seller_id is None else top_categories.where(F.col("seller_id") == seller_id)
    cats = (t.groupBy("seller_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "category"))).alias("_c"))  # <= top_n per seller
            .select("seller_id", F.transform("_c", lambda x: x["category"]).alias("top_categories")))
    return (s.join(cats, "seller_id", "left")
            .select("*", F.col("total_orders_fulfilled").alias("recent_orders_count"))
            .withColumn("top_categories", F.coalesce("top_categories", F.array().cast("array<string>"))))
