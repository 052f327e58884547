"""Fixed schemas of the eleven raw tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, SH, TS, D, B = (T.StringType(), T.IntegerType(), T.ShortType(),
                      T.TimestampNTZType(), T.DateType(), T.BooleanType())


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
        ("customer_city", S), ("customer_state", S)),
    "orders": _struct(
        ("order_id", S), ("customer_id", S), ("order_status", S),
        ("order_purchase_timestamp", TS), ("order_approved_at", TS),
        ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
        ("order_estimated_delivery_date", TS)),
    "order_items": _struct(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", TS), ("price", _dec(12, 2)), ("freight_value", _dec(12, 2))),
    "order_payments": _struct(
        ("order_id", S), ("payment_sequential", I), ("payment_type", S),
        ("payment_installments", I), ("payment_value", _dec(12, 2))),
    "order_reviews": _struct(
        ("review_id", S), ("order_id", S), ("review_score", SH), ("review_comment_title", S),
        ("review_comment_message", S), ("review_creation_date", TS),
        ("review_answer_timestamp", TS)),
    "products": _struct(
        ("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
        ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", I),
        ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I)),
    "sellers": _struct(
        ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S)),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", S), ("geolocation_lat", _dec(10, 6)),
        ("geolocation_lng", _dec(10, 6)), ("geolocation_city", S), ("geolocation_state", S)),
    "category_translations": _struct(
        ("product_category_name", S), ("product_category_name_english", S)),
    "mql": _struct(
        ("mql_id", S), ("first_contact_date", D), ("landing_page_id", S), ("origin", S)),
    "closed_deals": _struct(
        ("mql_id", S), ("seller_id", S), ("sdr_id", S), ("sr_id", S), ("won_date", D),
        ("business_segment", S), ("lead_type", S), ("lead_behaviour_profile", S),
        ("has_company", B), ("has_gtin", B), ("average_stock", S), ("business_type", S),
        ("declared_product_catalog_size", _dec(12, 2)), ("declared_monthly_revenue", _dec(14, 2))),
}

# Load order respecting foreign keys; module split as in the ingest job.
CORE_TABLES = ["category_translations", "geolocation", "products", "sellers", "customers",
               "orders", "order_items", "order_payments", "order_reviews"]
MARKETING_TABLES = ["mql", "closed_deals"]
ALL_TABLES = CORE_TABLES + MARKETING_TABLES

# Source file name of each raw table and the documented full-load
# row count (used by the row-count data-quality check).
SOURCE_FILES = {
    "category_translations": "product_category_name_translation.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "mql": "olist_marketing_qualified_leads_dataset.csv",
    "closed_deals": "olist_closed_deals_dataset.csv",
}
EXPECTED_ROW_COUNTS = {
    "category_translations": 71, "geolocation": 1000163, "products": 32951,
    "sellers": 3095, "customers": 99441, "orders": 99441, "order_items": 112650,
    "order_payments": 103886, "order_reviews": 99224, "mql": 8000, "closed_deals": 842,
}
PRIMARY_KEYS = {
    "customers": ["customer_id"], "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"], "products": ["product_id"],
    "sellers": ["seller_id"], "category_translations": ["product_category_name"],
    "mql": ["mql_id"], "closed_deals": ["mql_id"],
}
