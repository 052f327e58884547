"""Warehouse layers as DuckDB CTEs (name -> SQL), plus a tiny WITH-chain builder."""

from __future__ import annotations

import re


def R(expr: str, scale: int) -> str:
    """Half-away rounding on the decimal value (mirrors tidemark.functions.core.rnd)."""
    return f"round(CAST(({expr}) AS DECIMAL(38,10)), {scale})"


def RD(expr: str, scale: int) -> str:
    return f"CAST({R(expr, scale)} AS DOUBLE)"


def DIV(num: str, den: str) -> str:
    return f"(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0.0))"


def PCT(num: str, den: str, scale: int = 2) -> str:
    return f"coalesce({RD(DIV(num, den) + ' * 100.0', scale)}, 0.0)"


CTES: dict[str, str] = {}

# ---------------------------------------------------------------- raw adapter
CTES["raw_customers"] = """
SELECT 'C'||o_orderkey AS customer_id, 'U'||o_custkey AS customer_unique_id,
       lpad(CAST(n_nationkey AS varchar),5,'0') AS customer_zip_code_prefix,
       ' '||n_name AS customer_city, lower(substr(r_name,1,2)) AS customer_state
FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = (c_nationkey + o_orderkey % 3) % 25
JOIN region ON r_regionkey = n_regionkey"""

CTES["raw_orders"] = """
SELECT 'O'||o_orderkey AS order_id, 'C'||o_orderkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
       (o_orderdate + to_seconds(o_orderkey*7919%86400)) AS order_purchase_timestamp,
       (o_orderdate + to_seconds(o_orderkey*7919%86400+3600)) AS order_approved_at,
       (o_orderdate + to_seconds(2*86400)) AS order_delivered_carrier_date,
       CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderdate + to_seconds((3+o_orderkey%20)*86400+o_orderkey*104729%86400)) END AS order_delivered_customer_date,
       (o_orderdate + to_seconds(18*86400)) AS order_estimated_delivery_date
FROM orders"""

_LINE_NO = ("CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
            "l_suppkey, l_shipdate, l_extendedprice) AS int)")

CTES["raw_order_items"] = f"""
SELECT 'O'||l_orderkey AS order_id, {_LINE_NO} AS order_item_id,
       'P'||l_partkey AS product_id, 'S'||l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
       CAST(l_extendedprice AS decimal(12,2)) AS price, CAST(l_quantity AS decimal(12,2)) AS freight_value
FROM lineitem"""

CTES["raw_order_payments"] = f"""
SELECT 'O'||l_orderkey AS order_id, {_LINE_NO} AS payment_sequential,
       CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type,
       CAST(l_linenumber AS int) AS payment_installments,
       CAST(l_extendedprice AS decimal(12,2)) AS payment_value
FROM lineitem"""

CTES["raw_order_reviews"] = """
SELECT 'R'||o_orderkey AS review_id, 'O'||o_orderkey AS order_id,
       CASE WHEN o_orderkey % 50 <> 0 THEN CAST(substr(o_orderpriority,1,1) AS smallint) END AS review_score,
       (o_orderdate + to_seconds(25*86400)) AS review_creation_date
FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL
SELECT 'Q'||o_orderkey, 'O'||o_orderkey, CAST(1 + o_orderkey % 5 AS smallint), (o_orderdate + to_seconds(26*86400))
FROM orders WHERE o_orderkey % 11 = 0"""

CTES["raw_products"] = """
SELECT 'P'||p_partkey AS product_id,
       CASE WHEN p_partkey % 100 <> 0 THEN lower(p_type)||'_pt' END AS product_category_name,
       CAST(length(p_name) AS int) AS product_name_lenght, CAST(length(p_type) AS int) AS product_description_lenght,
       CAST(p_partkey % 6 AS int) AS product_photos_qty, CAST(p_size * 100 AS int) AS product_weight_g,
       CAST(p_size AS int) AS product_length_cm, CAST(p_size + 1 AS int) AS product_height_cm,
       CAST(p_size + 2 AS int) AS product_width_cm
FROM part"""

CTES["raw_category_translations"] = """
SELECT DISTINCT lower(p_type)||'_pt' AS product_category_name, lower(p_type) AS product_category_name_english
FROM part WHERE p_type <> 'PROMO'"""

CTES["raw_sellers"] = """
SELECT 'S'||s_suppkey AS seller_id, lpad(CAST(n_nationkey AS varchar),5,'0') AS seller_zip_code_prefix,
       n_name||' ' AS seller_city, lower(substr(r_name,1,2)) AS seller_state
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""

CTES["raw_geolocation"] = """
SELECT lpad(CAST(n_nationkey AS varchar),5,'0') AS geolocation_zip_code_prefix,
       CAST(n_nationkey AS decimal(10,6)) AS geolocation_lat, CAST(-n_nationkey AS decimal(10,6)) AS geolocation_lng,
       n_name AS geolocation_city, lower(substr(r_name,1,2)) AS geolocation_state
FROM nation JOIN region ON r_regionkey = n_regionkey"""

CTES["raw_mql"] = """
SELECT 'M'||event_id AS mql_id, CAST(ts AS date) AS first_contact_date, 'L'||(user_id % 10) AS landing_page_id,
       CASE user_id % 6 WHEN 0 THEN 'organic_search' WHEN 1 THEN ' Paid_Search ' WHEN 2 THEN 'social'
                        WHEN 3 THEN 'email' WHEN 4 THEN '' END AS origin
FROM events WHERE event_type = 'signup'"""

CTES["raw_closed_deals"] = """
SELECT 'M'||event_id AS mql_id, 'S'||user_id AS seller_id, 'D'||(user_id % 7) AS sdr_id, 'E'||(user_id % 5) AS sr_id,
       CASE WHEN event_id % 70 <> 0 THEN (CAST(ts AS date) + CAST(event_id % 120 AS int)) END AS won_date,
       CASE user_id % 5 WHEN 0 THEN ' Health_Beauty' WHEN 1 THEN 'reseller' WHEN 2 THEN 'pet' WHEN 3 THEN 'toys' END AS business_segment,
       CASE user_id % 4 WHEN 0 THEN 'online_big' WHEN 1 THEN 'offline' WHEN 2 THEN 'industry' END AS lead_type,
       CASE user_id % 3 WHEN 0 THEN 'Cat' WHEN 1 THEN 'wolf' END AS lead_behaviour_profile,
       CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_company,
       CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS has_gtin,
       CAST(NULL AS varchar) AS average_stock, 'Reseller' AS business_type,
       CAST(CASE WHEN user_id % 2 = 0 THEN user_id END AS decimal(12,2)) AS declared_product_catalog_size,
       CAST(CASE WHEN event_id % 3 <> 0 THEN value END AS decimal(14,2)) AS declared_monthly_revenue
FROM events WHERE event_type = 'signup' AND event_id % 10 = 0"""

# ---------------------------------------------------------------- staging
CTES["stg_customers"] = """
SELECT customer_id, customer_unique_id, customer_zip_code_prefix AS zip_prefix,
       lower(trim(customer_city)) AS city, upper(trim(customer_state)) AS state
FROM raw_customers"""

CTES["stg_orders"] = """
SELECT order_id, customer_id, order_status,
       order_purchase_timestamp AS purchased_at, order_approved_at AS approved_at,
       order_delivered_carrier_date AS shipped_at, order_delivered_customer_date AS delivered_at,
       order_estimated_delivery_date AS estimated_delivery_at,
       order_status = 'delivered' AS is_delivered,
       CAST(date_sub('microsecond', order_estimated_delivery_date, order_delivered_customer_date) AS DOUBLE) / 86400000000 AS delivery_delay_days,
       date_sub('microsecond', order_estimated_delivery_date, order_delivered_customer_date) AS delay_us
FROM raw_orders WHERE order_status = 'delivered'"""

CTES["stg_order_items"] = """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date AS shipping_limit_at,
       i.price, i.freight_value, i.price + i.freight_value AS item_revenue
FROM raw_order_items i WHERE i.order_id IN (SELECT order_id FROM stg_orders)"""

CTES["stg_order_payments"] = """
SELECT order_id,
       arg_min(payment_type, (-payment_value, payment_sequential)) FILTER (WHERE payment_value IS NOT NULL) AS primary_payment_type,
       sum(payment_value) AS total_payment_value,
       sum(payment_installments) AS total_installments,
       count(DISTINCT payment_type) AS payment_method_count,
       count(DISTINCT payment_type) > 1 AS has_multiple_payment_methods
FROM raw_order_payments GROUP BY order_id"""

CTES["stg_order_reviews"] = """
SELECT review_id, order_id, review_score, review_score <= 2 AS is_negative_review,
       review_score >= 4 AS is_positive_review, review_creation_date AS review_created_at
FROM raw_order_reviews WHERE review_score IS NOT NULL"""

CTES["stg_products"] = """
SELECT p.product_id, p.product_category_name AS category_name_pt,
       coalesce(t.product_category_name_english, p.product_category_name) AS category_name_en,
       p.product_name_lenght AS product_name_length, p.product_description_lenght AS product_description_length,
       p.product_photos_qty, p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm
FROM raw_products p LEFT JOIN raw_category_translations t USING (product_category_name)"""

CTES["stg_sellers"] = """
SELECT seller_id, seller_zip_code_prefix AS zip_prefix, lower(trim(seller_city)) AS city,
       upper(trim(seller_state)) AS state
FROM raw_sellers"""

CTES["stg_marketing_leads"] = """
SELECT mql_id, first_contact_date, landing_page_id,
       coalesce(nullif(lower(trim(origin)), ''), 'unknown') AS origin
FROM raw_mql"""

CTES["stg_closed_deals"] = """
SELECT mql_id, seller_id, sdr_id, sr_id, won_date,
       lower(trim(business_segment)) AS business_segment, lower(trim(lead_type)) AS lead_type,
       lower(trim(lead_behaviour_profile)) AS lead_behaviour_profile,
       coalesce(has_company, false) AS has_company, coalesce(has_gtin, false) AS has_gtin,
       average_stock, lower(trim(business_type)) AS business_type,
       CAST(coalesce(declared_product_catalog_size, 0) AS decimal(12,2)) AS declared_product_catalog_size,
       CAST(coalesce(declared_monthly_revenue, 0) AS decimal(14,2)) AS declared_monthly_revenue
FROM raw_closed_deals"""

# ---------------------------------------------------------------- intermediate
CTES["int_order_items_aggregated"] = """
SELECT order_id, count(*) AS item_count,
       CAST(sum(price) AS decimal(14,2)) AS product_revenue,
       CAST(sum(freight_value) AS decimal(14,2)) AS freight_revenue,
       CAST(sum(item_revenue) AS decimal(14,2)) AS total_order_item_revenue,
       count(DISTINCT product_id) AS unique_products_count,
       count(DISTINCT seller_id) AS unique_sellers_count
FROM stg_order_items GROUP BY order_id"""

CTES["int_order_reviews_aggregated"] = f"""
SELECT order_id, count(*) AS reviews_count,
       CAST({R('avg(review_score)', 2)} AS decimal(3,2)) AS avg_review_score,
       min(review_score) AS min_review_score, max(review_score) AS max_review_score,
       bool_or(is_negative_review) AS has_negative_review, bool_or(is_positive_review) AS has_positive_review,
       max(review_created_at) AS latest_review_created_at
FROM stg_order_reviews GROUP BY order_id"""

# The newest order wins (an order without time never beats one with), then the smallest customer_id:
# the last element of a sorted list of addresses per customer.
CTES["int_customer_locations"] = """
WITH seen AS (
  SELECT customer_unique_id, list({'t': purchased_at, 'id': customer_id, 'city': city, 'state': state, 'zip': zip_prefix}) AS addresses
  FROM stg_customers JOIN stg_orders USING (customer_id) GROUP BY ALL
), newest AS (
  SELECT customer_unique_id, list_max([a.t FOR a IN addresses]) AS t, addresses FROM seen
), picked AS (
  SELECT customer_unique_id, list_sort([{'id': a.id, 'address': a} FOR a IN addresses IF a.t IS NOT DISTINCT FROM t])[1].address AS a
  FROM newest
)
SELECT customer_unique_id, a.city AS primary_city, a.state AS primary_state, a.zip AS primary_zip_prefix FROM picked"""

CTES["int_customer_orders"] = f"""
SELECT c.customer_unique_id,
       min(o.purchased_at) AS first_purchased_at, max(o.purchased_at) AS latest_purchased_at,
       count(DISTINCT o.order_id) AS lifetime_orders,
       CAST(sum(coalesce(i.item_count, 0)) AS int) AS lifetime_items,
       CAST(sum(coalesce(i.product_revenue, 0)) AS decimal(14,2)) AS lifetime_product_spend,
       CAST(sum(coalesce(i.freight_revenue, 0)) AS decimal(14,2)) AS lifetime_freight_spend,
       CAST(sum(coalesce(i.total_order_item_revenue, 0)) AS decimal(14,2)) AS lifetime_spend,
       CAST({R(DIV('sum(coalesce(i.total_order_item_revenue, 0))', 'count(DISTINCT o.order_id)'), 2)} AS decimal(12,2)) AS avg_order_value,
       CAST(sum(coalesce(i.unique_products_count, 0)) AS int) AS total_unique_products_purchased,
       CAST(sum(coalesce(i.unique_sellers_count, 0)) AS int) AS total_unique_sellers_contacted
FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id
LEFT JOIN int_order_items_aggregated i ON i.order_id = o.order_id
GROUP BY c.customer_unique_id"""

CTES["int_customer_fulfillment"] = f"""
SELECT c.customer_unique_id,
       {R('avg(o.delay_us) / 86400000000', 2)} AS avg_delivery_delay_days,
       {R('max(o.delay_us) / 86400000000', 2)} AS max_delivery_delay_days,
       CAST(sum(CASE WHEN o.delay_us > 0 THEN 1 ELSE 0 END) AS int) AS late_orders_count,
       CAST(sum(CASE WHEN o.delay_us <= 0 THEN 1 ELSE 0 END) AS int) AS on_time_orders_count,
       CAST({R(DIV('sum(CASE WHEN o.delay_us > 0 THEN 1 ELSE 0 END)', 'count(*)'), 4)} AS decimal(6,4)) AS late_order_ratio,
       sum(CASE WHEN o.delay_us > 0 THEN 1 ELSE 0 END) > 0 AS has_late_delivery
FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id
GROUP BY c.customer_unique_id"""

CTES["int_customer_reviews"] = f"""
SELECT c.customer_unique_id,
       CAST(sum(r.reviews_count) AS int) AS total_reviews_submitted,
       CAST({R('avg(r.avg_review_score)', 2)} AS decimal(3,2)) AS avg_review_score,
       count(*) FILTER (WHERE r.has_negative_review) AS negative_reviews_count,
       count(*) FILTER (WHERE r.has_positive_review) AS positive_reviews_count,
       bool_or(r.has_negative_review) AS has_negative_review,
       CAST({R(DIV('count(*) FILTER (WHERE r.has_negative_review)', 'count(*)'), 4)} AS decimal(6,4)) AS negative_review_ratio
FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id
JOIN int_order_reviews_aggregated r ON r.order_id = o.order_id
GROUP BY c.customer_unique_id"""

# ---------------------------------------------------------------- marts
CTES["fact_orders"] = """
SELECT o.order_id, o.customer_id, c.customer_unique_id, o.order_status, o.purchased_at, o.approved_at,
       o.shipped_at, o.delivered_at, o.estimated_delivery_at, o.delivery_delay_days,
       o.delivery_delay_days > 0 AS is_late_delivery,
       coalesce(i.item_count, 0) AS item_count,
       coalesce(i.unique_products_count, 0) AS unique_products_count,
       coalesce(i.unique_sellers_count, 0) AS unique_sellers_count,
       CAST(coalesce(i.product_revenue, 0) AS decimal(14,2)) AS product_revenue,
       CAST(coalesce(i.freight_revenue, 0) AS decimal(14,2)) AS freight_revenue,
       CAST(coalesce(i.total_order_item_revenue, 0) AS decimal(14,2)) AS total_revenue,
       p.total_payment_value, p.primary_payment_type, p.total_installments,
       coalesce(p.has_multiple_payment_methods, false) AS has_multiple_payment_methods,
       coalesce(r.reviews_count, 0) AS reviews_count, r.avg_review_score,
       coalesce(r.has_negative_review, false) AS has_negative_review,
       coalesce(r.has_positive_review, false) AS has_positive_review
FROM stg_orders o JOIN stg_customers c ON c.customer_id = o.customer_id
LEFT JOIN int_order_items_aggregated i ON i.order_id = o.order_id
LEFT JOIN stg_order_payments p ON p.order_id = o.order_id
LEFT JOIN int_order_reviews_aggregated r ON r.order_id = o.order_id"""

CTES["dim_customers"] = """
SELECT o.customer_unique_id, l.primary_city AS city, l.primary_state AS state, l.primary_zip_prefix AS zip_prefix,
       o.first_purchased_at, o.latest_purchased_at, o.lifetime_orders, o.lifetime_orders > 1 AS is_repeat_buyer,
       CAST(date_sub('day', o.first_purchased_at, o.latest_purchased_at) AS int) AS customer_tenure_days
FROM int_customer_orders o JOIN int_customer_locations l USING (customer_unique_id)"""

CTES["mart_customer_metrics"] = f"""
SELECT o.customer_unique_id, l.primary_city AS city, l.primary_state AS state, l.primary_zip_prefix AS zip_prefix,
       o.first_purchased_at, o.latest_purchased_at,
       CAST(date_sub('day', o.latest_purchased_at, (SELECT max(purchased_at) FROM stg_orders)) AS int) AS recency_days,
       CAST(date_sub('day', o.first_purchased_at, o.latest_purchased_at) AS int) AS customer_lifespan_days,
       o.lifetime_orders, o.lifetime_orders > 1 AS is_repeat_buyer,
       o.lifetime_spend, o.lifetime_product_spend, o.lifetime_freight_spend, o.avg_order_value, o.lifetime_items,
       CAST({R(DIV('o.lifetime_items', 'o.lifetime_orders'), 2)} AS decimal(6,2)) AS avg_items_per_order,
       o.total_unique_products_purchased, o.total_unique_sellers_contacted,
       CAST(coalesce(f.avg_delivery_delay_days, 0) AS decimal(12,2)) AS avg_delivery_delay_days,
       CAST(coalesce(f.max_delivery_delay_days, 0) AS decimal(12,2)) AS max_delivery_delay_days,
       coalesce(f.late_orders_count, 0) AS late_orders_count,
       coalesce(f.on_time_orders_count, CAST(o.lifetime_orders AS int)) AS on_time_orders_count,
       CAST(coalesce(f.late_order_ratio, 0) AS decimal(6,4)) AS late_order_ratio,
       coalesce(f.has_late_delivery, false) AS has_late_delivery,
       coalesce(r.total_reviews_submitted, 0) AS total_reviews_submitted,
       r.avg_review_score,
       coalesce(r.negative_reviews_count, 0) AS negative_reviews_count,
       coalesce(r.positive_reviews_count, 0) AS positive_reviews_count,
       coalesce(r.has_negative_review, false) AS has_negative_review,
       CAST(coalesce(r.negative_review_ratio, 0) AS decimal(6,4)) AS negative_review_ratio
FROM int_customer_orders o
JOIN int_customer_locations l USING (customer_unique_id)
LEFT JOIN int_customer_fulfillment f USING (customer_unique_id)
LEFT JOIN int_customer_reviews r USING (customer_unique_id)"""

CTES["mart_product_metrics"] = f"""
SELECT p.product_id, p.category_name_pt, p.category_name_en,
       CAST(coalesce(s.units, 0) AS bigint) AS total_units_sold,
       CAST(coalesce(s.n_orders, 0) AS bigint) AS total_orders_count,
       CAST(coalesce(s.revenue, 0) AS decimal(14,2)) AS total_revenue,
       CAST(coalesce(s.avg_price, 0) AS decimal(10,2)) AS avg_unit_price,
       CAST(s.avg_review AS decimal(10,2)) AS avg_review_score,
       p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm, p.product_photos_qty
FROM stg_products p LEFT JOIN (
  SELECT i.product_id, count(i.order_item_id) AS units, count(DISTINCT i.order_id) AS n_orders,
         {R('coalesce(sum(i.item_revenue), 0)', 2)} AS revenue,
         {R('coalesce(avg(i.price), 0)', 2)} AS avg_price,
         {R('coalesce(avg(r.avg_review_score), 0)', 2)} AS avg_review
  FROM stg_order_items i LEFT JOIN int_order_reviews_aggregated r ON r.order_id = i.order_id
  GROUP BY i.product_id
) s ON s.product_id = p.product_id"""

# Restated from per-item facts: one row per delivered item, then averages as quotients of sums.
CTES["seller_item_facts"] = """
SELECT seller_id, order_id, product_id, order_item_id, item_revenue, delay_us, avg_review_score AS stars
FROM stg_order_items LEFT JOIN stg_orders USING (order_id) LEFT JOIN int_order_reviews_aggregated USING (order_id)"""
CTES["mart_seller_metrics"] = f"""
WITH per_seller AS (
  SELECT seller_id, len(list_distinct(list(order_id))) AS orders, count(order_item_id) AS items, len(list_distinct(list(product_id))) AS products,
         sum(item_revenue) AS revenue, {R('avg(item_revenue)', 2)} AS item_value, {R('avg(delay_us) / 86400000000', 1)} AS delay,
         {R('100.0 * count(*) FILTER (WHERE delay_us > 0) / count(*)', 2)} AS late, {R('avg(stars)', 2)} AS stars,
         {R('100.0 * count(*) FILTER (WHERE stars >= 4.0) / count(*)', 2)} AS positive
  FROM seller_item_facts GROUP BY seller_id
)
SELECT seller_id, city, state, zip_prefix, coalesce(orders, 0)::BIGINT AS total_orders_fulfilled,
       coalesce(items, 0)::BIGINT AS total_items_sold, coalesce(products, 0)::BIGINT AS total_unique_products,
       coalesce(revenue, 0)::DECIMAL(14,2) AS total_revenue, coalesce(item_value, 0)::DECIMAL(10,2) AS avg_item_value,
       CASE WHEN orders > 0 THEN coalesce(delay, 0) END::DECIMAL(10,1) AS avg_delivery_delay_days,
       coalesce(late, 0)::DECIMAL(5,2) AS late_delivery_rate,
       CASE WHEN orders > 0 THEN coalesce(stars, 0) END::DECIMAL(10,2) AS avg_review_score,
       coalesce(positive, 0)::DECIMAL(5,2) AS positive_reviews_rate
FROM stg_sellers LEFT JOIN per_seller USING (seller_id)"""

CTES["mart_marketing_funnel"] = """
SELECT l.mql_id, l.first_contact_date, l.landing_page_id, l.origin,
       d.mql_id IS NOT NULL AS is_won, d.won_date,
       CAST(datediff('day', l.first_contact_date, d.won_date) AS int) AS days_to_close,
       d.seller_id, d.sdr_id, d.sr_id, d.business_segment, d.lead_type, d.lead_behaviour_profile,
       d.business_type, d.has_company, d.has_gtin,
       CAST(coalesce(d.declared_monthly_revenue, 0) AS decimal(14,2)) AS declared_monthly_revenue,
       CAST(coalesce(d.declared_product_catalog_size, 0) AS decimal(12,2)) AS declared_product_catalog_size,
       (sp.seller_id IS NOT NULL AND coalesce(sp.total_orders_fulfilled > 0, false)) AS is_active_marketplace_seller,
       CAST(coalesce(sp.total_orders_fulfilled, 0) AS bigint) AS actual_orders_fulfilled,
       CAST(coalesce(sp.total_revenue, 0) AS decimal(14,2)) AS actual_marketplace_revenue
FROM stg_marketing_leads l
LEFT JOIN stg_closed_deals d ON d.mql_id = l.mql_id
LEFT JOIN mart_seller_metrics sp ON sp.seller_id = d.seller_id"""


_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_chain(final_sql: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix ``final_sql`` with every CTE it (transitively) references, in dependency order."""
    table = dict(CTES)
    table.update(ctes or {})
    order: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in _IDENT.findall(sql):
            if name in table and name not in seen:
                seen.add(name)
                visit(table[name])
                order.append(name)

    visit(final_sql)
    if not order:
        return final_sql
    body = ",\n".join(f"{n} AS ({table[n]}\n)" for n in order)
    return f"WITH {body}\n{final_sql}"
