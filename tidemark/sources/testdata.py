"""Adapter: the driver's TPC-H-like parquet tables -> the eleven raw tables.

The source CSVs of the warehouse are not shipped with the tests; this maps the
given tables deterministically onto the raw shapes (mapping fixed in
FIXTURES.md §3). Every raw table grows with the input: orders, lineitem,
part, supplier and events are scanned whole. Only ``nation`` / ``region``
are small dimensions, joined by whatever strategy AQE picks after measuring them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import RAW_SCHEMAS

INPUT_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def read_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in INPUT_TABLES}


def _secs(ts, seconds) -> F.Column:
    return F.timestamp_add("SECOND", seconds, ts)


def _zip(col) -> F.Column:
    return F.lpad(col.cast("string"), 5, "0")


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the fixed raw schema; missing columns become typed NULLs."""
    cols = []
    for f in RAW_SCHEMAS[table].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _geo(nation: DataFrame, region: DataFrame) -> DataFrame:
    # No broadcast hint: AQE broadcasts these dimensions after measuring them
    # (spark.sql.adaptive.autoBroadcastJoinThreshold), so the choice rests on a size check.
    return (nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
            .select("n_nationkey", "n_name", "r_name"))


class RawTables(Mapping):
    """Raw tables by name, each made when it is asked for: what it alone needs is only written then."""

    def __init__(self, builds: dict[str, Callable[[], DataFrame]]):
        self._builds = builds

    def __getitem__(self, name: str) -> DataFrame:
        return _conform(self._builds[name](), name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._builds)

    def __len__(self) -> int:
        return len(self._builds)


def raw_tables(spark: SparkSession, sf_dir: str, keep: Callable | None = None) -> Mapping[str, DataFrame]:
    """The raw tables made from the input tables; ``keep(name, build)`` may write what several of them read."""
    t = read_inputs(spark, sf_dir)
    geo = _geo(t["nation"], t["region"])
    state = F.lower(F.substring("r_name", 1, 2))
    o, l = t["orders"], t["lineitem"]
    k = F.col("o_orderkey")

    customers = (o.select("o_orderkey", "o_custkey")
                 .join(t["customer"].select("c_custkey", "c_nationkey"),
                       F.col("c_custkey") == F.col("o_custkey"))
                 .join(geo, F.col("n_nationkey") == (F.col("c_nationkey") + k % 3) % 25)
                 .select(F.concat(F.lit("C"), k.cast("string")).alias("customer_id"),
                         F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("customer_unique_id"),
                         _zip(F.col("n_nationkey")).alias("customer_zip_code_prefix"),
                         F.concat(F.lit(" "), F.col("n_name")).alias("customer_city"),
                         state.alias("customer_state")))

    od = F.col("o_orderdate")
    orders = o.select(
        F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
        F.concat(F.lit("C"), k.cast("string")).alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
         .when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing").alias("order_status"),
        _secs(od, k * 7919 % 86400).alias("order_purchase_timestamp"),
        _secs(od, k * 7919 % 86400 + 3600).alias("order_approved_at"),
        _secs(od, F.lit(2 * 86400)).alias("order_delivered_carrier_date"),
        F.when(k % 97 != 0, _secs(od, (k % 20 + 3) * 86400 + k * 104729 % 86400))
         .alias("order_delivered_customer_date"),
        _secs(od, F.lit(18 * 86400)).alias("order_estimated_delivery_date"))

    # (l_orderkey, l_linenumber) repeats in the input, so line ids are
    # re-numbered per order; the window is partitioned by order (distributed).
    line_no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).cast("int")
    lk = F.col("l_orderkey")
    numbered = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                        "l_extendedprice", "l_quantity", "l_returnflag").withColumn("seq", line_no)

    @cache
    def lines() -> DataFrame:  # items and payments both read the numbered lines: number them once
        return numbered if keep is None else keep("numbered_lines", lambda: numbered)

    order_items = lambda: lines().select(
        F.concat(F.lit("O"), lk.cast("string")).alias("order_id"),
        F.col("seq").alias("order_item_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_quantity").cast("decimal(12,2)").alias("freight_value"))
    order_payments = lambda: lines().select(
        F.concat(F.lit("O"), lk.cast("string")).alias("order_id"),
        F.col("seq").alias("payment_sequential"),
        F.when(F.col("l_returnflag") == "A", "credit_card")
         .when(F.col("l_returnflag") == "N", "boleto").otherwise("voucher").alias("payment_type"),
        F.col("l_linenumber").cast("int").alias("payment_installments"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("payment_value"))

    reviews_a = o.where(k % 13 != 0).select(
        F.concat(F.lit("R"), k.cast("string")).alias("review_id"),
        F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
        F.when(k % 50 != 0, F.substring("o_orderpriority", 1, 1).cast("smallint")).alias("review_score"),
        _secs(od, F.lit(25 * 86400)).alias("review_creation_date"))
    reviews_b = o.where(k % 11 == 0).select(
        F.concat(F.lit("Q"), k.cast("string")).alias("review_id"),
        F.concat(F.lit("O"), k.cast("string")).alias("order_id"),
        (k % 5 + 1).cast("smallint").alias("review_score"),
        _secs(od, F.lit(26 * 86400)).alias("review_creation_date"))
    order_reviews = reviews_a.unionByName(reviews_b)

    p = t["part"]
    pk = F.col("p_partkey")
    products = p.select(
        F.concat(F.lit("P"), pk.cast("string")).alias("product_id"),
        F.when(pk % 100 != 0, F.concat(F.lower("p_type"), F.lit("_pt"))).alias("product_category_name"),
        F.length("p_name").cast("int").alias("product_name_lenght"),
        F.length("p_type").cast("int").alias("product_description_lenght"),
        (pk % 6).cast("int").alias("product_photos_qty"),
        (F.col("p_size") * 100).cast("int").alias("product_weight_g"),
        F.col("p_size").cast("int").alias("product_length_cm"),
        (F.col("p_size") + 1).cast("int").alias("product_height_cm"),
        (F.col("p_size") + 2).cast("int").alias("product_width_cm"))
    category_translations = (p.where(F.col("p_type") != "PROMO")
                             .select(F.concat(F.lower("p_type"), F.lit("_pt")).alias("product_category_name"),
                                     F.lower("p_type").alias("product_category_name_english"))
                             .distinct())

    sellers = (t["supplier"].join(geo, F.col("n_nationkey") == F.col("s_nationkey"))
               .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("seller_id"),
                       _zip(F.col("n_nationkey")).alias("seller_zip_code_prefix"),
                       F.concat(F.col("n_name"), F.lit(" ")).alias("seller_city"),
                       state.alias("seller_state")))
    geolocation = geo.select(
        _zip(F.col("n_nationkey")).alias("geolocation_zip_code_prefix"),
        F.col("n_nationkey").cast("decimal(10,6)").alias("geolocation_lat"),
        (-F.col("n_nationkey")).cast("decimal(10,6)").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"), state.alias("geolocation_state"))

    e = t["events"].where(F.col("event_type") == "signup")
    eid, uid = F.col("event_id"), F.col("user_id")

    def case(col, mapping: dict):
        expr = None
        for key, val in mapping.items():
            expr = F.when(col == key, val) if expr is None else expr.when(col == key, val)
        return expr

    mql = e.select(
        F.concat(F.lit("M"), eid.cast("string")).alias("mql_id"),
        F.col("ts").cast("date").alias("first_contact_date"),
        F.concat(F.lit("L"), (uid % 10).cast("string")).alias("landing_page_id"),
        case(uid % 6, {0: "organic_search", 1: " Paid_Search ", 2: "social", 3: "email", 4: ""}).alias("origin"))
    deals = e.where(eid % 10 == 0).select(
        F.concat(F.lit("M"), eid.cast("string")).alias("mql_id"),
        F.concat(F.lit("S"), uid.cast("string")).alias("seller_id"),
        F.concat(F.lit("D"), (uid % 7).cast("string")).alias("sdr_id"),
        F.concat(F.lit("E"), (uid % 5).cast("string")).alias("sr_id"),
        F.when(eid % 70 != 0, F.date_add(F.col("ts").cast("date"), (eid % 120).cast("int"))).alias("won_date"),
        case(uid % 5, {0: " Health_Beauty", 1: "reseller", 2: "pet", 3: "toys"}).alias("business_segment"),
        case(uid % 4, {0: "online_big", 1: "offline", 2: "industry"}).alias("lead_type"),
        case(uid % 3, {0: "Cat", 1: "wolf"}).alias("lead_behaviour_profile"),
        case(uid % 3, {0: True, 1: False}).alias("has_company"),
        case(uid % 4, {0: True, 1: False}).alias("has_gtin"),
        F.lit("Reseller").alias("business_type"),
        F.when(uid % 2 == 0, uid).cast("decimal(12,2)").alias("declared_product_catalog_size"),
        F.when(eid % 3 != 0, F.col("value")).cast("decimal(14,2)").alias("declared_monthly_revenue"))

    raw = {
        "customers": customers, "orders": orders, "order_items": order_items,
        "order_payments": order_payments, "order_reviews": order_reviews, "products": products,
        "sellers": sellers, "geolocation": geolocation,
        "category_translations": category_translations, "mql": mql, "closed_deals": deals,
    }
    return RawTables({name: df if callable(df) else lambda df=df: df for name, df in raw.items()})
