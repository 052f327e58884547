"""Portfolio analytics: segment mix, revenue trends, cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import combine_single_rows, count_if, grand_total, rnd_double
from .marts import in_months

INTERVALS = {"month", "week", "day"}


def segments_overview(rfm_segments: DataFrame) -> DataFrame:
    """Per RFM segment: count, % of base, total/avg spend, avg recency, avg frequency; by spend desc."""
    return (rfm_segments.groupBy("segment")
            .agg(F.count(F.lit(1)).alias("customer_count"),
                 F.coalesce(F.sum("monetary"), F.lit(0)).alias("_spend"),
                 F.avg(F.col("monetary").cast("double")).alias("_avg_spend"),
                 F.avg("recency_days").alias("_avg_recency"),
                 F.avg("frequency").alias("_avg_frequency"))
            .withColumn("_total", grand_total("customer_count"))
            .select("segment", "customer_count",
                    rnd_double(F.col("customer_count") / F.col("_total") * 100.0, 2).alias("percentage"),
                    rnd_double(F.col("_spend"), 2).alias("total_spend"),
                    rnd_double(F.coalesce(F.col("_avg_spend"), F.lit(0.0)), 2).alias("avg_spend"),
                    rnd_double(F.coalesce(F.col("_avg_recency"), F.lit(0.0)), 1).alias("avg_recency_days"),
                    rnd_double(F.coalesce(F.col("_avg_frequency"), F.lit(0.0)), 2).alias("avg_frequency"))
            .orderBy(F.desc("total_spend"), "segment"))


def _period_label(ts, interval: str):
    if interval == "week":
        start = F.date_trunc("week", ts)
        # calendar year of the week's Monday + ISO week number
        return F.concat(F.year(start).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    if interval == "day":
        return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")
    return F.date_format(F.date_trunc("month", ts), "yyyy-MM")


def revenue_trends(fact_orders: DataFrame, interval: str = "month", start_date: str | None = None,
                   end_date: str | None = None) -> DataFrame:
    """GMV, orders, delivered, AOV, freight and late % per period (unknown interval -> month).

    Of a fact table partitioned by month, only the months of the window are opened."""
    interval = interval.lower() if interval and interval.lower() in INTERVALS else "month"
    ts = F.col("purchased_at")
    f = in_months(fact_orders, start_date, end_date).where(ts.isNotNull())
    if start_date:
        f = f.where(ts >= F.lit(start_date).cast("timestamp_ntz"))
    if end_date:
        f = f.where(ts <= F.lit(end_date).cast("timestamp_ntz"))
    late = F.when(F.col("is_late_delivery"), 1.0).otherwise(0.0)
    return (f.groupBy(_period_label(ts, interval).alias("period"))
            .agg(rnd_double(F.coalesce(F.sum("total_revenue"), F.lit(0)), 2).alias("gmv"),
                 F.count("order_id").alias("orders_count"),
                 count_if(F.col("delivered_at").isNotNull()).alias("delivered_count"),
                 rnd_double(F.coalesce(F.avg("total_revenue"), F.lit(0)), 2).alias("avg_order_value"),
                 rnd_double(F.coalesce(F.sum("freight_revenue"), F.lit(0)), 2).alias("total_freight"),
                 rnd_double(F.coalesce(F.avg(late), F.lit(0.0)) * 100.0, 2).alias("late_order_rate"))
            .orderBy("period"))


def cohort_retention(fact_orders: DataFrame, max_offset: int = 12) -> DataFrame:
    """Monthly acquisition cohorts: size and % of the cohort buying again at month offsets 0..12.

    One scan of the fact table and two shuffles: per customer, the set of
    active months (bounded by the calendar span of the data, not by its
    volume; built by partial aggregation, so a hot customer is merged from
    small partial sets); the cohort is the earliest month; offsets are
    exploded and counted per (cohort, offset). Every customer buys in their
    first month, so the cohort size is the offset-0 count.
    """
    months = (fact_orders.where(F.col("purchased_at").isNotNull())
              .groupBy("customer_unique_id")
              .agg(F.collect_set(F.date_trunc("month", "purchased_at")).alias("_months")))
    cohort = F.array_min("_months")
    offsets = F.transform("_months", lambda m: ((F.year(m) - F.year(cohort)) * 12
                                                + (F.month(m) - F.month(cohort))).cast("int"))
    counts = (months.select(cohort.alias("cohort_ts"), F.explode(offsets).alias("month_offset"))
              .where((F.col("month_offset") >= 0) & (F.col("month_offset") <= max_offset))
              .groupBy("cohort_ts", "month_offset").agg(F.count(F.lit(1)).alias("retained_customers")))
    # the size comes from the already-aggregated rows of the same cohort (at most 13 per cohort)
    size = F.max(F.when(F.col("month_offset") == 0, F.col("retained_customers"))).over(
        Window.partitionBy("cohort_ts"))
    return (counts.withColumn("cohort_size", size)
            .select(F.date_format("cohort_ts", "yyyy-MM").alias("cohort_month"), "cohort_size", "month_offset",
                    rnd_double(F.col("retained_customers") / F.col("cohort_size") * 100.0, 2).alias("retention_rate"))
            .orderBy("cohort_month", "month_offset"))


def cohort_matrix(retention: DataFrame) -> DataFrame:
    """One row per cohort with ``retention_rates`` = map m0..m12 -> rate (absent offsets absent)."""
    return (retention.groupBy("cohort_month", "cohort_size")
            .agg(F.map_from_entries(F.collect_list(F.struct(
                F.concat(F.lit("m"), F.col("month_offset").cast("string")), F.col("retention_rate"))))
                .alias("retention_rates"))
            .orderBy("cohort_month"))


# ------------------------------------------------------------------ churn exposure
VIP = "Priority 1: Immediate VIP Retention"


def portfolio_sums(mart: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of sums and counts from which the portfolio KPIs follow; sums of two parts of the customers add up.

    Scores are summed where they are stored, so a scored customer who has left the mart counts too. Sums of doubles
    are taken over decimals, so they don't depend on how the customers are parted.
    """
    exact = lambda c, scale: F.col(c).cast(f"decimal(28,{scale})")
    customers = mart.agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col("lifetime_orders").cast("decimal(20,0)")).alias("orders"),
        F.sum(exact("lifetime_spend", 2)).alias("revenue"), F.sum(exact("avg_order_value", 6)).alias("aov"),
        F.count("avg_order_value").alias("aov_n"), count_if(F.col("is_repeat_buyer")).alias("repeat"))
    scores = pred.agg(
        F.sum(exact("revenue_at_risk", 2)).alias("rar"), F.sum(exact("churn_probability", 6)).alias("p"), F.count("churn_probability").alias("p_n"),
        count_if(F.col("risk_tier") == "High").alias("high"),
        F.sum(F.when(F.col("retention_priority") == VIP, exact("revenue_at_risk", 2))).alias("vip"))
    sums = combine_single_rows([customers, scores])
    return sums.select(*[F.coalesce(c, F.lit(0)).cast("decimal(38,6)").alias(c) for c in sums.columns])


def portfolio_kpis(sums: DataFrame) -> DataFrame:
    """Portfolio KPIs from one row of merged sums: a projection."""
    mean = lambda a, n: F.coalesce(F.col(a).cast("double") / F.nullif(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))
    rev, rar = rnd_double(F.col("revenue"), 2), rnd_double(F.col("rar"), 2)
    return sums.select(
        F.col("customers").cast("long").alias("total_customers"), F.col("orders").cast("long").alias("total_orders"),
        rev.alias("total_revenue"), rnd_double(mean("aov", "aov_n"), 2).alias("avg_order_value"),
        rnd_double(mean("repeat", "customers") * 100.0, 2).alias("repeat_buyer_rate"), rar.alias("portfolio_revenue_at_risk"),
        F.when(rev > 0, rnd_double(rar / rev * 100.0, 2)).otherwise(0.0).alias("portfolio_risk_percentage"),
        rnd_double(mean("p", "p_n"), 4).alias("avg_churn_probability"), F.col("high").cast("long").alias("high_risk_customers_count"),
        rnd_double(mean("high", "customers") * 100.0, 2).alias("high_risk_percentage"),
        rnd_double(F.col("vip"), 2).alias("vip_retention_revenue_at_risk"))


def portfolio_overview(mart: DataFrame, pred: DataFrame) -> DataFrame:
    """Portfolio KPIs: customers and sales from the customer mart, exposure from the score table."""
    return portfolio_kpis(portfolio_sums(mart, pred))


def rar_summary(pred: DataFrame) -> DataFrame:
    s = pred.agg(F.coalesce(F.sum("monetary_value"), F.lit(0.0)).alias("_s"),
                 F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("_r"),
                 F.count(F.lit(1)).alias("total_count"))
    spend, rar = rnd_double(F.col("_s"), 2), rnd_double(F.col("_r"), 2)
    return s.select(spend.alias("total_historical_spend"), rar.alias("total_revenue_at_risk"), "total_count",
                    F.when(spend > 0, rnd_double(rar / spend * 100.0, 2)).otherwise(0.0)
                    .alias("portfolio_risk_percentage"))


def rar_by_tier(pred: DataFrame) -> DataFrame:
    order = F.when(F.col("risk_tier") == "High", 1).when(F.col("risk_tier") == "Medium", 2) \
        .when(F.col("risk_tier") == "Low", 3).otherwise(4)
    return (pred.groupBy("risk_tier")
            .agg(F.count(F.lit(1)).alias("customer_count"),
                 F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("_rar"),
                 F.coalesce(F.avg("churn_probability"), F.lit(0.0)).alias("_p"))
            .withColumn("_n", grand_total("customer_count"))
            .select("risk_tier", "customer_count",
                    rnd_double(F.col("customer_count") / F.col("_n") * 100.0, 2).alias("percentage"),
                    rnd_double(F.col("_rar"), 2).alias("total_revenue_at_risk"),
                    rnd_double(F.col("_p"), 4).alias("avg_churn_probability"))
            .orderBy(order, "risk_tier"))


def rar_by_priority(pred: DataFrame) -> DataFrame:
    return (pred.groupBy("retention_priority")
            .agg(F.count(F.lit(1)).alias("customer_count"),
                 F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)).alias("_rar"))
            .withColumn("_n", grand_total("customer_count"))
            .select("retention_priority", "customer_count",
                    rnd_double(F.col("customer_count") / F.col("_n") * 100.0, 2).alias("percentage"),
                    rnd_double(F.col("_rar"), 2).alias("total_revenue_at_risk"))
            .orderBy(F.desc("total_revenue_at_risk"), "retention_priority"))


def top_at_risk(profile: DataFrame, n: int = 5) -> DataFrame:
    """Top-n High-tier customers by revenue at risk, from the customer profile (mart ⟕ RFM ⟕ scores):
    one scan, a per-partition top-n, then a merge of n rows per partition."""
    return (profile.where(F.col("risk_tier") == "High")
            .orderBy(F.desc("revenue_at_risk"), "customer_unique_id").limit(n)
            .select("customer_unique_id", "city", "state", "zip_prefix", "first_purchased_at",
                    "latest_purchased_at", "recency_days", "customer_lifespan_days", "lifetime_orders",
                    "is_repeat_buyer", "lifetime_spend", "avg_order_value", "segment", "churn_probability",
                    "risk_tier", "revenue_at_risk", "retention_priority"))
