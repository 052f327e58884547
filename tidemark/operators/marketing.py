"""Acquisition funnel reports over the marketing funnel mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, grand_total, pct, rnd_double
from . import paging


def _won() -> F.Column:
    return F.coalesce(F.col("is_won"), F.lit(False))


def _active() -> F.Column:
    return F.coalesce(F.col("is_active_marketplace_seller"), F.lit(False))


def _money(c: str) -> F.Column:
    return rnd_double(F.coalesce(F.sum(c), F.lit(0)), 2)


def _avg_days() -> F.Column:
    return rnd_double(F.coalesce(F.avg("days_to_close"), F.lit(0.0)), 1)


def funnel_overview(funnel: DataFrame) -> DataFrame:
    """Leads, won, conversion %, days to close, declared vs realised revenue, activation % (zeros when empty)."""
    return funnel.agg(
        F.count(F.lit(1)).alias("total_leads"),
        count_if(_won()).alias("total_closed_deals"),
        pct(count_if(_won()), F.count(F.lit(1))).alias("overall_conversion_rate"),
        _avg_days().alias("avg_days_to_close"),
        _money("declared_monthly_revenue").alias("total_declared_monthly_revenue"),
        _money("actual_marketplace_revenue").alias("total_actual_marketplace_revenue"),
        count_if(_active()).alias("active_marketplace_sellers_count"),
        pct(count_if(_active()), count_if(_won())).alias("seller_activation_rate"))


def channel_attribution(funnel: DataFrame) -> DataFrame:
    return (funnel.groupBy("origin")
            .agg(F.count(F.lit(1)).alias("leads_count"),
                 count_if(_won()).alias("closed_deals_count"),
                 pct(count_if(_won()), F.count(F.lit(1))).alias("conversion_rate"),
                 _avg_days().alias("avg_days_to_close"),
                 _money("declared_monthly_revenue").alias("total_declared_monthly_revenue"),
                 _money("actual_marketplace_revenue").alias("total_actual_marketplace_revenue"))
            .withColumn("_leads", grand_total("leads_count"))
            .withColumn("share_of_leads_percent", pct(F.col("leads_count"), F.col("_leads")))
            .drop("_leads")
            .orderBy(F.desc("closed_deals_count"), F.desc("leads_count"), "origin"))


def velocity_overall(funnel: DataFrame) -> DataFrame:
    return funnel.where(F.col("is_won")).agg(_avg_days().alias("overall_avg_days_to_close"))


def velocity_by_segment(funnel: DataFrame) -> DataFrame:
    """Won deals per business segment; ascending by average days (fastest first)."""
    return (funnel.where(F.col("is_won") & F.col("business_segment").isNotNull())
            .groupBy("business_segment")
            .agg(F.count(F.lit(1)).alias("closed_deals_count"), _avg_days().alias("avg_days_to_close"),
                 F.coalesce(F.min("days_to_close"), F.lit(0)).cast("int").alias("min_days_to_close"),
                 F.coalesce(F.max("days_to_close"), F.lit(0)).cast("int").alias("max_days_to_close"))
            .orderBy("avg_days_to_close", "business_segment"))


def velocity_summary(funnel: DataFrame) -> DataFrame:
    """Overall average plus fastest / slowest segment (ties by name), in two aggregation levels:
    per segment (days summed and counted), then over those few rows."""
    per = (funnel.where(F.col("is_won")).groupBy("business_segment")
           .agg(F.sum("days_to_close").alias("_s"), F.count("days_to_close").alias("_c")))
    seg_avg = rnd_double(F.coalesce(F.col("_s") / F.nullif(F.col("_c"), F.lit(0)), F.lit(0.0)), 1)
    key = F.when(F.col("business_segment").isNotNull(), F.struct(seg_avg.alias("a"), F.col("business_segment")))
    return per.agg(
        rnd_double(F.coalesce(F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0)), F.lit(0.0)), 1)
        .alias("overall_avg_days_to_close"),
        F.min_by("business_segment", key).alias("fastest_segment"),
        F.max_by("business_segment", key).alias("slowest_segment"))


def velocity_by_lead_type(funnel: DataFrame) -> DataFrame:
    return (funnel.where(F.col("is_won") & F.col("lead_type").isNotNull())
            .groupBy("lead_type")
            .agg(F.count(F.lit(1)).alias("closed_deals_count"), _avg_days().alias("avg_days_to_close"))
            .orderBy("avg_days_to_close", "lead_type"))


def segment_performance(funnel: DataFrame) -> DataFrame:
    return (funnel.where(F.col("is_won"))
            .groupBy(F.coalesce("business_segment", F.lit("other")).alias("business_segment"))
            .agg(count_if(_won()).alias("closed_deals_count"),
                 _money("declared_monthly_revenue").alias("total_declared_monthly_revenue"),
                 rnd_double(F.coalesce(F.avg("declared_monthly_revenue"), F.lit(0)), 2).alias("avg_declared_monthly_revenue"),
                 _money("actual_marketplace_revenue").alias("total_actual_marketplace_revenue"),
                 count_if(_active()).alias("active_sellers_count"))
            .orderBy(F.desc("total_actual_marketplace_revenue"), F.desc("closed_deals_count"), "business_segment"))


def lead_list(funnel: DataFrame, page: int = 1, page_size: int = 20, origin: str | None = None,
              is_won: bool | None = None, business_segment: str | None = None) -> DataFrame:
    """Newest first (NULL dates last), then id; page size clamped to 1..100."""
    page_size = min(max(int(page_size), 1), 100)
    f = paging.where_all(funnel, [
        paging.eq("origin", origin.strip().lower() if origin else None),
        None if is_won is None else F.col("is_won") == F.lit(bool(is_won)),
        paging.eq("business_segment", business_segment.strip().lower() if business_segment else None)])
    rows = f.select("mql_id", F.col("first_contact_date").cast("string").alias("first_contact_date"),
                    "landing_page_id", "origin", "is_won", F.col("won_date").cast("string").alias("won_date"),
                    "days_to_close", "seller_id", "business_segment", "lead_type", "declared_monthly_revenue",
                    "is_active_marketplace_seller", "actual_marketplace_revenue", F.col("first_contact_date").alias("_d"))
    return paging.page(rows, "_d", False, "mql_id", page, page_size).drop("_d")
