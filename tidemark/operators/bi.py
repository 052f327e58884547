"""BI measures of the star schema (fact_orders, dim_customers, customer mart, RFM, churn)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import combine_single_rows, count_if, pct, ratio, rnd, rnd_double

VIP = "Priority 1: Immediate VIP Retention"


def bi_measures(fact: DataFrame, dim: DataFrame, mart: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of headline measures: sales, customers, churn exposure and service quality."""
    sales = fact.agg(rnd_double(F.coalesce(F.sum("total_revenue"), F.lit(0)), 2).alias("gmv"),
                     F.count("order_id").alias("total_orders"),  # order_id is the fact key
                     rnd_double(F.sum("freight_revenue"), 2).alias("total_freight"),
                     count_if(F.col("is_late_delivery")).alias("late_orders"),
                     pct(count_if(F.col("is_late_delivery")), F.count(F.lit(1))).alias("late_delivery_rate"),
                     rnd_double(F.avg("avg_review_score"), 2).alias("avg_review_score"),
                     pct(count_if(F.col("avg_review_score") <= 2), F.count(F.lit(1))).alias("negative_review_share"))
    cust = dim.agg(F.count("customer_unique_id").alias("total_customers"),  # the dimension key
                   count_if(F.col("is_repeat_buyer")).alias("repeat_customers"))
    churn = pred.agg(rnd_double(F.coalesce(F.sum("revenue_at_risk"), F.lit(0.0)), 2).alias("revenue_at_risk"),
                     rnd_double(F.coalesce(F.sum(F.when(F.col("retention_priority") == VIP, F.col("revenue_at_risk"))),
                                           F.lit(0.0)), 2).alias("vip_revenue_at_risk"),
                     count_if(F.col("risk_tier") == "High").alias("high_risk_customers"),
                     rnd_double(F.avg("churn_probability"), 4).alias("avg_churn_probability"))
    return (combine_single_rows([sales, cust, churn])
            .select("gmv", "total_orders",
                    rnd_double(F.col("gmv") / F.nullif(F.col("total_orders").cast("double"), F.lit(0.0)), 2)
                    .alias("avg_order_value"),
                    "total_freight", "total_customers", "repeat_customers",
                    pct(F.col("repeat_customers"), F.col("total_customers")).alias("repeat_rate"),
                    "revenue_at_risk", "vip_revenue_at_risk", "high_risk_customers",
                    pct(F.col("high_risk_customers"), F.col("total_customers")).alias("high_risk_share"),
                    "avg_churn_probability", "late_orders", "late_delivery_rate", "avg_review_score",
                    "negative_review_share"))


def bi_measures_by_state_and_month(fact: DataFrame, dim: DataFrame, pred: DataFrame) -> DataFrame:
    """The measures in total, by customer state, by purchase month and by both (column ``cut`` says which).

    Customers of a cell are those who bought in it, each counted once, with their churn score. Orders are summed by
    customer and month, so that a customer is one row per month; the row of the first month is marked. Every
    cell is then made of sums alone: over all rows where the cell is a month's, over marked rows where it spans
    months. The sums are taken once by state and month and the GROUPING SETS run on that small table; ratios come last.
    """
    month = F.trunc("purchased_at", "month")
    late, review = F.col("is_late_delivery"), F.col("avg_review_score")
    orders = fact.groupBy("customer_unique_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_revenue").alias("gmv"), F.sum("freight_revenue").alias("freight"),
        count_if(late).alias("late"), F.sum(review).alias("stars"), F.count(review).alias("rated"), count_if(review <= 2).alias("bad"))
    scores = pred.select("customer_unique_id", "churn_probability", "risk_tier", "revenue_at_risk", "retention_priority")
    who = dim.select("customer_unique_id", "state", "is_repeat_buyer", F.trunc("first_purchased_at", "month").alias("first"))
    rows = orders.join(who, "customer_unique_id").join(scores, "customer_unique_id", "left")
    first = F.col("month").eqNullSafe(F.col("first"))
    of_customer = {"customers": F.lit(1), "repeat": F.col("is_repeat_buyer").cast("int"), "rar": F.col("revenue_at_risk"),
                   "vip": F.when(F.col("retention_priority") == VIP, F.col("revenue_at_risk")),
                   "high": F.when(F.col("risk_tier") == "High", 1), "p": rnd(F.col("churn_probability"), 4),
                   "scored": F.when(F.col("churn_probability").isNotNull(), 1)}
    sums = ["orders", "gmv", "freight", "late", "stars", "rated", "bad"]
    cells = rows.groupBy("state", "month").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.sum(c).alias(k) for k, c in of_customer.items()],
        *[F.sum(F.when(first, c)).alias(f"first_{k}") for k, c in of_customer.items()])
    spans = F.grouping("month") == 1
    out = cells.groupingSets([[], [F.col("state")], [F.col("month")], [F.col("state"), F.col("month")]], F.col("state"), F.col("month")).agg(
        F.when(spans & (F.grouping("state") == 1), "total").when(spans, "state").when(F.grouping("state") == 1, "month").otherwise("state_month").alias("cut"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.coalesce(F.when(spans, F.sum(f"first_{k}")).otherwise(F.sum(k)), F.lit(0)).alias(k) for k in of_customer])
    money = lambda c: rnd_double(F.coalesce(F.col(c), F.lit(0)), 2)
    return out.select(
        "cut", "state", "month", money("gmv").alias("gmv"), F.col("orders").alias("total_orders"),
        rnd_double(ratio(F.col("gmv"), F.col("orders")), 2).alias("avg_order_value"), money("freight").alias("total_freight"),
        F.col("customers").alias("total_customers"), F.col("repeat").alias("repeat_customers"),
        pct(F.col("repeat"), F.col("customers")).alias("repeat_rate"), money("rar").alias("revenue_at_risk"),
        money("vip").alias("vip_revenue_at_risk"), F.col("high").cast("long").alias("high_risk_customers"),
        pct(F.col("high"), F.col("customers")).alias("high_risk_share"),
        rnd_double(ratio(F.col("p"), F.col("scored")), 4).alias("avg_churn_probability"), F.col("late").alias("late_orders"),
        pct(F.col("late"), F.col("orders")).alias("late_delivery_rate"),
        rnd_double(ratio(F.col("stars"), F.col("rated")), 2).alias("avg_review_score"),
        pct(F.col("bad"), F.col("orders")).alias("negative_review_share"))


def bi_late_by_state(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Late-delivery rate and average delay by customer state; orders are summed by customer before the join."""
    per_customer = fact.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("is_late_delivery")).alias("late"),
        F.sum("delivery_delay_days").alias("days"), F.count("delivery_delay_days").alias("timed"))
    return (per_customer.join(dim.select("customer_unique_id", "state"), "customer_unique_id")
            .groupBy("state")
            .agg(F.sum("n").alias("orders"),
                 pct(F.sum("late"), F.sum("n")).alias("late_delivery_rate"),
                 rnd_double(ratio(F.sum("days"), F.sum("timed")), 2).alias("avg_delivery_delay_days"))
            .orderBy(F.desc("late_delivery_rate"), "state"))
