"""Property-based and skew tests for the distributed building blocks."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.intermediate import customer_rollup

PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300))
def test_exact_quantiles_property(spark, xs):
    x = np.array(xs, dtype=float)
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})), "x", PROBS, few=2)
    assert np.allclose(got, np.quantile(x, PROBS), rtol=0, atol=1e-9)


def test_customer_rollup_with_a_hot_customer(spark):
    """One customer holds a third of all orders: the rollup still matches a plain pandas groupby."""
    rng = np.random.default_rng(1)
    n = 3000
    cust = np.where(rng.random(n) < 1 / 3, "HOT", np.char.add("c", rng.integers(0, 200, n).astype(str)))
    base = dt.datetime(2020, 1, 1)
    pdf = pd.DataFrame({
        "order_id": [f"o{i}" for i in range(n)], "customer_id": [f"k{i}" for i in range(n)],
        "customer_unique_id": cust,
        "purchased_at": [base + dt.timedelta(hours=int(h)) for h in rng.integers(0, 20000, n)],
        "estimated_delivery_at": [base] * n,
        "delivered_at": [base + dt.timedelta(seconds=int(s)) for s in rng.integers(-86400 * 5, 86400 * 5, n)],
        "item_count": rng.integers(0, 4, n), "unique_products_count": rng.integers(0, 3, n),
        "unique_sellers_count": rng.integers(0, 2, n),
        "product_revenue": rng.integers(0, 10000, n) / 100, "freight_revenue": rng.integers(0, 1000, n) / 100,
        "reviews_count": rng.integers(0, 2, n), "has_negative_review": rng.random(n) < 0.2,
        "has_positive_review": rng.random(n) < 0.5,
    })
    pdf["total_revenue"] = pdf["product_revenue"] + pdf["freight_revenue"]
    pdf["avg_review_score"] = np.where(pdf["reviews_count"] > 0, rng.integers(1, 6, n), np.nan)
    schema = ("order_id string, customer_id string, customer_unique_id string, purchased_at timestamp_ntz, "
              "estimated_delivery_at timestamp_ntz, delivered_at timestamp_ntz, item_count long, "
              "unique_products_count long, unique_sellers_count long, product_revenue double, "
              "freight_revenue double, reviews_count long, has_negative_review boolean, "
              "has_positive_review boolean, total_revenue double, avg_review_score double")
    sdf = spark.createDataFrame(pdf[[f.split()[0] for f in schema.split(", ")]], schema)
    for c in ["product_revenue", "freight_revenue", "total_revenue"]:
        sdf = sdf.withColumn(c, sdf[c].cast("decimal(14,2)"))
    g = pdf.groupby("customer_unique_id")
    got = customer_rollup(sdf).toPandas().set_index("customer_unique_id").loc[g.size().index]
    assert (got["lifetime_orders"] == g.size()).all()
    assert (got["lifetime_items"] == g["item_count"].sum()).all()
    assert np.allclose(got["lifetime_spend"].astype(float), g["total_revenue"].sum(), atol=0.005)
    late = (pdf["delivered_at"] > pdf["estimated_delivery_at"]).groupby(pdf["customer_unique_id"]).sum()
    assert (got["late_orders_count"] == late.loc[got.index]).all()
    reviewed = pdf[pdf["reviews_count"] > 0].groupby("customer_unique_id")
    assert (got.loc[reviewed.size().index, "_reviewed_orders"] == reviewed.size()).all()
    assert got.loc["HOT", "lifetime_orders"] > n / 4
