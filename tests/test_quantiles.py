"""Distributed exact quantiles / ranks / prefix sums against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import (average_pct_rank, cumulative_by_key, exact_quantiles, exact_quantiles_of,
                                          order_statistics)
from tidemark.functions.selection import present, select_ranks

PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@pytest.mark.parametrize("kind", ["continuous", "ties", "heavy_hitter", "tiny"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "continuous":
        x = rng.normal(100, 30, 5000)
    elif kind == "ties":
        x = rng.integers(0, 40, 5000).astype(float)
    elif kind == "heavy_hitter":  # a third of all rows share one value
        x = np.concatenate([np.full(3000, 17.0), rng.uniform(0, 1000, 6000)])
    else:
        x = np.array([3.0, 1.0])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = exact_quantiles(df, "x", PROBS, few=5)  # few rows at the end: several rounds
    assert np.allclose(got, np.quantile(x, PROBS), rtol=0, atol=1e-9)


def test_order_statistics(spark):
    x = np.random.default_rng(3).integers(0, 50, 2000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    ranks = [0, 1, 999, 1000, 1999]
    got = order_statistics(df, "x", ranks, few=3)
    assert [got[r] for r in ranks] == list(np.sort(x)[ranks])


def test_average_pct_rank_matches_pandas(spark):
    x = np.random.default_rng(5).integers(0, 30, 3000)
    pdf = pd.DataFrame({"x": x})
    ranks = average_pct_rank(spark.createDataFrame(pdf), "x", len(x), chunk_rows=4).toPandas()
    expect = pdf.assign(pct=pdf["x"].rank(pct=True)).drop_duplicates("x")
    m = expect.merge(ranks, on="x", suffixes=("_pd", "_sp"))
    assert len(m) == len(expect)
    assert np.allclose(m["pct_pd"], m["pct_sp"])


def test_cumulative_by_key_grouped(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000, p=[0.6, 0.3, 0.1]),
                        "k": rng.integers(0, 500, 4000), "v": rng.integers(1, 5, 4000)})
    got = cumulative_by_key(spark.createDataFrame(pdf), "k", {"v": F.col("v")}, group="g", chunk_rows=17).toPandas()
    exp = pdf.groupby(["g", "k"], as_index=False)["v"].sum().sort_values(["g", "k"])
    exp["v_before"] = exp.groupby("g")["v"].cumsum() - exp["v"]
    m = exp.merge(got, on=["g", "k"], suffixes=("", "_sp"))
    assert len(m) == len(exp)
    assert (m["v_before"] == m["v_before_sp"]).all()


def test_selection_of_many_series_in_forced_rounds(spark):
    """Heavy ties, extreme and infinite values, missing ones, and a series of one row; eight bins and no last pass."""
    rng = np.random.default_rng(13)
    series = {"ties": np.where(rng.random(900) < 0.4, 5.0, rng.integers(0, 9, 900)), "wide": np.r_[10.0 ** rng.integers(-300, 300, 200), -1e308, 1e308],
              "inf": np.r_[np.full(30, -np.inf), rng.normal(size=50), np.full(40, np.inf)], "one": np.array([7.5]),
              "tiny": np.r_[np.full(9, 5e-324), np.zeros(4), np.full(3, 1e-323)]}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("ties", None), ("ties", float("nan")), ("none", None)]
    pairs = present(spark.createDataFrame(rows, "series string, x double"))
    ranks = {k: sorted({0, len(x) // 3, len(x) // 2, len(x) - 1, len(x)}) for k, x in series.items()} | {"none": [0]}
    got = select_ranks(pairs, ranks, few=0, most_bins=8)
    assert got == {(k, r): np.sort(x)[r] for k, x in series.items() for r in ranks[k] if r < len(x)}


def test_quantiles_of_several_columns(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 4, None], "b": [3, 3, 3, 9]})
    got = exact_quantiles_of(spark.createDataFrame(pdf).selectExpr("a", "b", "cast(null as double) as c"), ["a", "b", "c"], [0.0, 0.5, 1.0])
    assert got == {"a": [1.0, 2.0, 4.0], "b": [3.0, 3.0, 9.0], "c": [None, None, None]}
