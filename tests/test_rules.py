"""Scoring rules against the reference's expected values (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules


def _eval(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_frequency_score(spark):
    got = _eval(spark, [(1,), (2,), (3,), (4,), (5,), (10,), (100,)], "o int",
                rules.frequency_score(F.col("o")))
    assert got == [1, 3, 4, 4, 5, 5, 5]


@pytest.mark.parametrize("r,f,m,seg", [
    (5, 1, 5, "Champions"), (4, 1, 4, "Champions"), (4, 3, 4, "Champions"),
    (3, 3, 3, "Loyal Customers"), (5, 1, 3, "Potential Loyalists"),
    (5, 1, 1, "New Customers"), (4, 1, 2, "New Customers"),
    (1, 1, 5, "At Risk"), (2, 1, 4, "At Risk"),
    (1, 1, 1, "Lost / Inactive"), (2, 1, 2, "Lost / Inactive"), (3, 1, 3, "Others"),
])
def test_segment(spark, r, f, m, seg):
    got = _eval(spark, [(r, f, m)], "r int, f int, m int", rules.segment(F.col("r"), F.col("f"), F.col("m")))
    assert got == [seg]


def test_risk_tier(spark):
    ps = [0.70, 0.85, 1.0, 0.30, 0.50, 0.6999, 0.0, 0.15, 0.2999]
    got = _eval(spark, [(p,) for p in ps], "p double", rules.risk_tier(F.col("p")))
    assert got == ["High"] * 3 + ["Medium"] * 3 + ["Low"] * 3


@pytest.mark.parametrize("p,m,prio", [
    (0.75, 4, rules.PRIORITY_VIP), (0.10, 4, rules.PRIORITY_LOYALTY), (0.75, 1, rules.PRIORITY_REENGAGEMENT),
    (0.15, 1, rules.PRIORITY_STANDARD), (0.50, 3, rules.PRIORITY_MEDIUM), (0.50, 5, rules.PRIORITY_MEDIUM),
    (0.15, 3, rules.PRIORITY_MEDIUM),
])
def test_retention_priority(spark, p, m, prio):
    got = _eval(spark, [(p, m)], "p double, m int", rules.retention_priority(F.col("p"), F.col("m")))
    assert got == [prio]


def test_revenue_at_risk(spark):
    rows = [(0.80, 100.0), (0.5, 150.0), (0.3333, 150.0), (0.5, 49.99)]
    got = _eval(spark, rows, "p double, m double", rules.revenue_at_risk(F.col("p"), F.col("m")))
    assert got == [80.0, 75.0, 50.0, 25.0]


def test_estimate_m_score(spark):
    got = _eval(spark, [(400.0,), (399.9,), (200.0,), (100.0,), (50.0,), (49.99,)], "s double",
                rules.estimate_m_score(F.col("s")))
    assert got == [5, 4, 4, 3, 2, 1]


def test_recommended_action_labels(spark):
    rows = [(rules.PRIORITY_VIP, "High"), (rules.PRIORITY_LOYALTY, "Low"), (rules.PRIORITY_REENGAGEMENT, "High"),
            (None, "Medium"), (None, None)]
    default = _eval(spark, rows, "p string, t string", rules.recommended_action(F.col("p"), F.col("t")))
    # scorer labels for priority 2/3 do not match the export's labels: tier text is used
    assert default == [rules.ACTION_VIP, rules.ACTION_DEFAULT, rules.ACTION_HIGH, rules.ACTION_MEDIUM,
                       rules.ACTION_DEFAULT]
    strict = _eval(spark, rows, "p string, t string",
                   rules.recommended_action(F.col("p"), F.col("t"), strict_labels=True))
    assert strict[1] == rules.ACTION_LOYALTY and strict[2] == rules.ACTION_WINBACK
